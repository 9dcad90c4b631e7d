"""Typed conditions on fields, as Columns.

A field has a kind, and the kind decides how a comparison treats nulls and case:

number  any of = != < <= > >=; null never matches, not even !=
bool    = and !=; null matches neither unless the field's expression fills it
enum    = ignores case; != also takes nulls; ~ is contains
text    ~ is contains ignoring case; = equality ignoring case; != is "does not contain", with nulls
date    the six comparisons on the day alone
tags    = and ~ are membership ignoring case; != negates it, null counting as no tags
"""

from __future__ import annotations

import operator
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

KINDS = ("number", "bool", "enum", "text", "date", "tags")
COMPARE = {"=": operator.eq, "!=": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}


class FieldError(ValueError):
    """An unknown field, or a comparison its kind does not have."""


@dataclass(frozen=True)
class Field:
    expr: Column
    kind: str


def literal(value):
    """100k is 100000, yes/on/true and no/off/false are booleans, null and none are None."""
    if not isinstance(value, str):
        return value
    word = value.strip().lower()
    if word in ("true", "yes", "on"):
        return True
    if word in ("false", "no", "off"):
        return False
    if word in ("null", "none"):
        return None
    try:
        return float(word[:-1]) * 1000 if word.endswith("k") else float(word)
    except ValueError:
        return value


class Fields:
    """A registry of fields by name, with other names for them and for their values."""

    def __init__(self, fields: dict[str, Field], aliases: dict[str, str] | None = None, shorthands: dict[str, dict[str, str]] | None = None):
        self.fields, self.aliases, self.shorthands = fields, aliases or {}, shorthands or {}

    def __getitem__(self, name: str) -> Field:
        name = self.aliases.get(name, name)
        if name not in self.fields:
            raise FieldError(f"unknown field {name!r}; known: {', '.join(sorted(self.fields))}")
        return self.fields[name]

    def where(self, name: str, op: str, value) -> Column:
        """The condition ``name op value``."""
        field = self[name]
        value = self.shorthands.get(self.aliases.get(name, name), {}).get(value, value)
        if op == ":":
            op = "~" if field.kind == "text" else "="
        if literal(value) is None:
            if op not in ("=", "!="):
                raise FieldError(f"null has no {op}")
            return field.expr.isNull() if op == "=" else field.expr.isNotNull()
        return getattr(self, f"_{field.kind}")(field.expr, op, value, name)

    def _bad(self, name, op, value):
        raise FieldError(f"{name} has no {op} {value!r}")

    def _number(self, c, op, value, name):
        value = literal(value)
        if op not in COMPARE or isinstance(value, (bool, str)):
            self._bad(name, op, value)
        return COMPARE[op](c, F.lit(value))

    def _bool(self, c, op, value, name):
        value = literal(value)
        if op not in ("=", "!=") or value not in (True, False):
            self._bad(name, op, value)
        return COMPARE[op](c.cast("boolean"), F.lit(bool(value)))

    def _enum(self, c, op, value, name):
        value = F.lit(str(value).lower())
        if op == "=":
            return F.lower(c) == value
        if op == "!=":
            return F.coalesce(F.lower(c), F.lit("")) != value
        return F.contains(F.lower(c), value) if op == "~" else self._bad(name, op, value)

    def _text(self, c, op, value, name):
        value = F.lit(str(value).lower())
        if op == "~":
            return F.contains(F.lower(c), value)
        if op == "!=":
            return ~F.contains(F.coalesce(F.lower(c), F.lit("")), value)
        return F.lower(c) == value if op == "=" else self._bad(name, op, value)

    def _date(self, c, op, value, name):
        if op not in COMPARE:
            self._bad(name, op, value)
        return COMPARE[op](F.to_date(c), F.lit(str(value)[:10]).cast("date"))

    def _tags(self, c, op, value, name):
        has = F.array_contains(F.transform(F.coalesce(c, F.array()), F.lower), str(value).lower())
        if op in ("=", "~"):
            return has
        return ~has if op == "!=" else self._bad(name, op, value)


def all_of(*conditions: Column) -> Column:
    return reduce(operator.and_, conditions, F.lit(True))


def any_of(*conditions: Column) -> Column:
    return reduce(operator.or_, conditions, F.lit(False))


def negate(condition: Column) -> Column:
    """NOT, in three-valued logic."""
    return ~condition


def words_of(text: Column) -> Column:
    """Lower-cased tokens of letters, digits, _, + # and dots."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\w+#.]+"), 0)


def mentions(text: Column, said: str) -> Column:
    """All words of ``said`` are among the text's; without words nothing matches."""
    import re

    words = re.findall(r"[\w+#.]+", said.lower())
    return all_of(*(F.array_contains(words_of(text), w) for w in words)) if words else F.lit(False)
