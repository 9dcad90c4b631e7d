"""Recomputing only what a change reaches.

Derived columns are declared with the columns and the settings they need, so what depends on what is known
before anything runs.  An action on some rows recomputes those rows alone, found by their keys; a
changed setting recomputes only the columns it reaches, for all rows, from only the columns they need.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keys that are written into the plan, so that the scan skips row groups without them; more are joined.
IN_PLAN = 10_000


@dataclass(frozen=True)
class Derived:
    """needs: columns of the rows or derived before; settings: names of what ``make`` takes from the settings."""

    name: str
    make: Callable[[dict], Column]
    needs: tuple[str, ...]
    settings: tuple[str, ...] = ()


class Scores:
    def __init__(self, *derived: Derived):
        known: set[str] = set()
        for d in derived:
            if d.name in known or d.name in d.needs:
                raise ValueError(f"{d.name} is declared twice or needs itself")
            known.add(d.name)
        for i, d in enumerate(derived):
            if late := {x.name for x in derived[i:]} & set(d.needs):
                raise ValueError(f"{d.name} needs {', '.join(sorted(late))}, declared later")
        self.derived = derived
        self.names = [d.name for d in derived]

    def reached(self, columns: set[str] = frozenset(), settings: set[str] = frozenset()) -> list[str]:
        """The derived columns that a change of these columns and settings reaches, directly or through others."""
        out: list[str] = []
        for d in self.derived:
            if {*columns, *out} & set(d.needs) or set(settings) & set(d.settings):
                out.append(d.name)
        return out

    def read(self, names: list[str]) -> list[str]:
        """The columns that computing these needs, beside what is computed with them."""
        return sorted({c for d in self.derived if d.name in names for c in d.needs} - set(names))

    def computed(self, rows: DataFrame, settings: dict, names: list[str] | None = None) -> DataFrame:
        """rows with these derived columns (None: all) computed anew, each from those before it."""
        for d in self.derived:
            if names is None or d.name in names:
                rows = rows.withColumn(d.name, d.make({k: settings[k] for k in d.settings}))
        return rows

    def after_action(self, rows: DataFrame, key: str, changes: DataFrame, settings: dict) -> DataFrame:
        """(key, changed columns, reached columns) of the rows that changes (key and new values) names, and no others.
        Keys that rows does not have are left out; of changes that repeat a key the least row counts."""
        columns = [c for c in changes.columns if c != key]
        once = changes.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(*columns)).alias("_new"))
        names = self.reached(set(columns))
        few = [r[0] for r in once.select(key).limit(IN_PLAN + 1).collect()]
        own = rows.select(key, *(c for c in self.read(names) if c not in (key, *columns)))
        if len(few) <= IN_PLAN:
            own = own.where(F.col(key).isin(few))
        both = own.join(once, key).select(*own.columns, *(F.col(f"_new.{c}").alias(c) for c in columns))
        return self.computed(both, settings, names).select(key, *columns, *names)

    def after_settings(self, rows: DataFrame, key: str, old: dict, new: dict) -> DataFrame:
        """(key, reached columns) of all rows, by the settings that differ; no column is read that they do not need."""
        names = self.reached(settings={k for k in {*old, *new} if old.get(k) != new.get(k)})
        return self.computed(rows.select(key, *(c for c in self.read(names) if c != key)), new, names).select(key, *names)


def patched(rows: DataFrame, key: str, new: DataFrame) -> DataFrame:
    """rows with the columns of new where it has their key."""
    columns = [c for c in new.columns if c != key]
    both = rows.join(new.select(key, F.struct(*columns).alias("_new")), key, "left") if columns else rows
    return both.select(*(F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in rows.columns))
