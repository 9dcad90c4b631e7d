"""Text, URL and date expressions; all of them stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """body(value), with value computed once however often body uses it: as the element of an array of one."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def squashed(text: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def slug(text: Column) -> Column:
    """Lower case, everything but a-z and 0-9 as single hyphens, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def title_key(text: Column) -> Column:
    """Lower case, & as and, punctuation but + # . as space, squashed."""
    return squashed(F.regexp_replace(F.lower(F.regexp_replace(text, "&", " and ")), r"[^\w+#.]+", " "))


def tokens(text: Column, stop: list[str] = (), least: int = 1) -> Column:
    """Distinct lower-case words of at least least letters that are no stop words."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), 0))
    words = F.array_except(words, F.array(*(F.lit(s) for s in stop)).cast("array<string>"))
    return F.filter(words, lambda w: F.length(w) >= least)


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays of distinct items; 0 where both are empty."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b)).cast("double")), F.lit(0.0))


def overlap(a: Column, b: Column) -> Column:
    """Shared items as a part of the smaller array; null where one is empty."""
    return F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.least(F.size(a), F.size(b)).cast("double"))


def url_identity(url: Column, tracking: str = "utm_[a-z]+|gclid|fbclid|ref|source") -> Column:
    """host/path?query with lower-case host without www, sorted query without tracking, no slash at the end."""
    host = F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("HOST"))), r"^www\.", "")
    path = F.regexp_replace(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")), "/+$", "")
    pairs = F.filter(F.split(F.coalesce(F.try_parse_url(url, F.lit("QUERY")), F.lit("")), "&"), lambda p: (p != "") & ~F.rlike(F.lower(p), F.lit(f"^({tracking})(=|$)")))
    return F.concat(host, path, F.when(F.size(pairs) > 0, F.concat(F.lit("?"), F.array_join(F.array_sort(pairs), "&"))).otherwise(""))


def tidy_url(url: Column) -> Column:
    """Without tracking parameters, and without ?, & or a slash at the end; empty for null."""
    bare = F.regexp_replace(F.trim(F.coalesce(url, F.lit(""))), r"[?&](utm_[a-z]+|ref|source|src|gh_src|lever-source(?:%5B%5D|\[\])?)=[^&#]*", "")
    return F.regexp_replace(F.regexp_replace(bare, "[?&]+$", ""), "/+$", "")


def first_rule(text: Column, rules: list[tuple[str, str]], default: str | None = None) -> Column:
    """Label of the first pattern found, ignoring case."""
    out = F.lit(default).cast("string")
    for pattern, label in reversed(rules):
        out = F.when(F.rlike(text, F.lit(f"(?i){pattern}")), F.lit(label)).otherwise(out)
    return out


def every_rule(text: Column, rules: list[tuple[str, str]]) -> Column:
    """Labels of all patterns found, in the order of the rules."""
    return F.array_compact(F.array(*(F.when(F.rlike(text, F.lit(f"(?i){p}")), F.lit(label)) for p, label in rules)))


def annual(amount: Column, interval: Column) -> Column:
    """Yearly amount of an hourly (2080 hours) or monthly (12) one."""
    return F.when(interval == "hour", amount * 2080).when(interval == "month", amount * 12).otherwise(amount)


def days_between(later: Column, earlier: Column) -> Column:
    """Fractional days."""
    return (F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))) / F.lit(86_400_000_000.0)


def business_days_after(day: Column, n: int) -> Column:
    """The n-th day from Monday to Friday after a day."""
    days = F.sequence(F.date_add(day, 1), F.date_add(day, 2 * n + 3))
    return F.get(F.filter(days, lambda d: F.weekday(d) < 5), F.lit(n - 1))


def moment(text: Column) -> Column:
    """A timestamp from ISO text, a plain date, or epoch seconds or milliseconds; null if none fits."""
    number = F.when(F.rlike(text, F.lit(r"^[0-9]{10,13}$")), text.cast("bigint"))
    epoch = F.timestamp_micros(F.when(number > 10**12, number * 1000).otherwise(number * 1_000_000))
    return F.coalesce(epoch, F.try_to_timestamp(text), F.try_to_timestamp(text, F.lit("MMM d, yyyy")))


def overlap_of_ranges(lo_a: Column, hi_a: Column, lo_b: Column, hi_b: Column) -> Column:
    """Length shared by two ranges over the length of both together; 0 where that is 0."""
    shared = F.greatest(F.lit(0.0), F.least(hi_a, hi_b) - F.greatest(lo_a, lo_b))
    return F.coalesce(F.try_divide(shared, F.greatest(hi_a, hi_b) - F.least(lo_a, lo_b)), F.lit(0.0))
