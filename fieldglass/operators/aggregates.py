"""Aggregates with the pipeline's rules for samples, order and missing values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranges import placed


#: Values of a group that may be sorted in one row.
SMALL = 50_000


def at_places(df: DataFrame, keys: list[str], value: str, least: int, places: dict[str, Column], small: int = SMALL) -> DataFrame:
    """keys, the values at the given places (of _n) in the sorted group, and n, where n is at least
    least; nulls do not count.  Groups are counted first: those of at most small values are sorted in
    a row each, larger ones found by place, so that no task holds one; both give the same."""
    rows = df.where(F.col(value).isNotNull()).select(*keys, value)
    large = rows.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > small).select(*(F.col(k).alias(f"_{k}") for k in keys))
    none = large.isEmpty()
    of_large = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    few = rows if none else rows.join(large, of_large, "left_anti")
    listed = few.groupBy(*keys).agg(F.sort_array(F.collect_list(value)).alias("_v")).withColumn("_n", F.size("_v").cast("long")).where(F.col("_n") >= least)
    found = listed.select(*keys, *(F.get("_v", at.cast("int")).alias(name) for name, at in places.items()), F.col("_n").alias("n"))
    if none:
        return found
    ranked = placed(rows.join(large, of_large, "left_semi"), keys, [F.col(value)]).where(F.col("_n") >= least)
    picks = (F.max(F.when(F.col("_i") == at, F.col(value))).alias(name) for name, at in places.items())
    return found.unionByName(ranked.groupBy(*keys).agg(*picks, F.max("_n").alias("n")))


def medians(df: DataFrame, levels: list[list[str]], value: str, least: int) -> list[DataFrame]:
    """One table a level: keys, exact median and n, where n is at least least."""
    out = []
    for keys in levels:
        middle = at_places(df, keys, value, least, {"_low": F.floor((F.col("_n") - 1) / 2), "_high": F.floor(F.col("_n") / 2)})
        out.append(middle.select(*keys, ((F.col("_low") + F.col("_high")) / 2).alias("median"), "n"))
    return out


def index_quartiles(df: DataFrame, keys: list[str], value: str, least: int = 3) -> DataFrame:
    """The elements at n/4, n/2 and 3n/4 of the sorted values (from 0, no interpolation)."""
    return at_places(df, keys, value, least, {f"q{k}": F.floor(F.col("_n") * k / 4) for k in (1, 2, 3)})


def moving_average(df: DataFrame, keys: list[str], order: list[Column], value: str, out: str, keep: float = 0.7) -> DataFrame:
    """keep * old + (1 - keep) * new over the rows of a key in order, begun by the first value, as the
    sum of the values times what each still weighs at the end: a partial aggregate, no group in one row.
    Nulls do not count."""
    row = placed(df.where(F.col(value).isNotNull()), keys, order)
    weight = F.pow(F.lit(keep), F.col("_n") - 1 - F.col("_i")) * F.when(F.col("_i") == 0, F.lit(1.0)).otherwise(F.lit(round(1 - keep, 12)))
    return row.groupBy(*keys).agg(F.sum(F.col(value) * weight).alias(out))


def rate(part: Column, whole: Column) -> Column:
    """part / whole, null where there is no whole."""
    return F.try_divide(part.cast("double"), whole.cast("double"))


def accumulated(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Counters added up, the first known url kept, first and last sighting widened.
    Both: key, seen_count, url, first_seen, last_seen."""
    both = old.withColumn("_age", F.lit(0)).unionByName(new.withColumn("_age", F.lit(1)))
    return both.groupBy(*key).agg(F.sum("seen_count").alias("seen_count"), F.min_by("url", F.when(F.col("url").isNotNull(), F.struct("_age", "first_seen", "url"))).alias("url"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))


def week_label(at: Column) -> Column:
    """Year and week with weeks from Monday and days before the first Monday in week 00."""
    day, year = F.dayofyear(at), F.year(at)
    monday_based = F.weekday(at)  # Monday is 0
    week = F.floor((day + 6 - monday_based) / 7)
    return F.format_string("%04d-W%02d", year, week.cast("int"))
