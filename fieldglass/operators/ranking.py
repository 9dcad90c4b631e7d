"""Ranks, caps and islands."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranges import placed


def global_rank(df: DataFrame, order: list[Column], out: str = "rank") -> DataFrame:
    """1..n over the whole table without gathering it in one task.  order must be total for the ranks
    to be the same in every run."""
    return placed(df, [], order, "_place").withColumn(out, F.col("_place") + 1).drop("_place", "_n")


def capped(df: DataFrame, group: list[str], order: list[Column], counts: Column, cap: int, out: str = "within_cap") -> DataFrame:
    """True for the first cap rows of a group that count, null for those that do not count."""
    running = F.sum(F.when(counts, 1).otherwise(0)).over(Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return df.withColumn(out, F.when(counts, running <= cap))


def top_of_each(df: DataFrame, group: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group, with their place and how many more the group has.  Places are
    limited before the shuffle (Spark pushes the limit on row_number down), sizes come from a partial
    aggregate, so a large group costs its task k rows of each partition."""
    first = df.withColumn("place", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("place") <= k).alias("a")
    sizes = df.groupBy(*group).agg(F.count("*").alias("_size")).alias("b")
    same = reduce(lambda a, b: a & b, (F.col(f"a.{g}").eqNullSafe(F.col(f"b.{g}")) for g in group))
    return first.join(sizes, same).select("a.*", F.greatest(F.col("_size") - k, F.lit(0)).alias("more"))


def round_robin(df: DataFrame, group: str, order: list[Column], limit: int) -> DataFrame:
    """One row of each group in turn, groups by name, at most limit rows."""
    turn = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return df.withColumn("turn", turn).orderBy("turn", group).limit(limit)


def streaks(df: DataFrame, key: str, order: list[str], breaks: Column, out: str = "streak") -> DataFrame:
    """Rows since the last one that breaks the streak, within each key; 0 where one breaks it."""
    line = Window.partitionBy(key).orderBy(*order)
    island = F.sum(breaks.cast("int")).over(line.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    marked = df.withColumn("_broken", breaks).withColumn("_island", island)
    inside = Window.partitionBy(key, "_island").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return marked.withColumn(out, F.sum((~F.col("_broken")).cast("int")).over(inside)).drop("_broken", "_island")


def carried(df: DataFrame, key: str, order: list[str], column: str) -> DataFrame:
    """Nulls filled with the last value before them within a key."""
    line = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(column, F.last(column, ignorenulls=True).over(line))


def latest(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in this order."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_r = 1").drop("_r")


def kept_snapshots(df: DataFrame, at: str, daily: int = 7, weekly: int = 4) -> DataFrame:
    """The newest snapshot of each of the last days and of each of the last weeks (from Monday)."""
    newest_of = lambda by: F.row_number().over(Window.partitionBy(by).orderBy(F.desc(at)))
    df = df.withColumn("_day", F.to_date(at)).withColumn("_week", F.to_date(F.date_trunc("week", at)))
    df = df.withColumn("_d", newest_of("_day")).withColumn("_w", newest_of("_week"))
    days = df.where("_d = 1").orderBy(F.desc("_day")).limit(daily).drop("_d", "_w", "_day", "_week")
    weeks = df.where("_w = 1").orderBy(F.desc("_week")).limit(weekly).drop("_d", "_w", "_day", "_week")
    return days.union(weeks).distinct()
