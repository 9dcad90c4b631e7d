"""Default views with reasons for what they hide, counts and facets in one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_reason(rules: list[tuple[str, Column]]) -> Column:
    """The name of the first rule that holds; null if none does."""
    out = F.lit(None).cast("string")
    for name, rule in reversed(rules):
        out = F.when(rule, F.lit(name)).otherwise(out)
    return out


def with_view(df: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    """Stamps suppression_reason and in_default_view."""
    out = df.withColumn("suppression_reason", first_reason(rules))
    return out.withColumn("in_default_view", F.col("suppression_reason").isNull())


def view_counts(df: DataFrame) -> DataFrame:
    """master_total, view_total and suppressed in one aggregate."""
    shown = F.count_if("in_default_view")
    return df.agg(F.count("*").alias("master_total"), shown.alias("view_total"), (F.count("*") - shown).alias("suppressed"))


def facets(df: DataFrame, columns: dict[str, Column], top: int) -> DataFrame:
    """facet, value, n: the most frequent values of each expression, nulls left out, ties by value.
    Rows are first counted by all facets together, so only their combinations are taken apart."""
    together = df.select(*(c.cast("string").alias(name) for name, c in columns.items())).groupBy(*columns).agg(F.count("*").alias("_rows"))
    pairs = F.array(*(F.struct(F.lit(name).alias("facet"), F.col(name).alias("value")) for name in columns))
    counts = together.select(F.explode(pairs).alias("f"), "_rows").select("f.*", "_rows").where("value IS NOT NULL").groupBy("facet", "value").agg(F.sum("_rows").alias("n"))
    rank = F.row_number().over(Window.partitionBy("facet").orderBy(F.desc("n"), "value"))
    return counts.withColumn("_r", rank).where(F.col("_r") <= top).drop("_r")


#: Rows of a page.
MOST = 1000


def page(df: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """A page of at most MOST rows; a larger one is refused."""
    if not 0 < limit <= MOST or offset < 0:
        raise ValueError(f"a page has 1 to {MOST} rows and no negative offset")
    return df.orderBy(*order).offset(offset).limit(limit)
