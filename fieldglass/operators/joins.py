"""Joins that Spark has no operator for, as equi-joins with a residual."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranges import stored


def newest_earlier(rows: DataFrame, key: str, begin: str, end: str, order: str, days: int) -> DataFrame:
    """Each row with the row of the same key that ended last before it began: last_<order> and last_at,
    null if there is none, and earlier_<order>, null also where that was over days before.  One sort by
    key instead of a self join: ended rows and starting rows are put on one time line, and each start
    looks back to the last end."""
    ends = rows.where(F.col(end).isNotNull()).select(F.col(key).alias("_k"), F.col(end).alias("_t"), F.lit(0).alias("_what"), F.col(order).alias("_id"), F.struct(F.col(end).alias("at"), F.col(order).alias("id")).alias("_ended"))
    starts = rows.select(F.col(key).alias("_k"), F.col(begin).alias("_t"), F.lit(1).alias("_what"), F.col(order).alias("_id"), F.lit(None).cast(ends.schema["_ended"].dataType).alias("_ended"))
    line = Window.partitionBy("_k").orderBy("_t", "_what", "_id").rowsBetween(Window.unboundedPreceding, -1)
    seen = ends.unionByName(starts).withColumn("_before", F.last("_ended", ignorenulls=True).over(line)).where("_what = 1 AND _k IS NOT NULL")
    close = F.col("_before.at") >= F.col("_t") - F.expr(f"INTERVAL {days} DAYS")
    return seen.select(F.col("_id").alias(order), F.col("_k").alias(key), F.col("_before.id").alias(f"last_{order}"), F.col("_before.at").alias("last_at"), F.when(close, F.col("_before.id")).alias(f"earlier_{order}"))


def prefix_join(left: DataFrame, right: DataFrame, name: str, full: str, least: int = 4, first: Callable[[Column], Column] | None = None) -> DataFrame:
    """Rows whose right name equals the left one or continues it after a space; names of least letters.
    Joined on a beginning that both must share: the first word, or what first takes of a name."""
    first = first or (lambda c: F.split(c, " ")[0])
    a = left.where(F.length(name) >= least).withColumn("_w", first(F.col(name)))
    b = right.withColumn("_w", first(F.col(full)))
    whole = (F.col(full) == F.col(name)) | F.startswith(F.col(full), F.concat(F.col(name), F.lit(" ")))
    return a.join(b, "_w").where(whole).drop("_w")


def first_found(df: DataFrame, levels: list[tuple[DataFrame, list[str], str]], out: str, default: Column) -> DataFrame:
    """Fallback lookups: the value of the first level that has the row's key, else the default.
    levels: (table, key columns, value column), each with one row a key."""
    values = []
    for i, (table, keys, value) in enumerate(levels):
        side = table.select(*(F.col(k).alias(f"_k{i}{k}") for k in keys), F.col(value).alias(f"_v{i}"))
        df = df.join(side, reduce(lambda a, b: a & b, (F.col(k) == F.col(f"_k{i}{k}") for k in keys)), "left").drop(*(f"_k{i}{k}" for k in keys))
        values.append(F.col(f"_v{i}"))
    return df.withColumn(out, F.coalesce(*values, default)).drop(*(f"_v{i}" for i in range(len(levels))))


def chain(rows: DataFrame, key: str, parent: str, most: int = 20) -> DataFrame:
    """(key, ancestor, depth) of up to ``most`` steps along parent, by doubling: paths of up to m steps,
    carried on from where they end after m, are those of up to 2 m.  Each round is stored, and a round
    without a path of m steps is the last."""
    reach, out = 1, stored(rows.where(F.col(parent).isNotNull()).select(F.col(key).alias("k"), F.col(parent).alias("ancestor"), F.lit(1).alias("depth")))
    while reach < most:
        jump = out.where(F.col("depth") == reach).select("k", F.col("ancestor").alias("via"))
        if jump.isEmpty():
            break
        further = jump.join(out.select(F.col("k").alias("via"), "ancestor", "depth"), "via").select("k", "ancestor", (F.col("depth") + reach).alias("depth"))
        out, reach = stored(out.unionByName(further.where(F.col("depth") <= most))), 2 * reach
    return out.select(F.col("k").alias(key), "ancestor", "depth")
