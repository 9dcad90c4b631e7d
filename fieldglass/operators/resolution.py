"""Which rows are the same thing: shared keys, blocked pairs, pair scores, constrained merging."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions.text import jaccard
from .ranges import stored as cut

# Fixed values of the pair score.
SAME, TITLE_WORDS, TITLE_ORDER = 0.80, 0.6, 0.4
AGES = [(300, -0.4), (90, -0.25), (45, -0.12)]


def linked(rows: DataFrame, row_id: str, keys: list[str]) -> DataFrame:
    """(id, cluster): rows that share a key, directly or through others, with the least id of all.
    Null keys link nothing.  A key's rows are pre-aggregated to its least label, so a key that a
    third of the rows share costs one joined row for each of them, never pairs."""
    member = rows.select(F.col(row_id).alias("id"), F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.col(k).cast("string").alias("v")) for i, k in enumerate(keys)))).alias("key"))
    member = cut(member.where("id IS NOT NULL AND key.v IS NOT NULL").select("id", F.xxhash64("key").alias("h"), "key").distinct())
    labels = cut(rows.where(F.col(row_id).isNotNull()).select(F.col(row_id).alias("id"), F.col(row_id).alias("cluster")).distinct())
    while True:
        least = member.join(labels, "id").groupBy("h", "key").agg(F.min("cluster").alias("m"))
        near = member.join(least, ["h", "key"]).groupBy("id").agg(F.min("m").alias("m"))
        lower = labels.join(near, "id", "left").select("id", F.col("cluster").alias("was"), F.least("cluster", "m").alias("cluster"))
        above = lower.select(F.col("id").alias("cluster"), F.col("cluster").alias("up"))
        step = cut(lower.join(above, "cluster").select("id", "was", F.least("cluster", "up").alias("cluster")))
        labels = step.select("id", "cluster")
        if step.where("was <> cluster").isEmpty():
            return labels


def blocked_pairs(rows: DataFrame, row_id: str, block: list[str], words: str, least: float) -> tuple[DataFrame, DataFrame]:
    """Pairs (ka, kb, similarity) of a block whose distinct words have a Jaccard similarity of at
    least ``least`` (above 0), and the rows (id, k) they stand for: rows of a block with the same
    words have the least id of them as k.  Joined on the rarest words only: two such sets share a
    word among their first n - ceil(least * n) + 1 in order of frequency."""
    sets = rows.select(F.col(row_id).alias("id"), F.xxhash64(*block).alias("_blk"), F.struct(*block).alias("_b"), F.array_sort(F.col(words)).alias("w")).where(F.size("w") > 0)
    kinds = cut(sets.groupBy("_blk", "_b", "w").agg(F.min("id").alias("k")))
    often = sets.select("_blk", F.explode("w").alias("word")).groupBy("_blk", "word").count()
    ranked = kinds.select("_blk", "k", F.size("w").alias("n"), F.explode("w").alias("word")).join(often, ["_blk", "word"])
    place = F.row_number().over(Window.partitionBy("_blk", "k").orderBy("count", "word"))
    prefix = cut(ranked.withColumn("p", place).where(F.col("p") <= F.col("n") - F.ceil(F.col("n") * F.lit(least) - 1e-9) + 1).select("_blk", "k", "word", "n"))
    a, b = (prefix.toDF("_blk", f"k{s}", "word", f"n{s}") for s in "ab")
    close = (F.col("na") * least <= F.col("nb") + 1e-9) & (F.col("nb") * least <= F.col("na") + 1e-9)
    near = a.join(b, ["_blk", "word"]).where((F.col("ka") < F.col("kb")) & close).select("ka", "kb").distinct()
    for s in "ab":
        near = near.join(kinds.select(F.col("k").alias(f"k{s}"), F.col("w").alias(f"w{s}"), F.col("_b").alias(f"b{s}")), f"k{s}")
    near = near.where(F.col("ba").eqNullSafe(F.col("bb"))).select("ka", "kb", jaccard(F.col("wa"), F.col("wb")).alias("similarity")).where(F.col("similarity") >= least)
    return near, sets.join(kinds, ["_blk", "_b", "w"]).select("id", "k")


@F.pandas_udf(DoubleType())
def order_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Share of characters in common runs, in order; 0 where a side is null."""
    return pd.Series([SequenceMatcher(None, x, y).ratio() if x and y else 0.0 for x, y in zip(a, b)], dtype=float)


def order_ratio_bound(a: Column, b: Column) -> Column:
    """No order_ratio is above this: every character of the shorter side in a common run."""
    shorter, both = F.least(F.length(a), F.length(b)), F.length(a) + F.length(b)
    return F.coalesce(F.try_divide(2.0 * shorter, both.cast("double")), F.lit(0.0))


def pair_score(title: Column, described: Column, pay: Column, days: Column, levels_differ: Column, same_board: Column) -> Column:
    """Evidence on a pair, from 0 to 1.  Null described, pay or days say nothing."""
    score = F.when(described.isNotNull(), title * 0.6 + described * 0.4).otherwise(title)
    score = F.when(pay.isNotNull(), score * 0.85 + pay * 0.15).otherwise(score)
    age = F.when(days <= 14, F.lit(0.03))
    for above, change in reversed(AGES):
        age = F.when(days > above, F.lit(change)).otherwise(age)
    score = score + F.coalesce(age, F.lit(0.0)) - F.when(levels_differ, 0.3).otherwise(0.0) - F.when(same_board, 0.5).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))


def merged_in_order(pairs: pd.DataFrame, names: pd.DataFrame) -> pd.DataFrame:
    """Whole connected parts, merged pair by pair: pairs a, b, score; names id, s, n."""
    up, held = {}, {}
    for i, s, n in zip(names["id"], names["s"], names["n"]):
        held.setdefault(i, {}).setdefault(s, n)

    def root(x):
        while (y := up.setdefault(x, x)) != x:
            up[x] = x = up[y]
        return x

    # a row with two names of one space can merge with nothing that has a name there
    for i, s, n in zip(names["id"], names["s"], names["n"]):
        if held[i][s] != n:
            held[i][s] = object()
    for a, b, _ in pairs.sort_values(["score", "a", "b"], ascending=[False, True, True])[["a", "b", "score"]].itertuples(index=False):
        x, y = sorted((root(a), root(b)))
        of_x, of_y = held.get(x, {}), held.get(y, {})
        if x != y and not any(s in of_x and of_x[s] != n for s, n in of_y.items()):
            up[y] = x
            held[x] = {**of_x, **of_y}
    ids = list(up)
    return pd.DataFrame({"id": ids, "cluster": [root(i) for i in ids]})


def least_of_each(edges: list[tuple]) -> dict:
    """Each vertex of these edges with the least that it reaches."""
    up: dict = {}

    def root(x):
        while (y := up.setdefault(x, x)) != x:
            up[x] = x = up[y]
        return x

    for x, y in edges:
        x, y = root(x), root(y)
        if x != y:
            up[max(x, y)] = min(x, y)
    return {x: root(x) for x in list(up)}


#: Edges that one task contracts at a time, and pairs of connected parts that one task merges.
HELD, ONE_TASK = 500_000, 20_000


def contracted(edges: DataFrame) -> DataFrame:
    """Edges (a, b) to the least vertex that each reaches over the edges of its task, HELD of them at a time."""
    kind = edges.schema["a"].dataType

    def run(batches):
        held: list[tuple] = []
        for batch in batches:
            held += zip(batch["a"].to_pylist(), batch["b"].to_pylist())
            if len(held) > HELD:
                yield told(held)
                held = []
        yield told(held)

    def told(held):
        a, b = (list(x) for x in zip(*least_of_each(held).items())) if held else ([], [])
        return pa.RecordBatch.from_arrays([pa.array(a, like), pa.array(b, like)], names=["a", "b"])

    like = to_arrow_type(kind)
    return edges.select("a", "b").mapInArrow(run, StructType([StructField("a", kind), StructField("b", kind)]))


def connected(edges: DataFrame) -> DataFrame:
    """(id, cluster): the least vertex that each vertex of edges (a, b) reaches.  Each task contracts its own
    edges first; what is left goes to one task if it is no more than HELD edges, else through ``linked``."""
    left = cut(contracted(edges))
    if left.count() <= HELD:
        return cut(contracted(left.coalesce(1)).toDF("id", "cluster"))
    return linked(left.select(F.explode(F.array("a", "b")).alias("id"), F.concat_ws(" ", "a", "b").alias("pair")), "id", ["pair"])


def merged_best_first(rows: DataFrame, pairs: DataFrame, row_id: str, space: str, name: str, least: float = SAME, one_task: int = ONE_TASK) -> DataFrame:
    """(id, cluster) as by merging pairs (a, b, score) in order of score, then a, then b, unless the
    cluster would hold two names of one space; cluster is its least id.  Null spaces hinder nothing.

    Connected parts of at most one_task pairs are merged in order, about one_task pairs of whole parts
    to a task: parts have nothing to do with each other, so a task's order is that of each.  Of larger
    parts those without two names of a space anywhere merge at once, in any order.  The rest goes in
    rounds: each drops pairs that can never merge any more and merges the pairs that are best
    for both their clusters: no pair that comes earlier touches either of them, so the outcome is that
    of the sequential order.  Rounds grow with the longest run of pairs at one cluster that must wait
    for each other, at most the largest such connected part."""
    alone = rows.select(F.col(row_id).alias("id")).where("id IS NOT NULL").distinct()
    names = rows.where(F.col(space).isNotNull() & F.col(name).isNotNull()).select(F.col(row_id).alias("id"), F.col(space).alias("s"), F.col(name).alias("n"))
    good = cut(pairs.where(F.col("score") >= least).select("a", "b", "score"))
    total = good.count()
    parts = connected(good)
    of_part = good.join(parts.select(F.col("id").alias("a"), "cluster"), "a")
    large = of_part.groupBy("cluster").count().where(F.col("count") > one_task).select("cluster") if total > one_task else None
    large = None if large is None or (large := cut(large)).isEmpty() else large
    tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // max(1, one_task) + 1)

    def by_task(df):
        df = df if large is None else df.join(large, "cluster", "left_anti")
        return df.toDF(*df.columns).withColumn("_task", F.pmod(F.xxhash64("cluster"), F.lit(tasks))).drop("cluster").groupBy("_task")

    named = names.join(parts, "id")
    merged = by_task(of_part).cogroup(by_task(named)).applyInPandas(merged_in_order, parts.schema)
    if large is None:
        return cut(alone.join(merged, "id", "left").select("id", F.coalesce("cluster", "id").alias("cluster")))
    clashing = named.join(large, "cluster").groupBy("cluster", "s").agg((F.min("n") != F.max("n")).alias("two")).where("two").select("cluster").distinct()
    clashing = cut(clashing)
    calm = parts.join(large, "cluster").join(clashing, "cluster", "left_anti").select("id", "cluster")
    labels = cut(alone.join(merged.unionByName(calm), "id", "left").select("id", F.coalesce("cluster", "id").alias("cluster")))
    large = parts.join(clashing, "cluster").select("id")
    open_ = cut(good.join(large.select(F.col("id").alias("a")), "a").select("a", "b", F.struct((-F.col("score")).alias("s"), "a", "b").alias("at")))
    while not open_.isEmpty():
        held = names.join(labels, "id").select(F.col("cluster").alias("c"), "s", "n").distinct()
        of = labels.select(F.col("id").alias("a"), F.col("cluster").alias("x"))
        between = open_.join(of, "a").join(of.toDF("b", "y"), "b").where("x <> y")
        between = between.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"), "at").groupBy("x", "y").agg(F.min("at").alias("at"))
        clash = between.select("x", "y").join(held.toDF("x", "s", "nx"), "x").join(held.toDF("y", "s", "ny"), ["y", "s"]).where("nx <> ny").select("x", "y").distinct()
        free = cut(between.join(clash, ["x", "y"], "left_anti"))
        if free.isEmpty():
            break
        best = free.select(F.explode(F.array("x", "y")).alias("c"), "at").groupBy("c").agg(F.min("at").alias("at"))
        mutual = free.join(best.toDF("x", "ax"), "x").join(best.toDF("y", "ay"), "y").where("at = ax AND at = ay").select(F.col("y").alias("cluster"), F.col("x").alias("to"))
        labels = cut(labels.join(mutual, "cluster", "left").select("id", F.coalesce("to", "cluster").alias("cluster")))
        open_ = free.select(F.col("at.a").alias("a"), F.col("at.b").alias("b"), "at")
    return labels


def representatives(rows: DataFrame, row_id: str, cluster: str, order: list[Column]) -> DataFrame:
    """(cluster, chosen, size): of each cluster the row that comes first by the ascending columns,
    then by id, in one partial aggregation."""
    first = F.min(F.struct(*(c.alias(f"_{i}") for i, c in enumerate(order)), F.col(row_id).alias("id")))
    return rows.groupBy(cluster).agg(first.alias("f"), F.count("*").alias("size")).select(cluster, F.col("f.id").alias("chosen"), "size")
