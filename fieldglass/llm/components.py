"""Connected components of an edge table, by least label with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import saved


def components(edges: DataFrame) -> DataFrame:
    """(a, b) -> (v, label): the least vertex that each vertex can reach.  Each round takes the least
    label of the neighbours, then the label of that label, and is written to the shared folder;
    rounds grow with the logarithm of the longest path.  Self-loops and repeated edges are allowed."""
    both = saved(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct(), "edges")
    labels = both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("m")).select("v", F.least("v", "m").alias("label"))
    labels = saved(labels, "labels")
    while True:
        near = both.join(labels, both.b == labels.v).groupBy(F.col("a").alias("v")).agg(F.min("label").alias("m"))
        lower = labels.join(near, "v").select("v", F.col("label").alias("was"), F.least("label", "m").alias("label"))
        of = lower.select(F.col("v").alias("label"), F.least("label", "v").alias("above"))
        step = lower.join(of, "label").select("v", "was", F.least("label", "above").alias("label"))
        step = saved(step, "labels")
        labels = step.select("v", "label")
        if step.where("was <> label").isEmpty():
            return labels
