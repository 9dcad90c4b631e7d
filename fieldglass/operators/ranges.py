"""Tables written once, and places in sorted groups of any size."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def folder_for(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the cluster shares.  Where spark.checkpoint.dir is unset, a folder of
    our own in local mode, else an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: executors and driver need a folder that they share")
        folder = "file://" + tempfile.mkdtemp(prefix="fieldglass-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read back: cuts the lineage and survives lost executors."""
    path = folder_for(df.sparkSession, "stored")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def placed(df: DataFrame, keys: list[str], order: list[Column], place: str = "_i", size: str = "_n") -> DataFrame:
    """Each row's place (from 0) among the rows of its keys, and their number.  Null keys are a group.

    The rows are cut into ranges by keys and order and written once with their range, so that counting
    and numbering see the same cut; a group that is larger than a range spans several.  No task holds
    more than a range, whatever the size of a group, unless equal rows alone fill it."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = stored(df.repartitionByRange(n, *keys, *order).withColumn("_part", F.spark_partition_id()))
    group = F.struct(*keys) if keys else F.lit(0)
    counts = cut.groupBy("_part", group.alias("_key")).agg(F.count("*").alias("_count"))
    before = Window.partitionBy("_key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range that a group spans
    starts = counts.select("_part", "_key", F.coalesce(F.sum("_count").over(before), F.lit(0)).alias("_start"), F.sum("_count").over(Window.partitionBy("_key")).alias(size))
    within = F.row_number().over(Window.partitionBy("_part", "_key").orderBy(*order)) - 1
    numbered = cut.withColumn("_key", group).withColumn("_within", within)
    a, b = numbered.alias("a"), starts.alias("b")
    joined = a.join(b, (F.col("a._part") == F.col("b._part")) & F.col("a._key").eqNullSafe(F.col("b._key")))
    return joined.select("a.*", (F.col("_start") + F.col("_within")).alias(place), F.col(size)).drop("_part", "_key", "_within")
