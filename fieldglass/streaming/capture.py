"""Keyed change capture: a batch of sightings against the last snapshot.

State rows: key, content_hash, raw_hash, first_seen, last_seen, delisted_at, description.
Batch rows: key, content_hash, raw_hash, seen_at, description.

One full outer join by key decides new, unchanged, changed, relisted and delisted.  A row that is
absent is delisted only by a complete batch that is not a drift; rows are never deleted.  A batch
without a description never erases one.  Applying a batch twice changes nothing but last_seen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_of_each(batch: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Of repeated keys in a batch the first counts."""
    return batch.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_r = 1").drop("_r")


def merge(state: DataFrame, batch: DataFrame, key: list[str], as_of: Column, may_delist: bool) -> DataFrame:
    """The new snapshot with an action per row (null: nothing happened)."""
    old = state.select(*key, *(F.col(c).alias(f"old_{c}") for c in state.columns if c not in key), F.lit(True).alias("_old"))
    new = batch.select(*key, *(F.col(c).alias(f"new_{c}") for c in batch.columns if c not in key), F.lit(True).alias("_new"))
    both = old.join(new, key, "full")
    was, now = F.col("_old").isNotNull(), F.col("_new").isNotNull()
    gone = F.col("old_delisted_at").isNotNull()
    action = (
        F.when(~was, "new")
        .when(was & now & gone, "relisted")
        .when(was & now & F.col("old_raw_hash").eqNullSafe(F.col("new_raw_hash")), "unchanged")
        .when(was & now & ~F.col("old_content_hash").eqNullSafe(F.col("new_content_hash")), "changed")
        .when(was & now, "unchanged")
        .when(was & ~now & ~gone & F.lit(may_delist), "delisted")
    )
    pick = lambda c: F.when(now, F.col(f"new_{c}")).otherwise(F.col(f"old_{c}"))
    return both.select(
        *key,
        pick("content_hash").alias("content_hash"),
        pick("raw_hash").alias("raw_hash"),
        F.least("old_first_seen", "new_seen_at").alias("first_seen"),
        F.greatest("old_last_seen", "new_seen_at").alias("last_seen"),
        F.when(now, F.lit(None)).when(~gone & F.lit(may_delist), as_of).otherwise(F.col("old_delisted_at")).cast("timestamp").alias("delisted_at"),
        F.coalesce("new_description", "old_description").alias("description"),
        action.alias("action"),
    )


def changed_fields(old: dict[str, Column], new: dict[str, Column]) -> Column:
    """Names of the fields that differ, empty text and null being the same."""
    same = lambda c: F.nullif(c.cast("string"), F.lit(""))
    names = F.array(*(F.when(~same(old[n]).eqNullSafe(same(new[n])), F.lit(n)) for n in old))
    return F.array_compact(names)


def unseen(stream: DataFrame, history: DataFrame, key: list[str]) -> DataFrame:
    """Rows of a batch whose key the history does not have, each once."""
    return stream.dropDuplicates(key).join(history.select(*key).distinct(), key, "left_anti")


def run_stream(spark, folder: str, schema, table: str, key: list[str], checkpoint: str) -> None:
    """Drains the JSON files of a folder into a Parquet table, each key once for ever.  Offsets and the
    keys seen are in the checkpoint (in RocksDB, dealt by key, so the history is never read again); the
    file sink commits each batch once."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = spark.readStream.schema(schema).json(folder).dropDuplicates(key)
    query = rows.writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
