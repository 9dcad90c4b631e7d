"""Documents in chunks, and the two exchanges that the corpus operators are built of.

A chunk is a few megabytes of documents dealt by a hash of their id.  ``stage`` writes the
documents once as a table bucketed by chunk in the shared folder, so that each later pass over
the texts reads its chunks without another shuffle, and a lost executor only rereads files.
Between passes only packed numpy blocks travel: ``to_buckets`` takes facts of every chunk to the
bucket of their hash, ``to_chunks`` brings the answers back.  A chunk sends each fact once,
whatever the number of its documents that hold it, so a fact that a third of all rows share
reaches its bucket at most once per chunk.
"""

from __future__ import annotations

import pickle
import tempfile
import uuid
from contextlib import contextmanager
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of input on disk for two chunks; the number of chunks follows the input, whatever its size.
BUCKET_BYTES = 10 << 20
#: Files of a staged table; of larger inputs a file holds more chunks, one after the other.
MOST_FILES = 50_000
MESSAGE = "chunk int, bucket int, body binary"
#: Spark's setting under which the shuffle files of a query go when it ends, not when the driver collects garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else (in local mode) one of our own."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: executors and driver need a folder that they share")
        folder = "file://" + tempfile.mkdtemp(prefix="fieldglass-")
        spark.conf.set("spark.checkpoint.dir", folder)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def shuffles_dropped(spark: SparkSession):
    """What is written in here leaves no shuffle files behind; nothing reads those of a finished write again."""
    was = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if was is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, was)


def saved(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back: cuts the lineage and survives lost executors."""
    path = new_folder(df.sparkSession, name)
    with shuffles_dropped(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def size_of(df: DataFrame, text_col: str = "text") -> int:
    """About what the texts take on disk: half their bytes, counted in one aggregate over that column alone.
    Spark's own estimate of a join is the product of its sides, so it isn't asked."""
    return (df.agg(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0) // 2


def partitions_for(df: DataFrame, text_col: str = "text") -> int:
    """At least the session's shuffle partitions, more where the input is larger than they should hold."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), size_of(df, text_col) // BUCKET_BYTES)


def by_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, text and, as rest, the columns to carry.  Rows without an id are left out: no result could name them."""
    rest = [F.struct(*(F.col(f"`{c}`") for c in carry)).alias("rest")] if carry else []
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *rest).filter("doc_id IS NOT NULL")


def unused(df: DataFrame, name: str) -> str:
    """name, or name after as many underscores as it takes for df not to have it, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def numbered(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, str]:
    """The rows with an id under a number of their own, and the name of its column, which docs did not
    have.  Where ids repeat, equal id and text are one row (with the least of its other columns), and
    different texts are rows of their own, none of which is lost; they are numbered by id and text.
    Where no id repeats, the number is the id."""
    row = unused(docs, "_row")
    rows = docs.withColumn(row, F.col(id_col).cast("long")).where(F.col(row).isNotNull())
    if rows.groupBy(row).count().where(F.col("count") > 1).isEmpty():
        return rows, row
    other = F.struct(row, *(c for c in docs.columns if c not in (id_col, text_col)))
    rest = unused(docs, "_rest")
    once = rows.groupBy(id_col, text_col).agg(F.min_by(other, F.to_json(other)).alias(rest))
    once = once.select(*(F.col(c) if c in (id_col, text_col) else F.col(rest)[c].alias(c) for c in rows.columns))
    return saved(once.orderBy(row, text_col).withColumn(row, F.monotonically_increasing_id()), "numbered"), row


def new_table(spark: SparkSession, name: str) -> str:
    """A name that no other table has, in a database that lies in the shared folder."""
    folder = shared_folder(spark)
    database = f"fieldglass_{blake2b(folder.encode(), digest_size=8).hexdigest()}"
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database} LOCATION '{folder}/tables'")
    return f"{database}.{name}_{uuid.uuid4().hex}"


def stage(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", name: str | None = None, carry: tuple[str, ...] = ()) -> tuple[DataFrame, int, int]:
    """(chunk, doc_id, text) as a table bucketed by chunk, its number of chunks, and that of the
    buckets for facts.  Both follow the input, so chunks and buckets stay small; a chunk sends a
    message only to buckets that it has facts for, so messages are never more than the facts.
    The columns to carry are there as one more, rest.  A caller that gives the table its name
    (``new_table``) can drop it, and its files with it, once nothing reads it any more."""
    spark, n = docs.sparkSession, partitions_for(docs, text_col)
    chunks, held = 2 * n, min(n, MOST_FILES)
    rows = by_id(docs, id_col, text_col, carry).withColumn("chunk", chunk_of("doc_id", chunks))
    name = name or new_table(spark, "staged")
    with shuffles_dropped(spark):
        writer = rows.repartition(held, "chunk").write.format("parquet").option("compression", "zstd")
        writer.bucketBy(held, "chunk").sortBy("chunk").saveAsTable(name)
    return spark.table(name), chunks, n


def message(chunk, bucket, body) -> tuple[int, int, bytes]:
    return int(chunk), int(bucket), pickle.dumps(body, protocol=5)


def messages(out: list[tuple[int, int, bytes]]) -> pa.Table:
    chunk, bucket, body = zip(*out) if out else ((), (), ())
    return pa.table({"chunk": pa.array(chunk, pa.int32()), "bucket": pa.array(bucket, pa.int32()), "body": pa.array(body, pa.binary())})


def bodies(table: pa.Table) -> list[tuple[int, object]]:
    """(chunk, body) of each message, in order of chunk, whatever order they arrived in."""
    got = sorted(zip(table["chunk"].to_pylist(), table["body"].to_pylist()))
    return [(c, pickle.loads(b)) for c, b in got]


def ordered(table: pa.Table) -> pa.Table:
    """The rows by id, ascending.  Of rows that repeat an id, the one with the smallest text."""
    ids = table["doc_id"].to_numpy()
    if len(np.unique(ids)) < len(ids):
        table = table.sort_by([("doc_id", "ascending"), ("text", "ascending")])
        ids = table["doc_id"].to_numpy()
        return table.filter(pa.array(np.r_[True, ids[1:] != ids[:-1]]))
    return table.take(pa.array(np.argsort(ids)))


def documents(table: pa.Table) -> tuple[np.ndarray, pa.Array]:
    """Ids, ascending, and their texts (null: empty), of the rows in order."""
    table = ordered(table)
    return table["doc_id"].to_numpy().astype(np.int64), filled(table["text"])


def filled(column) -> pa.Array:
    """One array of strings with 64-bit offsets, null as empty."""
    parts = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    parts = [p.cast(pa.large_string()).fill_null("") for p in parts]
    return pa.concat_arrays(parts) if parts else pa.array([], pa.large_string())


def on_chunks(staged: DataFrame, function, schema: str) -> DataFrame:
    """function(chunk, table) -> table over every chunk."""

    def run(key, table):
        return function(key[0].as_py(), table)

    return staged.groupBy("chunk").applyInArrow(run, schema)


def on_chunks_with(staged: DataFrame, answers: DataFrame, function, schema: str) -> DataFrame:
    """function(chunk, table, answers to the chunk) -> table; chunks with no answers get an empty table."""

    def run(key, table, sent):
        return function(key[0].as_py(), table, sent)

    return staged.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(run, schema)


def chunk_of(doc_id, chunks: int):
    return F.pmod(F.xxhash64(doc_id), F.lit(chunks)).cast("int")


def on_buckets(sent: DataFrame, function, schema: str = MESSAGE) -> DataFrame:
    """function(bucket, table of messages) -> table over every bucket."""

    def run(key, table):
        return function(key[0].as_py(), table)

    return sent.groupBy("bucket").applyInArrow(run, schema)
