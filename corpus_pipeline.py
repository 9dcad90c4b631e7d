"""From raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns documents with the columns it got, except the
last, which returns the pieces of the packed sequences.

In every stage rows without a doc_id are left out, since no result could name them; rows that repeat
a doc_id and its text count once; different texts under one doc_id are documents of their own, in
the order of their texts, and all of them go through.  An empty table gives an empty table with the
same columns.  Other columns come through as they are, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldglass.llm.ngram_join import ngram_join
from fieldglass.llm.packing import pack
from fieldglass.llm.pii import redacted
from fieldglass.llm.quality import kept
from fieldglass.llm.staging import numbered, saved, unused
from fieldglass.llm.substring_dedup import dedup_substrings

#: Words of a passage that is removed where it repeats.
PASSAGE = 50


def counted(docs: DataFrame) -> DataFrame:
    """n_chars follows the text."""
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def of_rows(docs: DataFrame, row: str, found: DataFrame, how: str) -> DataFrame:
    """docs (a) joined with what was found (b) for each row number (key)."""
    return docs.alias("a").join(found.alias("b"), F.col(f"a.{row}") == F.col("b.key"), how)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: documents that fail the rules go, those without a text among them."""
    rows, _ = numbered(docs)
    return kept(rows.select(*docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3 on five words and a similarity of 0.8: of each component the smallest doc_id (and text)
    stays.  Documents without words are like no other and stay."""
    rows, row = numbered(docs)
    first = ngram_join(rows, n=5, num=80, den=100, id_col=row).where("doc_id = component_id").select(F.col("doc_id").alias("key"))
    return of_rows(rows, row, first, "left_semi").select(*docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: passages that an earlier document has are cut out.  Null texts stay null."""
    rows, row = numbered(docs)
    empty = unused(rows, "_null")
    rows = rows.withColumn(empty, F.col("text").isNull())
    cut = dedup_substrings(rows, window=PASSAGE, joined=False, id_col=row, carry=(empty, *(c for c in docs.columns if c != "text")))
    text = F.when(~F.col("rest")[empty], F.col("kept")).alias("text")
    return counted(cut.select(*(text if c == "text" else F.col("rest")[c].alias(c) for c in docs.columns)))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: personal data gives way to its kind.  Null texts stay null."""
    return counted(redacted(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: the pieces of the packed sequences.  A null or empty text is its end id alone."""
    return pack(numbered(docs)[0], window=4096, end=2)


STAGES = [
    ("quality rules", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("substring dedup", repeated_passages),
    ("PII", personal_data),
    ("packing", packing),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = saved(docs, f"stage{k}")
    return docs
