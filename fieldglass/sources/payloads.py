"""Stored payloads, strict decoding, quarantine, exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def stored(payloads: DataFrame, key: list[str], order: str, content: str) -> DataFrame:
    """sha256 of each payload and whether it equals the one before it of the same key."""
    before = F.lag("sha256").over(Window.partitionBy(*key).orderBy(order))
    return payloads.withColumn("sha256", F.sha2(F.col(content).cast("string"), 256)).withColumn("unchanged", F.coalesce(F.col("sha256") == before, F.lit(False)))


def decoded(payloads: DataFrame, content: str, schema: T.StructType, listed: str) -> tuple[DataFrame, DataFrame]:
    """(items, quarantine).  A payload that is no JSON or lacks the list is quarantined with a reason;
    a null list is an empty one."""
    names = F.json_object_keys(content)
    parsed = payloads.withColumn("_j", F.from_json(content, schema)).withColumn("_keys", names)
    reason = F.when(F.col("_keys").isNull(), "not JSON").when(~F.array_contains("_keys", listed), f"no {listed}")
    parsed = parsed.withColumn("reason", reason)
    items = parsed.where("reason IS NULL").select(*payloads.columns, F.explode(f"_j.{listed}").alias("item")).drop(content)
    return items, parsed.where("reason IS NOT NULL").drop("_j", "_keys")


def table_rows(text: Column) -> Column:
    """Cells of the lines of a pipe table, without the ruling line."""
    lines = F.filter(F.split(text, "\n"), lambda s: F.startswith(F.trim(s), F.lit("|")) & ~F.rlike(s, F.lit(r"^[\s|:-]+$")))
    return F.transform(lines, lambda s: F.transform(F.split(F.regexp_replace(F.trim(s), r"^\||\|$", ""), r"\|"), F.trim))


def without_tags(html: Column) -> Column:
    """Text of HTML: scripts and styles dropped, tags as spaces, white space squashed."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, "<[^>]*>", " "), r"\s+", " "))


def redacted(text: Column, terms: list[str]) -> Column:
    """Literal terms, longest first, ignoring case, as [redacted]."""
    import re

    if not terms:
        return text
    return F.regexp_replace(text, "(?i)" + "|".join(re.escape(t) for t in sorted(terms, key=len, reverse=True)), "[redacted]")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)
