"""Alerts, back-off, late data and retention: conditions and keyed merges over batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def wait_minutes(cadence: Column, failures: Column, most: int = 1440) -> Column:
    """Cadence doubled for each of up to six failures in a row, at most a day."""
    return F.least(F.lit(most), cadence * F.pow(F.lit(2), F.least(failures, F.lit(6)))).cast("bigint")


def due(last: Column, now: Column, cadence: Column, failures: Column, early: float = 0.1) -> Column:
    """Never run, or waited for long enough, early by at most a tenth."""
    waited = (F.unix_micros(now) - F.unix_micros(last)) / F.lit(60_000_000.0)
    return last.isNull() | (waited >= wait_minutes(cadence, failures) * (1 - early))


def after_seed(rows: DataFrame, seeds: DataFrame, key: list[str], seen: str, seeded: str) -> DataFrame:
    """Rows first seen after their source was first read in full, or of a source without such a time."""
    return rows.join(seeds.select(*key, F.col(seeded).alias("_seeded")), key, "left").where(F.col("_seeded").isNull() | (F.col(seen) > F.col("_seeded"))).drop("_seeded")


def once(sent: DataFrame, new: DataFrame, tier: str, key: str, top: str = "p0") -> DataFrame:
    """New rows whose (tier, key) was never sent and whose key was not sent, nor is now, at the top tier.
    Of repeats in the batch one stays."""
    fresh = new.dropDuplicates([tier, key]).join(sent.select(tier, key).distinct(), [tier, key], "left_anti")
    above = sent.where(F.col(tier) == top).select(key).union(fresh.where(F.col(tier) == top).select(key)).distinct()
    return fresh.where(F.col(tier) == top).unionByName(fresh.where(F.col(tier) != top).join(above, key, "left_anti"))


def backdated(known: DataFrame, late: DataFrame, key: str, seen: str) -> DataFrame:
    """(key, seen, provisional): the earliest sighting of each; provisional where only late rows have it."""
    both = known.select(key, seen, F.lit(True).alias("_known")).unionByName(late.select(key, seen, F.lit(False).alias("_known")))
    return both.groupBy(key).agg(F.min(seen).alias(seen), (~F.bool_or("_known")).alias("provisional"))


def quiet(at: Column, begin: int, end: int, zone: str = "America/New_York") -> Column:
    """Whether a UTC time falls in hours [begin, end) of the zone; may span midnight."""
    hour = F.hour(F.from_utc_timestamp(at, zone))
    return (hour >= begin) & (hour < end) if begin <= end else (hour >= begin) | (hour < end)


def drifted(rows: Column, usual: Column, least: int = 20, share: float = 0.2) -> Column:
    """A batch far smaller than usual: it must not delist anything."""
    return F.coalesce((usual >= least) & (rows < usual * share), F.lit(False)) | F.coalesce((rows == 0) & (usual > 0), F.lit(False))


def link_state(old: Column, verdict: Column, present: Column) -> Column:
    """struct(status, rescore): a passing failure leaves a row that its source still lists alive."""
    status = F.when(verdict == "transient", F.when(present & (old == "live"), old).otherwise("unknown")).otherwise(verdict)
    return F.struct(status.alias("status"), (F.coalesce(status.startswith("dead"), F.lit(False)) != F.coalesce(old.startswith("dead"), F.lit(False))).alias("rescore"))


def sessions(events: DataFrame, key: str, at: str, gap: str) -> DataFrame:
    """(key, start, n) of runs of events less than gap apart; also runs on a stream with a watermark."""
    return events.groupBy(key, F.session_window(at, gap).alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), "n")


def weekly(events: DataFrame, key: str, at: str) -> DataFrame:
    """(key, week, n) by weeks from Monday; also runs on a stream with a watermark."""
    week = F.window(F.col(at), "7 days", "7 days", "4 days").alias("w")
    return events.groupBy(key, week).agg(F.count("*").alias("n")).select(key, F.to_date("w.start").alias("week"), "n")
