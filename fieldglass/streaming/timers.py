"""Keyed streams with state and event-time timers, and their draining into tables.

Each processor takes the rows of a key in order of time, within a batch and, where the stream is
in order, across batches, so its rows are those of the batch query over the whole history.  State
is dealt by key and kept in RocksDB; no batch reads the history again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

HOUR = 3_600_000
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
# Fixed values of the row-count average.
KEPT, ADDED, LEAST, SHARE = 0.7, 0.3, 20, 0.2


def in_order(rows: Iterator[pd.DataFrame], by: list[str]) -> pd.DataFrame:
    return pd.concat(list(rows)).sort_values(by, kind="stable")


class Engagement(StatefulProcessor):
    """Input key, kind (sent, engaged), at.  Output key, outcome, at: engaged, by the first engagement
    within hours of the sending, or else ignored, by a timer, when those hours are over.  A sending
    that repeats its key starts nothing anew while the first is open; engagement of what was not sent,
    or is settled, says nothing.

    Keys are taken together by bucket, as calls and state cost far more than rows: a bucket's state is its
    open keys with the times of their sending, and its one timer stands at the first of these to end."""

    SCHEMA = "key long, outcome string, at timestamp"
    BUCKETS = 2048

    def __init__(self, hours: int = 48):
        self.span = hours * HOUR

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("open", "until long, body binary")

    def load(self) -> tuple[int | None, dict[int, int]]:
        """The timer that stands, and the open keys."""
        if not self.state.exists():
            return None, {}
        until, body = self.state.get()
        return until, dict(np.frombuffer(bytes(body), np.int64).reshape(-1, 2).tolist())

    def store(self, stands: int | None, sent: dict[int, int]) -> None:
        """Keeps the open keys, with the timer at the first to end; stands is the timer that stands."""
        until = min(sent.values()) + self.span if sent else None
        if until != stands:
            if stands is not None:
                self.handle.deleteTimer(stands)
            if until is not None:
                self.handle.registerTimer(until)
        if sent:
            self.state.update((until, np.array(list(sent.items()), np.int64).tobytes()))
        elif stands is not None:
            self.state.clear()

    def settled(self, rows: list, outcome: str) -> pd.DataFrame:
        return pd.DataFrame({"key": [k for k, _ in rows], "outcome": outcome, "at": pd.to_datetime([at for _, at in rows], unit="ms")})

    def handleInputRows(self, key, rows, timerValues):
        data = pd.concat(list(rows))
        at, first = data["at"].astype("datetime64[ms]").astype("int64").to_numpy(), (data["kind"] == "sent").to_numpy()
        order = np.lexsort((~first, at))
        until, sent = self.load()
        kinds, out = np.where(first, 0, np.where(data["kind"] == "engaged", 1, 2)), []
        for k, kind, t in zip(data["key"].to_numpy()[order].tolist(), kinds[order].tolist(), at[order].tolist()):
            if kind == 0:
                sent.setdefault(k, t)
            elif kind == 1 and k in sent and t <= sent[k] + self.span:
                del sent[k]
                out.append((k, t))
        self.store(until, sent)
        if out:
            yield self.settled(out, "engaged")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        fired, sent = self.load()
        # all that a timer of their own would settle now: those that end before the watermark
        before = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs() + 1)
        over = [(k, t + self.span) for k, t in sent.items() if t + self.span < before]
        for k, _ in over:
            del sent[k]
        self.store(fired, sent)
        if over:
            yield self.settled(over, "ignored")

    def close(self) -> None:
        pass


class Sightings(StatefulProcessor):
    """Input key, known, at.  Output, whenever one of them changes, key, first_seen (the earliest sighting,
    so a late one dates it back) and provisional (no known row yet)."""

    SCHEMA = "key long, first_seen timestamp, provisional boolean"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("seen", "at long, known boolean")

    def handleInputRows(self, key, rows, timerValues):
        data = pd.concat(list(rows))
        at, known = int(data["at"].astype("datetime64[us]").astype("int64").min()), bool(data["known"].any())
        before = self.state.get() if self.state.exists() else None
        now = (at, known) if before is None else (min(at, before[0]), known or before[1])
        if before is None or now != tuple(before):
            self.state.update(now)
            yield pd.DataFrame({"key": [key[0]], "first_seen": pd.to_datetime([now[0]], unit="us"), "provisional": [not now[1]]})

    def close(self) -> None:
        pass


class RowCounts(StatefulProcessor):
    """Input key, at, n of a source's complete runs.  Output key, at, n, typical (the average before the
    run, 0 at first) and drifted: far fewer rows than typical, or none where some were known.  A
    drifted run must not delist anything and does not move the average; a source whose runs were empty
    from the start drifts once."""

    SCHEMA = "key long, at timestamp, n long, typical double, drifted boolean"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("typical", "typical double, empty boolean")

    def handleInputRows(self, key, rows, timerValues):
        data = in_order(rows, ["at", "n"])
        typical, empty = self.state.get() if self.state.exists() else (0.0, False)
        out = []
        for at, n in zip(data["at"], data["n"]):
            drifted = bool((typical >= LEAST and n < typical * SHARE) or (n == 0 and (typical > 0 or not empty)))
            out.append((key[0], at, int(n), typical, drifted))
            if not drifted:
                typical = KEPT * typical + ADDED * n if typical else float(n)
            empty = n == 0
        self.state.update((typical, bool(empty)))
        yield pd.DataFrame(out, columns=["key", "at", "n", "typical", "drifted"])

    def close(self) -> None:
        pass


class EmitOnce(StatefulProcessor):
    """Input key, tier, at, id.  Output: of each key and tier the first row ever (by at, then id), but none of
    another tier once the top tier was sent."""

    SCHEMA = "key long, tier string, at timestamp, id long"

    def __init__(self, top: str = "p0"):
        self.top = top

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.tiers = handle.getMapState("tiers", "tier string", "sent boolean")

    def handleInputRows(self, key, rows, timerValues):
        data = in_order(rows, ["at", "id"])
        sent, out = {t[0] for t in self.tiers.keys()}, []
        for tier, at, i in zip(data["tier"], data["at"], data["id"]):
            if tier not in sent and self.top not in sent:
                sent.add(tier)
                self.tiers.updateValue((tier,), (True,))
                out.append((key[0], tier, at, i))
        if out:
            yield pd.DataFrame(out, columns=["key", "tier", "at", "id"])

    def close(self) -> None:
        pass


def keyed(stream: DataFrame, processor: StatefulProcessor, mode: str = "Append", at: str = "", delay: str = "0 seconds") -> DataFrame:
    """The processor over the stream's rows by key, or by bucket of keys where it has BUCKETS; with at, in event
    time, rows later than delay are dropped."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    rows = stream.withWatermark(at, delay) if at else stream
    buckets, by = getattr(processor, "BUCKETS", None), "key"
    if buckets:
        rows, by = rows.withColumn("_bucket", F.pmod(F.xxhash64("key"), F.lit(buckets))), "_bucket"
    return rows.groupBy(by).transformWithStateInPandas(processor, type(processor).SCHEMA, mode, "EventTime" if at else "None")


def drained(spark: SparkSession, rows: DataFrame, table: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Drains what is there of a stream into Parquet files, a folder a batch, and returns all of them with
    their batch.  A batch that is done again writes its folder anew, so each counts once.  State has no more
    partitions than twice the tasks that run at once: each batch opens all of them."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table}/batch={number}")

    key = "spark.sql.shuffle.partitions"
    before = spark.conf.get(key)
    spark.conf.set(key, min(int(before), 2 * spark.sparkContext.defaultParallelism))
    try:
        rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(key, before)
    return spark.read.schema(rows.schema.add("batch", "long")).parquet(table)


def latest(rows: DataFrame) -> DataFrame:
    """Of each key the row of the last batch."""
    return rows.groupBy("key").agg(F.max_by(F.struct(*(c for c in rows.columns if c not in ("key", "batch"))), "batch").alias("_r")).select("key", "_r.*")
