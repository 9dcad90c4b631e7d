"""Operator 1: WARC archives and the external merge of their capture indexes.

Tasks write archives of one gzip member a record and report each archive's captures as a run,
sorted by URL key, timestamp and page.  Split keys from a bounded sample of the runs cut every run
into ranges; a range's segments meet in one task, where a loser tree merges them, so the ranges in
order are one capture index in global order.  The split keys hold the page as well, so a URL key
with a third of all captures spans as many ranges as it needs.  The archives are read back by the
places in the merged index.

Of records with equal payloads of at least least_bytes, the one with the largest page_id is the
response and the others revisit it: they hold the HTTP header with the payload's length, and the
digest, but no payload.  A null payload is empty, a null URL has the key "-"; repeated rows of the
same page_id and payload are records of the same kind; rows without a page_id are left out; other
columns are ignored.  An empty table writes no archive.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import pickle
import zlib
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import files
from .staging import new_folder, saved

#: Records of an archive; captures that a range should hold; split-key sample a run and in all.
ARCHIVE, RANGE, SAMPLE, SAMPLES = 50_000, 100_000, 32, 20_000
CAPTURE = "urlkey string, timestamp string, page_id long, record_type string, path string, offset long, length long"
RUN = "run binary, captures long, sample array<binary>"


def url_key(url: str | None) -> str:
    """Sort-friendly form: host labels reversed, then path and query; "-" where there is none."""
    try:
        parts = urlsplit((url or "").strip().lower())
        host = (parts.hostname or "").removeprefix("www.")
    except ValueError:
        return "-"
    if not host:
        return "-"
    port = parts.netloc.rpartition(":")[2]
    port = f":{port}" if port.isdigit() and port not in ("80", "443") else ""
    return ",".join(reversed(host.split("."))) + port + ")" + (parts.path or "/") + (f"?{parts.query}" if parts.query else "")


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int, url: str, timestamp: str, payload: bytes, refers_to: int | None) -> bytes:
    date = f"{timestamp[:4]}-{timestamp[4:6]}-{timestamp[6:8]}T{timestamp[8:10]}:{timestamp[10:12]}:{timestamp[12:14]}Z"
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Date: {date}", "WARC-Target-URI: " + "".join(url.split()), f"WARC-Payload-Digest: sha1:{sha1_base32(payload)}"]
    if refers_to is None:
        block += payload
    else:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 6, mtime=0)


def parsed(member: bytes) -> tuple[int, int, str, str, int | None]:
    """page_id, payload bytes, digest, record type, page referred to.  A response's digest is computed anew."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    page = int(fields["WARC-Record-ID"][10:-1])
    if fields["WARC-Type"] == "revisit":
        length = int(dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])["Content-Length"])
        return page, length, fields["WARC-Payload-Digest"][5:], "revisit", int(fields["WARC-Refers-To"][10:-1])
    digest = sha1_base32(payload)
    if fields["WARC-Payload-Digest"] != "sha1:" + digest:
        raise ValueError(f"payload of page {page} is damaged")
    return page, len(payload), digest, "response", None


def sort_key(capture: tuple) -> bytes:
    """Bytes that sort as (URL key, timestamp, page)."""
    return capture[0].encode() + b"\0" + capture[1].encode() + b"\0" + (capture[2] + (1 << 63)).to_bytes(8, "big")


class LoserTree:
    """Merges sorted lists; one comparison a level for each item."""

    def __init__(self, runs: list[list]):
        self.runs, self.place = runs, [0] * len(runs)
        self.k = 1
        while self.k < len(runs):
            self.k *= 2
        self.losers = [-1] * self.k
        level = [i if i < len(runs) and runs[i] else -1 for i in range(self.k)]
        at = self.k
        while at > 1:
            at //= 2
            up = []
            for i in range(at):
                w, self.losers[at + i] = self.play(level[2 * i], level[2 * i + 1])
                up.append(w)
            level = up
        self.best = level[0]

    def play(self, a: int, b: int) -> tuple[int, int]:
        if a < 0 or b < 0:
            return (b, a) if a < 0 else (a, b)
        x, y = self.runs[a][self.place[a]], self.runs[b][self.place[b]]
        return (a, b) if x < y or (x == y and a < b) else (b, a)

    def __iter__(self):
        while (best := self.best) >= 0:
            yield self.runs[best][self.place[best]]
            self.place[best] += 1
            x, node = best if self.place[best] < len(self.runs[best]) else -1, (best + self.k) // 2
            while node:
                x, self.losers[node] = self.play(x, self.losers[node])
                node //= 2
            self.best = x


def write_archives(pages: DataFrame, least_bytes: int = 0, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", time_col: str | None = None) -> DataFrame:
    """Writes every page and returns the runs (one row an archive)."""
    folder = folder or new_folder(pages.sparkSession, "warc")
    when = F.date_format(F.col(time_col).cast("timestamp"), "yyyyMMddHHmmss") if time_col else F.lit(None)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col).cast("string"), F.lit("")).alias("payload"), F.coalesce(when, F.lit("20240101000000")).alias("timestamp")).where("page_id IS NOT NULL")
    same = F.sha2("payload", 256)
    size = F.octet_length("payload")
    # payloads that several pages have: one row each, gathered by partial aggregates
    several = rows.where(size >= least_bytes).groupBy(same.alias("same")).agg(F.max("page_id").alias("response"), F.count("*").alias("n")).where("n > 1").drop("n")
    marked = rows.withColumn("_same", same).join(several, F.col("_same") == several.same, "left")
    refers = F.when((size >= least_bytes) & (F.col("page_id") < F.col("response")), F.col("response"))
    marked = marked.select("page_id", "url", "timestamp", "payload", refers.alias("refers_to"))

    def write(batches):
        out, captures, at = None, [], 0

        def finish():
            nonlocal out, captures, at
            out.close()
            captures.sort(key=sort_key)
            step = max(1, len(captures) // SAMPLE)
            row = pa.RecordBatch.from_arrays([pa.array([pickle.dumps(captures)], pa.binary()), pa.array([len(captures)], pa.int64()), pa.array([[sort_key(c) for c in captures[step // 2 :: step]]], pa.list_(pa.binary()))], ["run", "captures", "sample"])
            out, captures, at = None, [], 0
            return row

        for batch in batches:
            for page, url, timestamp, payload, refers_to in zip(*(batch[c] for c in ("page_id", "url", "timestamp", "payload", "refers_to"))):
                page, url, timestamp, refers_to = page.as_py(), url.as_py(), timestamp.as_py(), refers_to.as_py()
                if out is None:
                    uri = files.new_file(folder, ".warc.gz")
                    out = files.writer(uri)
                data = record(page, url or "", timestamp, payload.as_py().encode(), refers_to)
                out.write(data)
                captures.append((url_key(url), timestamp, page, "response" if refers_to is None else "revisit", uri, at, len(data)))
                at += len(data)
                if len(captures) >= ARCHIVE:
                    yield finish()
        if out is not None:
            yield finish()

    return saved(marked.mapInArrow(write, RUN), "runs")


def merged_index(runs: DataFrame) -> DataFrame:
    """The capture index: position in global order (part, place) and the captures of CAPTURE."""
    spark = runs.sparkSession
    total = runs.agg(F.sum("captures")).first()[0] or 0
    keys = runs.select(F.explode("sample").alias("key"))
    if (n := keys.count()) > SAMPLES:
        keys = keys.sample(SAMPLES / n, seed=1).limit(2 * SAMPLES)  # only where ranges are cut depends on it
    keys = sorted(bytes(r.key) for r in keys.collect())
    most = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = max(1, -(-total // RANGE), min(most, total // 500))
    splits = sorted({keys[i * len(keys) // ranges] for i in range(1, ranges)}) if keys else []

    def cut(batches):
        from bisect import bisect_left

        for batch in batches:
            for run in batch["run"]:
                captures = pickle.loads(run.as_py())
                ends = [bisect_left(captures, s, key=sort_key) for s in splits] + [len(captures)]
                parts = [(k, captures[a:b]) for k, (a, b) in enumerate(zip([0, *ends], ends)) if a < b]
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in parts], pa.int32()), pa.array([pickle.dumps(x) for _, x in parts], pa.binary())], ["part", "segment"])

    def merge(key, table):
        segments = sorted((pickle.loads(x) for x in table["segment"].to_pylist()), key=lambda s: s[0][4:])
        tree = LoserTree([[(sort_key(c), *c[4:6], c) for c in s] for s in segments])
        captures = [x[-1] for x in tree]
        names = [c.split()[0] for c in CAPTURE.split(", ")]
        out = pa.table({n: pa.array(list(x)) for n, x in zip(names, zip(*captures))})
        place = pa.array(np.arange(len(captures)), pa.int64())
        return out.add_column(0, "place", place).add_column(0, "part", pa.array([key[0].as_py()] * len(captures), pa.int32()))

    segments = runs.select("run").repartition(most).mapInArrow(cut, "part int, segment binary")
    return saved(segments.groupBy("part").applyInArrow(merge, "part int, place long, " + CAPTURE), "index")


def read_archives(index: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of every capture, by its place."""

    def read(batches):
        uri = file = None
        for batch in batches:
            out = []
            for path, offset, length in zip(*(batch[c].to_pylist() for c in ("path", "offset", "length"))):
                if path != uri:
                    uri, file = path, files.reader(path)
                file.seek(offset)
                out.append(parsed(file.read(length)))
            types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
            columns = zip(*out) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    n = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    places = index.select("path", "offset", "length").repartition(n, "path").sortWithinPartitions("path", "offset")
    return places.mapInArrow(read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
