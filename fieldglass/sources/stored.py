"""Data sources of our own: stored feed payloads as postings, and delta files line by line.

``stored_payloads`` (batch) reads a folder of payload envelopes, one JSON document a line, in
directories provider=<layout>/slug=<board>.  An envelope is {"fetched_at", "pages": [{"url", "status",
"body"}]}, and with "detail_of" it is the page of one posting.  A partition is about SPLIT_BYTES of
lines; directories that a filter on provider or slug rules out are never listed.

``delta_lines`` (stream) reads the lines of files that only grow.  Its offset is, for each file, the
place after its last whole line, so lines appended later are read once, a half-written line waits,
and a batch that failed reads the same bytes again.

Files are opened through pyarrow's file systems, in the tasks that read them.
"""

from __future__ import annotations

import io
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, In, InputPartition

SPLIT_BYTES, ROWS = 8 << 20, 4096
POSTING = "provider string, slug string, kind string, fetched_at string, url string, status int, source_job_id string, title string, apply_url string, locations array<string>, department string, posted_at string, description string, error string"
NAMES = [c.split()[0] for c in POSTING.split(", ")]
ARROW = pa.schema([(n, pa.list_(pa.string()) if n == "locations" else pa.int32() if n == "status" else pa.string()) for n in NAMES])


@dataclass(frozen=True)
class Layout:
    """listed: the key of a page's list, empty where the page is the list.  fields: paths of names joined
    by dots, [] for every element, the first value found; locations: all values found, each once."""

    listed: str
    fields: dict[str, str]
    locations: tuple[str, ...]
    detail: str = ""  # path of the description in the page of one posting


# Published layouts of posting feeds.
LAYOUTS = {
    "offices_and_departments": Layout("jobs", {"source_job_id": "id", "title": "title", "apply_url": "absolute_url", "posted_at": "updated_at", "department": "departments[].name", "description": "content"}, ("location.name", "offices[].name"), "content"),
    "bare_list": Layout("", {"source_job_id": "id", "title": "text", "apply_url": "hostedUrl", "posted_at": "createdAt", "department": "categories.team", "description": "descriptionPlain"}, ("categories.location",), "descriptionPlain"),
}


def found(item, path: str) -> Iterator:
    """The values at a path that are not null."""
    name, _, rest = path.partition(".")
    every, name = name.endswith("[]"), name.removesuffix("[]")
    value = item.get(name) if isinstance(item, dict) else None
    for v in value if every and isinstance(value, list) else [value]:
        if v is not None:
            yield from found(v, rest) if rest else [v]


def moment(value) -> str:
    """A time as text; numbers are milliseconds since 1970."""
    return datetime.fromtimestamp(value / 1000, UTC).strftime("%Y-%m-%dT%H:%M:%SZ") if isinstance(value, int | float) else str(value)


def items(body: str, layout: Layout) -> list:
    """The items of a page.  A null list is empty; anything else that is no list is an error that says what was there."""
    try:
        data = json.loads(body)
    except ValueError:
        raise ValueError("not JSON") from None
    if layout.listed:
        if not isinstance(data, dict) or layout.listed not in data:
            raise ValueError(f"no {layout.listed}")
        data = data[layout.listed]
    if data is None and layout.listed:
        return []
    if not isinstance(data, list):
        raise ValueError("not a list")
    return data


def posting(item, layout: Layout) -> dict:
    row = {c: next(found(item, path), None) for c, path in layout.fields.items()}
    row = {c: v if v is None else moment(v) if c == "posted_at" else str(v) for c, v in row.items()}
    return row | {"locations": list(dict.fromkeys(str(v) for path in layout.locations for v in found(item, path)))}


def envelope_rows(line: str, provider: str, slug: str) -> Iterator[dict]:
    """Rows of one envelope: its postings, the first of each id; or, where a page can't be read, the reason."""
    layout, base = LAYOUTS.get(provider), {"provider": provider, "slug": slug, "kind": "listed"}
    try:
        envelope = json.loads(line)
        pages, detail = envelope["pages"], envelope.get("detail_of")
    except (ValueError, KeyError, TypeError, AttributeError):
        yield base | {"error": "no envelope"}
        return
    base |= {"fetched_at": envelope.get("fetched_at"), "kind": "listed" if detail is None else "detail"}
    seen: set = set()
    for page in pages or []:
        at = base | {"url": page.get("url"), "status": page.get("status")}
        try:
            if layout is None:
                raise ValueError("no such layout")
            if detail is not None:
                data = json.loads(page["body"]) if page.get("status") == 200 else {}
                yield at | {"source_job_id": str(detail), "description": next((str(v) for v in found(data, layout.detail)), None)}
                continue
            if page.get("status") != 200:
                raise ValueError(f"HTTP {page.get('status')}")
            for item in items(page.get("body"), layout):
                row = posting(item, layout)
                if row["source_job_id"] not in seen:
                    seen.add(row["source_job_id"])
                    yield at | row
        except (ValueError, TypeError) as wrong:
            yield at | {"error": str(wrong) if isinstance(wrong, ValueError) and not isinstance(wrong, json.JSONDecodeError) else "not JSON"}


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """A file system and the path there."""
    return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri.removeprefix("file:"))


def lines(system: fs.FileSystem, path: str, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """Place and bytes of each line that begins in [start, end)."""
    with system.open_input_file(path) as file:
        at = max(0, start - 1)
        file.seek(at)
        reader = io.BufferedReader(file, 1 << 20)
        if start:
            at += len(reader.readline())
        while at < end and (line := reader.readline()):
            yield at, line.rstrip(b"\r\n")
            at += len(line)


@dataclass
class Ranges(InputPartition):
    """Ranges (file, from, to, provider, slug) that a task reads."""

    ranges: list


def cut(files: list[tuple]) -> list[Ranges]:
    """Ranges of at most SPLIT_BYTES, small ones together: (file, from, to, ...)."""
    out, held = [], 0
    for name, start, end, *rest in files:
        for a in range(start, end, SPLIT_BYTES):
            b = min(end, a + SPLIT_BYTES)
            if not out or held + b - a > SPLIT_BYTES:
                out.append(Ranges([]))
                held = 0
            out[-1].ranges.append((name, a, b, *rest))
            held += b - a
    return out


def children(system: fs.FileSystem, path: str) -> list[fs.FileInfo]:
    found = system.get_file_info(fs.FileSelector(path, allow_not_found=True))
    return sorted((f for f in found if not f.base_name.startswith((".", "_"))), key=lambda f: f.path)


class PayloadReader(DataSourceReader):
    def __init__(self, path: str):
        self.path, self.only = path, {}

    def pushFilters(self, filters):
        """Equality and membership of provider and slug choose directories; Spark still applies all filters."""
        for f in filters:
            if isinstance(f, EqualTo | In) and len(f.attribute) == 1 and f.attribute[0] in ("provider", "slug"):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.only[f.attribute[0]] = self.only.get(f.attribute[0], values) & values
            yield f

    def partitions(self):
        system, root = opened(self.path)
        files = []
        for provider in self.chosen(system, root, "provider"):
            for slug in self.chosen(system, provider.path, "slug"):
                names = tuple(d.base_name.partition("=")[2] for d in (provider, slug))
                files += [(f.path, 0, f.size, *names) for f in children(system, slug.path) if f.type == fs.FileType.File]
        return cut(files)

    def chosen(self, system, path, key):
        only = self.only.get(key)
        return [d for d in children(system, path) if d.base_name.startswith(f"{key}=") and (only is None or d.base_name.partition("=")[2] in only)]

    def read(self, partition):
        system, _ = opened(self.path)
        held = []
        for path, a, b, provider, slug in partition.ranges if partition else []:
            for _, line in lines(system, path, a, b):
                if line.strip():
                    held.extend(envelope_rows(line.decode("utf-8", "replace"), provider, slug))
                if len(held) >= ROWS:
                    yield pa.RecordBatch.from_pylist(held, schema=ARROW)
                    held = []
        if held:
            yield pa.RecordBatch.from_pylist(held, schema=ARROW)


class StoredPayloads(DataSource):
    """spark.read.format("stored_payloads").load(folder)"""

    @classmethod
    def name(cls) -> str:
        return "stored_payloads"

    def schema(self) -> str:
        return POSTING

    def reader(self, schema) -> PayloadReader:
        return PayloadReader(self.options["path"])


class LineReader(DataSourceStreamReader):
    def __init__(self, path: str, newest: int):
        self.path, self.newest = path, newest

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        """The place after the last whole line of each file, of the newest files by name where asked for."""
        system, root = opened(self.path)
        files = [f for f in children(system, root) if f.type == fs.FileType.File]
        return {f.base_name: whole(system, f) for f in (files[-self.newest :] if self.newest else files)}

    def partitions(self, start: dict, end: dict):
        return cut([(name, start.get(name, 0), to) for name, to in sorted(end.items()) if to > start.get(name, 0)])

    def read(self, partition):
        system, root = opened(self.path)
        held = []
        for name, a, b in partition.ranges:
            for at, line in lines(system, f"{root}/{name}", a, b):
                held.append((name, at, line.decode("utf-8", "replace")))
                if len(held) >= ROWS:
                    yield batch(held)
                    held = []
        if held:
            yield batch(held)

    def commit(self, end: dict) -> None:
        pass


def batch(rows: list[tuple]) -> pa.RecordBatch:
    file, at, value = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(file, pa.string()), pa.array(at, pa.int64()), pa.array(value, pa.string())], names=["file", "at", "value"])


def whole(system: fs.FileSystem, file: fs.FileInfo) -> int:
    """The place after the last line end of a file, found from its end."""
    with system.open_input_file(file.path) as opened_file:
        end, step = file.size, 1 << 16
        while end > 0:
            start = max(0, end - step)
            opened_file.seek(start)
            if (at := opened_file.read(end - start).rfind(b"\n")) >= 0:
                return start + at + 1
            end = start
    return 0


class DeltaLines(DataSource):
    """spark.readStream.format("delta_lines").load(folder): file, at (byte where the line begins), value.
    Option newest: so many files, the last by name; what older ones get later is left out."""

    @classmethod
    def name(cls) -> str:
        return "delta_lines"

    def schema(self) -> str:
        return "file string, at long, value string"

    def streamReader(self, schema) -> LineReader:
        return LineReader(self.options["path"], int(self.options.get("newest", 0)))


def register(spark: SparkSession) -> None:
    """Makes both sources known to the session and lets filters reach them."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(StoredPayloads)
    spark.dataSource.register(DeltaLines)


def write_envelopes(payloads: DataFrame, folder: str) -> None:
    """provider, slug and envelope (JSON) as the folder that stored_payloads reads, a file a slug and task."""
    payloads.select("provider", "slug", "envelope").repartition("provider", "slug").write.partitionBy("provider", "slug").text(folder)


def newest_listed(rows: DataFrame) -> DataFrame:
    """Of each posting the row of the payload fetched last."""
    order = Window.partitionBy("provider", "slug", "source_job_id").orderBy(F.desc("fetched_at"))
    return rows.where("kind = 'listed' AND error IS NULL").withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r", "kind", "error")


def with_details(rows: DataFrame) -> DataFrame:
    """The newest listed postings, with the description of their page where the list has none, and link:
    what the page said last (live, dead, transient), or unverified without one."""
    key = ["provider", "slug", "source_job_id"]
    details = rows.where("kind = 'detail'").groupBy(*key).agg(F.max_by(F.struct("status", "description"), "fetched_at").alias("_d"), F.max_by("description", F.when(F.col("description") != "", F.col("fetched_at"))).alias("_text"))
    said = F.when(F.col("_d.status") == 200, "live").when(F.col("_d.status").isin(404, 410), "dead").when(F.col("_d.status").isNotNull(), "transient").otherwise("unverified")
    listed = newest_listed(rows).join(details, key, "left")
    return listed.withColumn("description", F.coalesce(F.nullif("description", F.lit("")), "_text")).withColumn("link", said).drop("_d", "_text")


def write_lines(rows: DataFrame, folder: str, file: str, order: str, value: str) -> None:
    """The files of delta_lines: each named by the column file, with all its lines in order.  A file is
    put in its place whole, so a task done again leaves the same; lines written later come after those
    that were there if order says so."""

    def put(batches):
        system, root = opened(folder)
        system.create_dir(root, recursive=True)
        name = out = None
        held = f"{root}/.{uuid.uuid4().hex}"

        def finish():
            out.close()
            system.move(held, f"{root}/{name}")

        for got in batches:
            for own, text in zip(got.column(0).to_pylist(), got.column(1).to_pylist()):
                if own != name:
                    if out is not None:
                        finish()
                    name, out = own, system.open_output_stream(held)
                out.write(text.encode() + b"\n")
        if out is not None:
            finish()
        yield pa.RecordBatch.from_arrays([pa.array([name], pa.string())], names=["last"])

    sorted_rows = rows.repartition(F.col(file)).sortWithinPartitions(file, order).select(F.col(file).alias("f"), F.col(value).alias("v"))
    sorted_rows.mapInArrow(put, "last string").write.format("noop").mode("overwrite").save()
