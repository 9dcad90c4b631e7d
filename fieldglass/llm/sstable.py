"""Operator 4: token ids in sorted-string-table shards.

A shard holds documents in ascending order of id.  Layout, all numbers little-endian:

    blocks   entries of about BLOCK_BYTES: varint shared, varint rest, varint tokens, rest of the
             key, the ids.  The key is the doc_id in 8 bytes, big-endian with the sign bit turned,
             so bytes sort as numbers do; shared counts the bytes that repeat the key before it,
             and is 0 at a block's start.
    index    for each block: first key (8 bytes), offset and length (u64 each)
    filter   Bloom filter of the keys: BITS bits a key, HASHES hashes
    footer   FOOTER: places of index and filter, numbers of blocks, documents and ids, width, magic

Ids take 2 bytes where the vocabulary allows, else 4.  Texts are encoded where they lie; only doc_ids
and packed ids are shuffled, once, to ranges cut by a sample of doc_ids of bounded size; a range fills
as many shards as it needs, so the plan and what the driver holds do not grow with their number.

Repeated doc_ids are entries of their own, ordered by the crc32 of their packed ids; an id so frequent
that several cuts fall on it fills several shards.  Rows without a doc_id are left out; null
and empty texts hold only the end id; other columns are ignored; an empty table writes no shard.
Files are named once per attempt, and only those that finished tasks report are read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import files
from . import grams as g
from .staging import by_id, new_folder, partitions_for, saved
from .tokens import default_tokenizer, encoded_flat, largest_id, library_words

BLOCK_BYTES, BITS, HASHES = 1 << 16, 10, 7
FOOTER = struct.Struct("<QQQQQQB7s")
MAGIC = b"FGSST01"
#: Ids in the sample that ranges are cut by, ranges at most, and bytes after which a range goes on in another shard.
SAMPLE, MOST_RANGES, SHARD_BYTES = 1 << 17, 1 << 16, 64 << 20
SHARDS = "shard long, path string, first long, last long, documents long, tokens long, bytes long"


def key_of(doc_id: int) -> bytes:
    return struct.pack(">Q", (doc_id + (1 << 63)) & ((1 << 64) - 1))


def id_of(key: bytes) -> int:
    return struct.unpack(">Q", key)[0] - (1 << 63)


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def read_varint(data, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def bloom_places(ids: np.ndarray, bits: int) -> np.ndarray:
    one = g.mix(ids.astype(np.int64).view(np.uint64))
    two = g.mix(one ^ np.uint64(0x5851F42D4C957F2D)) | np.uint64(1)
    return (one[:, None] + np.arange(HASHES, dtype=np.uint64) * two[:, None]) % np.uint64(bits)


class ShardWriter:
    """Takes documents in ascending order."""

    def __init__(self, out, width: int):
        self.out, self.width, self.at = out, width, 0
        self.block, self.before, self.first = bytearray(), b"", None
        self.index, self.ids, self.tokens = [], [], 0

    def add(self, doc_id: int, ids: np.ndarray) -> None:
        key, shared = key_of(doc_id), 0
        if self.block:
            while shared < 8 and key[shared] == self.before[shared]:
                shared += 1
        else:
            self.first = key
        self.block += varint(shared) + varint(8 - shared) + varint(len(ids)) + key[shared:] + ids.astype(f"<u{self.width}").tobytes()
        self.before = key
        self.ids.append(doc_id)
        self.tokens += len(ids)
        if len(self.block) >= BLOCK_BYTES:
            self.flush()

    def flush(self) -> None:
        if self.block:
            self.out.write(bytes(self.block))
            self.index.append(self.first + struct.pack("<QQ", self.at, len(self.block)))
            self.at += len(self.block)
            self.block = bytearray()

    def close(self) -> int:
        self.flush()
        bits = max(64, BITS * len(self.ids))
        bloom = np.zeros(-(-bits // 8), np.uint8)
        ids = np.array(self.ids, np.int64)
        for a in range(0, len(ids), 1 << 16):
            places = bloom_places(ids[a : a + (1 << 16)], bits).ravel().astype(np.int64)
            np.bitwise_or.at(bloom, places >> 3, (1 << (places & 7)).astype(np.uint8))
        index = b"".join(self.index)
        self.out.write(index + bloom.tobytes() + FOOTER.pack(self.at, self.at + len(index), bits, len(self.index), len(ids), self.tokens, self.width, MAGIC))
        self.out.close()
        return self.at + len(index) + len(bloom) + FOOTER.size


class Shard:
    """Reads one shard; blocks are read as they are asked for."""

    def __init__(self, uri: str):
        self.file = files.reader(uri)
        size = self.file.size()
        self.file.seek(size - FOOTER.size)
        index, bloom, self.bits, blocks, self.documents, self.tokens, self.width, magic = FOOTER.unpack(self.file.read(FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"{uri} is no shard")
        self.file.seek(index)
        raw = self.file.read(bloom - index)
        self.keys = [raw[i * 24 : i * 24 + 8] for i in range(blocks)]
        self.places = [struct.unpack_from("<QQ", raw, i * 24 + 8) for i in range(blocks)]
        self.bloom = np.frombuffer(self.file.read(size - FOOTER.size - bloom), np.uint8)

    def entries(self, block: int) -> Iterator[tuple[int, np.ndarray]]:
        offset, length = self.places[block]
        self.file.seek(offset)
        data, at, key = self.file.read(length), 0, b""
        while at < length:
            shared, at = read_varint(data, at)
            rest, at = read_varint(data, at)
            n, at = read_varint(data, at)
            key = key[:shared] + data[at : at + rest]
            at += rest
            yield id_of(key), np.frombuffer(data, f"<u{self.width}", n, at)
            at += n * self.width

    def scan(self) -> Iterator[tuple[int, np.ndarray]]:
        for b in range(len(self.places)):
            yield from self.entries(b)

    def get(self, doc_id: int) -> list[np.ndarray]:
        """The ids of every entry of a document: Bloom filter, binary search in the index, scan of a block."""
        places = bloom_places(np.array([doc_id], np.int64), self.bits)[0].astype(np.int64)
        if not (self.bloom[places >> 3] >> (places & 7) & 1).all():
            return []
        import bisect

        key, out = key_of(doc_id), []
        block = max(0, bisect.bisect_left(self.keys, key) - 1)
        while block < len(self.keys) and self.keys[block] <= key:
            out += [ids for d, ids in self.entries(block) if d == doc_id]
            block += 1
        return out


def id_cuts(rows: DataFrame, parts: int) -> np.ndarray:
    """parts - 1 ids at about equal shares of the rows, from a sample of some SAMPLE ids."""
    if parts == 1 or not (n := rows.count()):
        return np.zeros(0, np.int64)
    some = rows.select("doc_id") if n <= SAMPLE else rows.select("doc_id").sample(SAMPLE / n, seed=7)
    ids = np.sort(some.toPandas()["doc_id"].to_numpy(np.int64))
    return ids[np.arange(1, parts) * len(ids) // parts] if len(ids) else ids


def write_shards(docs: DataFrame, tokenizer: str | None = None, end: int = 2, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes every text, appends the end id and writes shards that follow each other in doc_id.
    Returns one row a shard, with the number of ids in the shards before it (start)."""
    path, folder = tokenizer or default_tokenizer(), folder or new_folder(docs.sparkSession, "shards")

    width = 2 if max(largest_id(path), end) < 1 << 16 else 4

    parts = min(partitions_for(docs, text_col), MOST_RANGES)
    rows = by_id(docs, id_col, text_col)
    cuts = id_cuts(rows, parts)

    def encode(batches):
        words = library_words(path)
        for batch in batches:
            ids = batch["doc_id"].to_numpy()
            for a, flat, bounds, _, _ in encoded_flat(batch["text"], words, end):
                own, flat = ids[a : a + len(bounds) - 1], flat.astype(f"<u{width}")
                crc = np.array([zlib.crc32(flat[x:y]) for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist())], np.int64)
                low, high = np.searchsorted(cuts, own, "left"), np.searchsorted(cuts, own, "right")
                part = low + crc * (high - low + 1) // (1 << 32)
                packed = pa.Array.from_buffers(pa.large_binary(), len(own), [None, pa.py_buffer((bounds * width).astype(np.int64)), pa.py_buffer(flat)])
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(own, pa.int64()), pa.array(crc, pa.int64()), packed.cast(pa.binary())], ["part", "doc_id", "crc", "ids"])

    def write(batches):
        out = None
        shard = first = last = number = None

        def finished():
            size = out.close()
            return pa.RecordBatch.from_arrays([pa.array([shard << 32 | number], pa.int64()), pa.array([uri]), *(pa.array([x], pa.int64()) for x in (first, last, len(out.ids), out.tokens, size))], [f.split()[0] for f in SHARDS.split(", ")])

        for batch in batches:
            for part, d, x in zip(batch["part"].to_pylist(), batch["doc_id"].to_pylist(), batch["ids"]):
                if part != shard or out.at >= SHARD_BYTES:
                    if out is not None:
                        yield finished()
                    uri = files.new_file(folder, ".sst")
                    number = number + 1 if part == shard else 0
                    out, shard, first = ShardWriter(files.writer(uri), width), part, d
                out.add(d, np.frombuffer(x.as_buffer(), f"<u{width}"))
                last = d
        if out is not None:
            yield finished()

    ranged = rows.mapInArrow(encode, "part int, doc_id long, crc long, ids binary").repartitionById(parts, "part")
    shards = saved(ranged.sortWithinPartitions("part", "doc_id", "crc", "ids").drop("crc").mapInArrow(write, SHARDS), "manifest")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return shards.withColumn("start", F.coalesce(F.sum("tokens").over(before), F.lit(0)))


def read_shards(shards: DataFrame) -> DataFrame:
    """One row a document: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""

    def told(out):
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    def read(batches):
        for batch in batches:
            for uri, at in zip(batch["path"].to_pylist(), batch["start"].to_pylist()):
                out = []
                for d, ids in Shard(uri).scan():
                    out.append((d, at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    at += len(ids)
                    if len(out) == 10_000:
                        yield told(out)
                        out = []
                if out:
                    yield told(out)

    n = int(shards.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return shards.select("path", "start").repartition(n, "path").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def lookup(shards: DataFrame, wanted: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """doc_id and ids of the wanted documents.  Each id goes to the shards whose range holds it."""
    asked = wanted.select(F.col(id_col).cast("long").alias("doc_id")).where("doc_id IS NOT NULL").distinct()
    held = asked.join(shards.select("path", "first", "last"), F.col("doc_id").between(F.col("first"), F.col("last")))

    def find(key, table):
        shard = Shard(key[0].as_py())
        got = [(d, ids.astype(np.int64).tolist()) for d in sorted(table["doc_id"].to_pylist()) for ids in shard.get(d)]
        return pa.table({"doc_id": pa.array([d for d, _ in got], pa.int64()), "ids": pa.array([x for _, x in got], pa.list_(pa.int64()))})

    return held.groupBy("path").applyInArrow(find, "doc_id long, ids array<long>")
