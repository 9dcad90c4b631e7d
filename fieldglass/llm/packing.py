"""Operator 9: packing documents into windows by best-fit decreasing.

Overlong documents are first cut into full windows; what remains of them and all other documents
are dealt into groups of about GROUP windows' tokens and packed there, longest first, each into the
open window with the least room that still holds it.  A segment tree over the remaining capacities
finds that window.  A group leaves at most about one window part empty, so what is padded does not
depend on how many groups there are.

Null and empty texts are documents of the end id alone; repeated rows are documents of their own;
rows without a doc_id are left out; other columns are ignored.  An empty table gives no pieces.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import by_id, saved
from .tokens import default_tokenizer, encoded, library_words

GROUP = 1024
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, row long"


class OpenWindows:
    """Open windows by remaining capacity, in a segment tree that counts them."""

    def __init__(self, window: int):
        self.leaves = 1
        while self.leaves <= window:
            self.leaves *= 2
        self.count = [0] * (2 * self.leaves)
        self.at: dict[int, list[int]] = {}

    def put(self, room: int, which: int) -> None:
        self.at.setdefault(room, []).append(which)
        node = self.leaves + room
        while node:
            self.count[node] += 1
            node >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """The window with the least room >= need, taken out: (window, its room)."""
        node = self.leaves + need
        if not self.count[node]:
            while node > 1 and (node & 1 or not self.count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if self.count[2 * node] else 2 * node + 1
        room = node - self.leaves
        which = self.at[room].pop()
        while node:
            self.count[node] -= 1
            node >>= 1
        return which, room


def best_fit(lengths: list[int], window: int) -> list[tuple[int, int]]:
    """(window, offset) of each piece; lengths descend."""
    open_windows, out, n = OpenWindows(window), [], 0
    for length in lengths:
        got = open_windows.take(length)
        which, room = got if got else (n, window)
        n += got is None
        out.append((which, window - room))
        if room > length:
            open_windows.put(room - length, which)
    return out


def pack(docs: DataFrame, window: int = 4096, tokenizer: str | None = None, end: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a piece: doc_id, start (its document's ids before it), length, ids_crc32, doc_tokens,
    sequence_id and offset there."""
    path = tokenizer or default_tokenizer()

    def cut(batches):
        from pyspark import TaskContext

        words, row = library_words(path), TaskContext.get().partitionId() << 40
        for batch in batches:
            ids = batch["doc_id"].to_numpy().tolist()
            for a, texts, _, _ in encoded(batch["text"], words, end):
                out = []
                for d, x in zip(ids[a:], texts):
                    for s in range(0, len(x), window):
                        piece = x[s : s + window]
                        out.append((d, s, len(piece), zlib.crc32(piece.astype("<u4").tobytes()), len(x), row))
                        row += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "row"])

    pieces = saved(by_id(docs, id_col, text_col).mapInArrow(cut, PIECES), "pieces")
    total = pieces.agg(F.sum("length")).first()[0] or 0
    groups = max(1, -(-total // (GROUP * window)))

    def fit(key, table):
        order = np.lexsort((table["row"].to_numpy(), -table["length"].to_numpy()))
        table = table.take(pa.array(order))
        placed = best_fit(table["length"].to_pylist(), window)
        group = key[0].as_py() << 32
        out = table.select(["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
        out = out.append_column("sequence_id", pa.array([group + w for w, _ in placed], pa.int64()))
        return out.append_column("offset", pa.array([o for _, o in placed], pa.int64()))

    dealt = pieces.withColumn("bin_group", F.pmod(F.xxhash64("row", "start"), F.lit(groups)).cast("long"))
    return dealt.groupBy("bin_group").applyInArrow(lambda key, t: fit(key, t), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
