"""Operator 11: ranked lexical search by sort-based accumulation.

1. Documents are cut into terms where they are read; of each, its length and the places and counts
   of the terms that some item asks for are written once (postings by document).
2. Number and length of the documents and each asked term's document frequency are summed.
3. Each task takes a range of the documents.  For every posting, an entry (item, document, impact)
   is made for each item that asks for the term; the arrays are put together, the packed keys are
   radix sorted by 16-bit digits (entries come in document order, so only the item's digits are
   left to sort), and runs of equal keys are summed by reduceat.  As a document is whole in its
   task, so are its scores.  A heap an item keeps the best k of the task.
4. The tasks' best are range-partitioned by item and part, heap-selected again, and ranked.

Items are taken in blocks of ITEM_BYTES of text, a pass over the documents each, so what goes to
the tasks has a bound.  Null texts have no terms: such a document is not counted and such an item
has no rows.  Rows without an id are left out; rows that repeat an item_id ask for all their terms
together; every other row of documents is a document, repeated rows as often as they come; other
columns are ignored.  Ties go to the smaller doc_id.  Without items or documents the result is empty.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import grams as g
from .staging import by_id, filled, saved

#: Letters and digits of ASCII (capitals as small ones) and every byte of other characters; the rest separates.
TERM = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
#: Bytes of items to a pass, entries sorted at once, and parts of an item's candidates.
ITEM_BYTES, ENTRIES, PARTS = 4 << 20, 1 << 20, 64
SCALE = 10**9


def terms(text: bytes) -> list[bytes]:
    return text.translate(TERM).split()


def radix_order(keys: np.ndarray, low: int, high: int) -> np.ndarray:
    """Order by the bits from low to high, least digit first; numpy sorts 16-bit numbers by radix."""
    order = np.arange(len(keys))
    for shift in range(low, high, 16):
        digit = ((keys >> shift) & 0xFFFF).astype(np.uint16)
        order = order[np.argsort(digit[order], kind="stable")]
    return order


class Best:
    """The k best (score, then the smaller id) of each item so far, in heaps with the least on top."""

    def __init__(self, k: int):
        self.k, self.heaps = k, {}

    def take(self, item: int, doc: np.ndarray, score: np.ndarray) -> None:
        heap = self.heaps.setdefault(item, [])
        least = heap[0][0] if len(heap) == self.k else 1
        if len(score) > self.k:
            least = max(least, int(np.partition(score, len(score) - self.k)[len(score) - self.k]))
        keep = np.flatnonzero(score >= least)
        for entry in zip(score[keep].tolist(), (-doc[keep]).tolist()):
            if len(heap) < self.k:
                heapq.heappush(heap, entry)
            elif entry > heap[0]:
                heapq.heapreplace(heap, entry)

    def rows(self) -> tuple[list, list, list]:
        out = [(item, -doc, score) for item, heap in self.heaps.items() for score, doc in heap]
        item, doc, score = zip(*out) if out else ((), (), ())
        return list(item), list(doc), list(score)


def accumulated(term: np.ndarray, count: np.ndarray, impact: np.ndarray, start: np.ndarray, asking: np.ndarray):
    """(item, document, score), by item: postings with their impacts, count of them a document, meet
    the items that ask for their term (asking[start[t]:start[t + 1]])."""
    doc = np.repeat(np.arange(len(count)), count)
    run, place = g.expand(start[term + 1] - start[term])
    if not len(run):
        return
    low = max(1, int(len(count) - 1).bit_length())
    key = (asking[start[term][run] + place] << low) | doc[run]
    order = radix_order(key, low, low + max(1, int(asking.max()).bit_length()))
    key = key[order]
    edge = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    score = np.add.reduceat(impact[run][order], edge)
    item, doc = key[edge] >> low, key[edge] & ((1 << low) - 1)
    cut = np.flatnonzero(np.r_[True, item[1:] != item[:-1], True])
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
        yield int(item[a]), doc[a:b], score[a:b]


def matched(docs: DataFrame, asked: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, term, tf) of the documents with a term: those asked for and their counts, as 32-bit numbers."""

    def run(batches):
        get = asked.get
        for batch in batches:
            ids, n, term, tf = [], [], [], []
            for i, text in zip(batch.column(0).to_pylist(), filled(batch.column(1)).cast(pa.large_binary())):
                own = terms(text.as_py())
                if own:
                    hit = [t for t in map(get, own) if t is not None]
                    known, count = np.unique(np.array(hit, "<i4"), return_counts=True)
                    ids.append(i)
                    n.append(len(own))
                    term.append(known.tobytes())
                    tf.append(count.astype("<i4").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(term, pa.binary()), pa.array(tf, pa.binary())], names=["doc_id", "n", "term", "tf"])

    return docs.mapInArrow(run, "doc_id long, n long, term binary, tf binary")


def numbers(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i4").astype(np.int64)


def frequencies(postings: DataFrame, asked: int) -> np.ndarray:
    """Documents that hold each asked term."""

    def run(batches):
        count = np.zeros(asked, np.int64)
        for batch in batches:
            count += np.bincount(numbers(batch.column(0)), minlength=asked)
        used = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(count[used], pa.int64())], names=["term", "df"])

    df = np.zeros(asked, np.int64)
    for t, n in postings.select("term").mapInArrow(run, "term int, df long").groupBy("term").agg(F.sum("df")).collect():
        df[t] = n
    return df


def block_of(docs: DataFrame, texts: dict[int, set[bytes]], k: int) -> DataFrame:
    """(item_id, doc_id, score, part): each task's best for the items of a block."""
    items = sorted(texts)
    asked = {t: i for i, t in enumerate(sorted(set().union(*texts.values())))}
    pairs = np.array(sorted((asked[t], i) for i, item in enumerate(items) for t in texts[item]), np.int64).reshape(-1, 2)
    start, asking = np.searchsorted(pairs[:, 0], np.arange(len(asked) + 1)), pairs[:, 1]
    postings = saved(matched(docs, asked), "postings")
    total = postings.agg(F.count("*").alias("docs"), F.sum("n").alias("length")).first()
    count, length = total["docs"], total["length"] or 0
    df = frequencies(postings, len(asked))
    weight = np.array([math.floor(1000 * math.log((2 * count + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)

    def run(batches):
        from pyspark import TaskContext

        best = Best(k)
        for batch in batches:
            ids, n = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            held = np.array([len(b.as_py()) // 4 for b in batch.column(2)], np.int64)
            term, tf = numbers(batch.column(2)), numbers(batch.column(3))
            if 50 * int(n.max(initial=0)) * count < 2**63:
                m = 50 + 50 * n * count // length
            else:
                m = np.array([50 + 50 * v * count // length for v in n.tolist()], np.int64)
            impact = weight[term] * (SCALE * tf // (1000 * tf + 20 * np.repeat(m, held)))
            first = np.r_[0, np.cumsum(held)]
            entries = np.r_[0, np.cumsum(start[term + 1] - start[term])][first]
            for a, b in g.parts(entries, ENTRIES):
                own = slice(first[a], first[b])
                for item, doc, score in accumulated(term[own], held[a:b], impact[own], start, asking):
                    best.take(item, ids[a:b][doc], score)
        item, doc, score = best.rows()
        part = TaskContext.get().partitionId() % PARTS
        yield pa.RecordBatch.from_arrays([pa.array([items[i] for i in item], pa.int64()), pa.array(doc, pa.int64()), pa.array(score, pa.int64()), pa.array([part] * len(item), pa.int32())], names=["item_id", "doc_id", "score", "part"])

    return postings.mapInArrow(run, "item_id long, doc_id long, score long, part int")


def selected(found: DataFrame, k: int) -> DataFrame:
    """The k best of each item in each range of items and parts."""

    def run(batches):
        best = Best(k)
        for batch in batches:
            item, doc, score = (batch.column(c).to_numpy() for c in range(3))
            order = np.argsort(item, kind="stable")
            cut = np.flatnonzero(np.r_[True, item[order][1:] != item[order][:-1], True]) if len(item) else np.zeros(1, np.int64)
            for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
                best.take(int(item[order[a]]), doc[order[a:b]], score[order[a:b]])
        item, doc, score = best.rows()
        yield pa.RecordBatch.from_arrays([pa.array(item, pa.int64()), pa.array(doc, pa.int64()), pa.array(score, pa.int64())], names=["item_id", "doc_id", "score"])

    return found.repartitionByRange("item_id", "part").select("item_id", "doc_id", "score").mapInArrow(run, "item_id long, doc_id long, score long")


def ranked(docs: DataFrame, items: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the k documents of the highest score above 0 for each item."""
    rows, asked = by_id(docs, id_col, text_col), by_id(items, item_col, item_text)
    size = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks, found = -(-size // ITEM_BYTES), None
    for block in range(blocks):
        texts: dict[int, set[bytes]] = {}
        for r in asked.where(F.pmod(F.xxhash64("doc_id"), F.lit(blocks)) == block).where("text IS NOT NULL").toLocalIterator():
            texts.setdefault(r["doc_id"], set()).update(terms(r["text"].encode()))
        own = saved(block_of(rows, texts, k), "found") if any(texts.values()) else None
        found = own if found is None else found if own is None else found.union(own)
    if found is None:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    return selected(found, k).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
