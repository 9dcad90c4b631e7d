"""An inverted index of stemmed terms, in blocks of postings that a search reads alone.

A posting block holds the ids of the documents with a term within a range of RANGE ids, ascending.
Blocks lie in folders by generation and by a hash of the term, sorted by term, so a search reads only
the folders, and in them the row groups, of the terms it asks for.  A search meets by query and range:
a task holds the blocks of a few terms over RANGE ids, never a whole list, and intersects them from
the shortest by galloping.

Changes do not rewrite blocks.  A batch of changed documents (old and new text, as change capture has
them) becomes a generation of its own with the ids that a term gains and loses; a search folds the
generations of its terms in order, and ``compacted`` folds all of them into one.  A batch written
again replaces its generation.

Null and empty texts have no terms.  A search without words finds nothing.  A term that is several
words (as of "node.js") must have them one after the other, which is checked on the texts found.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.stems import asked, stems

RANGE, HELD = 1 << 16, 1 << 20
BLOCKS = "term string, range long, ids array<long>, gone array<long>"


def blocks(changes: DataFrame) -> DataFrame:
    """doc_id, old and new text -> the blocks that gain and lose ids."""

    def run(batches):
        held: dict[tuple[str, int], tuple[list, list]] = {}
        size = 0
        for batch in batches:
            for doc, old, new in zip(*(c.to_pylist() for c in batch.columns)):
                was, now = set(stems(old)), set(stems(new))
                for k, terms in enumerate((now - was, was - now)):
                    size += len(terms)
                    for term in terms:
                        held.setdefault((term, doc // RANGE), ([], []))[k].append(doc)
            if size > HELD:
                yield told(held)
                held, size = {}, 0
        if held:
            yield told(held)

    def told(held):
        term, at = zip(*held)
        ids, gone = zip(*held.values())
        many = pa.list_(pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(term, pa.string()), pa.array(at, pa.int64()), pa.array(ids, many), pa.array(gone, many)], names=["term", "range", "ids", "gone"])

    found = changes.select(F.col("doc_id").cast("long"), "old", "new").where("doc_id IS NOT NULL").mapInArrow(run, BLOCKS)
    both = (F.array_sort(F.flatten(F.collect_list(c))).alias(c) for c in ("ids", "gone"))
    return found.groupBy("term", "range").agg(*both)


def write_generation(changes: DataFrame, path: str, generation: int, folders: int = 64) -> None:
    """Writes a batch of changes (doc_id, old, new) as a generation of the index at path; the first has no old texts."""
    rows = blocks(changes).withColumn("folder", (F.crc32(F.col("term").cast("binary")) % folders).cast("int"))
    rows.repartition("folder").sortWithinPartitions("folder", "term", "range").write.mode("overwrite").option("parquet.block.size", 4 << 20).partitionBy("folder").parquet(f"{path}/generation={generation}")


def blocks_of(spark: SparkSession, path: str, terms: list[str] | None = None, folders: int = 64) -> DataFrame:
    """The blocks of these terms (None: all) in every generation."""
    index = spark.read.schema(f"{BLOCKS}, generation int, folder int").parquet(path)
    if terms is None:
        return index
    return index.where(F.col("folder").isin(sorted({zlib.crc32(t.encode()) % folders for t in terms})) & F.col("term").isin(sorted(terms)))


def folded(parts: list[tuple[int, np.ndarray, np.ndarray]]) -> np.ndarray:
    """The ids that are left after generations (number, gained, lost), in order of their numbers."""
    have = np.zeros(0, np.int64)
    for _, gained, lost in sorted(parts, key=lambda p: p[0]):
        have = np.union1d(have[~np.isin(have, lost)] if len(lost) else have, gained)
    return have


def galloped(few: np.ndarray, many: np.ndarray, step: int = 64) -> np.ndarray:
    """Members of few that are in many, both ascending: runs of few are looked for from where the last
    ended, in a stretch of many that doubles until it holds the run."""
    out, low = [], 0
    for a in range(0, len(few), step):
        run, width = few[a : a + step], step
        while low + width < len(many) and many[low + width] < run[-1]:
            width *= 2
        stretch = many[low : low + width + 1]
        at = np.searchsorted(stretch, run)
        hit = at < len(stretch)
        hit[hit] = stretch[at[hit]] == run[hit]
        out.append(run[hit])
        low += int(at[-1])
        if low >= len(many):
            break
    return np.concatenate(out) if out else few[:0]


def search(spark: SparkSession, path: str, queries: dict[str, str], docs: DataFrame | None = None, folders: int = 64) -> DataFrame:
    """(query, doc_id) for each of the named searches whose terms the document has.  docs (doc_id, text): the
    present texts, read only where a term is several words."""
    wanted = {name: asked(said) for name, said in queries.items()}
    need = {name: sorted({s for t in terms for s in t}) for name, terms in wanted.items() if terms}
    pairs = [(name, s, len(all_)) for name, all_ in need.items() for s in all_]
    known = spark.createDataFrame(pairs, "query string, term string, need int")  # as many rows as the searches have words
    found = blocks_of(spark, path, [s for _, s, _ in pairs], folders).join(F.broadcast(known), "term").select("query", "range", "term", "generation", "ids", "gone", "need")

    def meet(key, table):
        of: dict[str, list] = {}
        for term, number, ids, gone in zip(*(table[c].to_pylist() for c in ("term", "generation", "ids", "gone"))):
            of.setdefault(term, []).append((number, np.array(ids, np.int64), np.array(gone, np.int64)))
        left = np.zeros(0, np.int64)
        if len(of) == table["need"][0].as_py():
            lists = sorted((folded(parts) for parts in of.values()), key=len)
            left = lists[0]
            for other in lists[1:]:
                left = galloped(left, other)
        return pa.table({"query": pa.array([key[0].as_py()] * len(left), pa.string()), "doc_id": pa.array(left, pa.int64())})

    hits = found.groupBy("query", "range").applyInArrow(meet, "query string, doc_id long")
    runs = {name: [t for t in terms if len(t) > 1] for name, terms in wanted.items()}
    if not any(runs.values()):
        return hits
    if docs is None:
        raise ValueError("terms of several words are checked on the texts: docs is needed")
    plain = hits.where(~F.col("query").isin([n for n, r in runs.items() if r]))
    checked = hits.where(F.col("query").isin([n for n, r in runs.items() if r])).join(docs.select("doc_id", "text"), "doc_id")
    return plain.unionByName(scanned(checked, runs))


def holds(own: list[str], run: list[str]) -> bool:
    return any(own[i : i + len(run)] == run for i in range(len(own) - len(run) + 1))


def scanned(rows: DataFrame, runs: dict[str, list[list[str]]]) -> DataFrame:
    """(query, doc_id) of the rows (query, doc_id, text) whose text has all runs of stems of its query."""

    def run(batches):
        for batch in batches:
            kept = [all(holds(own, r) for r in runs[q]) for q, own in zip(batch.column(0).to_pylist(), map(stems, batch.column(2).to_pylist()))]
            yield batch.filter(pa.array(kept, pa.bool_())).select(["query", "doc_id"])

    return rows.select("query", "doc_id", "text").mapInArrow(run, "query string, doc_id long")


def compacted(spark: SparkSession, path: str, to: str, folders: int = 64) -> None:
    """All generations at path folded into the first of a new index."""

    def fold(key, table):
        ids = folded([(n, np.array(i, np.int64), np.array(g, np.int64)) for n, i, g in zip(*(table[c].to_pylist() for c in ("generation", "ids", "gone")))])
        n = int(len(ids) > 0)
        return pa.table({"term": pa.array([key[0].as_py()] * n, pa.string()), "range": pa.array([key[1].as_py()] * n, pa.int64()), "ids": pa.array([ids] * n, pa.list_(pa.int64())), "gone": pa.array([[]] * n, pa.list_(pa.int64())), "folder": pa.array([zlib.crc32(key[0].as_py().encode()) % folders] * n, pa.int32())})

    rows = blocks_of(spark, path).groupBy("term", "range").applyInArrow(fold, f"{BLOCKS}, folder int")
    rows.repartition("folder").sortWithinPartitions("folder", "term", "range").write.mode("overwrite").partitionBy("folder").parquet(f"{to}/generation=0")
