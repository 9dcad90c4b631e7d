"""Operator 12: near-duplicates by SimHash, compared bit-sliced.

1. The fingerprint of a text has a bit for each of 64: 1 if it is set in over half of the XXH64
   values of its word shingles.  Texts are hashed where they are read, without a shuffle.
2. Equal fingerprints become one row with the least doc_id; all that follows sees distinct ones.
3. Fingerprints that differ in at most ``radius`` of 64 bits agree on all but ``radius`` parts of
   them, however the bits are cut in parts, so they meet in the list of some choice of parts.  The
   number of bits that a list is chosen by follows the number of fingerprints, so lists hold about
   LIST of them at any size.  A list of over BLOCK is cut in blocks, and each pair of blocks is a
   group of its own.
4. In a group the bit planes stand vertically: word w of plane b holds bit b of 64 fingerprints.  A
   block of others is compared with all of them plane by plane: the differing bits go into
   carry-save counters of a few bits a fingerprint, which overflow beyond the radius; what has
   overflowed everywhere is left, whole blocks as soon as nothing in them is near.
5. A group gives each fingerprint's least one reachable there, not its pairs; the components of
   those links are found over all of Spark.

Null and empty texts and texts without words have the fingerprint zero and link like any other;
texts with fewer words than a shingle are one shingle.  Rows without a doc_id are left out; every
other row gives a row, repeated rows as often as they come; other columns are ignored.  An empty
table gives an empty table.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .staging import by_id, filled, saved

U = np.uint64
SEED, BITS = 42, 64
#: Fingerprints that a list should hold, those of a block, and those compared with a block at once.
LIST, BLOCK, ROWS = 1024, 4096, 256
#: Shingles whose bits are counted at once.
COUNTED = 1 << 16


def shingle_hashes(text: bytes, n: int) -> np.ndarray:
    """XXH64 of every run of n words, lower-cased and joined by spaces."""
    words = text.lower().split()
    line, hashed = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= n:
        return np.array([hashed(line, SEED)] if words else [], U)
    length = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(length + 1) - 1
    spans = zip((end - length).tolist(), end[n - 1 :].tolist())
    return np.fromiter((hashed(line[a:b], SEED) for a, b in spans), U, len(words) - n + 1)


def bits(values: np.ndarray) -> np.ndarray:
    """Bit b of each value in column b."""
    return np.unpackbits(values.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def fingerprint(hashes: np.ndarray) -> int:
    """Bits that are set in over half of the hashes, as a signed number."""
    count = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), COUNTED):
        count += bits(hashes[at : at + COUNTED]).sum(0, dtype=np.int64)
    return int(np.packbits(2 * count > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, n: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp) of every row with an id."""

    def run(batches):
        for batch in batches:
            texts = filled(batch.column(1)).cast(pa.large_binary())
            found = [fingerprint(shingle_hashes(t.as_py(), n)) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], names=["doc_id", "fp"])

    return by_id(docs, id_col, text_col).mapInArrow(run, "doc_id long, fp long")


def masks(count: int, radius: int) -> list[int]:
    """The bits that choose a list, one mask a choice: values within the radius agree under one of them."""
    wanted = max(0, (max(count, 1) // LIST).bit_length() - 1)
    if not wanted:
        return [0]
    agree = 1
    while agree * (BITS // (radius + agree)) < wanted and radius + agree < 12:
        agree += 1
    width = BITS // (radius + agree)
    used = min(width, -(-wanted // agree))
    parts = [((1 << used) - 1) << (width * i) for i in range(radius + agree)]
    return [sum(chosen) for chosen in combinations(parts, agree)]


def signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def planes(values: np.ndarray) -> np.ndarray:
    """Row b: bit b of all values, 64 of them a word."""
    flat = np.zeros((BITS, -(-len(values) // 64) * 64), np.uint8)
    flat[:, : len(values)] = bits(values).T
    return np.packbits(flat, axis=1, bitorder="little").view("<u8")


def near(rows: np.ndarray, sliced: np.ndarray, count: int, radius: int):
    """(row, places) of the values within the radius of each row, for rows that have any.  A row's
    counters start so that they carry out at radius + 1; the carry sticks."""
    words = sliced.shape[1]
    unused = np.zeros(words * 64, np.uint8)
    unused[count:] = 1
    unused = np.packbits(unused, bitorder="little").view("<u8")
    flip = np.where(bits(rows) == 1, ~U(0), U(0))
    width = radius.bit_length()
    start = [~U(0) if (2**width - 1 - radius) >> i & 1 else U(0) for i in range(width)]
    row, word = np.arange(len(rows)), np.arange(words)
    counters = [np.full((len(rows), words), s, U) for s in start]
    over = np.repeat(unused[None, :], len(rows), axis=0)
    for b in range(BITS):
        carry = sliced[b, word][None, :] ^ flip[row, b][:, None]
        for i in range(width):
            counters[i], carry = counters[i] ^ carry, counters[i] & carry
        over |= carry
        if b > radius and b % 4 == 3:
            open_ = over != ~U(0)
            if not open_.any():
                return
            rows_left, words_left = open_.any(1), open_.any(0)
            if 2 * rows_left.sum() < len(row) or 2 * words_left.sum() < len(word):
                row, word = row[rows_left], word[words_left]
                over = over[np.ix_(rows_left, words_left)]
                counters = [c[np.ix_(rows_left, words_left)] for c in counters]
    for r, left in zip(row.tolist(), ~over):
        if left.any():
            at = np.flatnonzero(np.unpackbits(left.view(np.uint8), bitorder="little"))
            yield r, word[at // 64] * 64 + at % 64


def merged(label: np.ndarray, at: int, others: np.ndarray) -> None:
    """One label, the least, for a place and others, and for all that have their labels."""
    roots = np.unique(label[others])
    roots = np.unique(np.append(roots, label[at]))
    for root in roots[1:].tolist():
        label[label == root] = roots[0]


def links(distinct: DataFrame, radius: int) -> DataFrame:
    """(fp, rep) -> (a, b): links between reps that join all fingerprints within the radius."""
    chosen = masks(distinct.count(), radius)
    lists = F.explode(F.array(*(F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("key")) for t, m in enumerate(chosen))))
    members = distinct.select("fp", "rep", lists.alias("at")).select("fp", "rep", "at.t", "at.key")
    large = saved(members.groupBy("t", "key").count().where(F.col("count") > BLOCK), "large")
    members = members.join(large, ["t", "key"], "left").withColumn("blocks", F.coalesce(F.ceil(F.col("count") / BLOCK), F.lit(1)).cast("int"))
    members = members.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    members = members.select("t", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "fp", "rep")

    def compare(key, table):
        i, j = key[2].as_py(), key[3].as_py()
        table = table.sort_by("rep")
        fp, rep, own = (table[c].to_numpy() for c in ("fp", "rep", "own"))
        fp, label = fp.view(U), np.arange(len(fp))
        left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
        sliced = planes(fp[right])
        for at in range(0, len(left), ROWS):
            for r, places in near(fp[left[at : at + ROWS]], sliced, len(right), radius):
                merged(label, left[at + r], right[places])
        moved = label != np.arange(len(fp))
        return pa.table({"a": pa.array(rep[moved], pa.int64()), "b": pa.array(rep[label[moved]], pa.int64())})

    return members.groupBy("t", "key", "i", "j").applyInArrow(compare, "a long, b long")


def simhash_join(docs: DataFrame, n: int = 3, radius: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id: the smallest doc_id reachable over
    fingerprints that differ in at most radius bits."""
    rows = saved(fingerprints(docs, n, id_col, text_col), "fingerprints")
    distinct = saved(rows.groupBy("fp").agg(F.min("doc_id").alias("rep")), "distinct")
    classes = components(links(distinct, radius))
    named = distinct.join(classes, distinct.rep == classes.v, "left").select("fp", F.coalesce("label", "rep").alias("component_id"))
    return rows.join(saved(named, "named"), "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
