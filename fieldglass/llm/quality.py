"""Operator 5: quality rules by distribution divergence.

Two histograms of each document are compared with those of a language: characters over the classes
of CLASSES, and words (in lower case, told apart by 64-bit hashes) over the COMMON most frequent
words of the language and the rest.  The references are counted over all documents that pass the
base rules.  The distance is Jensen-Shannon's (the square root of the divergence in bits, 0 to 1).  A
document is judged only if it has enough words.  It is compared with its own language first and, if
it is far from that, with the others one at a time; it fails only if no language is near in both
distances, so a text under a wrong label stays.

Languages are the values of the language column; null is a language of its own.  Those with less
than one in SHARE of all words, or with fewer than LEAST_WORDS (too few to tell a language by), have
no reference of their own, so there are SHARE references at most; their documents are compared first
with the pooled reference of all documents.  Null and empty
texts have no words: they fail the base rules, as all with fewer than min_words do.  Repeated rows
and doc_ids are judged each on its own; rows without a doc_id are left out of the result; other
columns are ignored.  An empty table gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import grams as g
from .staging import filled, saved

CLASSES = ("lower", "upper", "digit", "space", "stop", "mark", "symbol", "control", "beyond ASCII")
COMMON, SHARE, LEAST_WORDS = 64, 1000, 2000
#: Distinct words that a task holds before it hands on their counts.
HELD = 1 << 18
PART_BYTES = 1 << 20
SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, chars_distance double, words_distance double, kept boolean"


@dataclass(frozen=True)
class Rules:
    min_words: int = 10
    repeat_percent: int = 20
    judged_words: int = 50  # fewer are not compared
    most_chars_distance: float = 0.30
    most_words_distance: float = 0.50


def class_table() -> np.ndarray:
    """Class of each byte; bytes that continue a character count as none (9)."""
    out = np.full(256, 6)
    for chars, k in ((range(97, 123), 0), (range(65, 91), 1), (range(48, 58), 2), ((9, 10, 11, 12, 13, 32), 3), (b".,;:!?", 4), (b"'\"()-", 5), ([*range(9), *range(14, 32), 127], 7), (range(0xC0, 256), 8), (range(0x80, 0xC0), 9)):
        out[list(chars)] = k
    return out


CLASS = class_table()
SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True


class Texts:
    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets, self.n = data, offsets, len(offsets) - 1
        self.starts, self.ends, self.bounds = g.words(data, offsets)
        self.words = np.diff(self.bounds)
        self.prefix = g.sums(g.BYTES[data])
        self.hash = g.span_hash(self.prefix, self.starts, self.ends)
        self.word_doc = np.repeat(np.arange(self.n), self.words)
        self.word = g.word_hashes(g.LOWER[data], self.starts, self.ends)

    def per_doc(self, flags: np.ndarray) -> np.ndarray:
        total = np.r_[0, np.cumsum(flags)]
        return total[self.offsets[1:]] - total[self.offsets[:-1]]

    def classes(self) -> np.ndarray:
        doc = np.repeat(np.arange(self.n), np.diff(self.offsets))
        return np.bincount(doc * 10 + CLASS[self.data], minlength=self.n * 10).reshape(self.n, 10)[:, : len(CLASSES)]

    def dup_lines(self) -> np.ndarray:
        """Lines with a word that are equal to an earlier line."""
        if not len(self.data):
            return np.zeros(self.n, np.int64)
        newline = np.flatnonzero(self.data == 10)
        cuts = np.unique(np.concatenate([self.offsets, newline, newline + 1]))
        first, last = cuts[:-1], cuts[1:]
        line = self.data[first] != 10
        first, last = first[line], last[line]
        doc = np.searchsorted(self.offsets, first, "right") - 1
        said = np.searchsorted(self.starts, last) > np.searchsorted(self.starts, first)
        first, last, doc = first[said], last[said], doc[said]
        h = g.span_hash(self.prefix, first, last)
        order = np.lexsort((h, doc))
        again = (h[order][1:] == h[order][:-1]) & (doc[order][1:] == doc[order][:-1])
        return np.bincount(doc[order][1:][again], minlength=self.n)

    def repeat_words(self, k: int = 5) -> np.ndarray:
        """Words in windows of k words that the text has twice or more."""
        h = g.gram_hashes(self.hash, k)
        doc = self.word_doc[: len(h)]
        at = np.flatnonzero(np.arange(len(h)) + k <= self.bounds[doc + 1]) if len(h) else np.zeros(0, np.int64)
        h, doc = h[at], doc[at]
        order = np.lexsort((h, doc))
        same = np.r_[(h[order][1:] == h[order][:-1]) & (doc[order][1:] == doc[order][:-1]), False]
        twice = at[order[same | np.r_[False, same[:-1]]]] if len(at) else at
        edge = np.zeros(len(self.hash) + 1, np.int64)
        np.add.at(edge, twice, 1)
        np.add.at(edge, np.minimum(twice + k, len(self.hash)), -1)
        return np.bincount(self.word_doc[np.cumsum(edge[:-1]) > 0], minlength=self.n)


def texts_of(column):
    data, offsets = g.bytes_of(filled(column))
    for a, b in g.parts(offsets, PART_BYTES):
        yield a, b, Texts(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])


def distances(rows: np.ndarray, reference: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of each row of counts to the reference's."""
    p = rows / np.maximum(rows.sum(1, keepdims=True), 1)
    q = reference / max(reference.sum(), 1)
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        d = np.where(p > 0, p * np.log2(p / m), 0).sum(1) + np.where(q > 0, q * np.log2(q / m), 0).sum(1)
    return np.sqrt(np.clip(d / 2, 0, 1))


def base_rules(t: Texts, rules: Rules) -> tuple[np.ndarray, np.ndarray]:
    """Repeated words and base_failed of each text."""
    repeat = t.repeat_words()
    return repeat, (t.words < rules.min_words) | (100 * repeat > rules.repeat_percent * t.words)


@dataclass(frozen=True)
class Reference:
    key: str  # of KEY
    chars: np.ndarray  # counts of the classes
    words: np.ndarray  # hashes of the common words, ascending
    counts: np.ndarray  # theirs and, last, that of all other words


#: A language's key: a label can't be taken for null or for the pool.
POOL, NO_LABEL = "pool", "null"


def key_of(lang: str | None) -> str:
    return NO_LABEL if lang is None else "=" + lang


def references(docs: DataFrame, rules: Rules = Rules(), text_col: str = "text", lang_col: str = "lang") -> list[Reference]:
    """The pool's reference and those of the languages, over all documents that pass the base rules."""

    def count(batches):
        found: dict[str, list] = {}
        held = 0

        def rows():
            for key, (words, counts, classes) in found.items():
                word, at = np.unique(np.concatenate(words), return_inverse=True)
                n = np.bincount(at, np.concatenate(counts)).astype(np.int64)
                for a in range(0, len(word), 1 << 16):
                    k = len(word[a : a + (1 << 16)])
                    yield pa.RecordBatch.from_arrays([pa.array([key] * k), pa.array([False] * k), pa.array(word[a : a + k].view(np.int64)), pa.array(n[a : a + k])], ["key", "is_class", "word", "n"])
                k = np.flatnonzero(classes)
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(k), pa.string()), pa.array([True] * len(k), pa.bool_()), pa.array(k, pa.int64()), pa.array(classes[k])], ["key", "is_class", "word", "n"])

        for batch in batches:
            keys = np.array([key_of(x) for x in batch["lang"].to_pylist()], object)
            for a, b, t in texts_of(batch["text"]):
                passed, classes = ~base_rules(t, rules)[1], t.classes()
                for key in set(keys[a:b].tolist()):
                    own = passed & (keys[a:b] == key)
                    word, n = np.unique(t.word[own[t.word_doc]], return_counts=True)
                    words, counts, total = found.setdefault(key, [[], [], np.zeros(len(CLASSES), np.int64)])
                    words.append(word)
                    counts.append(n)
                    total += classes[own].sum(0)
                    held += len(word) + 64
                if held > 4 * HELD:
                    for x in found.values():
                        word, at = np.unique(np.concatenate(x[0]), return_inverse=True)
                        x[:2] = [word], [np.bincount(at, np.concatenate(x[1])).astype(np.int64)]
                    held = sum(len(x[0][0]) + 64 for x in found.values())
                if held > HELD:
                    yield from rows()
                    found, held = {}, 0
        yield from rows()

    counted = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).mapInArrow(count, "key string, is_class boolean, word long, n long")
    counted = saved(counted.groupBy("key", "is_class", "word").agg(F.sum("n").alias("n")), "words")
    sizes = counted.where("NOT is_class").groupBy("key").agg(F.sum("n").alias("words"))
    total = sizes.agg(F.sum("words")).first()[0] or 0
    sizes = {r.key: r.words for r in sizes.where((F.col("words") * SHARE >= total) & (F.col("words") >= LEAST_WORDS)).collect()} | {POOL: total}  # SHARE + 1 at most
    own = counted.where(F.col("key").isin(list(sizes)))
    pool = counted.groupBy("is_class", "word").agg(F.sum("n").alias("n")).select(F.lit(POOL).alias("key"), "is_class", "word", "n")
    either = own.unionByName(pool)
    # the most frequent of each share of the words, then of them
    part = F.pmod(F.xxhash64("word"), F.lit(1024))
    order = [F.desc("n"), F.asc("word")]
    some = either.where("NOT is_class").withColumn("r", F.row_number().over(Window.partitionBy("key", part).orderBy(*order))).where(F.col("r") <= COMMON)
    most = some.withColumn("r", F.row_number().over(Window.partitionBy("key").orderBy(*order))).where(F.col("r") <= COMMON).drop("r")
    rows = either.where("is_class").unionByName(most).collect()  # COMMON and the classes of each reference
    out = []
    for key, words in sorted(sizes.items()):
        common = sorted((r.word % (1 << 64), r.n) for r in rows if r.key == key and not r.is_class)
        chars = np.zeros(len(CLASSES))
        for r in rows:
            if r.key == key and r.is_class:
                chars[r.word] = r.n
        counts = np.array([n for _, n in common], float)
        out.append(Reference(key, chars, np.array([w for w, _ in common], np.uint64), np.r_[counts, words - counts.sum()]))
    return out


def both_distances(t: Texts, chars: np.ndarray, which: np.ndarray, to: Reference) -> tuple[np.ndarray, np.ndarray]:
    """Distances of characters and of words of some texts to a reference."""
    number = np.cumsum(which) - 1
    own = which[t.word_doc]
    word, doc, k = t.word[own], number[t.word_doc[own]], len(to.words)
    at = np.minimum(np.searchsorted(to.words, word), k - 1) if k else np.zeros(len(word), np.int64)
    place = np.where(to.words[at] == word, at, k) if k else at
    n = int(which.sum())
    words = np.bincount(doc * (k + 1) + place, minlength=n * (k + 1)).reshape(n, k + 1)
    return distances(chars[which], to.chars), distances(words, to.counts)


def verdicts(batch, known: list[Reference], rules: Rules):
    """(first, end, texts, repeated words, base_failed, both distances, kept) in parts of a batch with
    text and lang.  The distances are those to the nearest reference that was looked at."""
    at = {r.key: i for i, r in enumerate(known)}
    first = np.array([at.get(key_of(x), at[POOL]) for x in batch["lang"].to_pylist()], np.int64)
    for a, b, t in texts_of(batch["text"]):
        repeat, failed = base_rules(t, rules)
        chars, near_chars, near_words = t.classes(), np.ones(t.n), np.ones(t.n)

        def far():
            return np.maximum(near_chars / rules.most_chars_distance, near_words / rules.most_words_distance)

        def look(which, i):
            if which.any():
                c, w = both_distances(t, chars, which, known[i])
                closer = np.flatnonzero(which)[np.maximum(c / rules.most_chars_distance, w / rules.most_words_distance) < far()[which]]
                number = np.cumsum(which)[closer] - 1
                near_chars[closer], near_words[closer] = c[number], w[number]

        for i in set(first[a:b].tolist()):
            look(first[a:b] == i, i)
        judged = t.words >= rules.judged_words
        for i in range(len(known)):
            look(judged & (first[a:b] != i) & (far() > 1), i)
        yield a, b, t, repeat, failed, near_chars, near_words, ~failed & ~(judged & (far() > 1))


def judge(docs: DataFrame, rules: Rules = Rules(), id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", against=None) -> DataFrame:
    """Counts, distances to the nearest reference and verdict of every document.  against: references
    from elsewhere (the pool's among them) instead of those of docs."""
    known = references(docs, rules, text_col, lang_col) if against is None else against

    def run(batches):
        for batch in batches:
            ids = batch["doc_id"].to_numpy()
            for a, b, t, repeat, failed, near_chars, near_words, kept in verdicts(batch, known, rules):
                letters = ((t.data & 0xC0) != 0x80) & ~g.SPACE[t.data]
                counts = [ids[a:b], t.words, t.per_doc(letters), t.per_doc(SYMBOL[t.data]), t.dup_lines(), repeat]
                yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in counts), pa.array(failed), pa.array(near_chars), pa.array(near_words), pa.array(kept)], [f.split()[0] for f in SCHEMA.split(", ")])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where("doc_id IS NOT NULL")
    return rows.mapInArrow(run, SCHEMA)


def kept(docs: DataFrame, rules: Rules = Rules(), against=None) -> DataFrame:
    """The rows of documents (text, lang and any other columns) that pass, as they are."""
    known = references(docs, rules) if against is None else against

    def run(batches):
        for batch in batches:
            passed = [v[-1] for v in verdicts(batch, known, rules)]
            yield batch.filter(pa.array(np.concatenate(passed) if passed else np.zeros(0, bool)))

    return docs.mapInArrow(run, docs.schema)
