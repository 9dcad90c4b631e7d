"""Operator 8: personal data by patterns and by bootstrapped contexts.

Base spans come from four patterns (email, ip, card, phone) with their checks; they always stay.
They and the seeds of a fifth kind, secret, induce lexical patterns, which are the last word and the
last two words before a span (lower case, without marks).  A graph joins these contexts and the
instances found in them: the text of a span, or of another piece that looks like an identifier.
Spark scores it in rounds.  An instance is worth one minus the product of what its good contexts
lack; a context the confidence of its distinct instances over their number and that of all other
words that follow it anywhere in the corpus, so that a common word discovers nothing whatever seeds
it precedes.  Identifiers in contexts that end up worth enough, with enough distinct instances, are
spans of the kind that most seeds there have.  Copies of a text add no instance.

Secrets: keys of KEY's form are spans wherever they stand; hexadecimal pieces of SECRET's form are
seeds only, and spans where a context bears them out.

How often contexts occur is counted in a second pass over all texts.  It looks only for contexts
that could be good: they and their last words are marked in a bitmap of BITMAP bits, a fixed size, and what
the bitmap lets through too much a join drops.

Null and empty texts have no spans; repeated rows and doc_ids are searched each on its own; rows
without a doc_id are left out; other columns are ignored.  An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from bisect import bisect_left
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import by_id, numbered, saved, unused

KINDS = ("email", "ip", "card", "phone", "secret")
BASE = KINDS[:4]
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
MARKED = re.compile(r"[0-9@]+")
EDGES = "\"'()[]{}<>.,;:!?*#$%&|="
#: Rounds of scoring; least worth and least distinct instances of a context that discovers.
ROUNDS, WORTH, SUPPORT = 3, 0.6, 4
BITMAP = 1 << 22
PIECE = re.compile(r"[^\s\"'()\[\]{}<>,;!?*#$%&|=/]+")
KEY = re.compile("AKIA[0-9A-Z]{16}")
SECRET = re.compile("(?=[0-9]*[A-F])(?=[A-F]*[0-9])[0-9A-F]{16,}|(?=[0-9]*[a-f])(?=[a-f]*[0-9])[0-9a-f]{16,}")
SCHEMA = (
    "row long, doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, "
    "base array<struct<kind:int,start:long,end:long>>, near array<struct<kind:int,start:long,end:long,contexts:array<string>,instance:long>>"
)


def emails(text: str):
    """Matches from left to right.  What stands before an @ in one run of LOCAL starts the match."""
    at = done = 0
    while (at := text.find("@", at)) >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = at = m.end()
        else:
            at += 1


def luhn(digits: str) -> bool:
    total = sum(int(d) for d in digits[-1::-2])
    return (total + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) in code points, by kind and start."""
    out = [(0, a, b) for a, b in emails(text)]
    for m in IP.finditer(text):
        if all(len(x.lstrip("0")) <= 3 and int(x) <= 255 for x in m[0].split(".")):
            out.append((1, m.start(), m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() <= 40:
            digits = re.sub("[^0-9]", "", m[0])
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append((2, m.start(), m.end()))
    for m in PHONE.finditer(text):
        if 8 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
            out.append((3, m.start(), m.end()))
    return out


def words_of(text: str) -> list[tuple[int, int]]:
    """The pieces between white space and marks that are more than marks themselves."""
    return [(m.start() + len(w) - len(w.lstrip(EDGES)), m.start() + len(w.rstrip(EDGES))) for m in PIECE.finditer(text) if (w := m[0]).strip(EDGES)]


def identifiers(text: str, taken: list[tuple[int, int, int]], words: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """(kind or -1, start, end) of words with an @ or three digits that touch no base span."""
    spans = sorted((a, b) for _, a, b in taken)
    reach = list(np.maximum.accumulate([b for _, b in spans])) if spans else []
    begins = [a for a, _ in spans]
    out = []
    for a, b in words:
        token = text[a:b]
        if b - a < 5 or not MARKED.search(token) or ("@" not in token and sum(c.isdigit() for c in token) < 3):
            continue
        k = bisect_left(begins, b)
        if not k or reach[k - 1] <= a:
            out.append((4 if KEY.fullmatch(token) or SECRET.fullmatch(token) else -1, a, b))
    return out


def contexts_at(text: str, start: int, words: list[tuple[int, int]]) -> list[str]:
    """The last word and the last two words before a span."""
    k = bisect_left(words, (start, start))
    before = [w for a, b in words[max(0, k - 2) : k] if (w := text[a : min(b, start)].strip(EDGES).lower())]
    return [before[-1], *([" ".join(before)] if len(before) == 2 else [])] if before else []


def number(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode(), digest_size=8).digest(), "little", signed=True)


def found(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: base spans and keys, and spans and identifiers with their contexts (kind -1: no seed)."""

    def run(batches):
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            out = []
            for d, text in zip(batch["doc_id"].to_pylist(), batch["text"]):
                text = text.as_py() or ""
                spans = base_spans(text)
                words = words_of(text) if spans or MARKED.search(text) else []
                near = spans + identifiers(text, spans, words)
                sure = spans + [(k, a, b) for k, a, b in near[len(spans) :] if KEY.fullmatch(text[a:b])]
                near = [(k, a, b, contexts_at(text, a, words), number(text[a:b].lower())) for k, a, b in near]
                counts = [sum(k == x for k, _, _ in spans) for x in range(4)]
                said = ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)
                out.append((row, d, *counts, hashlib.sha256(said.encode()).hexdigest(), [dict(zip(("kind", "start", "end"), s)) for s in sure], [dict(zip(("kind", "start", "end", "contexts", "instance"), s)) for s in near if s[3]]))
                row += 1
            span = [("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64())]
            types = [*[pa.int64()] * 6, pa.string(), pa.list_(pa.struct(span)), pa.list_(pa.struct([*span, ("contexts", pa.list_(pa.string())), ("instance", pa.int64())]))]
            columns = zip(*out) if out else [[]] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], ["row", "doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "base", "near"])

    return by_id(docs, id_col, text_col).mapInArrow(run, SCHEMA)


def bit_of(word: str) -> int:
    return zlib.crc32(word.encode()) % BITMAP


def occurrences(docs: DataFrame, wanted: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(context, total): how often a word follows each wanted context, in all texts."""
    marked = F.explode(F.array("context", F.element_at(F.split("context", " "), -1)))
    bits = F.pmod(F.crc32("marked"), F.lit(BITMAP)).alias("bit")
    bitmap = np.zeros(BITMAP // 8, np.uint8)
    at = wanted.select(marked.alias("marked")).select(bits).distinct().toPandas()["bit"].to_numpy(np.int64)  # BITMAP numbers at most
    np.bitwise_or.at(bitmap, at >> 3, (1 << (at & 7)).astype(np.uint8))
    shared = docs.sparkSession.sparkContext.broadcast(bitmap.tobytes())

    def count(batches):
        marks, known, counts = shared.value, {}, Counter()

        def is_marked(context):
            bit = bit_of(context)
            return bool(marks[bit >> 3] >> (bit & 7) & 1)

        def possible(word):
            if (hit := known.get(word)) is None:
                hit = known[word] = is_marked(word)
            return hit

        def told():
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["context", "total"])

        for batch in batches:
            for text in batch["text"]:
                before = ""
                words = [w for p in PIECE.findall((text.as_py() or "").lower()) if (w := p.strip(EDGES))]
                for word in words[:-1]:
                    if possible(word):
                        counts[word] += 1
                        if before and is_marked(both := f"{before} {word}"):
                            counts[both] += 1
                    before = word
                if len(known) > 500_000:
                    known.clear()
                if len(counts) > 500_000:
                    yield told()
                    counts.clear()
        yield told()

    return by_id(docs, id_col, text_col).mapInArrow(count, "context string, total long").groupBy("context").agg(F.sum("total").alias("total")).join(wanted.select("context"), "context")


def candidates(near: DataFrame, support: int = SUPPORT) -> DataFrame:
    """(context, n, marked): the contexts with a seed and enough distinct instances, and how many they
    have, each once and each time.  The others can never be worth enough.  near: kind, context, instance."""
    graph = near.groupBy("context", "instance").agg(F.max("kind").alias("kind"), F.count("*").alias("times"))
    able = graph.groupBy("context").agg(F.count("*").alias("n"), F.sum("times").alias("marked"), F.count_if(F.col("kind") >= 0).alias("seeds"))
    return able.where((F.col("n") >= support) & (F.col("seeds") > 0)).select("context", "n", "marked")


def contexts(near: DataFrame, able: DataFrame, rounds: int = ROUNDS, worth: float = WORTH) -> DataFrame:
    """(context, kind, worth) of the contexts that discover.  near: kind, context, instance; able: the
    candidates with total, the number of all words that follow them."""
    others = F.greatest(F.col("total") - F.col("marked"), F.lit(0))
    able = able.where(F.col("n") >= worth * (F.col("n") + others)).select("context", (F.col("n") + others).alias("followers"))
    edges = near.groupBy("context", "instance").agg(F.max("kind").alias("kind")).join(able, "context")
    edges = saved(edges, "contexts")
    sure = edges.groupBy("instance").agg(F.max(F.when(F.col("kind") >= 0, 1.0).otherwise(0.0)).alias("seed"))
    scores = sure.withColumn("confidence", F.col("seed"))

    def value(scores):
        summed = edges.join(scores, "instance").groupBy("context").agg((F.sum("confidence") / F.first("followers")).alias("worth"))
        return summed.where(F.col("worth") >= worth)

    for _ in range(rounds):
        lack = edges.join(value(scores), "context").groupBy("instance").agg(F.product(1 - F.col("worth")).alias("lack"))
        scores = sure.join(lack, "instance", "left").select("instance", "seed", F.greatest("seed", 1 - F.coalesce("lack", F.lit(1.0))).alias("confidence"))
        scores = saved(scores, "scores")
    votes = edges.where("kind >= 0").groupBy("context", "kind").agg(F.count("*").alias("votes")).groupBy("context").agg(F.max_by("kind", F.struct("votes", -F.col("kind"))).alias("kind"))
    return value(scores).join(votes, "context").select("context", "kind", "worth")


def discovering(docs: DataFrame, near: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: int = SUPPORT, **scoring) -> DataFrame:
    """The contexts that discover (context, kind, worth).  near: kind, contexts, instance of every span and identifier."""
    near = saved(near.select("kind", F.explode("contexts").alias("context"), "instance"), "near")
    able = saved(candidates(near, support), "candidates")
    if not able.isEmpty():
        able = able.join(occurrences(docs, able, id_col, text_col), "context")
    else:
        able = able.withColumn("total", F.lit(0).cast("long"))
    return contexts(near, able, **scoring)


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **scoring) -> DataFrame:
    """doc_id, counts and digest of base spans, and all spans as array<struct<kind,start,end>>.
    scoring: rounds, worth, support."""
    rows = saved(found(docs, id_col, text_col), "spans")
    near = rows.select("row", F.explode("near").alias("s")).select("row", "s.*")
    good = saved(discovering(docs, near, id_col, text_col, **scoring), "patterns")
    new = near.where("kind < 0 OR kind = 4").drop("kind").withColumn("context", F.explode("contexts")).join(good, "context")
    new = new.groupBy("row", "start", "end").agg(F.max_by("kind", F.struct("worth", -F.col("kind"))).alias("kind"))
    new = new.groupBy("row").agg(F.collect_list(F.struct("kind", "start", "end")).alias("new"))
    spans = F.array_sort(F.array_distinct(F.concat("base", F.coalesce("new", F.expr("array()")))))
    return rows.join(new, "row", "left").select("doc_id", *(f"n_{k}" for k in BASE), "base_sha256", spans.alias("spans"))


def spans_text(spans):
    """kind:start:end, joined by commas."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def redacted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with <kind> in place of each span; overlapping spans become one, of the first kind.
    Rows that repeat an id and a text count once, other texts under an id are masked each by its own spans."""
    rows, row = numbered(docs, id_col, text_col)
    found_at = unused(docs, "_spans")
    spans = personal_data(rows, row, text_col).where(F.size("spans") > 0).select(F.col("doc_id").alias("key"), F.col("spans").alias(found_at)).alias("b")
    together = rows.alias("a").join(spans, F.col(f"a.{row}") == F.col("b.key"), "left").select(*(F.col(f"a.`{c}`") for c in docs.columns), F.col(f"b.{found_at}"))

    def mask(batches):
        for batch in batches:
            texts = batch[text_col].to_pylist()
            for i, spans in enumerate(batch[found_at].to_pylist()):
                if spans:
                    out, at, text = [], 0, texts[i]
                    for s in sorted(spans, key=lambda s: (s["start"], s["kind"])):
                        if s["start"] >= at:
                            out += [text[at : s["start"]], f"<{KINDS[s['kind']]}>"]
                        at = max(at, s["end"])
                    texts[i] = "".join(out) + text[at:]
            kept = batch.select(docs_columns)
            yield kept.set_column(docs_columns.index(text_col), text_col, pa.array(texts, kept.schema.field(text_col).type))

    docs_columns = docs.columns
    return together.mapInArrow(mask, docs.schema)
