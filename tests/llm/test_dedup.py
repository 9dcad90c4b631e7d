"""Operators 3, 6 and 10 against brute force."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldglass.llm import grams as g
from fieldglass.llm import ngram_join as ngram
from fieldglass.llm.ngram_join import histograms, joined, may_share, ngram_join
from fieldglass.llm.quality import judge
from fieldglass.llm.staging import size_of, stage
from fieldglass.llm.substring_dedup import Automaton, dedup_substrings
from fieldglass.llm.suffix_dedup import common, dedup_byte_substrings, front_coded, decoded, merge


def passages(seed, docs=80):
    rng = random.Random(seed)
    text = lambda: [rng.choice(["ab", "c", "é", "dd\xa0d", "x"]) for _ in range(rng.choice([0, 3, 10, 40, 200]))]
    base, rows = [text() for _ in range(12)], []
    for d in range(docs):
        w = list(rng.choice(base)) if rng.random() < 0.6 else text()
        for _ in range(rng.choice([0, 0, 1, 3])):
            if w:
                w[rng.randrange(len(w))] = rng.choice(["q", "zz", "ab"])
        if rng.random() < 0.3:
            w = w + rng.choice(base)[:50]
        if rng.random() < 0.1:
            w = ["a"] * 150
        rows.append((d * 7 % 83, rng.choice([" ", "\n", " \t"]).join(w) if rng.random() < 0.95 else None))
    return rows


def frame(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumn("chunk", F.lit(1)).withColumn("bucket", F.lit("x")).withColumn("body", F.lit(None).cast("string"))


def brute_words(rows, window):
    seen, out = set(), {}
    texts = {d: (t or "").encode().split() for d, t in rows}
    for d in sorted(texts):
        w = texts[d]
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            if k in seen:
                gone[i : i + window] = [True] * window
            seen.add(k)
        out[d] = (len(w), sum(gone), b" ".join(x for x, y in zip(w, gone) if not y).decode())
    return out


def brute_bytes(rows, window):
    texts, out = {d: (t or "").encode() for d, t in rows}, {}
    n = Counter(x[i : i + window] for x in texts.values() for i in range(len(x) - window + 1))
    for d, x in texts.items():
        gone = [False] * len(x)
        for i in range(len(x) - window + 1):
            if n[x[i : i + window]] > 1:
                gone[i : i + window] = [True] * window
        spans = sum(g and not before for g, before in zip(gone, [False, *gone]))
        out[d] = (len(x), sum(gone), spans, bytes(b for b, g in zip(x, gone) if not g))
    return out


@pytest.mark.parametrize("window", [5, 20])
def test_word_windows(spark, window):
    rows = passages(5)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in dedup_substrings(frame(spark, rows), window).collect()}
    assert got == brute_words(rows, window)


def test_word_windows_keep_white_space(spark):
    rows = [(1, "a b c d e\n\nf g"), (2, "x\ta  b c d e y")]
    got = {r.doc_id: r.kept for r in dedup_substrings(frame(spark, rows), 5, joined=False).collect()}
    assert got == {1: "a b c d e\n\nf g", 2: "x y"}


@pytest.mark.parametrize("window", [12, 40])
def test_byte_windows(spark, window):
    rows = passages(6)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in dedup_byte_substrings(frame(spark, rows), window).collect()}
    assert got == brute_bytes(rows, window)


def test_repeated_and_missing_ids(spark):
    rows = [(1, "b b"), (1, "a a"), (None, "zz"), (2, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.kept for r in dedup_substrings(df).collect()} == {1: "a a", 2: ""}
    assert {r.doc_id: bytes(r.kept) for r in dedup_byte_substrings(df).collect()} == {1: b"a a", 2: b""}
    assert {r.doc_id: r.n_shingles for r in ngram_join(df).collect()} == {1: 1, 2: 0}


def test_empty_tables(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert dedup_substrings(df).count() == dedup_byte_substrings(df).count() == ngram_join(df).count() == 0


def test_automaton_matching_statistics():
    rng = random.Random(2)
    for _ in range(200):
        known = [[rng.randrange(3) for _ in range(rng.randrange(12))] for _ in range(4)]
        a = Automaton()
        for s in known:
            a.add(s)
        q = [rng.randrange(3) for _ in range(12)]
        inside = lambda x: any(x == s[i : i + len(x)] for s in known for i in range(len(s)))
        want = [max(n for n in range(e + 2) if n == 0 or inside(q[e + 1 - n : e + 1])) for e in range(len(q))]
        assert a.statistics(q) == want


def test_merge_keeps_common_prefixes():
    rng = random.Random(4)
    for k in (1, 2, 3, 7):
        runs = [[bytes(rng.choice(b"ab") for _ in range(rng.randrange(9))) for _ in range(rng.randrange(9))] for _ in range(k)]
        coded = [decoded(front_coded(r)) for r in runs]
        order, prefixes = merge([(s, h) for _, s, h in coded])
        out = [coded[r][1][p] for r, p in order]
        assert out == sorted(x for r in runs for x in r)
        assert prefixes[1:] == [common(a, b, 0) for a, b in zip(out, out[1:])]


def near_copies():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    base = [[rng.choice(words) for _ in range(rng.choice([0, 1, 2, 5, 30, 60, 150]))] for _ in range(25)]
    rows = []
    for d in range(400):
        w = list(rng.choice(base)) if d % 3 else list(base[6])
        for _ in range(rng.choice([0, 0, 0, 1, 1, 2, 3, 4])):
            if w:
                w[rng.randrange(len(w))] = rng.choice(words).upper()
        rows.append((d * 13 % 1009 - 200, " ".join(w) if rng.random() < 0.97 else None))
    return rows


def brute_join(rows, n, num):
    low = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
    sets = {}
    for d, t in rows:
        w = low(t or "").encode().split()
        sets[d] = {tuple(w)} if 0 < len(w) < n else {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
    ids = sorted(sets)
    label = {d: d for d in ids}
    links = [(a, b) for i, a in enumerate(ids) for b in ids[:i] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])]
    for _ in ids:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    return {d: (len(sets[d]), label[d]) for d in ids}


@pytest.mark.parametrize(("n", "num", "short", "block"), [(3, 90, 64, 768), (5, 80, 64, 768), (3, 90, 4, 12)])
def test_join(spark, monkeypatch, n, num, short, block):
    monkeypatch.setattr(ngram, "SHORT", short)  # reaches the tasks with the function that names it
    rows = near_copies()
    got = ngram_join(frame(spark, rows), n, num, 100, block=block).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_join(rows, n, num)


@pytest.mark.parametrize(("room", "turns"), [(None, range(3, 9)), (0, range(8, 9)), (1 << 20, range(2, 3))])
def test_join_in_turns(spark, monkeypatch, room, turns):
    """Near copies in small blocks: sets go to many pairs of blocks, so all at once would be far more than the texts."""
    if room is not None:
        monkeypatch.setattr(ngram, "ROOM", room)
    written, saved = [], ngram.saved
    monkeypatch.setattr(ngram, "saved", lambda df, name: written.append(name) or saved(df, name))
    rows = near_copies()
    got = ngram_join(frame(spark, rows), 5, 80, 100, block=12).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_join(rows, 5, 80)
    assert written.count("met") in turns


def test_join_of_long_texts(spark):
    long = [str(i) for i in range(2_200_000)]  # some 68 750 n-grams in each part of a histogram
    near = [*long[:1_000_000], "changed", *long[1_000_001:]]
    rows = [(5, " ".join(long)), (3, " ".join(near)), (4, "a b c d")]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {5: (2_199_998, 3), 3: (2_199_998, 3), 4: (2, 4)}


def test_full_histograms():
    token = np.arange(70_000, dtype=np.uint64)  # all in one part
    a, b = histograms(np.r_[token, token], np.r_[np.zeros(70_000, np.int64), np.ones(70_000, np.int64)], 2)[:, None]
    assert may_share(a, b, np.array([70_000])).all()
    c = histograms(token[:9], np.zeros(9, np.int64), 1)
    assert may_share(a, c, np.array([9])).all() and not may_share(a, c, np.array([10])).any()


@pytest.mark.parametrize("num", [20, 50])
def test_join_of_loose_sets(spark, num):
    words = [f"w{i}" for i in range(12)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:7])), (3, " ".join(words[:3])), (4, "x y z"), (5, "x y z z z z")]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join(frame(spark, rows), 3, num, 100).collect()}
    assert got == brute_join(rows, 3, num)
    assert got[2] == (5, 1)  # 5 of 10 n-grams


def test_pairs_of_a_list_join_what_passes():
    rng = random.Random(9)
    for _ in range(50):
        n = rng.randrange(1, 40)
        near = {(a, b) for a in range(n) for b in range(a + 1, n) if rng.random() < rng.choice([0.02, 0.1, 0.9])}
        label, of = np.arange(n + 3), {v: v for v in range(n)}
        label[1] = label[0]  # one group by another list
        joined(label, np.arange(n), lambda x, y: np.array([(i, j) in near for i, j in zip(x.tolist(), y.tolist())], bool))
        for _ in range(n):
            for x, y in [*near, *([(0, 1)] if n > 1 else [])]:
                of[x] = of[y] = min(of[x], of[y])
        assert [[label[x] == label[y] for x in range(n)] for y in range(n)] == [[of[x] == of[y] for x in range(n)] for y in range(n)]


def thue_morse():
    """Two strings of 1024 letters that collide under every polynomial modulo 2**64."""
    x, y = "a", "b"
    for _ in range(10):
        x, y = x + y, y + x
    return x, y


def test_words_whose_polynomials_collide(spark):
    x, y = thue_morse()
    head = " ".join(f"w{i}" for i in range(19))
    rows = [(1, f"{head} {x}"), (2, f"{head} {y}"), (3, f"{x}\n{y}\n{x}")]
    assert {r.doc_id: r.n_removed for r in dedup_substrings(frame(spark, rows)).collect()} == {1: 0, 2: 0, 3: 0}
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join(frame(spark, rows)).collect()} == {1: (18, 1), 2: (18, 2), 3: (1, 3)}
    assert {r.doc_id: r.n_removed for r in dedup_byte_substrings(frame(spark, [(1, x), (2, y)]), 1024).collect()} == {1: 0, 2: 0}
    got = {r.doc_id: (r.n_dup_lines, r.n_repeat_words) for r in judge(frame(spark, [*rows, (4, f"{head} {x} {head} {y}")]).withColumn("lang", F.lit("en"))).collect()}
    assert got == {1: (0, 0), 2: (0, 0), 3: (1, 0), 4: (0, 38)}


def test_hashes_are_those_of_the_spans():
    rng = np.random.default_rng(3)
    values = rng.integers(0, 2**63, 3000, np.uint64)
    values = np.r_[values, values[100:900]]
    prefix = g.sums(values)
    start, length = rng.integers(0, 2000, 500), rng.integers(0, 900, 500)
    assert (g.span_hash(prefix, start, start + length) == [plain_hash(values[a : a + n].tolist()) for a, n in zip(start.tolist(), length.tolist())]).all()
    assert (g.run_hashes(prefix, 7)[[5, 3001]] == [plain_hash(values[5:12].tolist()), plain_hash(values[3001:3008].tolist())]).all()
    assert g.run_hashes(prefix, 9000).size == 0 == g.span_hash(prefix, start[:0], start[:0]).size


def plain_hash(values):
    p = 2**31 - 1
    low, high = (sum((v >> 31 * k) % 2**31 * pow(b, i, p) for i, v in enumerate(values)) % p for k, b in enumerate(g.BASES))
    return int(g.mix(np.array([((low | high << 32) + len(values) * int(g.LENGTH)) % 2**64], np.uint64))[0])


def test_size_follows_the_texts(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    joined = docs.join(labels, "doc_id", "left").join(labels.select("doc_id", F.col("toxic").alias("t")), "doc_id", "left")
    assert stage(joined)[1:] == stage(docs)[1:]
    assert size_of(joined) == size_of(docs) > 0 == size_of(docs.limit(0))
    one = ngram_join(joined).orderBy("doc_id").collect()
    assert one == ngram_join(docs).orderBy("doc_id").collect()
