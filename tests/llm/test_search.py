"""Ranked search, SimHash and weighted clustering against plain versions."""

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from fieldglass.llm import clustering, lexical, queries, simhash

DATA = "/root/testdata/sf0.001"
HARD = [(1, None), (2, ""), (3, "  \t\n"), (4, "One"), (5, "one TWO"), (6, "é É é ÀB ß1"), (7, "a-b_c.d\x00e"), (8, "one TWO"), (None, "one two three"), (9, "one two three " * 4000), (9, "one two"), (10, " one two")]


def plain_components(ids, near):
    up = {i: i for i in ids}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in near:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_simhash(rows):
    rows = [(i, plain_fingerprint(t)) for i, t in rows if i is not None]
    least = {}
    for i, f in rows:
        least[f] = min(i, least.get(f, i))
    fps = np.array(list(least), np.uint64)
    pairs = [(least[int(fps[a])], least[int(fps[b])]) for a in range(len(fps)) for b in np.flatnonzero(np.bitwise_count(fps ^ fps[a]) <= 3).tolist()]
    of = plain_components(set(least.values()), pairs)
    return Counter((i, f"{f:016x}", of[least[f]]) for i, f in rows)


@pytest.mark.parametrize("few", [False, True])
def test_simhash_as_brute_force(spark, monkeypatch, few):
    if few:  # many lists, and lists cut in blocks
        monkeypatch.setattr(simhash, "LIST", 4)
        monkeypatch.setattr(simhash, "BLOCK", 8)
    got = Counter(map(tuple, queries.op12_bit_sliced_simhash(spark, DATA).collect()))
    assert got == plain_simhash(spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect())


def test_simhash_hard_texts_and_extra_columns(spark):
    docs = spark.createDataFrame([(i, t, i, "x") for i, t in HARD], "doc_id long, text string, fp long, rep string")
    assert Counter(map(tuple, simhash.simhash_join(docs).collect())) == plain_simhash(HARD)
    assert simhash.simhash_join(docs.limit(0)).collect() == []


@pytest.mark.parametrize("count", [1, 5000, 10**7, 10**12])
def test_every_pair_within_the_radius_shares_a_list(count):
    masks, rng = simhash.masks(count, 3), np.random.default_rng(count)
    for _ in range(300):
        flip = sum(1 << int(b) for b in rng.choice(64, 3, replace=False))
        assert any(flip & m == 0 for m in masks)
    assert count < 5000 or sum(bin(m).count("1") for m in masks) / len(masks) >= math.log2(count / simhash.LIST) - 1


@pytest.mark.parametrize("radius", [1, 2, 3, 4, 7])
def test_bit_sliced_distances(radius):
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 2**63, 40, np.uint64)
    values = np.concatenate([base, base ^ np.uint64(0b1011), base[:9] ^ np.uint64(0xFF), np.array([0, 2**64 - 1], np.uint64)])
    found = {(r, int(x)) for r, at in simhash.near(values, simhash.planes(values), len(values), radius) for x in at}
    assert found == {(a, b) for a in range(len(values)) for b in range(len(values)) if int(values[a] ^ values[b]).bit_count() <= radius}


def plain_ranking(docs, items, k=50):
    def terms(text):
        return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))

    held = [(i, Counter(terms(t))) for i, t in docs if i is not None]
    held = [(i, c, sum(c.values())) for i, c in held if c]
    count, length = len(held), sum(n for *_, n in held)
    asked = {}
    for i, t in items:
        if i is not None:
            asked.setdefault(i, set()).update(terms(t))
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, words in asked.items():
        scores = []
        for i, c, n in held:
            m = 50 + (50 * n * count) // length
            s = sum(math.floor(1000 * math.log((2 * count + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in words if t in c)
            if s > 0:
                scores.append((-s, i))
        out += [(item, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scores)[:k])]
    return Counter(out)


def test_ranking_with_many_small_parts(spark, monkeypatch):
    monkeypatch.setattr(lexical, "ITEM_BYTES", 900)
    monkeypatch.setattr(lexical, "ENTRIES", 64)
    docs, items = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "benchmark"))
    got = Counter(map(tuple, lexical.ranked(docs.repartition(7), items, k=5).collect()))
    assert got == plain_ranking(docs.select("doc_id", "text").collect(), items.select("item_id", "text").collect(), 5)


def test_ranking_of_hard_texts(spark):
    items = [(1, "one É e"), (1, "TWO"), (2, None), (3, "nothing here"), (4, "à̀b ß1 é"), (None, "one"), (5, "")]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in HARD], "doc_id long, text string, score long, n string")
    asked = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id long")
    assert Counter(map(tuple, lexical.ranked(docs, asked, k=3).collect())) == plain_ranking(HARD, items, 3)
    assert lexical.ranked(docs.limit(0), asked).collect() == [] == lexical.ranked(docs, asked.limit(0)).collect()


def test_radix_order_is_stable():
    keys = np.random.default_rng(0).integers(0, 1 << 40, 5000) % 977 << 20
    assert (lexical.radix_order(keys, 0, 40) == np.argsort(keys, kind="stable")).all()


def plain_lloyd(rows, k=40, rounds=5):
    kept = []
    for i, v in rows:
        if i is not None and v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, tuple(math.floor(256 * float(x)) for x in v)))
    c = [q for _, _, q in sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), q, q) for i, q in kept)[:k]]

    def nearest(q):
        return min((sum((a - b) ** 2 for a, b in zip(q, x)), j) for j, x in enumerate(c))

    for _ in range(rounds):
        own = [nearest(q)[1] for _, q in kept]
        for j in set(own):
            group = [q for (_, q), o in zip(kept, own) if o == j]
            c[j] = tuple(sum(x) // len(group) for x in zip(*group))
    at = [(i, *nearest(q)[::-1]) for i, q in kept]
    most = 2**63 - 1
    of = Counter()
    for _, j, d in at:
        of[j] += min(d, most)
    sha = [hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for x in c]
    return Counter((i, j, min(d, most), min(of[j], most), min(sum(of.values()), most), sha[j]) for i, j, d in at)


def six(df):
    return Counter(tuple(r)[:6] for r in df.collect())


def test_lloyd_with_copies_ties_and_odd_vectors(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(0, 0.2, (12, 64)).round(2)
    rows = [(i, base[i % 12 if i % 3 else 0].tolist()) for i in range(90)]
    rows += [(90, None), (91, []), (92, [0.0] * 63), (93, [0.0] * 63 + [None]), (94, [0.0] * 63 + [math.nan]), (95, [0.0] * 63 + [math.inf]), (None, [0.0] * 64), (96, [-0.0] * 64), (97, [0.0] * 64), (5, rows[5][1]), (6, rows[7][1])]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, cluster int, q string")
    exact = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    for k in (4, 40, 200):
        assert six(clustering.weighted_lloyd(df, k=k)) == plain_lloyd(exact, k)
    copies = {r["vec_id"]: r["copies"] for r in clustering.weighted_lloyd(df).where("vec_id in (0, 96)").collect()}
    assert copies == {0: 30, 96: 2}
    assert clustering.weighted_lloyd(df.limit(0)).collect() == []


def test_lloyd_with_large_components(spark):
    rng = np.random.default_rng(2)
    rows = [(i, (rng.normal(0, 1, 64) * s).tolist()) for i, s in enumerate([1, 1e3, 1e5, 1e7, 1e9, 1e25, 1e300, 1e304] * 3)]
    rows[7] = rows[7][0], [1.7e308] * 64  # not finite times 256: takes no part
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert six(clustering.weighted_lloyd(df, k=5)) == plain_lloyd([r for r in rows if r[0] != 7], 5)
