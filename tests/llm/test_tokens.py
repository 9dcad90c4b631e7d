"""Operators 4, 7 and 9 against the tokenizers library."""

import zlib

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")
from fieldglass.llm.bpe import bpe_round_trip  # noqa: E402
from fieldglass.llm.packing import best_fit, pack  # noqa: E402
from fieldglass.llm.sstable import lookup, read_shards, write_shards  # noqa: E402
from fieldglass.llm.tokens import default_tokenizer  # noqa: E402

ODD = ["", "  \n ", "Hello WORLD's don't it'll ΣΑΣ Straße İstanbul ﬁ é ́x a\xa0b   　 x y 日本語テキスト 😀😀!!", "<|endoftext|>a<|startoftext|> <|END<|endoftext|>", "aaaaaaaaaaaaaaaa abababababab " * 5, "12345 67.89 #*$%&|<>", "\x00\x01 \x1c\x1d\x1e\x1f\x85 z", "q" * 5000, None, "same", "same", "tok " * 9000]


@pytest.fixture(scope="module")
def docs(spark):
    from pyspark.sql import functions as F

    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").limit(60)
    odd = spark.createDataFrame([(100000 + i, t) for i, t in enumerate(ODD)], "doc_id long, text string")
    return d.union(odd).withColumn("ids", F.lit(2)).withColumn("row", F.lit("x")).repartition(5).cache()


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(default_tokenizer())


@pytest.fixture(scope="module")
def ids(docs, library):
    return {r.doc_id: library.encode(r.text or "", add_special_tokens=False).ids for r in docs.collect()}


def crc(x):
    return zlib.crc32(np.array(x, "<u4").tobytes())


def test_pair_index(docs, ids, library):
    got = {r.doc_id: r for r in bpe_round_trip(docs, with_ids=True).collect()}
    assert {d: list(r.ids) for d, r in got.items()} == ids
    assert {d: r.decoded for d, r in got.items()} == {d: library.decode(x, skip_special_tokens=False) for d, x in ids.items()}


def test_shards(spark, docs, ids):
    shards = write_shards(docs)
    want, at = {}, 0
    for d in sorted(ids):
        want[d] = (at, len(ids[d]) + 1, crc(ids[d] + [2]))
        at += len(ids[d]) + 1
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in read_shards(shards).collect()} == want
    found = lookup(shards, spark.createDataFrame([(3,), (100002,), (77777,)], "doc_id long"))
    assert {r.doc_id: list(r.ids) for r in found.collect()} == {d: ids[d] + [2] for d in (3, 100002) if d in ids}


def test_packing(docs, ids):
    rows = pack(docs, window=512).collect()
    by_sequence, by_doc = {}, {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
        by_doc.setdefault(r.doc_id, []).append((r.start, r.length))
        assert r.ids_crc32 == crc((ids[r.doc_id] + [2])[r.start : r.start + r.length]) and r.doc_tokens == len(ids[r.doc_id]) + 1
    for parts, most in [(p, 512) for p in by_sequence.values()] + [(p, 1 << 40) for p in by_doc.values()]:
        parts.sort()
        assert parts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:])) and sum(parts[-1]) <= most
    assert {d: sum(n for _, n in p) for d, p in by_doc.items()} == {d: len(x) + 1 for d, x in ids.items()}


def test_best_fit_takes_the_tightest_window():
    rng = np.random.default_rng(1)
    for _ in range(50):
        lengths = sorted(rng.integers(1, 65, 40).tolist(), reverse=True)
        room, want = [], []
        for n in lengths:
            fits = [r for r in room if r >= n]
            if not fits:
                room.append(64)
                fits = [64]
            room[room.index(min(fits))] -= n
            want.append(min(fits) - n)
        placed = best_fit(lengths, 64)
        assert [64 - o - n for (_, o), n in zip(placed, lengths)] == want


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert pack(df).count() == bpe_round_trip(df).count() == read_shards(write_shards(df)).count() == 0
