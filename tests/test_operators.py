import pytest
from pyspark.sql import functions as F

from fieldglass.functions import text as T
from fieldglass.operators import aggregates as A
from fieldglass.operators import joins as J
from fieldglass.operators import ranking as R
from fieldglass.operators import views as V
from fieldglass.operators.predicates import Field, FieldError, Fields, mentions, negate
from fieldglass.sources import payloads as P
from fieldglass.streaming import capture as C


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(1, 5.0, "Big", ["A", "b"], True, "c++ dev"), (2, None, None, None, None, None), (3, 100000.0, "small", [], False, "Graduate role")], "id long, pay double, size string, tags array<string>, flag boolean, text string")


def fields():
    return Fields({"pay": Field(F.col("pay"), "number"), "size": Field(F.col("size"), "enum"), "tags": Field(F.col("tags"), "tags"), "flag": Field(F.col("flag"), "bool"), "text": Field(F.col("text"), "text")}, aliases={"salary": "pay"}, shorthands={"size": {"b": "big"}})


@pytest.mark.parametrize(
    ("name", "op", "value", "ids"),
    [("pay", "!=", 5, [3]), ("salary", ">=", "100k", [3]), ("pay", "=", "null", [2]), ("pay", "!=", "none", [1, 3]), ("size", "=", "b", [1]), ("size", "!=", "BIG", [2, 3]), ("size", "~", "ma", [3]), ("tags", ":", "B", [1]), ("tags", "!=", "a", [2, 3]), ("flag", "=", "yes", [1]), ("flag", "!=", True, [3]), ("text", ":", "ROLE", [3]), ("text", "!=", "role", [1, 2])],
)
def test_conditions(rows, name, op, value, ids):
    assert [r.id for r in rows.where(fields().where(name, op, value)).orderBy("id").collect()] == ids


def test_negation_keeps_three_values(rows):
    assert [r.id for r in rows.where(negate(fields().where("pay", ">", 10))).collect()] == [1]


def test_words(rows):
    ids = lambda said: [r.id for r in rows.where(mentions(F.col("text"), said)).collect()]
    assert ids("C++") == [1] and ids("role graduate") == [3] and ids("grad") == [] and ids(" - ") == []


@pytest.mark.parametrize(("name", "op", "value"), [("nope", "=", 1), ("pay", "~", 1), ("pay", "=", "x"), ("flag", "<", True), ("pay", "<", None)])
def test_bad_conditions(spark, name, op, value):
    with pytest.raises(FieldError):
        fields().where(name, op, value)


def test_capture_cycle(spark):
    at = lambda d: F.lit(f"2024-01-0{d} 00:00:00").cast("timestamp")
    batch = lambda rows, day: spark.createDataFrame(rows, "k long, content_hash string, description string").withColumn("raw_hash", F.col("content_hash")).withColumn("seen_at", at(day))
    state = spark.createDataFrame([], "k long, content_hash string, raw_hash string, first_seen timestamp, last_seen timestamp, delisted_at timestamp, description string")
    acts = lambda df: {r.k: r.action for r in df.collect()}
    one = C.merge(state, batch([(1, "a", "text"), (2, "b", None)], 1), ["k"], at(1), True)
    assert acts(one) == {1: "new", 2: "new"}
    two = C.merge(one.drop("action"), batch([(1, "x", None)], 2), ["k"], at(2), True)
    assert acts(two) == {1: "changed", 2: "delisted"}
    assert two.where("k = 1").first().description == "text"
    three = C.merge(two.drop("action"), batch([(1, "x", None), (2, "b", None)], 3), ["k"], at(3), True)
    assert acts(three) == {1: "unchanged", 2: "relisted"}
    assert three.where("delisted_at IS NULL").count() == 2
    four = C.merge(three.drop("action"), batch([(1, "x", None)], 4), ["k"], at(4), False)
    assert acts(four) == {1: "unchanged", 2: None}


def test_stream_takes_each_key_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    schema = "update_id long, act string"
    (tmp_path / "in/a.json").write_text('{"update_id": 1, "act": "x"}\n{"update_id": 1, "act": "x"}\n{"update_id": 2, "act": "y"}\n')
    args = (spark, str(tmp_path / "in"), schema, str(tmp_path / "out"), ["update_id"], str(tmp_path / "check"))
    C.run_stream(*args)
    (tmp_path / "in/b.json").write_text('{"update_id": 2, "act": "z"}\n{"update_id": 3, "act": "w"}\n')
    C.run_stream(*args)
    assert sorted(r.update_id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 2, 3]


def test_text_functions(spark):
    df = spark.createDataFrame([("  R&D  Engineer (Remote) ", "https://www.X.com/a/?b=2&utm_source=q&a=1#f", "1700000000")], "t string, u string, m string")
    r = df.select(T.title_key(F.col("t")).alias("k"), T.url_identity(F.col("u")).alias("u"), T.moment(F.col("m")).cast("long").alias("m"), T.slug(F.col("t")).alias("s"), T.url_identity(F.lit("http://bad url[")).alias("bad")).first()
    assert (r.k, r.u, r.m, r.s, r.bad) == ("r and d engineer remote", "x.com/a?a=1&b=2", 1700000000, "r-d-engineer-remote", None)
    two = spark.range(1).select(T.jaccard(F.array(F.lit(1), F.lit(2)), F.array(F.lit(2))).alias("j"), T.overlap_of_ranges(F.lit(0.0), F.lit(2.0), F.lit(1.0), F.lit(4.0)).alias("o")).first()
    assert (two.j, two.o) == (0.5, 0.25)


def test_payloads(spark):
    from pyspark.sql import types as S

    df = spark.createDataFrame([(1, '{"jobs": [{"id": 1}, {"id": 2}]}'), (2, "oops"), (3, "{}"), (4, '{"jobs": null}')], "p long, body string")
    items, bad = P.decoded(df, "body", S.StructType().add("jobs", S.ArrayType(S.StructType().add("id", S.LongType()))), "jobs")
    assert sorted((r.p, r.item.id) for r in items.collect()) == [(1, 1), (1, 2)]
    assert {r.p: r.reason for r in bad.collect()} == {2: "not JSON", 3: "no jobs"}
    assert spark.range(1).select(P.redacted(F.lit("Bob and Bobby"), ["bob", "bobby"]).alias("x")).first().x == "[redacted] and [redacted]"


def test_snapshots_kept(spark):
    days = spark.range(60).select(F.expr("timestamp'2024-03-01 05:00:00' + make_interval(0,0,0,cast(id as int))").alias("at"))
    kept = sorted(str(r["at"])[:10] for r in R.kept_snapshots(days, "at").collect())
    assert kept[-7:] == [f"2024-04-{d}" for d in range(23, 30)] and kept[:2] == ["2024-04-14", "2024-04-21"]


def test_counters_add_up(spark):
    schema = "n string, seen_count long, url string, first_seen long, last_seen long"
    old, new = spark.createDataFrame([("a", 2, None, 5, 6)], schema), spark.createDataFrame([("a", 3, "u", 1, 9), ("b", 1, None, 2, 2)], schema)
    got = {r.n: (r.seen_count, r.url, r.first_seen, r.last_seen) for r in A.accumulated(old, new, ["n"]).collect()}
    assert got == {"a": (5, "u", 1, 9), "b": (1, None, 2, 2)}


def test_global_rank_of_two_million_rows(spark):
    from pyspark.sql import functions as F

    rows = spark.range(2_000_000, numPartitions=16).select("id", F.xxhash64("id").alias("v"), F.xxhash64("id", F.lit(1)).alias("carried"))
    ranked = R.global_rank(rows, [F.desc("v"), F.asc("id")])
    n, distinct, low, high, same = ranked.agg(F.count("*"), F.count_distinct("rank"), F.min("rank"), F.max("rank"), F.count_if(F.col("carried") == F.xxhash64("id", F.lit(1)))).first()
    assert (n, distinct, low, high, same) == (2_000_000, 2_000_000, 1, 2_000_000, 2_000_000)
    top = [r.id for r in ranked.where("rank <= 1000 OR rank > 1999000").orderBy("rank").collect()]
    by_value = [F.desc("v"), F.asc("id")]
    assert top[:1000] == [r.id for r in rows.orderBy(*by_value).limit(1000).collect()]
    assert top[1000:] == [r.id for r in rows.orderBy(F.asc("v"), F.desc("id")).limit(1000).collect()][::-1]


def test_places_in_groups_of_any_size(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(None if k % 7 == 0 else "big" if k % 3 else "small", k * 37 % 101) for k in range(300)] + [("one", 5), ("none", None)], "g string, v int")
    got = {r.g: (r.median, r.n) for r in A.medians(rows, [["g"]], "v", 1)[0].collect()}
    import statistics

    want = {}
    for k, v in [(r.g, r.v) for r in rows.collect() if r.v is not None]:
        want.setdefault(k, []).append(v)
    assert got == {k: (statistics.median(v), len(v)) for k, v in want.items()}
    fold = {r.g: r.e for r in A.moving_average(rows, ["g"], [F.asc("v")], "v", "e").collect()}
    for k, v in want.items():
        e = None
        for x in sorted(v):
            e = x if e is None else 0.7 * e + 0.3 * x
        assert abs(fold[k] - e) < 1e-9
    assert A.medians(rows.limit(0), [["g"]], "v", 1)[0].count() == 0


def test_chain_stops_and_doubles(spark):
    rows = spark.createDataFrame([(k, k - 1 if k else None) for k in range(30)] + [(100, 101), (101, 100)], "k long, p long")
    got = {(r.k, r.ancestor, r.depth) for r in J.chain(rows, "k", "p", 20).collect()}
    want = {(k, k - d, d) for k in range(30) for d in range(1, min(k, 20) + 1)}
    want |= {(k, k if d % 2 == 0 else 201 - k, d) for k in (100, 101) for d in range(1, 21)}
    assert got == want
    assert J.chain(rows.limit(0), "k", "p").count() == 0


def test_pages_are_bounded(spark):
    import pytest

    with pytest.raises(ValueError):
        V.page(spark.range(3), [], 1001)
