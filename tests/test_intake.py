import math

from pyspark.sql import functions as F

from fieldglass.functions import extract as X
from fieldglass.functions import places as P
from fieldglass.operators import estimates as E
from fieldglass.operators import upkeep as U
from fieldglass.plans.intake import KNOWN
from fieldglass.sources import feeds as S


def column(spark, values, expression, ddl="v string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, {ddl}")
    return [r[0] for r in rows.select("i", expression(F.col("v")).alias("x")).orderBy("i").select("x").collect()]


def test_pay_in_prose(spark):
    cases = {
        None: None,
        "": None,
        "no numbers": None,
        "base salary $100,000 to $130,000": (100000.0, 130000.0, "year", 0.9),
        "90000-120000": (90000.0, 120000.0, "year", 0.55),
        "120k through 90k": None,
        "$20 - $31.50/hr": (20.0, 31.5, "hour", 0.9),
        "hourly 3 - 5": None,
        "10 - 25% bonus": None,
        "£60,000 - £80,000": None,
        "CAD $60,000 - $80,000": (60000.0, 80000.0, "year", 0.65),
        "stock 30000 - 40000": None,
        "90k - 95k here; " + "x " * 100 + "pay range 70k - 80k": (70000.0, 80000.0, "year", 0.8),
        "é" * 300 + " annual 70k - 80k": (70000.0, 80000.0, "year", 0.8),
    }
    got = column(spark, list(cases), X.posted_pay)
    assert [g and (g["low"], g["high"], g["interval"], g["confidence"]) for g in got] == list(cases.values())


def test_pay_in_many_ranges_takes_the_first_of_equals(spark):
    (got,) = column(spark, [" ".join(f"{50 + i}k - {60 + i}k ." for i in range(35)) * 30], X.posted_pay)
    assert (got["low"], got["high"]) == (50000.0, 60000.0)


def test_places_of_null_and_empty(spark):
    got = column(spark, [None, "", "  "], lambda c: P.place(c, KNOWN))
    assert [(g["kind"], g["metro"], g["country"], g["confidence"]) for g in got] == [("unknown", None, None, 0.0)] * 3
    got = column(spark, [None, "Alphaville; Betatown"], lambda c: P.together(F.transform(P.apart(c), lambda x: P.place(x, KNOWN)), KNOWN))
    assert [(g["metros"], g["primary"], g["many"], g["abroad_only"]) for g in got] == [([], None, False, False), (["alpha", "beta"], "alpha", True, False)]


def test_feeds_of_broken_and_empty_payloads(spark):
    payloads = spark.createDataFrame([(1, None), (2, "{"), (3, "[]"), (4, '{"jobs": null}'), (5, '{"jobs": []}'), (6, '{"jobs": [null, {"id": 1}, {"id": 2, "title": "t"}]}'), (7, "{}")], "id int, content string")
    rows, bad = S.read_feed(payloads, "content", S.FEEDS["offices_and_departments"])
    assert [(r["id"], r["source_job_id"]) for r in rows.collect()] == [(6, "2")]
    assert {r["id"]: r["reason"] for r in bad.collect()} == {1: "not JSON", 2: "not JSON", 3: "no jobs", 7: "no jobs"}
    rows, bad = S.read_feed(payloads, "content", S.FEEDS["aggregated"])
    assert rows.count() == 0 and {r["id"]: r["reason"] for r in bad.collect()}[7] == "no list"


def test_equal_ids_in_one_payload_count_once(spark):
    payloads = spark.createDataFrame([(1, '{"jobs": [{"id": 7, "title": "first"}, {"id": 8, "title": "x"}, {"id": 7, "title": "second"}]}'), (2, '{"jobs": [{"id": 7, "title": "other"}]}')], "id int, content string")
    rows, _ = S.read_feed(payloads, "content", S.FEEDS["offices_and_departments"])
    assert sorted((r["id"], r["source_job_id"], r["title"]) for r in rows.collect()) == [(1, "7", "first"), (1, "8", "x"), (2, "7", "other")]


def test_pipe_table_without_a_header_has_no_rows(spark):
    texts = spark.createDataFrame([(1, None), (2, ""), (3, "| a | b | [x](https://e.x) |"), (4, "| Company | Role | Link |\n|--|--|--|\n| ↳ | r | [x](https://e.x) |\n| A | r | <a href=\"https://e.x/1\">go</a> |\n| B | r |")], "k int, t string")
    assert [tuple(r) for r in S.pipe_table(texts, "k", "t").select("k", "company", "title", "url").collect()] == [(4, "A", "r", "https://e.x/1")]


def test_pay_ladder_with_nulls(spark):
    rows = spark.createDataFrame([(1, None, 10.0, 20.0), (2, None, None, None), (3, "a", None, 9.0)], "id int, k string, lo double, hi double")
    peers = spark.createDataFrame([(None, 1.0, 2.0)], "k string, low double, high double")
    out = E.estimated_pay(rows, "lo", "hi", [("peers", peers, ["k"])], (5, 6), F.lit(None).cast("boolean"), F.lit(True)).orderBy("id").collect()
    assert [(r["pay_source"], round(r["pay"], 6), r["pay_sure"]) for r in out] == [("posted", 14.0, 0.9), ("peers", 1.4, 0.45), ("posted", 9.0, 0.9)]


def test_fitted_weights_are_those_of_gradient_descent(spark):
    points = [((i * 37 % 100) / 10, (i * 61 % 100) / 7, int((i * 37 % 100) + (i * 13 % 50) > 70)) for i in range(80)]
    got = U.fitted_weights(spark.createDataFrame(points, "a double, b double, y int"), ["a", "b"], "y")
    n, cols = len(points), list(zip(*points))
    mean = [sum(c) / n for c in cols[:2]]
    dev = [math.sqrt(sum((x - m) ** 2 for x in c) / n) for c, m in zip(cols, mean)]
    z = [[(p[j] - mean[j]) / dev[j] for j in range(2)] for p in points]
    w, b = [0.0, 0.0], 0.0
    for _ in range(8000):
        e = [1 / (1 + math.exp(-(w[0] * x[0] + w[1] * x[1] + b))) - p[2] for x, p in zip(z, points)]
        w = [w[j] - 0.5 * (sum(k * x[j] for k, x in zip(e, z)) / n + 0.5 * w[j] / n) for j in range(2)]
        b -= 0.5 * sum(e) / n
    assert abs(got["a"] - w[0]) < 1e-3 and abs(got["b"] - w[1]) < 1e-3
    assert U.fitted_weights(spark.createDataFrame([(1.0, 1), (2.0, 1)], "a double, y int"), ["a"], "y") == {"a": 0.0}
