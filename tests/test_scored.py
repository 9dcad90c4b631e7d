import random

import pytest
from pyspark.sql import functions as F

from fieldglass.functions import extract as X
from fieldglass.operators import resolution as N
from fieldglass.operators import scoring as S
from fieldglass.plans import scored as Q
from fieldglass.streaming import alerts as L


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_location_value_golden(spark):
    v = one(spark, S.location_value(F.lit(130000.0), F.lit(0.094), F.lit(140.0), F.lit(32000.0), S.Home(85000.0, 0.049, 85.0, 0.25)))
    assert (v.tax_delta, v.adjustment, v.adjusted, v.effective) == (6151, -48655, 75194, 107194)


def test_knobs_are_checked():
    with pytest.raises(ValueError):
        S.Gates(floor=2, parity=1)
    with pytest.raises(ValueError):
        S.composite({"a": (F.lit(1.0), 0.7)}, F.lit(False), F.lit(False))


def test_proposed_weights():
    got = S.proposed_weights({"a": 0.5, "b": 0.5}, {"a": 2.0, "b": -1.0})
    assert got == pytest.approx({"a": 0.65, "b": 0.35}) and S.proposed_weights({"a": 1.0}, {}) == {"a": 1.0}


@pytest.mark.parametrize(("text", "years"), [("3-5 years of experience", 3), ("minimum of 4 years; 2+ yrs professional experience", 2), ("2 years experience. New grads welcome", 0), ("5 years of experience, recent graduates are eligible", 5), ("no prior experience required", 0), ("20 years of experience", None), ("a team", None), (None, None)])
def test_years(spark, text, years):
    assert one(spark, X.least_years(F.lit(text).cast("string"))) == years


def test_linked(spark):
    rows = spark.createDataFrame([(1, "a", None), (2, None, None), (5, "b", "x"), (4, "a", "x"), (9, "b", "q"), (7, None, "z"), (7, None, "z")], "id long, u string, v string")
    assert {r.id: r.cluster for r in N.linked(rows, "id", ["u", "v"]).collect()} == {1: 1, 2: 2, 5: 1, 4: 1, 9: 1, 7: 7}
    assert N.linked(rows.limit(0), "id", ["u"]).count() == 0


@pytest.mark.parametrize("one_task, seed", [(20_000, 5), (0, 5), (20_000, 6), (7, 7)])
def test_merged_best_first(spark, one_task, seed):
    rnd = random.Random(seed)
    rows = [(i, rnd.choice(["s", "t", None]), rnd.randint(1, 3)) for i in range(16)]
    pairs = [(a, b, rnd.choice([0.7, 0.8, 0.9, 0.8 + rnd.random() / 5])) for a in range(16) for b in range(a + 1, 16) if rnd.random() < 0.25 and (a < 12) == (b < 12)]
    rows[12:] = [(i, None, None) for i in range(12, 16)]
    of = {i: {i} for i in range(16)}
    name = {i: (s, n) for i, s, n in rows if s}
    for a, b, score in sorted(pairs, key=lambda p: (-p[2], p[0], p[1])):
        if score >= 0.8 and of[a] is not of[b]:
            both, seen = of[a] | of[b], {}
            if all(seen.setdefault(name[i][0], name[i][1]) == name[i][1] for i in both if i in name):
                for i in both:
                    of[i] = both
    got = N.merged_best_first(spark.createDataFrame(rows, "id long, s string, n int"), spark.createDataFrame(pairs, "a long, b long, score double"), "id", "s", "n", one_task=one_task)
    assert {r.id: r.cluster for r in got.collect()} == {i: min(c) for i, c in of.items()}


def test_pair_score(spark):
    none, no = F.lit(None).cast("double"), F.lit(False)
    assert one(spark, N.pair_score(F.lit(0.9), none, none, F.lit(10.0), no, no)) == pytest.approx(0.93)
    assert one(spark, N.pair_score(F.lit(0.9), F.lit(0.5), F.lit(1.0), F.lit(100.0), F.lit(True), no)) == pytest.approx(0.229)
    assert one(spark, N.pair_score(F.lit(0.1), none, none, F.lit(400.0), no, F.lit(True))) == 0


def test_link_state_and_drift(spark):
    assert tuple(one(spark, L.link_state(F.lit("live"), F.lit("transient"), F.lit(True)))) == ("live", False)
    assert tuple(one(spark, L.link_state(F.lit("live"), F.lit("dead_404"), F.lit(True)))) == ("dead_404", True)
    assert [one(spark, L.drifted(F.lit(n), F.lit(u))) for n, u in ((3, 30), (10, 30), (0, 5), (0, 0))] == [True, False, True, False]


def rows_of(spark, folder, name, table, rows, schema):
    """Rows of a registered query over a table of these rows, and those of its SQL."""
    import duckdb

    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{table}.parquet")
    db = duckdb.connect()
    db.sql(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    return sorted(map(tuple, Q.QUERIES[name](spark, str(folder)).collect())), sorted(map(tuple, db.sql(Q.SQL[name]).fetchall()))


def test_expected_value_next_to_a_half(spark, tmp_path):
    orders = [(k, k % 997, 12.5 * (k * 7919 % 50_000)) for k in range(20_000)] + [(273_716, 21_889, 496_250.0), (4_216_831, 420_129, 384_750.0)]
    ours, theirs = rows_of(spark, tmp_path, "expected_value", "orders", orders, "o_orderkey long, o_custkey long, o_totalprice double")
    assert ours == theirs and (273_716, 215_006) in ours and (4_216_831, 154_377) in ours


def test_years_after_other_numbers(spark, tmp_path):
    rnd, parts = random.Random(3), ["1", "7", "13", "0", "99", "-", "–", "+", " ", "  ", "\n", "\x0b", " ", " years", " YEARſ", " years of experience", "at least ", "to", "no experience required", "ñ", "😀", "call +1 (427) 555-1339 now"]
    texts = ["Thedan eaer 4270558249789290 +1 (427) 555-1339 clown moron erou thwhan onreatw onst tiontion", "12- 45", "9" * 300, "", None]
    texts += ["".join(rnd.choices(parts, k=rnd.randint(0, 24))) for _ in range(3000)]
    ours, theirs = rows_of(spark, tmp_path, "years_in_texts", "documents", list(enumerate(texts)), "doc_id long, text string")
    assert ours == theirs and len({y for _, y in ours}) > 8


def test_long_runs_of_digits_are_passed_over_once(spark):
    assert one(spark, X.least_written_years(F.repeat(F.lit("7"), F.lit(400_000)))) is None
