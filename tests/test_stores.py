"""Data sources, streams with state, the posting index and the fit of resumes."""

import json
import random
import re
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, In

from fieldglass.functions.stems import asked, stem, stems
from fieldglass.operators import aggregates as A
from fieldglass.operators import discovery as D
from fieldglass.operators import fit as K
from fieldglass.operators import posting_index as I
from fieldglass.operators import reports as O
from fieldglass.operators import rescore as R
from fieldglass.operators import tracker as T
from fieldglass.operators import upkeep as U
from fieldglass.plans.fits import order_scores
from fieldglass.sources import stored as P
from fieldglass.streaming import timers as M


def envelope(pages, **more):
    return json.dumps({"fetched_at": "1", "pages": [{"url": "u", "status": s, "body": b} for s, b in pages], **more})


def test_rows_of_envelopes():
    rows = lambda line, provider="offices_and_departments": [(r.get("source_job_id"), r.get("error")) for r in P.envelope_rows(line, provider, "s")]
    job = {"id": 7, "title": "T", "location": {"name": "A"}, "offices": [{"name": "B"}, {"name": "A"}, {}], "departments": []}
    assert rows("{") == rows("[]") == rows('"x"') == rows("{}") == [(None, "no envelope")]
    assert rows(envelope([(200, json.dumps({"jobs": [job, job, {"id": 8}]}))])) == [("7", None), ("8", None)]
    assert rows(envelope([(200, "<html>"), (200, '{"jobs": null}'), (200, '{"jobs": {}}'), (200, "{}"), (500, ""), (200, None)])) == [(None, "not JSON"), (None, "not a list"), (None, "no jobs"), (None, "HTTP 500"), (None, "not JSON")]
    assert rows(envelope([(200, "[]")]), "unknown") == [(None, "no such layout")]
    assert rows(envelope([(200, "null")]), "bare_list") == [(None, "not a list")]
    row = next(iter(P.envelope_rows(envelope([(200, json.dumps({"jobs": [job]}))]), "offices_and_departments", "s")))
    assert row["locations"] == ["A", "B"] and row["department"] is None and row["title"] == "T"
    row = next(iter(P.envelope_rows(envelope([(200, json.dumps([{"id": "x", "createdAt": 86_400_000, "categories": None}]))]), "bare_list", "s")))
    assert row["posted_at"] == "1970-01-02T00:00:00Z" and row["locations"] == []
    assert [r["status"] for r in P.envelope_rows(envelope([(404, "")], detail_of=3), "bare_list", "s")] == [404]


@pytest.fixture
def payloads(spark, tmp_path):
    P.register(spark)
    lines = [(p, s, envelope([(200, json.dumps([{"id": f"{s}{i}", "text": "t" * i} for i in range(3)]) if p == "bare_list" else json.dumps({"jobs": [{"id": s}]}))])) for p in P.LAYOUTS for s in "abc"]
    P.write_envelopes(spark.createDataFrame(lines, "provider string, slug string, envelope string"), f"file://{tmp_path}/p")
    return f"file://{tmp_path}/p"


def test_filters_choose_folders(spark, payloads):
    rows = spark.read.format("stored_payloads").load(payloads)
    assert rows.count() == 12
    assert sorted(r.source_job_id for r in rows.where("provider = 'bare_list' AND slug IN ('a', 'c')").collect()) == ["a0", "a1", "a2", "c0", "c1", "c2"]
    assert rows.where("slug = 'z'").count() == 0
    reader = P.PayloadReader(payloads)
    kept = list(reader.pushFilters([EqualTo(("provider",), "bare_list"), In(("slug",), ("a", "c")), EqualTo(("title",), "x")]))
    assert len(kept) == 3  # Spark applies them too
    assert sorted(r[3:] for p in reader.partitions() for r in p.ranges) == [("bare_list", "a"), ("bare_list", "c")]


def test_pages_of_single_postings(spark, payloads):
    more = [("bare_list", "a", envelope([(200, '{"descriptionPlain": "long"}')], detail_of="a0")), ("bare_list", "b", envelope([(404, "")], detail_of="b0")), ("bare_list", "c", envelope([(503, "")], detail_of="c1"))]
    P.write_envelopes(spark.createDataFrame(more, "provider string, slug string, envelope string"), f"{payloads}2")
    rows = spark.read.format("stored_payloads").load(payloads).unionByName(spark.read.format("stored_payloads").load(f"{payloads}2"))
    got = {r.source_job_id: (r.description, r.link) for r in P.with_details(rows.where("provider = 'bare_list'")).collect()}
    assert got["a0"] == ("long", "live") and got["b0"] == (None, "dead") and got["c1"] == (None, "transient") and got["c2"] == (None, "unverified") and len(got) == 9


def test_ranges_give_each_line_once(tmp_path, monkeypatch):
    monkeypatch.setattr(P, "SPLIT_BYTES", 7)
    rng = random.Random(5)
    text = b"".join(b"x" * rng.choice([0, 1, 6, 7, 20]) + b"\n" for _ in range(60)) + b"last without end"
    (tmp_path / "f").write_bytes(text)
    system, path = P.opened(f"file://{tmp_path}/f")
    parts = P.cut([(path, 0, len(text)), ("g", 3, 5)])
    assert all(sum(b - a for _, a, b in p.ranges) <= 7 for p in parts)
    got = [x for p in parts for name, a, b in p.ranges if name == path for x in P.lines(system, path, a, b)]
    assert [v for _, v in got] == text.split(b"\n") and [at for at, _ in got] == [m.start() for m in re.finditer(rb"^", text, re.M)]


def test_growing_files(spark, tmp_path):
    P.register(spark)
    (tmp_path / "in").mkdir()
    stream = spark.readStream.format("delta_lines").load(f"file://{tmp_path}/in")
    drain = lambda: sorted((r.file, r.at, r.value, r.batch) for r in M.drained(spark, stream, f"file://{tmp_path}/out", f"file://{tmp_path}/check").collect())
    (tmp_path / "in/1").write_bytes(b"a\nbb\nhalf")
    (tmp_path / "in/.hidden").write_bytes(b"no\n")
    assert drain() == [("1", 0, "a", 0), ("1", 2, "bb", 0)]
    (tmp_path / "in/1").write_bytes(b"a\nbb\nhalf a line\n\n")
    (tmp_path / "in/2").write_bytes("é\n".encode())
    want = [("1", 0, "a", 0), ("1", 2, "bb", 0), ("1", 5, "half a line", 1), ("1", 17, "", 1), ("2", 0, "é", 1)]
    assert drain() == want == drain()
    # a batch that fails after it read is read again from the same places
    (tmp_path / "in/2").write_bytes("é\nmore\n".encode())

    def fail(batch, number):
        assert batch.count() == 1
        raise RuntimeError("after the read")

    with pytest.raises(Exception, match="after the read"):
        stream.writeStream.foreachBatch(fail).option("checkpointLocation", f"file://{tmp_path}/check").trigger(availableNow=True).start().awaitTermination()
    assert drain() == [*want, ("2", 3, "more", 2)]
    newest = P.LineReader(f"file://{tmp_path}/in", 1)
    assert newest.latestOffset() == {"2": 8} and [p.ranges for p in newest.partitions({"2": 3}, {"2": 8})] == [[("2", 3, 8)]] and list(newest.partitions({"2": 8}, {"2": 8})) == []


def at(hours):
    return datetime(2024, 1, 1) + timedelta(hours=hours)


def waves(spark, tmp_path, schema, batches, run, mode="append"):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
        stream = run(spark.readStream.schema(schema).parquet(f"file://{tmp_path}/in"))
        got = M.drained(spark, stream, f"file://{tmp_path}/out", f"file://{tmp_path}/check", mode)
    return got


def test_engagement_in_time_and_too_late(spark, tmp_path):
    first = [(1, "sent", at(0)), (2, "sent", at(1)), (3, "sent", at(2)), (3, "engaged", at(2)), (9, "engaged", at(3))]
    second = [(1, "engaged", at(48)), (1, "engaged", at(48.5)), (2, "engaged", at(49.5)), (1, "sent", at(49))]
    got = waves(spark, tmp_path, "key long, kind string, at timestamp", [first, second, [(-1, "end", at(97))], [(-1, "end", at(500))]], lambda s: M.keyed(s, M.Engagement(), at="at"))
    assert sorted((r.key, r.outcome, r.at) for r in got.collect()) == [(1, "engaged", at(48)), (1, "ignored", at(97)), (2, "ignored", at(49)), (3, "engaged", at(2))]


class OneBucket:
    """The state and timers of one bucket, kept in Python, with a count of the calls."""

    def __init__(self, processor):
        self.value, self.timers, self.calls, self.processor = None, set(), 0, processor
        processor.init(self)

    def getValueState(self, name, schema):
        return self

    def exists(self):
        return self.value is not None

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls, self.value = self.calls + 1, value

    def clear(self):
        self.calls, self.value = self.calls + 1, None

    def registerTimer(self, t):
        self.calls += 1
        self.timers.add(t)

    def deleteTimer(self, t):
        self.calls += 1
        self.timers.remove(t)

    def getCurrentWatermarkInMs(self):
        return self.mark

    def getExpiryTimeInMs(self):
        return self.expired

    def batch(self, rows, mark):
        """What a batch of rows and the timers under the watermark give."""
        self.mark, got = mark, []
        if len(rows):
            got += self.processor.handleInputRows((0,), iter([rows[: len(rows) // 2], rows[len(rows) // 2 :]]), self)
        while fired := sorted(t for t in self.timers if t < mark):
            self.expired = fired[0]
            got += self.processor.handleExpiredTimer((0,), self, self)
            self.timers.discard(fired[0])
        return sorted((k, o, int(t.timestamp() * 1000)) for g in got for k, o, t in zip(g["key"], g["outcome"], g["at"]))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_engagement_of_many_keys_as_each_alone(seed):
    rnd, hour, bucket, sent, mark = random.Random(seed), M.HOUR, OneBucket(M.Engagement()), {}, 0
    for step in range(12):
        rows = sorted((mark + rnd.randint(0, 60) * hour, rnd.random() < 0.5, rnd.randint(0, 30)) for _ in range(rnd.choice([0, 5, 60])))
        want = []
        for t, engaged, k in rows:  # False, a sending, comes first
            if not engaged:
                sent.setdefault(k, t)
            elif k in sent and t <= sent[k] + 48 * hour:
                want.append((k, "engaged", t))
                del sent[k]
        table = pd.DataFrame({"key": [k for _, _, k in rows], "kind": ["engaged" if e else "sent" for _, e, _ in rows], "at": pd.to_datetime([t for t, _, _ in rows], unit="ms")}).sample(frac=1, random_state=seed)
        mark += rnd.randint(0, 50) * hour
        want += [(k, "ignored", t + 48 * hour) for k, t in sent.items() if t + 48 * hour < mark]
        sent = {k: t for k, t in sent.items() if t + 48 * hour >= mark}
        assert bucket.batch(table, mark) == sorted(want)
        assert bucket.timers == ({min(sent.values()) + 48 * hour} if sent else set()) and bucket.exists() == bool(sent)


def test_a_bucket_of_keys_takes_a_few_calls():
    n, bucket = 50_000, OneBucket(M.Engagement())
    rows = pd.DataFrame({"key": range(n), "kind": "sent", "at": pd.to_datetime(np.arange(n), unit="s")})
    assert bucket.batch(rows, 0) == [] and bucket.calls <= 5
    assert len(bucket.batch(rows[:0], (n + 48 * 3600) * 1000)) == n and bucket.calls <= 10


def test_late_sightings_date_back(spark, tmp_path):
    batches = [[(1, False, at(5)), (2, True, at(5))], [(1, False, at(7)), (2, False, at(1))], [(1, True, at(9)), (3, False, at(0))]]
    got = waves(spark, tmp_path, "key long, known boolean, at timestamp", batches, lambda s: M.keyed(s, M.Sightings(), "Update"), "update")
    assert got.where("key = 1").count() == 2  # nothing is said where nothing changes
    assert sorted(map(tuple, M.latest(got).collect())) == [(1, at(5), False), (2, at(1), False), (3, at(0), True)]


def test_counts_that_collapse(spark, tmp_path):
    batches = [[(1, at(0), 100), (1, at(1), 110), (2, at(0), 0)], [(1, at(2), 20), (1, at(3), 19), (2, at(1), 0), (1, at(4), 0)], [(1, at(5), 90), (2, at(2), 3)]]
    got = waves(spark, tmp_path, "key long, at timestamp, n long", batches, lambda s: M.keyed(s, M.RowCounts()))
    said = {(r.key, r.at): (round(r.typical, 6), r.drifted) for r in got.collect()}
    assert said == {(1, at(0)): (0, False), (1, at(1)): (100, False), (1, at(2)): (103, True), (1, at(3)): (103, True), (1, at(4)): (103, True), (1, at(5)): (103, False), (2, at(0)): (0, True), (2, at(1)): (0, False), (2, at(2)): (0, False)}


def test_each_tier_once_and_none_below_the_top(spark, tmp_path):
    batches = [[(1, "p1", at(0), 1), (1, "p1", at(1), 2)], [(1, "p2", at(2), 3), (1, "p0", at(3), 4), (1, "p3", at(4), 5), (2, "p0", at(0), 6)], [(1, "p0", at(5), 7), (2, "p1", at(6), 8), (3, "p2", at(6), 9)]]
    got = waves(spark, tmp_path, "key long, tier string, at timestamp, id long", batches, lambda s: M.keyed(s, M.EmitOnce()))
    assert sorted(r.id for r in got.collect()) == [1, 3, 4, 6, 9]


# Examples printed with the published rules.
STEMS = "caresses caress ponies poni ties ti cats cat feed feed agreed agre plastered plaster bled bled motoring motor sing sing conflated conflat troubled troubl sized size hopping hop tanned tan falling fall hissing hiss fizzed fizz failing fail filing file happy happi sky sky relational relat conditional condit rational ration digitizer digit vietnamization vietnam operator oper feudalism feudal decisiveness decis hopefulness hope sensibiliti sensibl triplicate triplic formative form formalize formal electrical electr goodness good revival reviv airliner airlin replacement replac dependent depend adoption adopt effective effect probate probat rate rate cease ceas controll control roll roll"


def test_stems():
    said = STEMS.split()
    assert [stem(w) for w in said[::2]] == said[1::2]
    assert stems("Élan, c++ node.js 10x _snake_case") == ["elan", "c", "node", "js", "10x", "snake", "case"]
    assert asked("C++ node.js, !!") == [["c"], ["node", "js"]] and asked(" ") == [] == stems(None)


def test_galloping():
    rng = np.random.default_rng(6)
    for few, many in [(0, 9), (9, 0), (5, 5000), (300, 5000), (2000, 2100), (1, 1)]:
        a, b = (np.unique(rng.integers(0, 6000, n)) for n in (few, many))
        for step in (1, 3, 64):
            assert (I.galloped(a, b, step) == np.intersect1d(a, b)).all()


def plain_search(texts, queries):
    out = set()
    for name, said in queries.items():
        runs = asked(said)
        out |= {(name, d) for d, t in texts.items() if runs and all(I.holds(stems(t), r) for r in runs)}
    return out


def test_index_as_a_plain_scan(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(I, "RANGE", 16)
    rng = random.Random(4)
    vocabulary = ["run", "running", "Runs", "node.js", "node", "js", "c++", "école", "ecole", "x", "hopeful", "hoping", "", "10"]
    text = lambda: rng.choice([None, " ".join(rng.choices(vocabulary, k=rng.randrange(9)))])
    texts, path = {}, f"file://{tmp_path}/index"
    queries = {"a": "runner running", "b": "run", "c": "node.js", "d": "js node", "e": "hope ECOLES", "f": "", "g": "absent run", "h": "x 10 run"}
    for generation in range(3):
        changed = {rng.randrange(120): text() for _ in range(80)}
        write = lambda g=generation, c=changed, old=dict(texts): I.write_generation(spark.createDataFrame([(d, old.get(d), t) for d, t in c.items()], "doc_id long, old string, new string"), path, g)
        write()
        write()  # a batch done again changes nothing
        texts |= changed
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = [(r.query, r.doc_id) for r in I.search(spark, path, queries, docs).collect()]
    assert len(got) == len(set(got)) and set(got) == plain_search(texts, queries)
    I.compacted(spark, path, f"{path}-one")
    again = I.search(spark, f"{path}-one", queries, docs)
    assert {(r.query, r.doc_id) for r in again.collect()} == set(got)
    assert I.blocks_of(spark, f"{path}-one").where("generation <> 0 OR size(gone) > 0 OR size(ids) = 0").count() == 0


def test_a_search_reads_only_its_blocks(spark, tmp_path, capsys):
    path = f"file://{tmp_path}/index"
    docs = spark.range(500).select(F.col("id").alias("doc_id"), F.lit(None).cast("string").alias("old"), F.concat_ws(" ", F.concat(F.lit("w"), F.col("id") % 97), F.lit("all")).alias("new"))
    I.write_generation(docs, path, 0)
    found = I.blocks_of(spark, path, ["w5", "all"])
    assert found.select("folder").distinct().count() == 2 < I.blocks_of(spark, path).select("folder").distinct().count()
    found.explain("formatted")
    plan = capsys.readouterr().out
    assert re.search(r"PartitionFilters: \[.*folder.*IN", plan) and re.search(r"PushedFilters: \[.*In\(term", plan)


def test_fit_of_one_posting(spark):
    profile = K.Profile({"go": K.Skill(0.9, "Go"), "c": K.Skill(0.0), "sql": K.Skill(0.2, "SQL", ("Select",))}, edges=("go",), gaps=("c", "distributed_systems"), domain="sql", domain_categories=("ai_lab",), stack_note="note")
    bullets = spark.createDataFrame([(1, 1, "Wrote golang"), (1, 2, "SELECTed " + "x" * 300), (1, 3, "go again"), (2, 1, "nothing")], "resume long, n long, bullet string")
    found = {r.resume: r.evidence for r in K.evidence(bullets, profile, ["go", "sql", "c"]).collect()}
    assert found[1] == {"go": "Wrote golang", "sql": ("SELECTed " + "x" * 300)[:220], "c": "SELECTed " + "x" * 211} and 2 not in found
    rows = spark.createDataFrame([(["c"], ["Golang", "SQL ", "golang", "none"], "ai_lab", None, "low_latency_systems", 0.6, found[1]), ([], None, "big_tech_swe", None, None, None, None), (None, None, None, "devops_sre", None, 0.15, {})], "tags array<string>, names array<string>, category string, family string, sub string, sim double, found map<string,string>")
    tags = K.required_tags(F.col("tags"), F.col("names"))
    a, b, c = (r.f for r in rows.select(K.fit(profile, tags, F.col("category"), F.col("family"), F.col("sub"), F.col("sim"), F.col("found")).alias("f")).collect())
    stack = 0.8 * (1.4 * 0 + 1.6 * 0.9 + 0.2) / (1.4 + 1.6 + 1)
    assert abs(a.stack - stack) < 1e-12 and abs(a.fit - (0.5 * stack + 0.3 + 0.2 * 0.8)) < 1e-12
    assert [(m.strength, m.evidence) for m in a.matched] == [("Go depth (edge)", "Wrote golang"), ("Go", "Wrote golang"), ("SQL", found[1]["sql"])]
    assert [tuple(g)[:2] for g in a.gaps] == [("c", "high"), ("SQL", "medium"), ("deep infra / distributed systems", "high")]
    assert a.explanation == "stack 0.33 over 3 tags; embedding sim 0.60; domain bonus +0.12"
    assert (b.stack, b.archetype, b.hours, [g.gap for g in b.gaps]) == (0.55, "leetcode_grind", 30, ["Big Tech stack mismatch"]) and abs(b.fit - (0.7 * 0.55 + 0.15)) < 1e-12
    assert abs(c.stack - 0.44) < 1e-12 and abs(c.fit - (0.22 + 0.1)) < 1e-12 and c.matched == [] and c.archetype == "behavioral_heavy"


def test_descent_step_by_step(spark):
    rng = random.Random(8)
    points = [(rng.gauss(0, 2), rng.gauss(1, 1), 3.0, int(rng.random() < 0.4)) for _ in range(40)] * 2 + [(None, 1.0, 3.0, 1)]
    rows = spark.createDataFrame(points, "a double, b double, c double, y int")
    x = np.array([p[:3] for p in points[:80]])
    z = (x - x.mean(0)) / np.where(x.std(0) > 0, x.std(0), 1)
    y, w, b = np.array([p[3] for p in points[:80]]), np.zeros(3), 0.0
    for _ in range(30):
        e = 1 / (1 + np.exp(-(z @ w + b))) - y
        w, b = w - 0.1 * (z.T @ e / 80 + 0.5 * w / 80), b - 0.1 * e.mean()
    for one_fit in (100, 5):  # in one task, and a pass a step
        got = {r.feature: r.weight for r in U.descended_weights(rows, ["a", "b", "c"], "y", steps=30, one_fit=one_fit).collect()}
        assert np.allclose([got[c] for c in "abc"], w, atol=1e-9)
    assert [r.weight for r in U.descended_weights(rows.limit(0), ["a"], "y").collect()] == [0.0]


def test_what_a_change_reaches(spark, capsys, tmp_path):
    scores = order_scores()
    assert scores.reached({"o_orderstatus"}) == ["open", "urgent", "score"] and scores.reached(settings={"pay_weight"}) == ["score"]
    assert scores.reached({"unheard of"}) == [] and scores.read(["urgent", "score"]) == ["o_orderpriority", "open", "pay"]
    with pytest.raises(ValueError, match="declared later"):
        R.Scores(R.Derived("a", lambda s: F.lit(1), ("b",)), R.Derived("b", lambda s: F.lit(1), ()))
    with pytest.raises(ValueError, match="needs itself"):
        R.Scores(R.Derived("a", lambda s: F.lit(1), ("a",)))
    rows = [(i, i * 1000.0, "OFP"[i % 3], f"{1 + i % 5}-X") for i in range(60)]
    settings = {"floor": 20000.0, "urgency": 0.5, "pay_weight": 1.0}
    full = scores.computed(spark.createDataFrame(rows, "o_orderkey long, o_totalprice double, o_orderstatus string, o_orderpriority string"), settings)
    full.coalesce(1).sortWithinPartitions("o_orderkey").write.parquet(f"file://{tmp_path}/kept")
    kept = spark.read.parquet(f"file://{tmp_path}/kept")
    changes = spark.createDataFrame([(3, "F"), (4, "O"), (4, "P"), (999, "F"), (None, "F")], "o_orderkey long, o_orderstatus string")
    new = scores.after_action(kept, "o_orderkey", changes, settings)
    assert new.columns == ["o_orderkey", "o_orderstatus", "open", "urgent", "score"] and [r.o_orderkey for r in new.orderBy("o_orderkey").collect()] == [3, 4]
    new.explain("formatted")
    assert re.search(r"PushedFilters: \[.*In\(o_orderkey", capsys.readouterr().out)
    after = scores.computed(spark.createDataFrame([(i, p, {3: "F", 4: "O"}.get(i, s), t) for i, p, s, t in rows], "o_orderkey long, o_totalprice double, o_orderstatus string, o_orderpriority string"), settings)
    assert sorted(map(tuple, R.patched(kept, "o_orderkey", new).collect())) == sorted(map(tuple, after.collect()))
    weights = scores.after_settings(kept, "o_orderkey", settings, settings | {"pay_weight": 3.0})
    weights.explain("formatted")
    assert re.search(r"ReadSchema: struct<o_orderkey:bigint,pay:double,urgent:double>", capsys.readouterr().out)
    same = scores.after_settings(kept, "o_orderkey", settings, settings)
    assert same.columns == ["o_orderkey"] and R.patched(kept, "o_orderkey", same).columns == kept.columns


def test_slugs_that_are_taken(spark):
    new = spark.createDataFrame([("a", "x", 1), ("b", "x", 5), ("c", "x-2", 9), ("d", "y", 1), ("e", "x", 5), ("f", "z-3", 1)], "key string, base string, seen long")
    taken = spark.createDataFrame([("x-3",), ("y",), ("z",), ("other-9",)], "slug string")
    assert {r.key: r.slug for r in D.numbered_slugs(new, taken).collect()} == {"b": "x", "c": "x-2", "e": "x-4", "a": "x-5", "d": "y-2", "f": "z-3"}
    assert D.numbered_slugs(new.limit(0), taken).count() == 0


def test_workflow_goes_by_the_natural_key(spark, tmp_path):
    columns = "board string, job string, status string, status_changed_at timestamp, starred boolean, notes string, tags_user array<string>, title string"
    old = spark.createDataFrame([("b", "1", "applied", datetime(2024, 1, 2), False, None, None, "t"), ("b", "2", "new", None, True, "", [], "t"), ("b", "3", "new", None, None, "", [], "t"), ("b", "4", "dismissed", None, False, "why", ["x"], "t"), ("b", "5", "shortlisted", None, False, None, None, "t")], columns)
    T.export_workflow(old, ["board", "job"], f"file://{tmp_path}/w")
    T.export_workflow(old, ["board", "job"], f"file://{tmp_path}/w")
    at = datetime(2020, 1, 1)
    now = spark.createDataFrame([("b", j, s, at, False, None, None, "new title") for j, s in (("1", "new"), ("2", "new"), ("3", "new"), ("4", "applied"), ("6", "new"))], columns)
    got = {r.job: (r.status, r.status_changed_at, r.starred, r.notes, r.tags_user, r.title) for r in T.import_workflow(now, ["board", "job"], f"file://{tmp_path}/w").collect()}
    assert got == {"1": ("applied", datetime(2024, 1, 2), False, None, None, "new title"), "2": ("new", at, True, "", [], "new title"), "3": ("new", at, False, None, None, "new title"), "4": ("applied", at, False, None, None, "new title"), "6": ("new", at, False, None, None, "new title")}


def test_places_in_small_and_large_groups(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.choice([None, *range(9)])) for _ in range(400)] + [("c", 1), ("d", None)]
    df = spark.createDataFrame(rows, "k string, v int")
    want = {}
    for k in {k for k, _ in rows}:
        v = sorted(v for x, v in rows if x == k and v is not None)
        if len(v) >= 2:
            want[k] = (v[len(v) // 4], v[-1], len(v))
    for small in (0, 100, 1000):
        got = A.at_places(df, ["k"], "v", 2, {"q": F.floor(F.col("_n") / 4), "top": F.col("_n") - 1}, small).collect()
        assert {r.k: (r.q, r.top, r.n) for r in got} == want and len(got) == len(want)


def test_lines_and_sections_of_a_report(spark):
    pay = spark.createDataFrame([(120500.0, 121500.0, None), (0.0, 9.0, 80_000.0), (None, None, None), (1.0, None, 0.0)], "low double, high double, est double")
    assert [r[0] for r in pay.select(O.pay_text(F.col("low"), F.col("high"), F.col("est"))).collect()] == ["$120–122k", "~$80k est", "no comp", "no comp"]
    line = O.posting_line(F.lit(None).cast("string"), F.lit("T"), F.lit("new_york"), F.lit("p"), F.lit("arguably_better"), F.lit("u"))
    assert spark.range(1).select(line).first()[0] == "•  — T · new york · p · arguably better\n  u"
    new = spark.createDataFrame([(i, "ab"[i % 2], float(i), f"l{i}") for i in range(20)] + [(99, None, 1.0, "x")], "id long, category string, priority double, line string")
    today = spark.createDataFrame([(3, "c"), (1, "a"), (2, "b")], "rank long, line string")
    none = spark.createDataFrame([], "id long, line string")
    got = [(r.section, r.n, r.body) for r in O.daily(new, today, none, {"b": 1}, shown=2, places=2).orderBy("place").collect()]
    assert got == [("head", 21, "21 new postings cleared the floor in the last 24h."), ("b", 10, "B (10)\nl19\nl17\n  … and 8 more in the dashboard"), ("a", 10, "A (10)\nl18\nl16\n  … and 8 more in the dashboard"), ("other", 1, "OTHER (1)\nx"), ("today", 2, "TODAY'S QUEUE (2)\na\nb")]
    assert [r.n for r in O.daily(new.limit(0), today.limit(0), none, {}).orderBy("place").collect()] == [0, 0]


def test_siblings_of_the_asked(spark):
    rows = spark.createDataFrame([(1, 7), (2, 7), (3, 7), (4, 8), (5, None), (6, 8)], "id long, c long")
    asked = spark.createDataFrame([(2,), (5,), (2,), (99,)], "id long")
    assert sorted((r.id, r.siblings) for r in T.siblings(rows, "id", "c", asked).collect()) == [(2, [1, 3]), (5, [])]
    assert {r.id: r.siblings for r in T.siblings(rows, "id", "c").collect()} == {1: [2, 3], 2: [1, 3], 3: [1, 2], 4: [6], 5: [], 6: [4]}
