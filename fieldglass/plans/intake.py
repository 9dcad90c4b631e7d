"""Registered queries of feeds, places, pay in prose, estimates, sub-scores and upkeep, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import extract as X
from ..functions import places as P
from ..operators import estimates as E
from ..operators import upkeep as U
from ..sources import feeds as S

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return register


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def listed(spark, d, item: str, keys: tuple = ("o_custkey",)):
    """One array of items per customer, over all orders."""
    return table(spark, d, "orders").groupBy(*keys).agg(F.collect_list(F.expr(item)).alias("xs"))


@query("SELECT o_custkey, CAST(o_orderkey AS VARCHAR) AS source_job_id, o_orderpriority AS title, 'http://x/' || o_orderkey AS apply_url, CASE WHEN o_orderstatus = 'F' THEN 'F' ELSE o_orderstatus || ',F' END AS locations, o_orderstatus AS department, CAST(o_orderdate AS DATE) AS day FROM orders")
def feed_offices_and_departments(spark, d):
    item = "struct(o_orderkey AS id, o_orderpriority AS title, concat('http://x/', o_orderkey) AS absolute_url, date_format(o_orderdate, 'yyyy-MM-dd') AS updated_at, struct(o_orderstatus AS name) AS location, array(struct('F' AS name), struct(o_orderstatus AS name)) AS offices, array(struct(o_orderstatus AS name)) AS departments)"
    payloads = listed(spark, d, item).select("o_custkey", F.to_json(F.struct(F.col("xs").alias("jobs"))).alias("content"))
    rows, _ = S.read_feed(payloads, "content", S.FEEDS["offices_and_departments"])
    return rows.select("o_custkey", "source_job_id", "title", "apply_url", F.array_join("locations", ",").alias("locations"), "department", F.to_date("posted_at").alias("day"))


@query("SELECT o_custkey, CAST(o_orderkey AS VARCHAR) AS source_job_id, o_orderpriority AS title, o_orderstatus AS place, count(*) OVER (PARTITION BY o_custkey) >= 9 AS complete FROM orders")
def feed_paged(spark, d):
    item = "struct(o_orderpriority AS title, concat('/job/a_', o_orderkey) AS externalPath, o_orderstatus AS locationsText)"
    pages = F.array(F.struct(F.lit(9).alias("total"), F.slice("xs", 1, 3).alias("jobPostings")), F.struct(F.lit(None).cast("int").alias("total"), F.slice("xs", 4, 1_000_000).alias("jobPostings")))
    rows, _ = S.read_feed(listed(spark, d, item).select("o_custkey", F.to_json(F.struct(pages.alias("pages"))).alias("content")), "content", S.FEEDS["paged"])
    return rows.select("o_custkey", "source_job_id", "title", F.col("locations")[0].alias("place"), "complete")


@query("SELECT o_custkey, CAST(o_orderkey AS VARCHAR) AS source_job_id, o_orderpriority AS title, o_orderstatus || ',Z' AS locations FROM orders")
def feed_two_levels(spark, d):
    item = "struct(CAST(o_orderkey AS string) AS Id, o_orderpriority AS Title, o_orderstatus AS PrimaryLocation, array(struct('Z' AS Name)) AS secondaryLocations)"
    groups = listed(spark, d, item, ("o_custkey", "o_orderstatus")).groupBy("o_custkey").agg(F.collect_list(F.struct(F.col("xs").alias("requisitionList"))).alias("items"))
    rows, _ = S.read_feed(groups.select("o_custkey", F.to_json(F.struct("items")).alias("content")), "content", S.FEEDS["two_levels"])
    return rows.select("o_custkey", "source_job_id", "title", F.array_join("locations", ",").alias("locations"))


@query("SELECT o_custkey, CAST(o_orderkey AS VARCHAR) AS source_job_id, 'about' || chr(10) || 'needs' || chr(10) || o_orderpriority AS description, CASE WHEN o_orderstatus <> 'O' THEN o_totalprice END AS pay_max, CASE WHEN o_orderstatus = 'F' THEN 'hour' WHEN o_orderstatus = 'P' THEN 'year' END AS pay_interval FROM orders")
def feed_bare_list(spark, d):
    pay = "CASE WHEN o_orderstatus <> 'O' THEN struct(1.0D AS min, o_totalprice AS max, CASE o_orderstatus WHEN 'F' THEN 'per-hour-wage' ELSE 'per-year-salary' END AS interval) END"
    item = f"struct(CAST(o_orderkey AS string) AS id, o_orderpriority AS text, 'about' AS descriptionPlain, array(struct('needs' AS text, o_orderpriority AS content)) AS lists, {pay} AS salaryRange)"
    rows, _ = S.read_feed(listed(spark, d, item).select("o_custkey", F.to_json("xs").alias("content")), "content", S.FEEDS["bare_list"])
    return rows.select("o_custkey", "source_job_id", "description", "pay_max", "pay_interval")


@query("SELECT o_custkey, CAST(o_orderkey AS VARCHAR) AS source_job_id, greatest(o_totalprice, 100000.0) AS pay_max, 'year' AS pay_interval FROM orders WHERE o_orderstatus <> 'P'")
def feed_pay_tiers(spark, d):
    part = lambda kind, most: f"struct('{kind}' AS compensationType, '1 YEAR' AS interval, 1.0D AS minValue, {most} AS maxValue)"
    item = f"struct(CAST(o_orderkey AS string) AS id, o_orderpriority AS title, o_orderstatus <> 'P' AS isListed, struct(array(struct(array({part('Salary', 'o_totalprice')}, {part('Bonus', '9e9D')}) AS components), struct(array({part('Salary', '100000.0D')}) AS components)) AS compensationTiers) AS compensation)"
    payloads = listed(spark, d, item).select("o_custkey", F.to_json(F.struct(F.col("xs").alias("jobs"))).alias("content"))
    rows, _ = S.read_feed(payloads, "content", S.FEEDS["pay_tiers"])
    return rows.select("o_custkey", "source_job_id", "pay_max", "pay_interval")


@query("SELECT o_custkey, CAST(o_orderkey AS VARCHAR) AS source_job_id, 'Utrecht, NL' AS place FROM orders WHERE o_orderstatus <> 'P'")
def feed_status_filtered(spark, d):
    item = "struct(o_orderkey AS id, o_orderpriority AS title, CASE o_orderstatus WHEN 'P' THEN 'draft' WHEN 'F' THEN 'published' END AS status, 'Utrecht' AS city, 'NL' AS country)"
    payloads = listed(spark, d, item).select("o_custkey", F.to_json(F.struct(F.col("xs").alias("offers"))).alias("content"))
    rows, _ = S.read_feed(payloads, "content", S.FEEDS["status_filtered"])
    return rows.select("o_custkey", "source_job_id", F.col("locations")[0].alias("place"))


@query("SELECT o_custkey, CAST(o_orderkey AS VARCHAR) AS source_job_id, CAST(o_orderdate AS DATE) AS day FROM orders WHERE o_orderstatus = 'F'")
def feed_aggregated(spark, d):
    item = "struct(CAST(o_orderkey AS string) AS id, o_orderpriority AS title, o_orderstatus <> 'P' AS active, o_orderstatus <> 'O' AS is_visible, unix_seconds(CAST(to_date(o_orderdate) AS timestamp)) AS date_posted, array('a') AS locations)"
    rows, _ = S.read_feed(listed(spark, d, item).select("o_custkey", F.to_json("xs").alias("content")), "content", S.FEEDS["aggregated"])
    return rows.select("o_custkey", "source_job_id", F.to_date("posted_at").alias("day"))


@query("SELECT CASE event_type WHEN 'click' THEN 'not JSON' ELSE 'no jobs' END AS reason, count(*) AS n FROM events WHERE event_type IN ('click', 'view') GROUP BY 1")
def feed_quarantine(spark, d):
    content = F.when(F.col("event_type") == "click", F.concat(F.lit("<"), "props")).when(F.col("event_type") == "view", F.lit('{"other": []}')).otherwise(F.lit('{"jobs": null}'))
    _, bad = S.read_feed(table(spark, d, "events").select("event_id", content.alias("content")), "content", S.FEEDS["offices_and_departments"])
    return bad.groupBy("reason").agg(F.count("*").alias("n"))


@query(
    "WITH s AS (SELECT s_nationkey, s_suppkey, s_name, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS i FROM supplier) "
    "SELECT a.s_nationkey, b.s_name AS company, 'Role ' || a.s_suppkey AS title, CASE WHEN a.s_suppkey % 2 = 0 THEN 'https://e.x/' ELSE 'https://tracker.x/' END || a.s_suppkey AS url FROM s a JOIN s b ON a.s_nationkey = b.s_nationkey AND b.i = a.i - (a.i - 1) % 3 WHERE a.s_suppkey % 7 <> 0"
)
def pipe_tables(spark, d):
    line = (
        "concat('| ', CASE WHEN (i - 1) % 3 = 0 THEN concat('**', s_name, '**') ELSE '↳' END, ' | Role ', s_suppkey, ' | NYC | ', "
        "CASE WHEN s_suppkey % 7 = 0 THEN '🔒' ELSE concat('[t](https://tracker.x/', s_suppkey, ')', CASE WHEN s_suppkey % 2 = 0 THEN concat(' [Apply](https://e.x/', s_suppkey, ')') ELSE '' END) END, ' |')"
    )
    from pyspark.sql import Window

    numbered = table(spark, d, "supplier").withColumn("i", F.row_number().over(Window.partitionBy("s_nationkey").orderBy("s_suppkey")))
    lines = numbered.groupBy("s_nationkey").agg(F.array_sort(F.collect_list(F.struct("i", F.expr(line).alias("line")))).alias("xs"))
    text = F.concat(F.lit("# Roles\n\n| Company | Role | Location | Apply |\n| --- | --- | --- | --- |\n"), F.array_join("xs.line", "\n"))
    return S.pipe_table(lines.select("s_nationkey", text.alias("text")), "s_nationkey", "text").select("s_nationkey", "company", "title", "url")


@query(
    "WITH x AS (SELECT o_orderkey, o_orderkey % 6 AS k, 50 + o_custkey % 100 AS lo FROM orders) "
    "SELECT o_orderkey, CAST(CASE k WHEN 0 THEN lo * 1000 WHEN 1 THEN lo * 1000 WHEN 2 THEN 40 WHEN 5 THEN lo * 1000 END AS DOUBLE) AS low, CAST(CASE k WHEN 0 THEN (lo + 30) * 1000 WHEN 1 THEN (lo + 30) * 1000 WHEN 2 THEN 55.5 WHEN 5 THEN (lo + 30) * 1000 END AS DOUBLE) AS high, "
    "CASE WHEN k IN (0, 1, 5) THEN 'year' WHEN k = 2 THEN 'hour' END AS interval, CAST(CASE k WHEN 0 THEN 0.9 WHEN 1 THEN 0.55 WHEN 2 THEN 0.9 WHEN 5 THEN 0.9 END AS DOUBLE) AS confidence FROM x"
)
def stated_pay(spark, d):
    text = (
        "CASE o_orderkey % 6 WHEN 0 THEN concat('The pay range is $', lo, ',000 - $', lo + 30, ',000 for this role') WHEN 1 THEN concat('We offer ', lo, 'k to ', lo + 30, 'k') WHEN 2 THEN '$40 - $55.50 per hour' "
        "WHEN 3 THEN concat('Salary range EUR ', lo, ',000 - ', lo + 30, ',000') WHEN 4 THEN 'grow 20 - 35 people' ELSE concat('Sign-on bonus 25000 - 30000. ', repeat('Then a lot of other words follow here. ', 9), 'Base pay: $', lo, 'k – $', lo + 30, 'k a year') END"
    )
    o = table(spark, d, "orders").select("o_orderkey", (50 + F.col("o_custkey") % 100).alias("lo"))
    return o.select("o_orderkey", X.posted_pay(F.expr(text)).alias("p")).select("o_orderkey", "p.low", "p.high", "p.interval", "p.confidence")


_TITLES = ["Senior Engineer", "Software Engineer II", "Engineer, L4", "New Grad Engineer", "Staffing Analyst", "Junior developer 3", "Sr. Analyst", "ii engineer", "University Program"]
_MARKS = ["Senior", "II", "L4", None, None, "developer 3", "Sr", None, None]
_STARTS = [False, False, False, True, False, True, False, False, True]


def _case(values, key):
    said = lambda v: "NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v)
    return f"CASE {key} " + " ".join(f"WHEN {i} THEN {said(v)}" for i, v in enumerate(values)) + " END"


@query(f"SELECT p_partkey, {_case(_MARKS, 'p_partkey % 9')} AS mark, {_case(_STARTS, 'p_partkey % 9')} AS beginners FROM part")
def title_marks(spark, d):
    title = F.array(*map(F.lit, _TITLES))[(F.col("p_partkey") % 9).cast("int")]
    return table(spark, d, "part").select("p_partkey", X.senior_mark(title).alias("mark"), X.for_beginners(title).alias("beginners"))


KNOWN = P.Places(
    metros={"alpha": ("best", ["AA", "AB"], ["Alphaville", "alpha city"]), "beta": ("good", ["BB"], ["Beta", "Betatown"])},
    states={"AA": "Alphaland", "AB": "Abland", "BB": "Betaland", "DE": "Deland"},
    countries={"DE": ["germany", "berlin"], "UK": ["london"]},
    weak=frozenset({"beta"}),
    buckets=["best", "good", "elsewhere", "remote"],
)
_RAW = ["Alphaville, AA", "Betatown - BB", "Berlin, DE", "Remote - US", "Beta, AA", "Multiple Locations", "Remote (Alphaville)", "Beta, Germany", "US", "nowhere", "Hybrid; Alpha City | London", ""]
_KIND = ["metro", "metro", "international", "remote", "us_unknown", "multiple", "metro", "international", "us_unknown", "unknown", "metro", "unknown"]
_METRO = ["alpha", "beta", None, None, None, None, "alpha", None, None, None, "alpha", None]
_STATE = ["AA", "BB", None, None, "AA", None, "AA", None, None, None, "AA", None]
_BUCKET = ["best", "good", "elsewhere", "remote", "elsewhere", "elsewhere", "remote", "elsewhere", "elsewhere", "elsewhere", "best", "elsewhere"]
_PRIMARY = ["alpha", "beta", None, "remote", "us_unknown", None, "alpha", None, "us_unknown", None, "alpha", None]
_MODE = ["onsite", "onsite", "unknown", "remote", "unknown", "unknown", "remote", "unknown", "unknown", "unknown", "hybrid", "unknown"]


def _raw_place():
    return F.array(*map(F.lit, _RAW))[(F.col("c_custkey") % 12).cast("int")]


@query(f"SELECT c_custkey, {_case(_KIND, 'c_custkey % 12')} AS kind, {_case(_METRO, 'c_custkey % 12')} AS metro, {_case(_STATE, 'c_custkey % 12')} AS state, {_case(_BUCKET, 'c_custkey % 12')} AS bucket FROM customer")
def places(spark, d):
    p = P.place(_raw_place(), KNOWN)
    return table(spark, d, "customer").select("c_custkey", p.alias("p")).select("c_custkey", "p.kind", "p.metro", "p.state", "p.bucket")


@query(f"SELECT c_custkey, {_case(_PRIMARY, 'c_custkey % 12')} AS primary_place, {_case(_MODE, 'c_custkey % 12')} AS work_mode, c_custkey % 12 IN (2, 7) AS abroad_only FROM customer")
def places_together(spark, d):
    every = F.transform(P.apart(_raw_place()), lambda x: P.place(x, KNOWN))
    c = table(spark, d, "customer").select("c_custkey", every.alias("every")).select("c_custkey", P.together(F.col("every"), KNOWN).alias("t"))
    return c.select("c_custkey", F.col("t.primary").alias("primary_place"), "t.work_mode", "t.abroad_only")


@query(
    "WITH p AS (SELECT p_partkey, p_brand, p_type, p_size, CASE WHEN p_size % 3 = 0 THEN p_retailprice * 100 END AS lo, CASE WHEN p_size % 3 = 0 THEN p_retailprice * 140 END AS hi FROM part), "
    "f AS (SELECT p_brand, p_type, median(lo) AS l, median(hi) AS h FROM p WHERE lo IS NOT NULL GROUP BY ALL HAVING count(*) >= 2), g AS (SELECT p_type, median(lo) AS l, median(hi) AS h FROM p WHERE lo IS NOT NULL GROUP BY ALL HAVING count(*) >= 5), "
    "x AS (SELECT p_partkey, p_size, CASE WHEN lo IS NOT NULL THEN 'posted' WHEN f.l IS NOT NULL THEN 'company' WHEN g.l IS NOT NULL THEN 'peers' ELSE 'unknown' END AS pay_source, CAST(coalesce(p.lo, f.l, g.l, 90000.0) AS DOUBLE) AS l, CAST(coalesce(p.hi, f.h, g.h, 260000.0) AS DOUBLE) AS h FROM p LEFT JOIN f USING (p_brand, p_type) LEFT JOIN g USING (p_type)), "
    "y AS (SELECT *, l + (CASE WHEN p_size > 40 THEN 0.55::DOUBLE ELSE 0.4::DOUBLE END) * (h - l) AS b FROM x) "
    "SELECT p_partkey, pay_source, CAST(floor(CASE WHEN pay_source <> 'posted' AND b > 210000 THEN 210000 ELSE b END + 0.5) AS BIGINT) AS pay, CAST(floor(CASE WHEN pay_source <> 'posted' AND b > 210000 THEN least(h, 231000.0) ELSE h END + 0.5) AS BIGINT) AS pay_high FROM y"
)
def pay_ladder(spark, d):
    given = F.col("p_size") % 3 == 0
    p = table(spark, d, "part").select("p_partkey", "p_brand", "p_type", "p_size", F.when(given, F.col("p_retailprice") * 100).alias("lo"), F.when(given, F.col("p_retailprice") * 140).alias("hi"))
    fine, coarse = E.peer_ranges(p, ["p_brand", "p_type"], "lo", "hi", 2), E.peer_ranges(p, ["p_type"], "lo", "hi", 5)
    out = E.estimated_pay(p, "lo", "hi", [("company", fine, ["p_brand", "p_type"]), ("peers", coarse, ["p_type"])], (90_000, 260_000), F.col("p_size") > 40, F.lit(True))
    near = lambda c: F.floor(F.col(c) + 0.5).cast("bigint").alias(c)
    return out.select("p_partkey", "pay_source", near("pay"), near("pay_high"))


_PROGRAM = "CASE WHEN c_custkey % 4 = 0 THEN 'rotational' ELSE 'other' END"
_TIER = "CASE WHEN c_custkey % 5 > 0 THEN c_custkey % 5 END"


@query(
    f"WITH x AS (SELECT c_custkey, {_TIER} AS tier, {_PROGRAM} AS program, c_nationkey % 10 AS rank FROM customer), "
    "y AS (SELECT c_custkey, (CASE rank WHEN 1 THEN 1.0 WHEN 2 THEN 0.9 WHEN 3 THEN 0.8 WHEN 4 THEN 0.65 WHEN 5 THEN 0.5 WHEN 6 THEN 0.35 WHEN 7 THEN 0.3 ELSE 0.25 END)::DOUBLE + (CASE tier WHEN 1 THEN 0.12 WHEN 2 THEN 0.05 ELSE 0 END)::DOUBLE + 0.04::DOUBLE + (CASE WHEN program = 'rotational' THEN 0.04 ELSE 0 END)::DOUBLE AS c, "
    "0.5::DOUBLE + (CASE WHEN tier = 1 THEN -0.12 WHEN tier = 3 OR tier IS NULL THEN 0.08 ELSE 0 END)::DOUBLE + (CASE WHEN program = 'rotational' THEN 0.1 ELSE 0 END)::DOUBLE + (CASE WHEN c_custkey % 3 = 0 THEN 0.1 ELSE 0 END)::DOUBLE + (CASE WHEN c_custkey % 7 = 0 THEN 0.08 ELSE 0 END)::DOUBLE + 0.04::DOUBLE AS w, "
    "0.6::DOUBLE - (CASE WHEN c_custkey % 3 = 0 THEN 0.05 ELSE 0 END)::DOUBLE + (CASE WHEN c_custkey % 2 = 0 THEN 0.05 ELSE 0 END)::DOUBLE AS u FROM x) "
    "SELECT c_custkey, CAST(floor(1000 * least(1.0::DOUBLE, c) + 0.001) AS BIGINT) AS career, CAST(floor(10000 * (w * 0.85::DOUBLE + 0.075::DOUBLE) + 0.001) AS BIGINT) AS winnable, CAST(floor(1000 * u + 0.001) AS BIGINT) AS culture FROM y"
)
def sub_scores(spark, d):
    key, tier, program = F.col("c_custkey"), F.expr(_TIER), F.expr(_PROGRAM)
    career = E.career_score(F.col("c_nationkey") % 10, tier, F.lit("software_engineering"), F.lit("backend"), program, F.lit(False))
    winnable = E.winnable_score(tier, program, key % 3 == 0, F.when(key % 7 == 0, "likely"))
    culture = E.culture_score(F.lit(0.1), F.lit(0), F.lit("two days"), F.when(key % 2 == 0, "hybrid"), key % 3 == 0)
    fixed = lambda c, times: F.floor(c * times + 0.001).cast("bigint")
    return table(spark, d, "customer").select("c_custkey", fixed(career, 1000).alias("career"), fixed(winnable, 10000).alias("winnable"), fixed(culture, 1000).alias("culture"))


@query(
    "WITH x AS (SELECT p_partkey, CASE WHEN p_size > 45 THEN 'hard blocker' WHEN p_name LIKE '%a%' AND p_size > 40 THEN 'senior title' WHEN p_size < 3 THEN 'level' WHEN p_partkey % 5 = 0 AND p_partkey % 2 = 0 THEN 'unknown family' WHEN p_partkey % 5 = 1 THEN 'family' WHEN p_partkey % 7 = 0 AND p_partkey % 3 <> 0 THEN 'no sign of a beginners'' role' WHEN p_partkey % 7 > 2 THEN 'years' WHEN p_retailprice < 1000 AND p_partkey % 11 <> 0 THEN 'pay floor' END AS reason FROM part) "
    "SELECT p_partkey, reason IS NULL AS in_scope, reason IS NULL AND p_partkey % 7 = 2 AS stretch, reason FROM x"
)
def scope_gate(spark, d):
    k, size = F.col("p_partkey"), F.col("p_size")
    gate = E.scope_gate(
        size > 45,
        F.when(F.contains("p_name", F.lit("a")) & (size > 40), "x"),
        size >= 3,
        F.when(k % 5 == 1, "sales").when(k % 5 != 0, "software"),
        ["software"],
        F.when(k % 2 == 0, F.array(F.lit("plain"))).otherwise(F.array(F.lit("plain"), F.lit("spark"))),
        ["plain"],
        F.when(k % 7 != 0, k % 7),
        k % 3 == 0,
        F.col("p_retailprice"),
        1000,
        k % 11 == 0,
    )
    return table(spark, d, "part").select("p_partkey", gate.alias("g")).select("p_partkey", "g.*")


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' OR o_orderpriority = '1-URGENT' OR EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') THEN 'text' END AS body FROM orders")
def cleared_texts(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", (F.col("o_orderstatus") == "F").alias("in_scope"), F.when(F.col("o_orderpriority") == "1-URGENT", "applied").alias("status"), F.lit("text").alias("body"))
    held = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return U.cleared_texts(o, "o_orderkey", "body", held).select("o_orderkey", "body")


@query("SELECT event_id FROM events WHERE ts < TIMESTAMP '2024-12-31' - INTERVAL 90 DAY AND event_id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def stale_payloads(spark, d):
    kept = table(spark, d, "orders").where("o_orderstatus = 'F'")
    return U.stale_payloads(table(spark, d, "events"), "event_id", "ts", kept, "o_orderkey", F.lit("2024-12-31").cast("timestamp_ntz")).select("event_id")


@query("SELECT l_suppkey, count(*) AS n, count(*) FILTER (l_quantity = 1 AND l_returnflag = 'R') AS n_in_scope FROM lineitem GROUP BY 1 HAVING NOT bool_or(l_quantity = 50 AND l_returnflag = 'A' AND l_linenumber = 1 AND l_discount > 0.05) AND (n_in_scope = 0 OR (n_in_scope < 3 AND n_in_scope / n < 0.01))")
def low_yield(spark, d):
    fed = (F.col("l_quantity") == 50) & (F.col("l_returnflag") == "A") & (F.col("l_linenumber") == 1) & (F.col("l_discount") > 0.05)
    return U.low_yield(table(spark, d, "lineitem"), ["l_suppkey"], (F.col("l_quantity") == 1) & (F.col("l_returnflag") == "R"), fed)


@query("SELECT c_custkey, (c_custkey % 3 = 0 OR (c_custkey % 2 = 0 AND c_custkey % 30 > 14)) AS enabled FROM customer")
def reprobed_sources(spark, d):
    k = F.col("c_custkey")
    c = table(spark, d, "customer").select("c_custkey", (k % 3 == 0).alias("enabled"), F.when(k % 2 == 0, "low_yield").otherwise("broken").alias("disabled_reason"), F.date_sub(F.lit("2024-12-31").cast("date"), (k % 30).cast("int")).cast("timestamp").alias("disabled_at"))
    return U.reprobed(c, F.lit("2024-12-31").cast("timestamp")).select("c_custkey", "enabled")
