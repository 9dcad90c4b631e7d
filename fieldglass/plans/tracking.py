"""Registered queries of the application tracker, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import quals as Q
from ..functions import text as X
from ..functions import urls as U
from ..operators import discovery as D
from ..operators import tracker as T
from ..operators.ranges import folder_for
from .rules import POSTINGS, postings, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return register


AS_OF = "TIMESTAMP '1998-06-01'"
# stages of applications over line items: one application an order, one event a line
_STAGE = "['applied', 'oa_pending', 'screen', 'onsite', 'offer', 'rejected', 'ghosted'][1 + (l_partkey % 7)::INT]"
_EVENTS = f"SELECT l_orderkey AS app, l_shipdate AS seen, l_linenumber * 100000000 + l_partkey AS n, CASE WHEN l_linenumber = 1 THEN 'applied' ELSE {_STAGE} END AS stage FROM lineitem"
_APPS = (
    f"e AS ({_EVENTS}), apps AS (SELECT app, arg_max(stage, (seen, n)) AS stage, min(seen) AS applied_at, min(seen) FILTER (stage IN ('oa_pending', 'screen', 'onsite', 'offer', 'rejected')) AS first_response_at FROM e GROUP BY app), "
    "a AS (SELECT *, stage IN ('rejected', 'ghosted') AS completed, CASE WHEN stage IN ('offer', 'rejected', 'ghosted') THEN stage END AS outcome FROM apps)"
)


def stage_events(spark, d):
    stages = F.array(*map(F.lit, ("applied", "oa_pending", "screen", "onsite", "offer", "rejected", "ghosted")))
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("app"), F.col("l_shipdate").alias("at"), (F.col("l_linenumber").cast("bigint") * 100_000_000 + F.col("l_partkey")).alias("n"), F.when(F.col("l_linenumber") == 1, "applied").otherwise(stages[(F.col("l_partkey") % 7).cast("int")]).alias("stage"))


def applications(spark, d):
    return T.state_of_stages(stage_events(spark, d), "app", "at", "n")


@query(f"WITH {_APPS} SELECT * FROM a")
def application_states(spark, d):
    return applications(spark, d)


@query(f"WITH {_APPS} SELECT count(*) AS total, count(*) FILTER (NOT completed) AS active, count(*) FILTER (completed) AS completed, count(first_response_at) AS responded, CAST(count(first_response_at) AS DOUBLE) / count(*) AS response_rate FROM a")
def application_funnel(spark, d):
    return T.funnel(applications(spark, d))


@query(
    f"WITH {_APPS}, s AS (SELECT app, 'ghosted' AS suggestion FROM a WHERE NOT completed AND stage = 'applied' AND first_response_at IS NULL AND applied_at <= {AS_OF} - INTERVAL 30 DAY UNION ALL "
    f"SELECT app, 'follow_up' FROM a WHERE NOT completed AND (SELECT max(d) FROM (SELECT CAST(applied_at AS DATE) + CAST(i AS INTEGER) AS d FROM range(1, 15) t(i)) WHERE isodow(d) < 6) <= {AS_OF}) SELECT app, suggestion FROM s"
)
def application_suggestions(spark, d):
    a = applications(spark, d).withColumn("follow_up_due", X.business_days_after(F.to_date("applied_at"), 10))
    return T.suggestions(a, F.lit("1998-06-01").cast("timestamp_ntz")).select("app", "suggestion")


@query(f"WITH {_APPS} SELECT outcome, count(*) FILTER (o_orderpriority = '1-URGENT') AS \"1-URGENT\", count(*) FILTER (o_orderpriority = '2-HIGH') AS \"2-HIGH\" FROM a JOIN orders ON o_orderkey = app GROUP BY outcome")
def outcomes_by_priority(spark, d):
    a = applications(spark, d).join(table(spark, d, "orders"), F.col("app") == F.col("o_orderkey"))
    return T.cross_tab(a, "outcome", "o_orderpriority", ["1-URGENT", "2-HIGH"])


@query(f"WITH {_APPS} SELECT CASE WHEN o_totalprice >= 400000 THEN 400000.0::DOUBLE WHEN o_totalprice >= 200000 THEN 200000.0::DOUBLE WHEN o_totalprice >= 0 THEN 0.0::DOUBLE END AS bucket, count(*) AS n, avg(CASE WHEN first_response_at IS NOT NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS rate FROM a JOIN orders ON o_orderkey = app GROUP BY 1")
def response_rate_by_score(spark, d):
    a = applications(spark, d).join(table(spark, d, "orders"), F.col("app") == F.col("o_orderkey"))
    return T.rate_by_bucket(a, "o_totalprice", [0.0, 200000.0, 400000.0], F.col("first_response_at").isNotNull())


_ACTION = "CASE event_type WHEN 'click' THEN 'shortlist' WHEN 'view' THEN 'note' WHEN 'purchase' THEN 'snooze' WHEN 'error' THEN 'dismiss' ELSE CASE event_id % 3 WHEN 0 THEN 'referral' WHEN 1 THEN 'unsnooze' ELSE 'unshortlist' END END"


@query(
    f"WITH x AS (SELECT user_id, ts, event_id, {_ACTION} AS action, CASE WHEN event_id % 2 = 0 THEN 'r' || event_id END AS reason FROM events), s AS (SELECT * FROM x WHERE action NOT IN ('note', 'referral')) "
    "SELECT x.user_id, coalesce((SELECT arg_max(CASE action WHEN 'dismiss' THEN 'dismissed' WHEN 'shortlist' THEN 'shortlisted' WHEN 'snooze' THEN 'snoozed' ELSE 'new' END, (ts, event_id)) FROM s WHERE s.user_id = x.user_id), 'new') AS status, "
    "(SELECT CASE WHEN action = 'dismiss' THEN coalesce(reason, 'no reason given') END FROM s WHERE s.user_id = x.user_id ORDER BY ts DESC, event_id DESC LIMIT 1) AS dismiss_reason, "
    "(SELECT CASE WHEN action = 'snooze' THEN ts + INTERVAL 7 DAY END FROM s WHERE s.user_id = x.user_id AND action IN ('snooze', 'unsnooze') ORDER BY ts DESC, event_id DESC LIMIT 1) AS snooze_until, "
    "coalesce((SELECT arg_max(action = 'shortlist', (ts, event_id)) FROM s WHERE s.user_id = x.user_id AND action IN ('shortlist', 'unshortlist')), false) AS starred, bool_or(action = 'referral') AS referral_secured, false AS override_floor, "
    "arg_max(CASE WHEN action = 'note' THEN 'n' || event_id END, CASE WHEN action = 'note' THEN (ts, event_id) END) AS notes FROM x GROUP BY x.user_id"
)
def action_states(spark, d):
    e = table(spark, d, "events").select("user_id", "ts", "event_id", F.expr(_ACTION).alias("action"), F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("r"), "event_id")).alias("reason"), (F.col("ts") + F.expr("INTERVAL 7 DAYS")).alias("until"), F.concat(F.lit("n"), "event_id").alias("text"))
    return T.state_of_actions(e, "user_id", "ts", "event_id")


_GIVEN = "CASE s_suppkey % 5 WHEN 0 THEN s_name WHEN 1 THEN s_name || ' West, Inc.' WHEN 2 THEN 'East ' || s_name WHEN 3 THEN 'Unknown ' || s_suppkey ELSE 'supplier' END"
_KEYED = "trim(regexp_replace(regexp_replace(lower({}), '(?i)\\b(inc)\\b\\.?', ' ', 'g'), '[^a-z0-9]+', ' ', 'g'))"


@query(
    f"WITH g AS (SELECT s_suppkey, {_KEYED.format(_GIVEN)} AS k FROM supplier), r AS (SELECT s_suppkey AS id, {_KEYED.format('s_name')} AS k FROM supplier) "
    "SELECT g.s_suppkey, coalesce((SELECT min(id) FROM r WHERE r.k = g.k), (SELECT min(id) FROM r WHERE length(r.k) >= 4 AND (starts_with(g.k, r.k || ' ') OR ends_with(g.k, ' ' || r.k)))) AS company FROM g"
)
def company_matches(spark, d):
    s = table(spark, d, "supplier")
    given = s.select("s_suppkey", Q.company_key(F.expr(_GIVEN)).alias("k"))
    registry = s.select(Q.company_key(F.col("s_name")).alias("rk"), F.col("s_suppkey").alias("company"))
    return given.join(T.matched_names(given, "k", registry, "rk", "company", "company"), "k", "left").select("s_suppkey", "company")


_APPLIED = "SELECT event_id AS a, event_id * 3 % 5000 AS posting, CASE WHEN event_id % 5 = 0 THEN 'http://x/' || (event_id * 7 % 5000) ELSE 'http://own/' || event_id END AS url FROM events WHERE event_type = 'purchase'"
_POSTED = "SELECT o_orderkey AS p, CASE WHEN o_orderkey % 3 > 0 THEN o_custkey * 10 + o_orderkey % 3 END AS c, CASE WHEN o_orderkey % 4 = 0 AND o_orderkey > 8 THEN o_orderkey - 8 END AS r, 'http://x/' || o_orderkey AS u FROM orders"


@query(
    f"WITH RECURSIVE a AS ({_APPLIED}), p AS ({_POSTED}), ch AS (SELECT p, r AS e, 1 AS n FROM p WHERE r IS NOT NULL UNION ALL SELECT ch.p, p.r, n + 1 FROM ch JOIN p ON p.p = ch.e WHERE p.r IS NOT NULL AND n < 20), "
    "f AS (SELECT p.p, a.a, 0 AS k FROM p JOIN a ON a.posting = p.p UNION SELECT p.p, a.a, 1 FROM p JOIN p s ON s.c = p.c AND s.p <> p.p JOIN a ON a.posting = s.p UNION SELECT x.p, a.a, 2 FROM (SELECT p, e FROM ch UNION SELECT r, p FROM p WHERE r IS NOT NULL) x JOIN a ON a.posting = x.e UNION SELECT p.p, a.a, 3 FROM p JOIN a ON a.url = p.u) "
    "SELECT p AS posting_id, a AS application_id, ['" + "', '".join(T.REASONS) + "'][k + 1] AS reason FROM f QUALIFY k = min(k) OVER (PARTITION BY p)"
)
def duplicate_applications(spark, d):
    p = table(spark, d, "orders").select(F.expr("o_orderkey").alias("posting_id"), F.expr("CASE WHEN o_orderkey % 3 > 0 THEN o_custkey * 10 + o_orderkey % 3 END").alias("c"), F.expr("CASE WHEN o_orderkey % 4 = 0 AND o_orderkey > 8 THEN o_orderkey - 8 END").alias("r"), F.expr("'http://x/' || o_orderkey").alias("u"))
    a = table(spark, d, "events").where("event_type = 'purchase'").select(F.col("event_id").alias("application_id"), F.expr("event_id * 3 % 5000").alias("posting"), F.expr("CASE WHEN event_id % 5 = 0 THEN 'http://x/' || (event_id * 7 % 5000) ELSE 'http://own/' || event_id END").alias("url"))
    return T.duplicates(p, a, "posting_id", "c", "r", "u", "application_id", "posting", "url")


@query(f"WITH p AS ({POSTINGS}) SELECT a.id, coalesce((SELECT string_agg(CAST(b.id AS VARCHAR), ',' ORDER BY b.id) FROM p b WHERE b.cluster_id = a.cluster_id AND b.id <> a.id), '') AS siblings FROM p a")
def cluster_siblings(spark, d):
    return T.siblings(postings(spark, d), "id", "cluster_id").select("id", F.array_join("siblings", ",").alias("siblings"))


@query(
    "SELECT c_custkey, n_name, coalesce(count(o_orderkey), 0) AS orders, coalesce((SELECT string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderdate DESC, o_orderkey) FROM (SELECT * FROM orders o WHERE o.o_custkey = c_custkey ORDER BY o_orderdate DESC, o_orderkey LIMIT 5)), '') AS newest, "
    "coalesce((SELECT string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY ts DESC, event_id) FROM (SELECT * FROM events e WHERE e.user_id = c_custkey ORDER BY ts DESC, event_id LIMIT 40)), '') AS events FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, n_name"
)
def posting_details(spark, d):
    c, n, o, e = (table(spark, d, t) for t in ("customer", "nation", "orders", "events"))
    newest = T.newest_children(o, "o_custkey", [F.desc("o_orderdate"), F.asc("o_orderkey")], 5, ["o_orderkey"], "newest")
    events = T.newest_children(e, "user_id", [F.desc("ts"), F.asc("event_id")], 40, ["event_id"], "seen")
    counts = o.groupBy("o_custkey").agg(F.count("*").alias("orders")).withColumnRenamed("o_custkey", "k")
    out = c.join(n, c.c_nationkey == n.n_nationkey, "left").join(counts, F.col("k") == F.col("c_custkey"), "left").join(newest, F.col("o_custkey") == F.col("c_custkey"), "left").join(events, F.col("user_id") == F.col("c_custkey"), "left")
    ids = lambda a, f: F.coalesce(F.array_join(F.transform(a, lambda r: r[f].cast("string")), ","), F.lit(""))
    return out.select("c_custkey", "n_name", F.coalesce("orders", F.lit(0)).alias("orders"), ids("newest", "o_orderkey").alias("newest"), ids("seen", "event_id").alias("events"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE CAST(l_shipdate AS DATE) >= DATE '1998-06-01' ORDER BY l_shipdate, l_orderkey, l_linenumber LIMIT 30")
def calendar(spark, d):
    return T.upcoming(table(spark, d, "lineitem"), "l_shipdate", F.lit("1998-06-01"), [F.asc("l_shipdate"), F.asc("l_orderkey"), F.asc("l_linenumber")]).select("l_orderkey", "l_linenumber")


@query("(SELECT o_orderkey, 'queue' AS kind FROM orders WHERE o_orderstatus <> 'P' ORDER BY o_totalprice DESC, o_orderkey LIMIT 50) UNION ALL (SELECT o_orderkey, 'dead' FROM orders WHERE o_orderstatus = 'P' ORDER BY o_totalprice DESC, o_orderkey LIMIT 20)")
def work_queue(spark, d):
    return T.queue(table(spark, d, "orders"), F.col("o_orderstatus") == "P", [F.desc("o_totalprice"), F.asc("o_orderkey")], 50).select("o_orderkey", "kind")


_ASKED = "CASE event_id % 4 WHEN 0 THEN 'http://x/' || event_id WHEN 1 THEN 'http://jobs.y/' || (1000000 + event_id % 3000) || '?a=1' WHEN 2 THEN 'http://none/' || event_id END"


@query(
    f"WITH a AS (SELECT event_id, {_ASKED} AS u FROM events), p AS (SELECT o_orderkey AS id, 'http://x/' || o_orderkey AS pu, CAST(1000000 + o_orderkey AS VARCHAR) AS j FROM orders), "
    "m AS (SELECT a.*, (SELECT min(id) FROM p WHERE pu = u) AS e, (SELECT min(id) FROM p WHERE j = nullif(regexp_extract(u, '(\\d{6,})', 1), '')) AS n FROM a) SELECT event_id, coalesce(e, n) AS id, CASE WHEN e IS NOT NULL THEN 1.0::DOUBLE WHEN n IS NOT NULL THEN 0.9::DOUBLE END AS confidence FROM m"
)
def autofilled(spark, d):
    asked = table(spark, d, "events").select("event_id", F.expr(_ASKED).alias("u"))
    p = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.expr("'http://x/' || o_orderkey").alias("pu"), F.expr("1000000 + o_orderkey").alias("j"))
    return T.autofilled(asked, "u", p, "id", "pu", "j").select("event_id", "id", "confidence")


@query(
    "WITH s AS (SELECT c_name, CASE WHEN c_custkey % 3 = 0 THEN 'shortlisted' WHEN c_custkey % 3 = 1 THEN 'dismissed' END AS st, 'note ' || c_custkey AS no FROM customer WHERE c_custkey % 2 = 0) "
    "SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'applied' WHEN s.c_name IS NOT NULL THEN coalesce(st, 'new') ELSE 'new' END AS status, no AS notes FROM customer c LEFT JOIN s USING (c_name)"
)
def imported_workflow(spark, d):
    c = table(spark, d, "customer")
    now = c.select("c_custkey", "c_name", F.when(F.col("c_custkey") % 5 == 0, "applied").otherwise("new").alias("status"), F.lit(None).cast("string").alias("notes"))
    saved = c.where("c_custkey % 2 = 0").select("c_name", F.when(F.col("c_custkey") % 3 == 0, "shortlisted").when(F.col("c_custkey") % 3 == 1, "dismissed").alias("status"), F.concat(F.lit("note "), "c_custkey").alias("notes"))
    return T.imported(now, saved, ["c_name"]).select("c_custkey", "status", "notes")


@query("SELECT key AS name, CAST(sum(CAST(value AS BIGINT)) AS BIGINT) AS n FROM (SELECT unnest(json_keys(props)) AS key, props FROM events), LATERAL (SELECT json_extract_string(props, '$.' || key) AS value) GROUP BY 1")
def counts_by_model(spark, d):
    return T.merged_counts(table(spark, d, "events"), "props")


@query("SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 3 > 0 THEN 'site:a.com:1' || right('00000' || o_orderkey, 5) END, CASE WHEN o_orderkey % 2 = 0 THEN 'site:c.com:2' || right('00000' || o_orderkey, 5) END) AS k FROM orders")
def url_key_backfill(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.expr("CASE WHEN o_orderkey % 3 > 0 THEN 'http://a.com/1' || right('00000' || o_orderkey, 5) END").alias("a"), F.expr("CASE WHEN o_orderkey % 2 = 0 THEN 'http://c.com/2' || right('00000' || o_orderkey, 5) END").alias("c"))
    return o.select("o_orderkey", F.coalesce(U.url_key(F.col("a")), U.url_key(F.col("c"))).alias("k"))


_NAMES = """SELECT o_custkey % 60 AS k, CASE WHEN o_custkey % 60 >= 40 THEN 'House ' || (o_custkey % 60 - 20) || ' West' ELSE 'House ' || (o_custkey % 60) || CASE WHEN o_orderkey % 2 = 0 THEN ' Inc.' ELSE '' END || CASE WHEN o_custkey % 60 % 9 = 4 THEN ' Bank' ELSE '' END END AS name,
    CASE WHEN o_custkey % 60 >= 40 THEN NULL WHEN o_custkey % 5 = 1 THEN 'https://boards.greenhouse.io/h' || (o_custkey % 60) || '/jobs/1' WHEN o_custkey % 5 = 2 THEN 'https://jobs.lever.co/s' || (o_custkey % 60 // 10) WHEN o_custkey % 5 = 3 THEN 'https://example.com/x' WHEN o_custkey % 5 = 4 THEN 'https://jobs.lever.co/r' || (o_custkey % 60) END AS url, o_orderdate AS t0 FROM orders"""


@query(
    f"""WITH r AS ({_NAMES}), q AS (SELECT k, trim(replace(lower(name), ' inc.', '')) AS key, count(*) AS seen, trim(regexp_replace(lower(arg_min(name, (t0, name))), '[^a-z0-9]+', '-', 'g'), '-') AS base FROM r GROUP BY 1, 2),
    s AS (SELECT *, CASE WHEN k < 40 AND k % 5 = 1 THEN 'greenhouse' WHEN k < 40 AND k % 5 IN (2, 4) THEN 'lever' END AS provider, CASE WHEN k % 5 = 1 THEN 'h' || k WHEN k % 5 = 2 THEN 's' || (k // 10) ELSE 'r' || k END AS board FROM q),
    o AS (SELECT *, CASE WHEN key IN ('house 3', 'house 8') THEN 'linked' WHEN provider IS NULL THEN 'unresolvable' WHEN k % 5 = 4 AND k % 2 = 0 THEN 'known' WHEN k % 5 = 1 AND k % 3 = 0 THEN 'failed' WHEN k % 5 = 1 AND k % 7 = 0 OR k % 5 = 4 AND k % 3 = 0 THEN 'waiting' ELSE 'found' END AS one FROM s),
    b AS (SELECT *, row_number() OVER (PARTITION BY provider, board ORDER BY seen DESC, key) AS turn FROM o WHERE one = 'found'),
    e AS (SELECT key, base || CASE WHEN base = 'house-12' THEN '-3' ELSE '' END AS slug, provider, board FROM b WHERE turn = 1),
    l AS (SELECT o.key, min(e.slug) AS slug FROM o JOIN e ON starts_with(o.key, e.key || ' ') GROUP BY o.key)
    SELECT o.key, CASE WHEN e.key IS NOT NULL THEN 'added' WHEN o.one = 'linked' THEN 'linked' WHEN l.key IS NOT NULL THEN 'linked' WHEN o.one = 'found' THEN 'known' ELSE o.one END AS outcome,
        CASE WHEN e.key IS NOT NULL THEN e.slug WHEN o.one = 'linked' THEN 'given-' || o.k WHEN l.key IS NOT NULL THEN l.slug WHEN o.one = 'known' THEN 'board-' || o.k WHEN o.one = 'found' THEN (SELECT e.slug FROM e WHERE e.provider = o.provider AND e.board = o.board) END AS company
    FROM o LEFT JOIN e ON e.key = o.key LEFT JOIN l ON l.key = o.key"""
)
def discovery_loop(spark, d):
    """Names of all orders against a registry made of suppliers' numbers: linked, known, failed, waiting, added, and
    linked to what was added."""
    rows = table(spark, d, "orders").selectExpr("o_custkey", "o_orderkey", "o_orderdate AS at", "o_custkey % 60 AS k").selectExpr(
        "CASE WHEN k >= 40 THEN concat('House ', k - 20, ' West') ELSE concat('House ', k, CASE WHEN o_orderkey % 2 = 0 THEN ' Inc.' ELSE '' END, CASE WHEN k % 9 = 4 THEN ' Bank' ELSE '' END) END AS name",
        "CASE WHEN k >= 40 THEN NULL WHEN k % 5 = 1 THEN concat('https://boards.greenhouse.io/h', k, '/jobs/1') WHEN k % 5 = 2 THEN concat('https://jobs.lever.co/s', k div 10) WHEN k % 5 = 3 THEN 'https://example.com/x' WHEN k % 5 = 4 THEN concat('https://jobs.lever.co/r', k) END AS url",
        "at",
    )
    n = spark.range(60).withColumnRenamed("id", "k")
    given = n.where("k IN (3, 8)").selectExpr("concat('House ', k) AS name", "concat('given-', k) AS slug", "CAST(NULL AS STRING) AS provider", "CAST(NULL AS STRING) AS board")
    given = given.union(n.where("k % 5 = 4 AND k % 2 = 0").selectExpr("concat('Board of ', k)", "concat('board-', k)", "'lever'", "concat('r', k)"))
    given = given.union(n.where("k IN (1, 2)").selectExpr("concat('Other ', k)", "CASE WHEN k = 1 THEN 'house-12' ELSE 'house-12-2' END", "CAST(NULL AS STRING)", "CAST(NULL AS STRING)"))
    visits = n.where("k % 5 = 1").selectExpr("'greenhouse' AS provider", "concat('h', k) AS board", "k % 3 <> 0 AND k % 7 <> 0 AS ok", "k AS n", "CASE WHEN k % 3 = 0 THEN DATE'1998-01-01' ELSE DATE'1990-01-01' END AS at")
    visits = visits.union(n.where("k % 5 = 4 AND k % 3 <> 0").selectExpr("'lever'", "concat('r', k)", "true", "k", "DATE'1997-01-01'")).union(n.where("k < 4").selectExpr("'lever'", "concat('s', k)", "true", "k", "DATE'1997-01-01'"))
    half = F.col("at") < F.lit("1998-06-01")
    queue = D.queued(rows.where(~half), "name", "url", "at", D.queued(rows.where(half), "name", "url", "at"))
    return D.discovered(queue, given, visits, F.lit("1998-01-10").cast("date"))[0]


@query(
    "WITH p AS (SELECT c_custkey, c_name, CASE WHEN c_custkey % 7 = 0 THEN 'applied' WHEN c_custkey % 7 = 1 THEN 'shortlisted' ELSE 'new' END AS st, c_custkey % 5 = 0 AS starred, CASE WHEN c_custkey % 11 = 0 THEN 'n' || c_custkey WHEN c_custkey % 11 = 1 THEN '' END AS notes FROM customer) "
    "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'applied' WHEN st <> 'new' OR starred OR notes <> '' THEN st ELSE 'new' END AS status, CASE WHEN c_custkey % 3 <> 0 OR st = 'applied' THEN CASE WHEN st <> 'new' OR starred OR notes <> '' THEN notes END END AS notes FROM p"
)
def workflow_round_trip(spark, d):
    """What was decided, exported as compressed JSON lines and read into postings built anew, a third of them applied to meanwhile."""
    i = F.col("c_custkey")
    p = table(spark, d, "customer").select("c_custkey", "c_name", F.when(i % 7 == 0, "applied").when(i % 7 == 1, "shortlisted").otherwise("new").alias("status"), (i % 5 == 0).alias("starred"), F.when(i % 11 == 0, F.concat(F.lit("n"), i)).when(i % 11 == 1, "").alias("notes"))
    folder = folder_for(spark, "workflow")
    T.export_workflow(p, ["c_name"], folder)
    rebuilt = p.select("c_custkey", "c_name", F.when(i % 3 == 0, "applied").otherwise("new").alias("status"), F.lit(False).alias("starred"), F.lit(None).cast("string").alias("notes"))
    return T.import_workflow(rebuilt, ["c_name"], folder).select("c_custkey", "status", "notes")
