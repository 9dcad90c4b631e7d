"""Registered queries of a cycle's work, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import cycle as Y
from ..operators import estimates as E
from ..operators import reports as O
from ..operators import resolution as N
from ..sources import feeds as S
from .intake import listed
from .rules import POSTINGS, chosen, postings, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return register


_STOP = "['" + "', '".join(Y.STOP_WORDS) + "']"


@query(f"SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(lower(substr(text, 1, 2000)), '[a-z0-9]+'), lambda w: length(w) >= 3 AND NOT list_contains({_STOP}, w)))), ' ') AS tokens FROM documents WHERE length(text) > 0")
def description_tokens(spark, d):
    return table(spark, d, "documents").where("length(text) > 0").select("doc_id", F.array_join(F.array_sort(Y.description_tokens(F.col("text"))), " ").alias("tokens"))


@query(f"SELECT p_partkey, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(lower(p_name || ' Engineer II, C++ & the ' || p_type), '[a-z0-9+#.]+'), lambda w: NOT list_contains({_STOP}, w)))), ' ') AS tokens FROM part")
def title_tokens(spark, d):
    title = F.concat_ws("", "p_name", F.lit(" Engineer II, C++ & the "), "p_type")
    return table(spark, d, "part").select("p_partkey", F.array_join(F.array_sort(Y.title_tokens(title)), " ").alias("tokens"))


@query(
    f"WITH p AS ({POSTINGS}) SELECT id, coalesce(CASE WHEN id % 2 = 0 THEN priority END, CASE WHEN id % 3 = 0 THEN priority * 2 END, CASE WHEN id % 5 = 0 THEN priority / 2 END) AS base, id % 3 = 0 OR id % 5 = 0 AS has_posted_comp, "
    "CAST(trunc((epoch_us(coalesce(delisted_at, TIMESTAMP '1998-01-01 12:00:00')) - epoch_us(first_seen_at)) / 86400000000.0) AS INTEGER) AS days_open, CASE WHEN application_deadline IS NOT NULL THEN CAST(trunc((epoch_us(CAST(application_deadline AS TIMESTAMP)) - epoch_us(TIMESTAMP '1998-01-01 12:00:00')) / 86400000000.0) AS INTEGER) END AS days_to_close, "
    "delisted_at IS NOT NULL AS delisted, repost_of_id IS NOT NULL AS repost, status = 'dismissed' AND id % 2 = 0 AS snoozed FROM p"
)
def computed_fields(spark, d):
    i = F.col("id")
    p = postings(spark, d).withColumns({"base_est": F.when(i % 2 == 0, F.col("priority")), "base_posted_max": F.when(i % 3 == 0, F.col("priority") * 2), "base_posted_min": F.when(i % 5 == 0, F.col("priority") / 2), "status": F.when(F.col("status") == "dismissed", "snoozed").otherwise(F.col("status"))})
    p = p.withColumn("snooze_until", F.when(i % 2 == 0, F.lit("1998-02-01")).otherwise(F.lit("1997-02-01")).cast("timestamp_ntz"))
    return p.withColumns(Y.computed(F.lit("1998-01-01 12:00:00").cast("timestamp_ntz"))).select("id", "base", "has_posted_comp", "days_open", "days_to_close", "delisted", "repost", "snoozed")


@query(
    "WITH f AS (SELECT o_orderkey, o_custkey % 20 AS host, row_number() OVER (ORDER BY (o_orderpriority = '1-URGENT') DESC, (o_orderstatus = 'O') DESC, o_totalprice DESC, o_orderkey) AS p FROM orders QUALIFY p <= 480), t AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY p) AS turn, min(p) OVER (PARTITION BY host) AS h FROM f) "
    "SELECT o_orderkey FROM t ORDER BY turn, h LIMIT 120"
)
def banded_selection(spark, d):
    o = table(spark, d, "orders").withColumn("host", F.col("o_custkey") % 20)
    return Y.in_bands(o, [F.col("o_orderpriority") == "1-URGENT", F.col("o_orderstatus") == "O"], [F.desc("o_totalprice"), F.asc("o_orderkey")], "host", 120).select("o_orderkey")


@query("SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN CASE WHEN strftime(o_orderdate, '%m-%d') = '02-29' OR strftime(o_orderdate, '%m-%d') > '06-17' THEN CASE WHEN strftime(o_orderdate, '%m-%d') = '02-29' THEN NULL ELSE CAST('2022' || strftime(o_orderdate, '-%m-%d') AS DATE) END ELSE CAST('2023' || strftime(o_orderdate, '-%m-%d') AS DATE) END WHEN 1 THEN CAST(o_orderdate AS DATE) WHEN 2 THEN CAST(o_orderdate AS DATE) END AS day FROM orders")
def month_days(spark, d):
    fmt = lambda f: F.date_format("o_orderdate", f)
    said = F.array(fmt("MMM d"), fmt("MMMM d, yyyy"), fmt("MMM. d yyyy"), F.lit("Smarch 3"))[(F.col("o_orderkey") % 4).cast("int")]
    return table(spark, d, "orders").select("o_orderkey", Y.month_day(said, F.lit("2023-06-15").cast("date")).alias("day"))


@query(
    "WITH p AS (SELECT p_partkey, p_brand, p_type, p_size % 3 AS s, CASE WHEN p_size % 4 > 0 THEN p_retailprice END AS lo, CASE WHEN p_size % 4 > 0 THEN p_retailprice * 2 END AS hi FROM part), k AS (SELECT * FROM p WHERE lo IS NOT NULL), "
    "a AS (SELECT p_brand, p_type, s, median(lo) AS l FROM k GROUP BY ALL HAVING count(*) >= 5), b AS (SELECT p_type, s, median(lo) AS l FROM k GROUP BY ALL HAVING count(*) >= 5), c AS (SELECT p_type, median(lo) AS l FROM k GROUP BY ALL HAVING count(*) >= 5), e AS (SELECT p_brand, median(lo) AS l FROM k GROUP BY ALL HAVING count(*) >= 2) "
    "SELECT p_partkey, CASE WHEN lo IS NOT NULL THEN 'posted' WHEN e.l IS NOT NULL THEN 'company' WHEN a.l IS NOT NULL THEN 'peers' WHEN b.l IS NOT NULL THEN 'peers' WHEN c.l IS NOT NULL THEN 'peers_wider' ELSE 'unknown' END AS pay_source, CAST(coalesce(lo, e.l, a.l, b.l, c.l, 100.0) AS DOUBLE) AS pay_low FROM p LEFT JOIN e USING (p_brand) LEFT JOIN a USING (p_brand, p_type, s) LEFT JOIN b USING (p_type, s) LEFT JOIN c USING (p_type)"
)
def peer_levels(spark, d):
    given = F.col("p_size") % 4 > 0
    p = table(spark, d, "part").select("p_partkey", "p_brand", "p_type", (F.col("p_size") % 3).alias("s"), F.when(given, F.col("p_retailprice")).alias("lo"), F.when(given, F.col("p_retailprice") * 2).alias("hi"))
    levels = [("company", ["p_brand"], 2), ("peers", ["p_brand", "p_type", "s"], 5), ("peers", ["p_type", "s"], 5), ("peers_wider", ["p_type"], 5)]
    ladder = [(label, E.peer_ranges(p, keys, "lo", "hi", least), keys) for label, keys, least in levels]
    return E.estimated_pay(p, "lo", "hi", ladder, (100, 900), F.lit(False), F.lit(False)).select("p_partkey", "pay_source", "pay_low")


@query(f"WITH p AS ({POSTINGS}) SELECT cluster_id, arg_min(id, (CASE id % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 3 END, id % 3 <> 0, id % 5 <> 0, CAST(first_seen_at AS VARCHAR), id)) AS chosen, count(*) AS size FROM p GROUP BY cluster_id")
def cluster_representatives(spark, d):
    i = F.col("id")
    p = postings(spark, d).withColumns({"source": F.when(i % 4 == 0, "company_direct").when(i % 4 == 1, "aggregator").when(i % 4 == 2, "third_party"), "description_fetched": i % 3 == 0, "base_posted_min": F.when(i % 5 == 0, 1), "base_posted_max": F.lit(None).cast("int")})
    return N.representatives(p, "id", "cluster_id", Y.representative_order())


@query(
    "WITH x AS (SELECT event_id, user_id, event_type, ts, CASE WHEN event_id % 3 = 0 THEN ts + INTERVAL 1 HOUR END AS done FROM events), l AS (SELECT a.event_id, (SELECT arg_max(b.event_id, (b.done, b.event_id)) FROM x b WHERE b.user_id = a.user_id AND b.event_type = a.event_type AND b.done < a.ts) AS r, (SELECT max(b.done) FROM x b WHERE b.user_id = a.user_id AND b.event_type = a.event_type AND b.done < a.ts) AS gone, a.ts FROM x a), "
    "k AS (SELECT event_id, r FROM l WHERE gone >= ts - INTERVAL 2 DAY) SELECT e.event_id, k.r AS repost_of, (SELECT count(*) FROM k z WHERE z.r = e.event_id) AS repost_count FROM events e LEFT JOIN k USING (event_id)"
)
def repost_links(spark, d):
    e = table(spark, d, "events").withColumn("done", F.when(F.col("event_id") % 3 == 0, F.col("ts") + F.expr("INTERVAL 1 HOUR")))
    links, counts = Y.reposts(e, ["user_id", "event_type"], "event_id", "ts", "done", 2)
    return e.select("event_id").join(links, "event_id", "left").join(counts, "event_id", "left").select("event_id", "repost_of", F.coalesce("repost_count", F.lit(0)).alias("repost_count"))


@query("SELECT o_orderkey, coalesce((SELECT arg_max(event_type, ts) FROM events WHERE event_id % 5000 = o_orderkey), 'list') AS description, o_orderpriority AS title FROM orders")
def detail_merge(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", F.lit("list").alias("description"), F.col("o_orderpriority").alias("title"))
    details = table(spark, d, "events").select((F.col("event_id") % 5000).alias("o_orderkey"), F.col("event_type").alias("description"), F.lit(None).cast("string").alias("title"), F.col("ts").alias("fetched_at"))
    return Y.with_details(rows, details, ["o_orderkey"], ["description", "title"])


@query("SELECT o_custkey, o_orderkey, CASE WHEN o_orderkey % 3 > 0 AND o_custkey % 4 > 0 THEN o_orderpriority || ' new' ELSE 'as it was' END AS title FROM orders")
def replay(spark, d):
    state = table(spark, d, "orders").select("o_custkey", F.col("o_orderkey").cast("string").alias("source_job_id"), F.lit("as it was").alias("title"))
    texts = []
    for version in ("old", "new"):
        some = listed(spark, d, f"CASE WHEN o_orderkey % 3 > 0 THEN struct(o_orderkey AS id, concat(o_orderpriority, ' {version}') AS title) END").where("o_custkey % 4 > 0")
        texts.append(some.select("o_custkey", F.lit(version == "new").cast("int").alias("at"), F.to_json(F.struct(F.col("xs").alias("jobs"))).alias("content")))
    read = lambda payloads: S.read_feed(payloads, "content", S.FEEDS["offices_and_departments"])[0]
    out = Y.replayed(state, texts[0].unionByName(texts[1]), ["o_custkey"], "at", "content", read, ["o_custkey", "source_job_id"], ["title"])
    return out.select("o_custkey", F.col("source_job_id").cast("bigint").alias("o_orderkey"), "title")


@query(f"WITH p AS ({POSTINGS}) SELECT role_family, count(*) FILTER (first_seen_at >= TIMESTAMP '1997-06-01' AND first_seen_at < TIMESTAMP '1997-06-08') AS opened, count(*) FILTER (first_seen_at >= TIMESTAMP '1997-05-25' AND first_seen_at < TIMESTAMP '1997-06-01') AS opened_before, count(*) FILTER (delisted_at >= TIMESTAMP '1997-06-01' AND delisted_at < TIMESTAMP '1997-06-08') AS closed FROM p GROUP BY 1")
def weekly_digest(spark, d):
    return Y.digest(postings(spark, d), "role_family", "first_seen_at", "delisted_at", F.lit("1997-06-08").cast("timestamp_ntz"))


@query(f"WITH p AS ({POSTINGS}) SELECT count(*) AS total, count(*) FILTER (in_scope) AS in_scope, count(*) FILTER (in_scope AND floor_result = 'pass') AS above_floor, count(*) FILTER (in_scope AND floor_result = 'pass' AND status = 'new') AS queued, CAST(count(*) - count(*) FILTER (in_scope) AS DOUBLE) / count(*) AS eliminated FROM p")
def scope_funnel(spark, d):
    return Y.scope_funnel(postings(spark, d), F.col("in_scope"), F.col("floor_result") == "pass", F.col("status") == "new")


_TRACKED = chosen("o_orderkey % 4", ["'http://x.com/a/' || o_orderkey || '?utm_source=z&b=1'", "' http://x.com/a/' || o_orderkey || '/?ref=me'", "'http://x.com/a/' || o_orderkey || '?b=1&gh_src=q'", "NULL"])


@query("SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'http://x.com/a/' || o_orderkey || '&b=1' WHEN 1 THEN 'http://x.com/a/' || o_orderkey WHEN 2 THEN 'http://x.com/a/' || o_orderkey || '?b=1' ELSE '' END AS url FROM orders")
def tidy_urls(spark, d):
    return table(spark, d, "orders").select("o_orderkey", T.tidy_url(F.expr(_TRACKED)).alias("url"))


_PAY = "CASE WHEN id % 4 = 0 THEN NULL WHEN id % 4 = 1 THEN 0 ELSE priority / 2 END AS low, CASE WHEN id % 4 < 2 THEN NULL ELSE priority END AS high, CASE WHEN id % 8 < 5 THEN priority END AS est, CASE id % 3 WHEN 0 THEN 'new_york' WHEN 1 THEN '' END AS metro"
_LINE = "'• C' || company_id || ' — job ' || id || ' · ' || coalesce(nullif(replace(metro, '_', ' '), ''), '?') || ' · ' || CASE WHEN low <> 0 AND high <> 0 THEN '$' || CAST(round_even(low / 1000, 0) AS BIGINT) || '–' || CAST(round_even(high / 1000, 0) AS BIGINT) || 'k' WHEN est <> 0 THEN '~$' || CAST(round_even(est / 1000, 0) AS BIGINT) || 'k est' ELSE 'no comp' END || ' · ' || CASE beats_baseline WHEN 'clearly_better' THEN 'clearly better' WHEN 'worse' THEN 'worse' ELSE '—' END || chr(10) || '  http://x/' || id"


@query(
    f"""WITH p AS (SELECT *, {_LINE} AS line FROM (SELECT *, {_PAY} FROM ({POSTINGS}))),
    f AS (SELECT * FROM p WHERE first_seen_at >= TIMESTAMP '2001-07-20' AND in_scope AND NOT is_stretch AND floor_result IN ('pass', 'exempt') AND is_cluster_canonical AND delisted_at IS NULL ORDER BY role_family NULLS FIRST, priority DESC, id LIMIT 120),
    g AS (SELECT coalesce(role_family, 'other') AS c, count(*) AS n, list(line ORDER BY priority DESC, id) AS l FROM f GROUP BY 1),
    t AS (SELECT * FROM p WHERE status = 'shortlisted' AND in_scope ORDER BY priority DESC, id LIMIT 7),
    s AS (SELECT 0 AS part, 0 AS r, '' AS nm, 'head' AS section, (SELECT count(*) FROM f) AS n, (SELECT count(*) FROM f) || ' new postings cleared the floor in the last 24h.' AS body
        UNION ALL SELECT 1, CASE c WHEN 'sales' THEN 1 WHEN 'ml_ai' THEN 2 ELSE 9 END, c, c, n, upper(replace(c, '_', ' ')) || ' (' || n || ')' || chr(10) || array_to_string(l[1:8], chr(10)) || CASE WHEN n > 8 THEN chr(10) || '  … and ' || (n - 8) || ' more in the dashboard' ELSE '' END FROM g
        UNION ALL SELECT 2, 0, '', 'today', count(*), array_to_string(['TODAY''S QUEUE (' || count(*) || ')'] || coalesce(list(line ORDER BY priority DESC, id), []), chr(10)) FROM t
        UNION ALL SELECT 3, 0, '', 'follow_ups', count(*), 'FOLLOW-UPS DUE' || chr(10) || string_agg('• #' || c_custkey || ' ' || c_name, chr(10) ORDER BY c_custkey) FROM customer WHERE c_custkey % 300 = 7 HAVING count(*) > 0)
    SELECT CAST(row_number() OVER (ORDER BY part, r, nm) AS INTEGER) AS place, section, n, body FROM s"""
)
def daily_digest(spark, d):
    p = postings(spark, d).selectExpr("*", *_PAY.split(", CASE", 1)[:1], *(f"CASE{x}" for x in _PAY.split(", CASE")[1:]))
    line = O.posting_line(F.concat(F.lit("C"), "company_id"), F.concat(F.lit("job "), "id"), F.col("metro"), O.pay_text(F.col("low"), F.col("high"), F.col("est")), F.col("beats_baseline"), F.concat(F.lit("http://x/"), "id"))
    p = p.withColumn("line", line).withColumnRenamed("role_family", "category")
    new = p.where("first_seen_at >= TIMESTAMP '2001-07-20' AND in_scope AND NOT is_stretch AND floor_result IN ('pass', 'exempt') AND is_cluster_canonical AND delisted_at IS NULL")
    today = p.where("status = 'shortlisted' AND in_scope").select(F.struct((-F.col("priority")).alias("p"), "id").alias("rank"), "line")
    due = table(spark, d, "customer").where("c_custkey % 300 = 7").select(F.col("c_custkey").alias("id"), F.concat(F.lit("• #"), "c_custkey", F.lit(" "), "c_name").alias("line"))
    return O.daily(new, today, due, {"sales": 1, "ml_ai": 2}, places=7)
