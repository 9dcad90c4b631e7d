"""Registered queries of the stored payloads, the growing files and the streams with state, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import posting_index as I
from ..operators.ranges import folder_for
from ..sources import stored as P
from ..streaming import timers as M
from .rules import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return register


def payload_folder(spark, d) -> str:
    """Envelopes of every customer's orders as a board's payloads: one list, a later list of a third of
    them, pages of single postings, pages that failed and pages that are no JSON."""
    o = table(spark, d, "orders").withColumn("provider", F.when(F.col("o_custkey") % 2 == 0, "offices_and_departments").otherwise("bare_list")).withColumn("slug", F.concat(F.lit("n"), F.col("o_custkey") % 25))
    first = F.col("provider") == "offices_and_departments"

    def job(title):
        place, key = "o_orderstatus", F.col("o_orderkey")
        one = F.to_json(F.struct(key.alias("id"), title.alias("title"), F.concat(F.lit("http://x/"), key).alias("absolute_url"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("updated_at"), F.lit("").alias("content"), F.struct(F.col(place).alias("name")).alias("location"), F.array(F.struct(F.lit("F").alias("name")), F.struct(F.col(place).alias("name"))).alias("offices"), F.array(F.struct(F.concat(F.lit("t"), key % 9).alias("name"))).alias("departments")))
        two = F.to_json(F.struct(key.cast("string").alias("id"), title.alias("text"), F.concat(F.lit("http://y/"), key).alias("hostedUrl"), (F.unix_timestamp("o_orderdate") * 1000).alias("createdAt"), F.struct(F.col(place).alias("location"), F.concat(F.lit("t"), key % 9).alias("team")).alias("categories")))
        return F.when(first, one).otherwise(two)

    def page(body, status=200):
        return F.struct(F.lit("http://api").alias("url"), F.lit(status).cast("int").alias("status"), body.alias("body"))

    def envelopes(rows, title, at):
        lists = rows.groupBy("provider", "slug", "o_custkey").agg(F.array_join(F.array_sort(F.collect_list(job(title))), ",").alias("jobs"))
        body = F.when(first, F.concat(F.lit('{"jobs":['), "jobs", F.lit("]}"))).otherwise(F.concat(F.lit("["), "jobs", F.lit("]")))
        failed = F.when(F.col("o_custkey") % 25 == 3, page(F.lit("busy"), 500)).when(F.col("o_custkey") % 25 == 4, page(F.lit("<html>")))
        return lists.select("provider", "slug", F.to_json(F.struct(F.lit(at).alias("fetched_at"), F.array_compact(F.array(page(body), failed)).alias("pages"))).alias("envelope"))

    about = F.concat(F.lit('{"content":"about '), "o_orderkey", F.lit('","descriptionPlain":"on '), "o_orderkey", F.lit('"}'))
    status = F.when(F.col("o_orderstatus") == "P", 200).when(F.col("o_orderkey") % 5 == 0, 404).when(F.col("o_orderkey") % 5 == 1, 503)
    details = o.where(status.isNotNull()).select("provider", "slug", F.to_json(F.struct(F.lit("1999-01-01").alias("fetched_at"), F.col("o_orderkey").alias("detail_of"), F.array(F.struct(F.lit("http://api").alias("url"), status.alias("status"), about.alias("body"))).alias("pages"))).alias("envelope"))
    lists = envelopes(o, F.col("o_orderpriority"), "1998-01-01").unionByName(envelopes(o.where("o_orderkey % 3 = 0"), F.concat(F.lit("again "), "o_orderpriority"), "1999-01-01"))
    folder = folder_for(spark, "payloads")
    P.write_envelopes(lists.unionByName(details), folder)
    P.register(spark)
    return folder


_BOARD = "CASE WHEN o_custkey % 2 = 0 THEN 'offices_and_departments' ELSE 'bare_list' END AS provider, 'n' || (o_custkey % 25) AS slug"
_STORED = f"""SELECT {_BOARD}, CAST(o_orderkey AS VARCHAR) AS source_job_id, CASE WHEN o_orderkey % 3 = 0 THEN 'again ' ELSE '' END || o_orderpriority AS title,
    CASE WHEN o_custkey % 2 = 0 THEN 'http://x/' ELSE 'http://y/' END || o_orderkey AS apply_url, CASE WHEN o_custkey % 2 = 0 AND o_orderstatus <> 'F' THEN o_orderstatus || ',F' ELSE o_orderstatus END AS locations, 't' || (o_orderkey % 9) AS department,
    strftime(o_orderdate, '%Y-%m-%d') AS posted, CASE WHEN o_orderstatus = 'P' THEN CASE WHEN o_custkey % 2 = 0 THEN 'about ' ELSE 'on ' END || o_orderkey END AS description,
    CASE WHEN o_orderstatus = 'P' THEN 'live' WHEN o_orderkey % 5 = 0 THEN 'dead' WHEN o_orderkey % 5 = 1 THEN 'transient' ELSE 'unverified' END AS link FROM orders"""


def _stored(rows):
    return P.with_details(rows).select("provider", "slug", "source_job_id", "title", "apply_url", F.array_join("locations", ",").alias("locations"), "department", F.substring("posted_at", 1, 10).alias("posted"), "description", "link")


@query(_STORED)
def stored_postings(spark, d):
    return _stored(spark.read.format("stored_payloads").load(payload_folder(spark, d)))


@query(f"SELECT * FROM ({_STORED}) WHERE provider = 'bare_list' AND slug IN ('n7', 'n11')")
def stored_postings_of_boards(spark, d):
    rows = spark.read.format("stored_payloads").load(payload_folder(spark, d))
    return _stored(rows.where((F.col("provider") == "bare_list") & F.col("slug").isin("n7", "n11")))


@query(f"WITH b AS (SELECT {_BOARD}, o_custkey, bool_or(o_orderkey % 3 = 0) AS twice FROM orders WHERE o_custkey % 25 IN (3, 4) GROUP BY ALL) SELECT provider, slug, CASE WHEN slug = 'n3' THEN 'HTTP 500' ELSE 'not JSON' END AS error, CAST(sum(CASE WHEN twice THEN 2 ELSE 1 END) AS BIGINT) AS n FROM b GROUP BY ALL")
def stored_payload_errors(spark, d):
    rows = spark.read.format("stored_payloads").load(payload_folder(spark, d))
    return rows.where("error IS NOT NULL").groupBy("provider", "slug", "error").agg(F.count("*").alias("n"))


@query("SELECT event_id, user_id, event_type, 'day' || (event_id % 5) || '.jsonl' AS file FROM events")
def delta_lines(spark, d):
    """Files that grow between two drains from one checkpoint."""
    P.register(spark)
    folder = folder_for(spark, "deltas")
    e = table(spark, d, "events").withColumn("line", F.to_json(F.struct("event_id", "user_id", "event_type"))).withColumn("wave", (F.col("user_id") % 2).cast("int")).withColumn("file", F.concat(F.lit("day"), F.col("event_id") % 5, F.lit(".jsonl")))
    e = e.withColumn("order", F.struct("wave", "event_id"))
    stream = spark.readStream.format("delta_lines").load(f"{folder}/files")
    for wave in range(2):
        P.write_lines(e.where(F.col("wave") <= wave), f"{folder}/files", "file", "order", "line")
        got = M.drained(spark, stream, f"{folder}/table", f"{folder}/checkpoint")
    return got.select(F.from_json("value", "event_id long, user_id long, event_type string").alias("j"), "file").select("j.*", "file")


def in_waves(spark, rows, name: str, wave, waves: int, run, mode: str = "append"):
    """Writes rows as files, wave after wave, and drains run(stream of them) after each from one checkpoint."""
    folder = folder_for(spark, name)
    marked = rows.withColumn("_wave", wave)
    for w in range(waves):
        marked.where(F.col("_wave") == w).drop("_wave").write.mode("append").parquet(f"{folder}/files")
        stream = run(spark.readStream.schema(rows.schema).parquet(f"{folder}/files"))
        got = M.drained(spark, stream, f"{folder}/table", f"{folder}/checkpoint", mode)
    return got


@query("WITH s AS (SELECT o_orderkey, o_orderdate, min(l_shipdate) AS m FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_shipdate >= o_orderdate GROUP BY ALL) SELECT o_orderkey AS key, CASE WHEN m <= o_orderdate + INTERVAL 2 DAY THEN 'engaged' ELSE 'ignored' END AS outcome, CAST(CASE WHEN m <= o_orderdate + INTERVAL 2 DAY THEN m ELSE o_orderdate + INTERVAL 2 DAY END AS TIMESTAMP) AS at FROM s")
def engagement_timers(spark, d):
    """Orders not shipped within 48 hours are ignored, by timers; a last row far ahead moves the watermark past all."""
    sent = table(spark, d, "orders").select(F.col("o_orderkey").alias("key"), F.lit("sent").alias("kind"), F.col("o_orderdate").cast("timestamp").alias("at"))
    engaged = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("key"), F.lit("engaged").alias("kind"), F.col("l_shipdate").cast("timestamp").alias("at"))
    end = spark.range(1).select(F.lit(-1).cast("long").alias("key"), F.lit("end").alias("kind"), F.lit("2100-01-01").cast("timestamp").alias("at"))
    wave = F.when(F.col("at") <= "1997-06-30", 0).when(F.col("at") <= "1999-06-30", 1).when(F.col("at") < "2100-01-01", 2).otherwise(3)
    got = in_waves(spark, sent.union(engaged).union(end), "engagement", wave, 4, lambda s: M.keyed(s, M.Engagement(), at="at"))
    return got.select("key", "outcome", F.col("at").cast("timestamp_ntz").alias("at"))


@query("WITH k AS (SELECT user_id, ts FROM events WHERE user_id % 4 <> 0 AND event_type = 'click'), l AS (SELECT user_id, ts FROM events WHERE event_type = 'view') SELECT user_id AS key, CAST(min(ts) AS TIMESTAMP) AS first_seen, user_id NOT IN (SELECT user_id FROM k) AS provisional FROM (SELECT * FROM k UNION ALL SELECT * FROM l) GROUP BY user_id")
def provisional_sightings(spark, d):
    known = (F.col("user_id") % 4 != 0) & (F.col("event_type") == "click")
    e = table(spark, d, "events").where(known | (F.col("event_type") == "view")).select(F.col("user_id").alias("key"), known.alias("known"), F.col("ts").cast("timestamp").alias("at"))
    got = in_waves(spark, e, "sightings", F.pmod(F.xxhash64("at"), F.lit(3)).cast("int"), 3, lambda s: M.keyed(s, M.Sightings(), "Update"), "update")
    return M.latest(got).select("key", F.col("first_seen").cast("timestamp_ntz").alias("first_seen"), "provisional")


@query("""WITH RECURSIVE c AS (SELECT CAST(substr(o_orderpriority, 1, 1) AS BIGINT) AS key, CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS t0, count(*) AS m FROM orders GROUP BY ALL),
    r AS (SELECT key, t0, CASE WHEN month(t0) = 7 THEN m // 10 WHEN month(t0) = 11 AND key > 2 THEN 0 ELSE m END AS n, row_number() OVER (PARTITION BY key ORDER BY t0) AS i FROM c),
    s AS (SELECT key, t0, n, i, CAST(0 AS DOUBLE) AS typical, n = 0 AS drifted FROM r WHERE i = 1
        UNION ALL SELECT key, t0, n, i, t, (t >= 20 AND n < t * CAST(0.2 AS DOUBLE)) OR (n = 0 AND (t > 0 OR was > 0)) FROM (SELECT r.*, s.n AS was, CASE WHEN s.drifted THEN s.typical WHEN s.typical = 0 THEN CAST(s.n AS DOUBLE) ELSE CAST(0.7 AS DOUBLE) * s.typical + CAST(0.3 AS DOUBLE) * s.n END AS t FROM s JOIN r ON r.key = s.key AND r.i = s.i + 1))
    SELECT key, t0 AS at, n, typical, drifted FROM s""")
def row_count_drift(spark, d):
    o = table(spark, d, "orders").groupBy(F.substring("o_orderpriority", 1, 1).cast("long").alias("key"), F.date_trunc("month", "o_orderdate").cast("timestamp").alias("at")).agg(F.count("*").alias("m"))
    n = F.when(F.month("at") == 7, F.floor(F.col("m") / 10)).when((F.month("at") == 11) & (F.col("key") > 2), 0).otherwise(F.col("m")).cast("long")
    got = in_waves(spark, o.select("key", "at", n.alias("n")), "drift", F.when(F.col("at") < "1997-06-01", 0).when(F.col("at") < "1999-06-01", 1).otherwise(2), 3, lambda s: M.keyed(s, M.RowCounts()))
    return got.select("key", F.col("at").cast("timestamp_ntz").alias("at"), "n", "typical", "drifted")


@query("WITH t AS (SELECT user_id AS key, CASE event_type WHEN 'purchase' THEN 'p0' WHEN 'click' THEN 'p1' ELSE 'p2' END AS tier, ts, event_id FROM events), f AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY key, tier ORDER BY ts, event_id) = 1), z AS (SELECT key, ts, event_id FROM f WHERE tier = 'p0') SELECT f.key, f.tier, CAST(f.ts AS TIMESTAMP) AS at, f.event_id AS id FROM f LEFT JOIN z ON z.key = f.key WHERE f.tier = 'p0' OR z.key IS NULL OR (f.ts, f.event_id) < (z.ts, z.event_id)")
def emitted_once(spark, d):
    tier = F.when(F.col("event_type") == "purchase", "p0").when(F.col("event_type") == "click", "p1").otherwise("p2")
    e = table(spark, d, "events").select(F.col("user_id").alias("key"), tier.alias("tier"), F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("id"))
    low, high = (r for r in e.select(F.percentile_approx("at", [0.4, 0.7]).alias("p")).first()["p"])
    got = in_waves(spark, e, "once", F.when(F.col("at") <= F.lit(low), 0).when(F.col("at") <= F.lit(high), 1).otherwise(2), 3, lambda s: M.keyed(s, M.EmitOnce()))
    return got.select("key", "tier", F.col("at").cast("timestamp_ntz").alias("at"), "id")


SEARCHES = {"both": "tions Thing", "caps": "HANDED onsh", "one": "hand", "run": "handing.onshes", "none": "  "}
_ENDS = "(s|e|es|ed|ing|ings)?"
_NOW = "SELECT doc_id, CASE WHEN doc_id % 10 = 3 THEN coalesce(text, '') || ' handing onshes' ELSE text END AS text FROM documents WHERE doc_id % 10 <> 7 UNION ALL SELECT doc_id + 50000000, 'a new thing: tions' FROM documents WHERE doc_id % 20 = 9"


@query(
    f"WITH n AS ({_NOW}), w AS (SELECT doc_id, regexp_extract_all(strip_accents(lower(coalesce(text, ''))), '[\\p{{L}}\\p{{N}}]+') AS w FROM n), h AS (SELECT doc_id, list_transform(w, lambda x: CASE WHEN regexp_full_match(x, 'tion{_ENDS}') THEN 't' WHEN regexp_full_match(x, 'thing{_ENDS}') THEN 'g' WHEN regexp_full_match(x, 'hand{_ENDS}') THEN 'h' WHEN regexp_full_match(x, 'onsh{_ENDS}') THEN 'o' ELSE '-' END) AS k FROM w) "
    "SELECT unnest(list_filter([CASE WHEN list_has_all(k, ['t', 'g']) THEN 'both' END, CASE WHEN list_has_all(k, ['h', 'o']) THEN 'caps' END, CASE WHEN list_contains(k, 'h') THEN 'one' END, CASE WHEN contains(array_to_string(k, ''), 'ho') THEN 'run' END], lambda x: x IS NOT NULL)) AS query, doc_id FROM h"
)
def stemmed_search(spark, d):
    """An index of all documents, then a generation of changes: texts that gain words, documents that go, and new ones."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    path, k = folder_for(spark, "index"), F.col("doc_id") % 10
    I.write_generation(docs.select("doc_id", F.lit(None).cast("string").alias("old"), F.col("text").alias("new")), path, 0)
    longer = F.concat(F.coalesce("text", F.lit("")), F.lit(" handing onshes"))
    changed = docs.where(k.isin(3, 7)).select("doc_id", F.col("text").alias("old"), F.when(k == 3, longer).alias("new"))
    added = docs.where("doc_id % 20 = 9").select((F.col("doc_id") + 50_000_000).alias("doc_id"), F.lit(None).cast("string").alias("old"), F.lit("a new thing: tions").alias("new"))
    I.write_generation(changed.unionByName(added), path, 1)
    now = docs.where(k != 7).select("doc_id", F.when(k == 3, longer).otherwise(F.col("text")).alias("text")).unionByName(added.select("doc_id", F.col("new").alias("text")))
    return I.search(spark, path, SEARCHES, now)
