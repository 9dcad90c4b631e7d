"""All registered queries over the driver's tables, each with the same query in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import aggregates as A
from ..operators import joins as J
from ..operators import ranking as R
from ..operators import views as V
from ..operators.predicates import Field, Fields, all_of, any_of, mentions, negate
from ..sources import payloads as P
from ..streaming import capture as C
from . import cycles, fits, intake, reads, rules, scored, stores, tracking

FLAGSHIP = "facets_one_pass"
_QUERIES: dict = {}
_SQL: dict[str, str] = {}


def query(sql: str):
    def register(f):
        _QUERIES[f.__name__] = f
        _SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def part_fields() -> Fields:
    return Fields(
        {"price": Field(F.col("p_retailprice"), "number"), "size": Field(F.col("p_size"), "number"), "brand": Field(F.col("p_brand"), "enum"), "name": Field(F.col("p_name"), "text"), "type": Field(F.col("p_type"), "enum"), "small": Field(F.col("p_size") < 10, "bool"), "tags": Field(F.split(F.lower("p_type"), " "), "tags")},
        aliases={"cost": "price"},
        shorthands={"brand": {"top": "Brand#11"}},
    )


@query("SELECT p_partkey FROM part WHERE (p_retailprice > 1000 AND lower(p_brand) <> 'brand#13') OR NOT (p_size >= 10)")
def filter_fields(spark, d):
    f = part_fields()
    ok = any_of(all_of(f.where("cost", ">", "1k"), f.where("brand", "!=", "BRAND#13")), negate(f.where("size", ">=", 10)))
    return table(spark, d, "part").where(ok).select("p_partkey")


@query("SELECT p_partkey FROM part WHERE lower(p_name) LIKE '%e%' AND list_contains(string_split(lower(p_type), ' '), 'small') AND p_size < 10")
def filter_text_tags_bool(spark, d):
    f = part_fields()
    return table(spark, d, "part").where(all_of(f.where("name", ":", "E"), f.where("tags", "=", "SMALL"), f.where("small", "=", "yes"))).select("p_partkey")


@query("SELECT o_orderkey FROM orders WHERE CAST(o_orderdate AS DATE) >= DATE '1996-03-01' AND CAST(o_orderdate AS DATE) <> DATE '1996-05-05'")
def filter_dates(spark, d):
    f = Fields({"placed": Field(F.col("o_orderdate"), "date")})
    return table(spark, d, "orders").where(all_of(f.where("placed", ">=", "1996-03-01"), f.where("placed", "!=", "1996-05-05"))).select("o_orderkey")


@query("SELECT doc_id FROM documents WHERE list_contains(regexp_extract_all(lower(text), '[\\w+#.]+'), 'the') AND list_contains(regexp_extract_all(lower(text), '[\\w+#.]+'), 'with')")
def free_text(spark, d):
    return table(spark, d, "documents").where(mentions(F.col("text"), "the WITH")).select("doc_id")


def _view_rules():
    return [("no balance", F.col("c_acctbal") < 0), ("machinery", F.col("c_mktsegment") == "MACHINERY"), ("far", F.col("c_nationkey") > 20)]


_VIEW = "CASE WHEN c_acctbal < 0 THEN 'no balance' WHEN c_mktsegment = 'MACHINERY' THEN 'machinery' WHEN c_nationkey > 20 THEN 'far' END"


@query(f"SELECT c_custkey, {_VIEW} AS suppression_reason, ({_VIEW}) IS NULL AS in_default_view FROM customer")
def default_view(spark, d):
    return V.with_view(table(spark, d, "customer"), _view_rules()).select("c_custkey", "suppression_reason", "in_default_view")


@query(f"SELECT count(*) AS master_total, count(*) FILTER (({_VIEW}) IS NULL) AS view_total, count(*) FILTER (({_VIEW}) IS NOT NULL) AS suppressed FROM customer")
def view_counts(spark, d):
    return V.view_counts(V.with_view(table(spark, d, "customer"), _view_rules()))


_FACETS = ("l_returnflag", "l_linestatus", "l_linenumber", "l_quantity_band")


@query(
    "WITH f AS (" + " UNION ALL ".join(f"SELECT '{c}' AS facet, CAST({'CAST(floor(l_quantity / 10) AS BIGINT)' if c == 'l_quantity_band' else c} AS VARCHAR) AS value, count(*) AS n FROM lineitem GROUP BY 2" for c in _FACETS) + ") SELECT facet, value, n FROM f WHERE value IS NOT NULL QUALIFY row_number() OVER (PARTITION BY facet ORDER BY n DESC, value) <= 5"
)
def facets_one_pass(spark, d):
    columns = {c: F.floor(F.col("l_quantity") / 10).cast("bigint") if c == "l_quantity_band" else F.col(c) for c in _FACETS}
    return V.facets(table(spark, d, "lineitem"), columns, 5)


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 25 OFFSET 50")
def sorted_page(spark, d):
    return V.page(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.asc("o_orderkey")], 25, 50)


@query("SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def dimension_joins(spark, d):
    c, n, r = (table(spark, d, t) for t in ("customer", "nation", "region"))
    return c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey, "left").select("c_custkey", "n_name", "r_name")


@query("SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') AS applied FROM customer")
def existence_field(spark, d):
    c, o = table(spark, d, "customer"), table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("k")).distinct()
    return c.join(o, c.c_custkey == o.k, "left").select("c_custkey", F.col("k").isNotNull().alias("applied"))


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND CAST(o_orderdate AS DATE) >= DATE '1997-01-01')")
def anti_join(spark, d):
    c, o = table(spark, d, "customer"), table(spark, d, "orders").where(F.to_date("o_orderdate") >= "1997-01-01")
    return c.join(o, c.c_custkey == o.o_custkey, "left_anti").select("c_custkey")


@query(
    "WITH e AS (SELECT event_id, user_id, ts, ts + INTERVAL 1 HOUR AS done FROM events) "
    "SELECT a.event_id, a.user_id, (SELECT b.event_id FROM e b WHERE b.user_id = a.user_id AND b.done < a.ts ORDER BY b.done DESC, b.event_id DESC LIMIT 1) AS last_id, "
    "(SELECT max(b.done) FROM e b WHERE b.user_id = a.user_id AND b.done < a.ts) >= a.ts - INTERVAL 2 DAY AS close FROM e a"
)
def newest_earlier_join(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", "ts", (F.col("ts") + F.expr("INTERVAL 1 HOUR")).alias("done"))
    out = J.newest_earlier(e, "user_id", "ts", "done", "event_id", 2)
    return out.select("event_id", "user_id", F.col("last_event_id").alias("last_id"), F.when(F.col("last_event_id").isNotNull(), F.col("earlier_event_id").isNotNull()).alias("close"))


@query(
    "WITH a AS (SELECT DISTINCT split_part(p_name, ' ', 1) AS name FROM part), b AS (SELECT p_partkey, p_name FROM part) "
    "SELECT name, p_partkey FROM a JOIN b ON (p_name = name OR starts_with(p_name, name || ' ')) WHERE length(name) >= 4"
)
def prefix_range_join(spark, d):
    p = table(spark, d, "part")
    names = p.select(F.split("p_name", " ")[0].alias("name")).distinct()
    return J.prefix_join(names, p.select("p_partkey", "p_name"), "name", "p_name").select("name", "p_partkey")


@query(
    "WITH s AS (SELECT p_brand, p_type, median(p_retailprice) AS m FROM part GROUP BY ALL HAVING count(*) >= 5), b AS (SELECT p_brand, median(p_retailprice) AS m FROM part GROUP BY ALL HAVING count(*) >= 5) "
    "SELECT p_partkey, CAST(coalesce(s.m, b.m, 0.0) AS DOUBLE) AS peer FROM part p LEFT JOIN s ON p.p_brand = s.p_brand AND p.p_type = s.p_type LEFT JOIN b ON p.p_brand = b.p_brand"
)
def fallback_ladder(spark, d):
    p = table(spark, d, "part")
    fine, coarse = A.medians(p, [["p_brand", "p_type"], ["p_brand"]], "p_retailprice", 5)
    return J.first_found(p, [(fine, ["p_brand", "p_type"], "median"), (coarse, ["p_brand"], "median")], "peer", F.lit(0.0)).select("p_partkey", "peer")


@query(
    "WITH RECURSIVE links AS (SELECT c_custkey AS k, c_custkey // 3 AS p FROM customer WHERE c_custkey % 3 <> 0 AND c_custkey > 3), up AS (SELECT k, p AS ancestor, 1 AS depth FROM links UNION ALL SELECT up.k, links.p, depth + 1 FROM up JOIN links ON up.ancestor = links.k WHERE depth < 20) SELECT k, ancestor, depth FROM up"
)
def ancestor_chain(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.when((F.col("c_custkey") % 3 != 0) & (F.col("c_custkey") > 3), F.floor(F.col("c_custkey") / 3)).alias("p"))
    return J.chain(c, "k", "p", 20)


@query("SELECT l_suppkey, count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS returned, CAST(count(*) FILTER (l_returnflag = 'R') AS DOUBLE) / count(*) AS rate FROM lineitem GROUP BY l_suppkey HAVING count(*) >= 10 AND count(*) FILTER (l_returnflag = 'R') * 4 > count(*)")
def having_on_rates(spark, d):
    returned = F.count_if(F.col("l_returnflag") == "R")
    out = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"), returned.alias("returned"))
    return out.where("n >= 10 AND returned * 4 > n").withColumn("rate", A.rate(F.col("returned"), F.col("n")))


@query("SELECT c_mktsegment, CAST(median(c_acctbal) AS DOUBLE) AS median, count(*) AS n FROM customer GROUP BY ALL HAVING count(*) >= 5")
def exact_median(spark, d):
    return A.medians(table(spark, d, "customer"), [["c_mktsegment"]], "c_acctbal", 5)[0]


@query(
    "WITH r AS (SELECT o_custkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice) - 1 AS i, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders) "
    "SELECT o_custkey, max(o_totalprice) FILTER (i = n // 4) AS q1, max(o_totalprice) FILTER (i = n * 2 // 4) AS q2, max(o_totalprice) FILTER (i = n * 3 // 4) AS q3, max(n) AS n FROM r WHERE n >= 3 GROUP BY o_custkey"
)
def index_quartiles(spark, d):
    return A.index_quartiles(table(spark, d, "orders"), ["o_custkey"], "o_totalprice", 3)


@query(
    "SELECT user_id, floor(list_reduce(list(CAST(length(event_type) AS DOUBLE) ORDER BY ts, event_id), lambda a, b: 0.7::DOUBLE * a + 0.3::DOUBLE * b) * 1e9 + 0.5) / 1e9 AS ewma FROM events GROUP BY user_id"
)
def moving_average(spark, d):
    e = table(spark, d, "events").select("user_id", "ts", "event_id", F.length("event_type").cast("double").alias("v"))
    out = A.moving_average(e, ["user_id"], [F.asc("ts"), F.asc("event_id")], "v", "ewma")
    return out.withColumn("ewma", F.floor(F.col("ewma") * 1e9 + 0.5) / F.lit(1e9))


@query("SELECT strftime(o_orderdate, '%Y-W%W') AS week, count(*) AS n FROM orders GROUP BY 1")
def week_buckets(spark, d):
    return table(spark, d, "orders").groupBy(A.week_label(F.col("o_orderdate")).alias("week")).agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, o_custkey, o_orderpriority, o_orderdate, row_number() OVER (ORDER BY (o_orderstatus = 'P'), o_totalprice DESC, o_orderkey) AS rank FROM orders")
def global_rank(spark, d):
    o = table(spark, d, "orders").withColumn("late", F.col("o_orderstatus") == "P")
    return R.global_rank(o, [F.asc("late"), F.desc("o_totalprice"), F.asc("o_orderkey")]).select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderdate", "rank")


@query("SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN sum(CASE WHEN o_orderstatus <> 'P' THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey ROWS UNBOUNDED PRECEDING) <= 3 END AS within_cap FROM orders")
def running_cap(spark, d):
    return R.capped(table(spark, d, "orders"), ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")], F.col("o_orderstatus") != "P", 3).select("o_orderkey", "within_cap")


@query("SELECT o_orderkey, place, more FROM (SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS place, greatest(count(*) OVER (PARTITION BY o_orderpriority) - 8, 0) AS more FROM orders) WHERE place <= 8")
def top_of_each(spark, d):
    return R.top_of_each(table(spark, d, "orders"), ["o_orderpriority"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 8).select("o_orderkey", "place", "more")


@query("SELECT s_suppkey, turn FROM (SELECT s_suppkey, s_nationkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS turn FROM supplier) ORDER BY turn, s_nationkey LIMIT 40")
def round_robin(spark, d):
    return R.round_robin(table(spark, d, "supplier"), "s_nationkey", [F.desc("s_acctbal"), F.asc("s_suppkey")], 40).select("s_suppkey", "turn")


@query(
    "WITH i AS (SELECT *, sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS isl FROM events) "
    "SELECT event_id, CAST(sum(CASE WHEN event_type <> 'click' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, isl ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS streak FROM i"
)
def ignored_streaks(spark, d):
    return R.streaks(table(spark, d, "events"), "user_id", ["ts", "event_id"], F.col("event_type") == "click").select("event_id", "streak")


@query("SELECT event_id, last_value(CASE WHEN event_type = 'click' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS last_click FROM events")
def carry_forward(spark, d):
    e = table(spark, d, "events").withColumn("last_click", F.when(F.col("event_type") == "click", F.col("event_id")))
    return R.carried(e, "user_id", ["ts", "event_id"], "last_click").select("event_id", "last_click")


@query("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def latest_per_key(spark, d):
    return R.latest(table(spark, d, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id")


@query("SELECT page_id, trim(regexp_replace(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')) AS slug FROM pages")
def slugs(spark, d):
    return table(spark, d, "pages").select("page_id", T.slug(F.col("url")).alias("slug"))


@query("SELECT p_partkey, CASE WHEN regexp_matches(p_type, '(?i)brass|copper') THEN 'red' WHEN regexp_matches(p_type, '(?i)steel') THEN 'grey' ELSE 'other' END AS metal FROM part")
def ordered_rules(spark, d):
    return table(spark, d, "part").select("p_partkey", T.first_rule(F.col("p_type"), [("brass|copper", "red"), ("steel", "grey")], "other").alias("metal"))


@query("SELECT page_id, sha256(html) AS sha256, coalesce(sha256(html) = lag(sha256(html)) OVER (PARTITION BY split_part(url, '/', 3) ORDER BY page_id), false) AS unchanged FROM pages")
def raw_store(spark, d):
    p = table(spark, d, "pages").withColumn("host", F.split("url", "/")[2])
    return P.stored(p, ["host"], "page_id", "html").select("page_id", "sha256", "unchanged")


@query("SELECT o_orderkey, (SELECT d FROM (SELECT CAST(CAST(o_orderdate AS DATE) + CAST(i AS INTEGER) AS DATE) AS d FROM range(1, 14) t(i)) WHERE isodow(d) < 6 ORDER BY d LIMIT 1 OFFSET 4) AS due FROM orders")
def business_days(spark, d):
    return table(spark, d, "orders").select("o_orderkey", T.business_days_after(F.to_date("o_orderdate"), 5).alias("due"))


@query(
    "WITH o AS (SELECT c_custkey AS k, md5(c_name) AS h FROM customer WHERE c_custkey % 7 <> 0), n AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 11 = 0 THEN md5(c_name || 'x') ELSE md5(c_name) END AS h FROM customer WHERE c_custkey % 5 <> 0) "
    "SELECT coalesce(o.k, n.k) AS k, coalesce(n.h, o.h) AS content_hash, CASE WHEN o.k IS NULL THEN TIMESTAMP '2024-02-01' ELSE TIMESTAMP '2024-01-01' END AS first_seen, CASE WHEN n.k IS NULL THEN TIMESTAMP '2024-01-01' ELSE TIMESTAMP '2024-02-01' END AS last_seen, CASE WHEN n.k IS NULL THEN TIMESTAMP '2024-02-01' END AS delisted_at, CASE WHEN n.k % 2 = 0 THEN 'new text' WHEN o.k IS NOT NULL THEN 'old text' END AS description, "
    "CASE WHEN o.k IS NULL THEN 'new' WHEN n.k IS NULL THEN 'delisted' WHEN o.h = n.h THEN 'unchanged' ELSE 'changed' END AS action FROM o FULL JOIN n ON o.k = n.k"
)
def change_capture(spark, d):
    c = table(spark, d, "customer")
    at, now = (F.lit(f"2024-0{m}-01 00:00:00").cast("timestamp") for m in (1, 2))
    old = c.where("c_custkey % 7 <> 0").select(F.col("c_custkey").alias("k"), F.md5("c_name").alias("content_hash"), F.md5("c_name").alias("raw_hash"), at.alias("first_seen"), at.alias("last_seen"), F.lit(None).cast("timestamp").alias("delisted_at"), F.lit("old text").alias("description"))
    h = F.when(F.col("c_custkey") % 11 == 0, F.md5(F.concat("c_name", F.lit("x")))).otherwise(F.md5("c_name"))
    new = c.where("c_custkey % 5 <> 0").select(F.col("c_custkey").alias("k"), h.alias("content_hash"), h.alias("raw_hash"), now.alias("seen_at"), F.when(F.col("c_custkey") % 2 == 0, "new text").alias("description"))
    plain = lambda c: F.col(c).cast("timestamp_ntz").alias(c)
    return C.merge(old, new, ["k"], now, True).select("k", "content_hash", plain("first_seen"), plain("last_seen"), plain("delisted_at"), "description", "action")


@query("SELECT s_suppkey, CAST(list_sum(list_transform(range(0, CAST(s_suppkey % 5 AS BIGINT) + 1), lambda i: i * i)) AS BIGINT) AS cost FROM supplier")
def stepped_series(spark, d):
    steps = F.transform(F.sequence(F.lit(0), (F.col("s_suppkey") % 5).cast("int")), lambda i: i * i)
    return table(spark, d, "supplier").select("s_suppkey", F.aggregate(steps, F.lit(0), lambda a, b: a + b).cast("bigint").alias("cost"))


@query("SELECT user_id, count(*) AS n, CAST(date_trunc('week', min(ts)) AS DATE) AS first_week, date_diff('day', CAST(min(ts) AS DATE), CAST(max(ts) AS DATE)) AS days FROM events GROUP BY user_id")
def activity_span(spark, d):
    e = table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.min("ts").alias("a"), F.max("ts").alias("b"))
    return e.select("user_id", "n", F.to_date(F.date_trunc("week", "a")).alias("first_week"), F.datediff("b", "a").cast("bigint").alias("days"))


def queries() -> dict:
    return {**_QUERIES, **scored.QUERIES, **intake.QUERIES, **rules.QUERIES, **tracking.QUERIES, **reads.QUERIES, **cycles.QUERIES, **stores.QUERIES, **fits.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {**_SQL, **scored.SQL, **intake.SQL, **rules.SQL, **tracking.SQL, **reads.SQL, **cycles.SQL, **stores.SQL, **fits.SQL}
