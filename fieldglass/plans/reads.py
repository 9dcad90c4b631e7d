"""Registered queries of pages, payloads, wages, registries, postings, views and explanations, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import quals as Q
from ..operators import aggregates as A
from ..operators import checklist as C
from ..operators import joins as J
from ..operators import posting as D
from ..operators.predicates import Field, Fields
from ..sources import feeds as S
from ..sources import pages as W
from .intake import KNOWN, listed
from .rules import POSTINGS, chosen, has, postings, said, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def duck_markdown(x: str) -> str:
    """The same replacements in DuckDB's SQL."""
    for pattern, to in W.MARKDOWN:
        x = f"regexp_replace({x}, '{pattern.replace(chr(39), chr(39) * 2)}', " + "'" + to.replace("'", "''").replace("\n", "' || chr(10) || '") + "', 'g')"
    return f"trim(regexp_replace({x}, '^\\s+|\\s+$', '', 'g'))"


def duck_bare(x: str) -> str:
    for tag in W.CHROME:
        x = f"regexp_replace({x}, '(?is)<{tag}[^>]*>.*?</{tag}>', ' ', 'g')"
    return x


@query(
    f"WITH b AS (SELECT page_id, {duck_bare('html')} AS h FROM pages), x AS (SELECT page_id, list_concat(regexp_extract_all(h, '(?is)<main[^>]*>(.*?)</main>', 1), regexp_extract_all(h, '(?is)<article[^>]*>(.*?)</article>', 1)) AS bs, h FROM b), "
    "y AS (SELECT page_id, CASE WHEN len(bs) = 0 THEN h ELSE list_reduce(bs, lambda p, q: CASE WHEN length(regexp_replace(q, '<[^>]+>', '', 'g')) > length(regexp_replace(p, '<[^>]+>', '', 'g')) THEN q ELSE p END) END AS b FROM x), "
    f"z AS (SELECT page_id, {duck_markdown('b')} AS t FROM y) SELECT page_id, CASE WHEN length(t) > 400 THEN 'main_block' ELSE 'none' END AS method, CASE WHEN length(t) > 400 THEN substr(array_to_string(list_filter(string_split(t, chr(10)), lambda s: length(trim(s)) >= 3), chr(10)), 1, 20000) END AS text FROM z"
)
def page_texts(spark, d):
    return table(spark, d, "pages").select("page_id", W.page_text(F.col("html")).alias("p")).select("page_id", "p.method", "p.text")


@query("SELECT split_part(url, '/', 3) AS host, max(page_id) AS page_id, sha256(arg_max(html, page_id)) AS sha FROM pages WHERE html IS NOT NULL GROUP BY 1")
def newest_payloads(spark, d):
    p = table(spark, d, "pages").where("html IS NOT NULL").withColumn("host", F.split("url", "/")[2])
    return W.newest_payloads(p, ["host"], "page_id", "html").select("host", "page_id", F.sha2("html", 256).alias("sha"))


_WAGES = {
    "Case_Status": "CASE o_orderstatus WHEN 'P' THEN 'Withdrawn' ELSE ' Certified ' END",
    "SOC_Code": "CASE o_orderkey % 4 WHEN 0 THEN '11-1021' WHEN 1 THEN '15-1252.00' ELSE '15-1221' END",
    "Full_Time_Position": "CASE o_orderkey % 7 WHEN 0 THEN 'N' WHEN 1 THEN 'y' END",
    "Wage_Rate_Of_Pay_From": "CASE o_custkey % 3 WHEN 0 THEN '$' || (40 + o_orderkey % 50) || '.50' WHEN 1 THEN '9' || (o_orderkey % 9) || ',000' ELSE 'n/a ' || o_custkey END",
    "Wage_Unit_Of_Pay": "CASE o_custkey % 3 WHEN 0 THEN 'HOUR' END",
    "Prevailing_Wage": "'' || (3000 + o_orderkey % 1000)",
    "PW_Unit_Of_Pay": "CASE o_orderkey % 2 WHEN 0 THEN 'bi-weekly' ELSE 'Month' END",
    "Employer_Name": "'Customer ' || (o_custkey % 60) || CASE o_orderkey % 3 WHEN 0 THEN ' West LLC' WHEN 1 THEN ' Inc' ELSE '' END",
    "Worksite_City": "CASE o_orderkey % 2 WHEN 0 THEN 'Alphaville' ELSE 'Betatown' END",
    "Worksite_State": "'AAB'",
    "PW_Wage_Level": "CASE o_orderkey % 5 WHEN 0 THEN 'i' WHEN 1 THEN 'II' WHEN 2 THEN 'IV' END",
    "Decision_Date": "CAST(o_orderdate AS DATE) || ''",
}
_WAGE = "CASE o_custkey % 3 WHEN 0 THEN (40 + o_orderkey % 50 + 0.5::DOUBLE) * 2080 WHEN 1 THEN (90 + o_orderkey % 9) * 1000 END::DOUBLE"
_KEPT = f"SELECT *, {_WAGE} AS wage, {_WAGES['Employer_Name']} AS employer FROM orders WHERE o_orderstatus <> 'P' AND o_orderkey % 4 > 0 AND o_orderkey % 7 > 0 AND o_custkey % 3 < 2"


def wage_rows(spark, d):
    rows = table(spark, d, "orders").select(*(F.expr(e).alias(n) for n, e in _WAGES.items()))
    return W.wages(rows, ["15-12", "15-11"])


@query(f"WITH k AS ({_KEPT}) SELECT employer, CASE o_orderkey % 4 WHEN 1 THEN '15-1252.00' ELSE '15-1221' END AS soc, {_WAGES['Worksite_City']} AS city, 'AA' AS state, CASE o_orderkey % 5 WHEN 0 THEN 'I' WHEN 1 THEN 'II' WHEN 2 THEN 'IV' END AS level, wage, (3000 + o_orderkey % 1000) * CASE o_orderkey % 2 WHEN 0 THEN 26 ELSE 12 END::DOUBLE AS prevailing, strftime(o_orderdate, '%Y-%m-%d') AS decided FROM k")
def wage_file(spark, d):
    return wage_rows(spark, d).select("employer", "soc", "city", "state", "level", "wage", "prevailing", "decided")


@query(
    f"WITH k AS ({_KEPT}), w AS (SELECT 'customer ' || (o_custkey % 60) || CASE o_orderkey % 3 WHEN 0 THEN ' west' ELSE '' END AS e, {_WAGES['Worksite_City']} AS city, wage FROM k WHERE o_orderkey % 5 < 2), c AS (SELECT c_custkey, 'customer ' || c_custkey AS n, CASE c_custkey % 3 WHEN 0 THEN 'Alphaville' WHEN 1 THEN 'Betatown' ELSE 'Nowhere' END AS city FROM customer), "
    "m AS (SELECT c_custkey, c.city = w.city AS here, wage FROM c JOIN w ON w.e = c.n OR starts_with(w.e, c.n || ' ')), r AS (SELECT c_custkey, g, wage, row_number() OVER (PARTITION BY c_custkey, g ORDER BY wage) - 1 AS i, count(*) OVER (PARTITION BY c_custkey, g) AS n FROM (SELECT *, unnest(CASE WHEN here THEN [0, 1] ELSE [1] END) AS g FROM m)), "
    "q AS (SELECT c_custkey, g, max(wage) FILTER (i = n // 4) AS low, max(wage) FILTER (i = n * 2 // 4) AS point, max(wage) FILTER (i = n * 3 // 4) AS high, max(n) AS n FROM r WHERE n >= 3 GROUP BY ALL) SELECT c_custkey, arg_min(low, g) AS low, arg_min(point, g) AS point, arg_min(high, g) AS high, arg_min(n, g) AS n FROM q GROUP BY 1"
)
def wage_prior(spark, d):
    w = wage_rows(spark, d).where("level IN ('I', 'II')").select(Q.company_key(F.col("employer")).alias("e"), "city", "wage")
    k = F.col("c_custkey")
    c = table(spark, d, "customer").select("c_custkey", F.concat(F.lit("customer "), k).alias("n"), F.when(k % 3 == 0, "Alphaville").when(k % 3 == 1, "Betatown").otherwise("Nowhere").alias("own"))
    # the first words are "customer" and a number: joined on both, so that no key is common to all
    two = lambda x: F.array_join(F.slice(F.split(x, " "), 1, 2), " ")
    m = J.prefix_join(c, w, "n", "e", first=two).withColumn("g", F.explode(F.when(F.col("own") == F.col("city"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(1)))))
    q = A.index_quartiles(m, ["c_custkey", "g"], "wage", 3)
    best = q.groupBy("c_custkey").agg(F.min(F.struct("g", F.col("q1").alias("low"), F.col("q2").alias("point"), F.col("q3").alias("high"), "n")).alias("b"))
    return best.select("c_custkey", "b.low", "b.point", "b.high", "b.n")


@query("SELECT o_custkey, CAST(o_orderkey AS VARCHAR) AS source_job_id, CASE WHEN o_orderkey % 2 = 0 THEN 'Remote - ' ELSE '' END || 'Utrecht, ' || CASE o_orderstatus WHEN 'F' THEN 'Germany' WHEN 'O' THEN 'United States' ELSE 'ZZ' END AS place FROM orders")
def feed_coded_countries(spark, d):
    item = "struct(CAST(o_orderkey AS string) AS id, o_orderpriority AS name, struct('Utrecht' AS city, CASE o_orderstatus WHEN 'F' THEN 'de' WHEN 'O' THEN 'us' ELSE 'zz' END AS country, o_orderkey % 2 = 0 AS remote) AS location)"
    payloads = listed(spark, d, item).select("o_custkey", F.to_json(F.struct(F.col("xs").alias("content"))).alias("content"))
    rows, _ = S.read_feed(payloads, "content", S.FEEDS["coded_countries"])
    return rows.select("o_custkey", "source_job_id", F.col("locations")[0].alias("place"))


@query("SELECT o_custkey, CAST(o_orderkey AS VARCHAR) AS source_job_id, 'Utrecht, NL' AS place, CAST(o_orderdate AS DATE) AS day FROM orders")
def feed_widget(spark, d):
    item = "struct(CAST(o_orderkey AS string) AS shortcode, o_orderpriority AS title, 'Utrecht' AS city, 'NL' AS country, date_format(o_orderdate, 'yyyy-MM-dd') AS published_on)"
    payloads = listed(spark, d, item).select("o_custkey", F.to_json(F.struct(F.col("xs").alias("jobs"))).alias("content"))
    rows, _ = S.read_feed(payloads, "content", S.FEEDS["widget"])
    return rows.select("o_custkey", "source_job_id", F.col("locations")[0].alias("place"), F.to_date("posted_at").alias("day"))


@query("SELECT o_orderkey, 'BEGIN:VEVENT' || chr(13) || chr(10) || 'UID:deadline-' || o_orderkey || chr(13) || chr(10) || 'DTSTAMP:20240101T000000Z' || chr(13) || chr(10) || 'DTSTART;VALUE=DATE:' || strftime(o_orderdate, '%Y%m%d') || chr(13) || chr(10) || 'SUMMARY:Deadline\\, ' || o_orderpriority || chr(13) || chr(10) || 'END:VEVENT' AS event FROM orders WHERE o_orderdate >= TIMESTAMP '1999-01-01'")
def calendar_feed(spark, d):
    o = table(spark, d, "orders").where("o_orderdate >= TIMESTAMP_NTZ '1999-01-01'").select("o_orderkey", F.concat(F.lit("deadline-"), "o_orderkey").alias("uid"), "o_orderdate", F.concat(F.lit("Deadline, "), "o_orderpriority").alias("summary"))
    return W.calendar_lines(o, "uid", "o_orderdate", "summary", "20240101T000000Z").select("o_orderkey", "event")


@query("WITH b AS (SELECT 'c' || c_custkey AS slug, 0 AS p, c_name AS name, c_custkey % 4 AS tier FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT 'c' || c_custkey, 1, 'found', NULL FROM customer WHERE c_custkey % 3 = 0) SELECT slug, arg_min(name, p) AS name, CASE WHEN slug IN ('c9', 'c10') THEN '15min' ELSE CASE min(tier) WHEN 1 THEN '15min' WHEN 2 THEN 'hourly' ELSE '6h' END END AS cadence FROM b GROUP BY slug")
def source_registry(spark, d):
    c = table(spark, d, "customer").withColumn("slug", F.concat(F.lit("c"), "c_custkey"))
    curated = c.where("c_custkey % 2 = 0").select("slug", F.col("c_name").alias("name"), (F.col("c_custkey") % 4).cast("int").alias("tier"))
    return W.registry(curated, c.where("c_custkey % 3 = 0").select("slug", F.lit("found").alias("name")), "slug", ["c9", "c10"]).select("slug", "name", "cadence")


@query("SELECT coalesce(a.k, b.k) AS k, coalesce(b.u, a.u) AS url, coalesce(b.k IS NOT NULL AND b.k % 11 <> 0 AND (a.k IS NULL OR a.k % 5 <> 0), false) AS enabled FROM (SELECT s_suppkey AS k, 'old' AS u FROM supplier WHERE s_suppkey % 2 = 0) a FULL JOIN (SELECT s_suppkey AS k, 'new ' || s_suppkey AS u FROM supplier WHERE s_suppkey % 3 = 0) b ON a.k = b.k")
def synced_sources(spark, d):
    s, k = table(spark, d, "supplier"), F.col("s_suppkey")
    state = s.where("s_suppkey % 2 = 0").select(k.alias("k"), F.lit("old").alias("url"), F.lit(True).alias("enabled"), F.when(k % 5 == 0, "low_yield").alias("disabled_reason"))
    config = s.where("s_suppkey % 3 = 0").select(k.alias("k"), F.concat(F.lit("new "), k).alias("url"), (k % 11 != 0).alias("enabled"))
    return W.synced(state, config, ["k"]).select("k", "url", "enabled")


@query("SELECT CAST(date_trunc('month', ts) AS DATE) AS month, count(*) AS n FROM events GROUP BY 1")
def runs_in_month(spark, d):
    return W.runs_in_month(table(spark, d, "events"), "ts")


@query("SELECT doc_id, n, 'Did ' || n || ' things and more of line ' || n AS bullet FROM documents, range(1, 4) t(n) WHERE n <= 1 + doc_id % 3")
def resume_bullets(spark, d):
    rows = F.flatten(F.transform(F.sequence(F.lit(1), (1 + F.col("doc_id") % 3).cast("int")), lambda n: F.array(F.concat(F.lit("• Did "), n, F.lit(" things")), F.concat(F.lit("  and more of line "), n), F.lit("Heading"), F.lit(""))))
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(rows).alias("pos", "line"))
    return W.bullets(lines, "doc_id", "pos", "line").select("doc_id", F.col("n").cast("bigint").alias("n"), "bullet")


@query("SELECT p_partkey, p_partkey % 3 > 0 AND p_size % 4 <> 0 AND p_size % 5 < 2 AS wanted FROM part")
def detail_prefilter(spark, d):
    size = F.col("p_size")
    seniority = F.when(size % 4 == 0, "staff").otherwise("unknown")
    family = F.when(size % 5 == 0, "ml_ai").when(size % 5 == 1, "unknown").otherwise("sales")
    return table(spark, d, "part").select("p_partkey", W.wants_detail("title_prefilter", F.col("p_partkey") % 3 > 0, seniority, family, list(C.NEVER), ["ml_ai"]).alias("wanted"))


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND NOT EXISTS (SELECT 1 FROM events WHERE event_id = o_orderkey AND event_type = 'error' AND ts > TIMESTAMP '2024-01-20' - INTERVAL 7 DAY) ORDER BY o_totalprice DESC, o_orderkey LIMIT 200")
def next_to_visit(spark, d):
    failed = table(spark, d, "events").where("event_type = 'error'")
    return W.next_to_visit(table(spark, d, "orders"), "o_orderkey", F.col("o_orderstatus") == "O", failed, "event_id", "ts", F.lit("2024-01-20").cast("timestamp_ntz"), [F.desc("o_totalprice"), F.asc("o_orderkey")], 200).select("o_orderkey")


@query("SELECT o_orderkey, o_orderpriority || ' at ' || 'Customer ' || o_custkey || chr(10) || CASE WHEN o_orderstatus <> 'P' THEN format('${:,} - ${:,}', CAST(floor(o_totalprice) AS BIGINT), CAST(floor(o_totalprice) + 10000 AS BIGINT)) || chr(10) ELSE '' END || 'because' AS body FROM orders")
def alert_bodies(spark, d):
    low = F.when(F.col("o_orderstatus") != "P", F.floor("o_totalprice"))
    return table(spark, d, "orders").select("o_orderkey", W.alert_text(F.col("o_orderpriority"), F.concat(F.lit("Customer "), "o_custkey"), F.lit(None).cast("string"), low, low + 10000, F.lit("because")).alias("body"))


@query("WITH x AS (SELECT user_id, list(event_type ORDER BY ts DESC, event_id DESC) AS a FROM events GROUP BY 1), f AS (SELECT user_id, list_distinct(a) AS ds, a FROM x) SELECT user_id, array_to_string(list_transform(list_sort(list_transform(ds, lambda e: {'p': list_position(a, e), 'e': e})), lambda s: s.e)[1:3], ',') AS newest FROM f")
def newest_kinds(spark, d):
    last = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.max(F.struct("ts", "event_id")).alias("at"))  # a row a kind
    e = last.groupBy("user_id").agg(F.reverse(F.array_sort(F.collect_list(F.struct("at", "event_type")))).alias("x"))
    return e.select("user_id", F.array_join(W.newest_union(F.slice(F.col("x.event_type"), 1, 2), F.col("x.event_type"), 3), ",").alias("newest"))


_REQ = "'{\"languages\": [\"Spark\", \"' || p_name || '\"], \"min_years\": ' || p_size % 4 || ', \"clearance\": \"' || CASE p_size % 3 WHEN 0 THEN 'required' WHEN 1 THEN 'none' ELSE 'preferred' END || '\", \"sponsorship\": \"does_not_offer\", \"graduation_window\": \"202' || (6 + p_size % 2) || '\"}'"


@query(
    "SELECT p_partkey, 'Spark=have,' || p_name || '=' || CASE p_name WHEN 'red widget' THEN 'partial' WHEN 'blue bolt' THEN 'gap' ELSE 'unknown' END || ',' || p_size % 4 || '+ years experience=' || CASE WHEN p_size % 4 <= 1 THEN 'have' WHEN p_size % 4 = 2 THEN 'partial' ELSE 'gap' END || "
    "CASE p_size % 3 WHEN 0 THEN ',clearance: required=gap' WHEN 1 THEN '' ELSE ',clearance: preferred=partial' END || ',no sponsorship=have,graduation window 202' || (6 + p_size % 2) || CASE WHEN p_size % 2 = 1 THEN '=have' ELSE '=gap' END AS items FROM part"
)
def requirement_checklist(spark, d):
    x = C.checklist(F.expr(_REQ), {"spark": 0.9, "red widget": 0.4, "blue bolt": 0.1}, "2027")
    return table(spark, d, "part").select("p_partkey", F.array_join(F.transform(x, lambda i: F.concat_ws("=", i["item"], i["status"])), ",").alias("items"))


@query("SELECT p_partkey, '{\"sub_scores\":{\"pay\":{\"value\":' || p_size || ',\"weight\":0.5},\"fit\":{\"value\":' || p_partkey || ',\"weight\":0.25}},\"name\":\"' || p_name || '\"}' AS why FROM part")
def explanations(spark, d):
    return table(spark, d, "part").select("p_partkey", C.explanation({"pay": (F.col("p_size"), 0.5), "fit": (F.col("p_partkey"), 0.25)}, name=F.col("p_name")).alias("why"))


def presets(spark, d):
    fields = Fields({"price": Field(F.col("o_totalprice"), "number"), "status": Field(F.col("o_orderstatus"), "enum"), "urgent": Field(F.col("o_orderpriority") == "1-URGENT", "bool")}, aliases={"pay": "price"})
    out = C.Presets(fields, {"priority": [F.desc("o_totalprice"), F.asc("o_orderkey")], "id": [F.asc("o_orderkey")]})
    out.add("Urgent", [("urgent", "=", "yes"), ("pay", ">=", "200k")], "priority", alert="p0")
    return out


@query("SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_totalprice >= 200000 AND lower(o_orderstatus) <> 'p' AND o_custkey % 2 = 0 ORDER BY o_totalprice DESC, o_orderkey LIMIT 100 OFFSET 5")
def preset_page(spark, d):
    p = presets(spark, d)
    rows = p.rows(table(spark, d, "orders"), "Urgent", ("status", "!=", "P"), default_view=F.col("o_custkey") % 2 == 0)
    from ..operators.views import page

    return page(rows, p.orders["priority"], 100, 5).select("o_orderkey")


@query("SELECT m, o_orderkey FROM orders, (VALUES ('unscored'), ('eligible'), ('ids')) v(m) WHERE CASE m WHEN 'unscored' THEN o_orderkey % 5 = 0 OR o_orderkey % 3 = 0 OR o_orderkey % 7 = 0 WHEN 'eligible' THEN (o_orderkey % 4 NOT IN (0, 3) AND o_orderkey % 2 = 0) OR o_totalprice > 400000 OR o_orderkey % 5 = 0 ELSE o_orderkey IN (SELECT c_custkey FROM customer) END")
def scoring_modes(spark, d):
    k = F.col("o_orderkey")
    rows = table(spark, d, "orders").select(
        "o_orderkey", F.when(k % 5 != 0, F.col("o_orderdate")).alias("scored_at"), F.when(k % 3 == 0, "old").otherwise("v2").alias("score_version"), (k % 7 == 0).alias("needs_rescore"), F.when(k % 4 == 0, "senior").when(k % 4 != 3, "unknown").alias("seniority"),
        F.when(k % 2 == 0, "ml_ai").otherwise("sales").alias("role_family"), F.lit(None).cast("string").alias("employment_type"), (F.col("o_totalprice") - 400000).alias("composite_score"),
    )
    ids = table(spark, d, "customer").select(F.col("c_custkey").alias("o_orderkey"))
    parts = [C.to_score(rows, m, "v2", ids, "o_orderkey").select(F.lit(m).alias("m"), "o_orderkey") for m in ("unscored", "eligible", "ids")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(f"WITH p AS ({POSTINGS}) SELECT company_id, count(*) FILTER (delisted_at IS NULL) AS n_open, count(*) FILTER (delisted_at IS NULL AND in_scope) AS n_in_scope, coalesce((SELECT string_agg(CAST(est_days_to_close AS VARCHAR), ',' ORDER BY first_seen_at DESC, est_days_to_close) FROM (SELECT * FROM p q WHERE q.company_id = p.company_id AND est_days_to_close IS NOT NULL ORDER BY first_seen_at DESC, est_days_to_close LIMIT 20)), '') AS ranges FROM p GROUP BY company_id")
def company_profiles(spark, d):
    p = C.company_profile(postings(spark, d), "company_id", F.col("delisted_at").isNull(), F.col("in_scope"), "first_seen_at", "est_days_to_close", "is_stretch")
    return p.select("company_id", "n_open", "n_in_scope", F.coalesce(F.array_join(F.transform("ranges", lambda r: r["est_days_to_close"].cast("string")), ","), F.lit("")).alias("ranges"))


@query("SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'alpha' WHEN 1 THEN 'beta' ELSE 'gamma' END AS metro FROM customer")
def own_places(spark, d):
    at = lambda m, k: F.struct(F.lit(m).alias("metro"), F.lit(k).alias("kind"))
    primary = F.when(F.col("c_custkey") % 3 == 1, "beta").when(F.col("c_custkey") % 3 == 2, "remote")
    return table(spark, d, "customer").select("c_custkey", C.own_place(F.array(at("alpha", "metro"), at("beta", "metro"), at("gamma", "remote")), primary)["metro"].alias("metro"))


# postings from raw records
_TITLE = chosen("o_orderkey % 6", ["'Senior Backend Engineer'", "'  New   Grad Engineer 2026'", "'Data Analyst II'", "'PhD Research Scientist'", "''", "'Software Intern'"])
_TEXT = chosen("o_custkey % 7", ["'We will not sponsor visas. Pay range $' || (100 + o_orderkey % 50) || ',000 - $' || (160 + o_orderkey % 50) || ',000 a year. Uses Spark.'", "'At least ' || (1 + o_orderkey % 5) || ' years of experience with python'", "NULL", "'You must hold an active clearance. $40 - $60 per hour'", "'Graduating in 2026 or 2027'", "'MS required. Start immediately'", "'plain'"])
_PLACE = chosen("o_custkey % 4", ["'Alphaville, AA'", "'Betatown - BB'", "'Berlin, DE'", "'nowhere'"])
_FAMILY = [("backend|software|engineer", "software_engineering"), ("data|analyst", "data_engineering"), ("research", "ml_ai")]
_LEVEL = [("intern", "internship"), ("senior|staff", "senior"), ("new grad", "new_grad")]
_TAGS = [(r"\bspark\b", "spark"), (r"\bpython\b", "python")]
_RAWS = f"SELECT o_orderkey, o_custkey, CASE o_orderkey % 6 WHEN 4 THEN '(untitled)' WHEN 1 THEN 'New Grad Engineer 2026' ELSE {_TITLE} END AS title, {_TEXT} AS t, {_PLACE} AS place, CASE WHEN o_orderkey % 11 = 0 THEN o_totalprice END AS lo FROM orders"
_DERIVED = (
    f"r AS ({_RAWS}), x AS (SELECT *, CASE WHEN regexp_matches(title, '(?i)backend|software|engineer') THEN 'software_engineering' WHEN regexp_matches(title, '(?i)data|analyst') THEN 'data_engineering' WHEN regexp_matches(title, '(?i)research') THEN 'ml_ai' ELSE 'unknown' END AS family, "
    "CASE WHEN regexp_matches(title, '(?i)intern') THEN 'internship' WHEN regexp_matches(title, '(?i)senior|staff') THEN 'senior' WHEN regexp_matches(title, '(?i)new grad') THEN 'new_grad' ELSE 'unknown' END AS seniority, "
    "CASE WHEN o_custkey % 7 = 1 THEN CAST(1 + o_orderkey % 5 AS DOUBLE) END AS years, CASE WHEN length(t) > 0 THEN " + has("t", Q.CLEARANCE) + " END AS clearance, "
    "CASE WHEN title LIKE 'PhD%' THEN true WHEN length(t) > 0 THEN " + has("t", Q.DEGREE) + " AND NOT " + has("t", Q.DEGREE_SOFT) + " END AS degree, "
    "CASE WHEN length(t) > 0 THEN CASE WHEN " + has("t", Q.SPONSOR_NO) + " THEN 'does_not_offer' WHEN " + has("t", Q.SPONSOR_YES) + " THEN 'offers' ELSE 'unknown' END END AS sponsorship, "
    "coalesce(CASE WHEN " + said("t", Q.GRADUATION, 4) + " IS NOT NULL THEN " + said("t", Q.GRADUATION, 2) + " || '-' || " + said("t", Q.GRADUATION, 4) + " ELSE " + said("t", Q.GRADUATION, 2) + " END, CASE WHEN title LIKE 'New Grad%' THEN '2026' END) AS graduation, "
    "CASE WHEN lo IS NOT NULL THEN lo WHEN o_custkey % 7 = 0 THEN (100 + o_orderkey % 50) * 1000.0::DOUBLE WHEN o_custkey % 7 = 3 THEN 40 * 2080.0::DOUBLE END AS pay_low, CASE WHEN lo IS NOT NULL THEN lo WHEN o_custkey % 7 = 0 THEN (160 + o_orderkey % 50) * 1000.0::DOUBLE WHEN o_custkey % 7 = 3 THEN 60 * 2080.0::DOUBLE END AS pay_high FROM r)"
)


def raw_records(spark, d):
    o = table(spark, d, "orders")
    none = F.lit(None).cast("string")
    return o.select(
        "o_orderkey", "o_custkey", F.lit("feed").alias("provider"), F.lit("s").alias("slug"), F.col("o_orderkey").cast("string").alias("source_job_id"), F.lit("Acme").alias("company_name"), F.expr(_TITLE).alias("title"), F.expr(_TEXT).alias("description"), none.alias("employment_type"), F.expr(_PLACE).alias("places"),
        F.when(F.col("o_orderkey") % 11 == 0, F.col("o_totalprice")).alias("pay_min"), F.lit(None).cast("double").alias("pay_max"), none.alias("pay_interval"), F.concat(F.lit("http://x/"), "o_orderkey").alias("apply_url"), F.col("o_orderdate").alias("posted_at"), none.alias("deadline"), F.lit(False).alias("remote"),
    )


def built(spark, d):
    return D.built(raw_records(spark, d), KNOWN, _FAMILY, _LEVEL, _TAGS, (2027, 5), ["aggregator"])


@query(
    f"WITH {_DERIVED} SELECT o_orderkey, title, family AS role_family, seniority, CASE WHEN seniority = 'internship' OR title LIKE '%Intern%' THEN 'internship' ELSE 'unknown' END AS employment_type, clearance AS requires_clearance, degree AS requires_advanced_degree, years AS min_years_experience, sponsorship, graduation AS graduation_window, "
    "pay_low AS base_posted_min, pay_high AS base_posted_max, CASE WHEN lo IS NOT NULL THEN 'api' WHEN pay_low IS NOT NULL THEN 'posted_range_text' END AS comp_source, title LIKE 'New Grad%' OR coalesce(years <= 1 AND seniority IN ('unknown', 'new_grad'), false) AS is_new_grad, "
    "CASE o_custkey % 4 WHEN 0 THEN 'alpha' WHEN 1 THEN 'beta' END AS primary_metro, o_custkey % 4 = 2 AS is_international_only, CASE o_custkey % 7 WHEN 0 THEN 'spark' WHEN 1 THEN 'python' ELSE '' END AS tags, "
    "(50 + CASE WHEN t IS NOT NULL THEN 20 ELSE 0 END + CASE WHEN o_custkey % 4 < 3 THEN 20 ELSE 0 END + CASE WHEN family <> 'unknown' THEN 10 ELSE 0 END) / 100::DOUBLE AS parse_confidence FROM x"
)
def posting_rows(spark, d):
    keep = ("title", "role_family", "seniority", "employment_type", "requires_clearance", "requires_advanced_degree", "min_years_experience", "sponsorship", "graduation_window", "base_posted_min", "base_posted_max", "comp_source", "is_new_grad", "primary_metro", "is_international_only", "parse_confidence")
    return built(spark, d).select("o_orderkey", *keep, F.array_join("tech_tags", ",").alias("tags"))


@query(
    f"WITH {_DERIVED} SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'offers' ELSE sponsorship END AS sponsorship, coalesce(graduation, CASE WHEN o_orderkey % 2 = 0 THEN '2025' END) AS graduation_window, coalesce(pay_low, CASE WHEN o_orderkey % 2 = 0 THEN 70000.0::DOUBLE END) AS base_posted_min, CASE WHEN o_orderkey % 2 = 0 THEN 3.0::DOUBLE ELSE years END AS min_years_experience, t IS NOT NULL OR o_orderkey % 2 = 0 AS description_fetched FROM x"
)
def posting_backfill(spark, d):
    late = table(spark, d, "orders").where("o_orderkey % 2 = 0").select("o_orderkey", F.lit("We can sponsor. Degree by 2025. Minimum of 3 years. Salary range $70,000 - $80,000").alias("text"))
    out = D.backfilled(built(spark, d), late, "o_orderkey", _TAGS, (2027, 5))
    return out.select("o_orderkey", "sponsorship", "graduation_window", "base_posted_min", "min_years_experience", "description_fetched")


@query("WITH x AS (SELECT o_orderkey, o_custkey, o_orderstatus FROM orders), n AS (SELECT *, CASE WHEN o_orderkey % 3 = 0 THEN 'new' ELSE 'old' END AS v FROM x) SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'title' ELSE '' END || CASE WHEN o_orderkey % 15 = 0 THEN ',' ELSE '' END || CASE WHEN o_orderkey % 5 = 0 THEN 'note' ELSE '' END AS fields FROM n")
def changed_fields(spark, d):
    from ..streaming.capture import changed_fields as differ

    k = F.col("o_orderkey")
    old = {"title": F.lit("old"), "note": F.lit("")}
    new = {"title": F.when(k % 3 == 0, "new").otherwise("old"), "note": F.when(k % 5 == 0, "x")}
    return table(spark, d, "orders").select("o_orderkey", F.array_join(differ(old, new), ",").alias("fields"))
