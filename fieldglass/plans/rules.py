"""Registered queries of demands, URLs, alert rules and runs, with their SQL.

Inputs that the tables do not have are written as expressions that Spark and DuckDB both read, so that
both sides start from the same values and each computes the rest in its own way."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import quals as Q
from ..functions import urls as U
from ..operators import alert_rules as R

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chosen(key: str, texts: list[str]) -> str:
    """SQL of one of the texts (SQL expressions) by a key."""
    return f"CASE {key} " + " ".join(f"WHEN {i} THEN {t}" for i, t in enumerate(texts)) + " END"


def quoted(pattern: str) -> str:
    """A pattern as a literal of DuckDB."""
    return "'" + pattern.replace("'", "''") + "'"


def has(text: str, pattern: str) -> str:
    return f"coalesce(regexp_matches({text}, {quoted(pattern)}), false)"


def said(text: str, pattern: str, group: int = 0) -> str:
    return f"nullif(regexp_extract({text}, {quoted(pattern)}, {group}), '')"


_DEMANDS = chosen(
    "p_partkey % 12",
    [
        "'You must currently hold a ' || p_brand || ' secret clearance'",
        "'The ability to obtain a clearance helps'",
        "'A PhD in ' || p_name || ' is required'",
        "'MS preferred, or bachelor degree'",
        "'We will not sponsor visas for ' || p_type",
        "'We can offer visa sponsorship'",
        "'Graduating between May 20' || (24 + p_size % 5) || ' and June 20' || (25 + p_size % 5)",
        "'A degree by December 20' || (26 + p_size % 3)",
        "'Minimum of a masters, MS required. Polygraph'",
        "''",
        "NULL",
        "p_name",
    ],
)
_BEGINS = chosen(
    "p_size % 8",
    [
        "'Must start by June 20' || (25 + p_partkey % 4)",
        "'Immediately available people only, class of 2027'",
        "'Starting date no later than ' || (1 + p_partkey % 12) || '/20' || (26 + p_partkey % 2)",
        "'For the class of 2027'",
        "'Summer 2027 start'",
        "'Start on or before 2027'",
        "'starting right away'",
        "p_type",
    ],
)
_TEXTS = f"SELECT p_partkey, {_DEMANDS} || '. ' || {_BEGINS} AS t, 'MS/PhD ' || p_partkey % 7 AS title FROM part"


@query(
    f"WITH x AS ({_TEXTS}) SELECT p_partkey, CASE WHEN length(t) > 0 THEN {has('t', Q.CLEARANCE)} END AS clearance, "
    f"CASE WHEN title LIKE '% 3' THEN true WHEN length(t) > 0 THEN {has('t', Q.DEGREE)} AND NOT {has('t', Q.DEGREE_SOFT)} END AS degree, "
    f"CASE WHEN length(t) > 0 THEN CASE WHEN {has('t', Q.SPONSOR_NO)} THEN 'does_not_offer' WHEN {has('t', Q.SPONSOR_YES)} THEN 'offers' ELSE 'unknown' END END AS sponsorship, "
    f"CASE WHEN {said('t', Q.GRADUATION, 4)} IS NOT NULL THEN {said('t', Q.GRADUATION, 2)} || '-' || {said('t', Q.GRADUATION, 4)} ELSE {said('t', Q.GRADUATION, 2)} END AS graduation FROM x"
)
def demands(spark, d):
    x = table(spark, d, "part").select("p_partkey", F.expr(f"{_DEMANDS} || '. ' || {_BEGINS}").alias("t"), F.when(F.col("p_partkey") % 7 == 3, "MS/PhD role").otherwise("role").alias("title"))
    t = F.col("t")
    return x.select("p_partkey", Q.needs_clearance(t).alias("clearance"), Q.needs_degree(t, F.col("title")).alias("degree"), Q.sponsorship(t).alias("sponsorship"), Q.graduation_window(t).alias("graduation"))


_EARLY = (
    f"CASE WHEN {said('t', Q.START_BY, 1)} LIKE '%/%' THEN CAST(split_part({said('t', Q.START_BY, 1)}, '/', 2) AS INT) * 12 + CAST(split_part({said('t', Q.START_BY, 1)}, '/', 1) AS INT) "
    f"WHEN length({said('t', Q.START_BY, 1)}) = 4 THEN CAST({said('t', Q.START_BY, 1)} AS INT) * 12 + 12 ELSE CAST(right({said('t', Q.START_BY, 1)}, 4) AS INT) * 12 + 6 END < 2027 * 12 + 5"
)


@query(
    f"WITH x AS ({_TEXTS}), y AS (SELECT p_partkey, {said('t', Q.START_BAD)} AS bad, {said('t', Q.START_BY)} AS due, coalesce({_EARLY}, false) AS early, {said('t', Q.START_GOOD)} AS good FROM x) "
    "SELECT p_partkey, CASE WHEN bad IS NOT NULL OR early THEN 'incompatible' WHEN good IS NOT NULL THEN 'compatible' END AS flag, trim(CASE WHEN bad IS NOT NULL THEN bad WHEN early THEN due ELSE good END) AS evidence FROM y"
)
def start_signals(spark, d):
    x = table(spark, d, "part").select("p_partkey", F.expr(f"{_DEMANDS} || '. ' || {_BEGINS}").alias("t"))
    return x.select("p_partkey", Q.start_signal(F.col("t"), 2027, 5).alias("s")).select("p_partkey", "s.flag", "s.evidence")


_KINDS = chosen("o_custkey % 5", ["'Software Intern'", "'Fixed-term developer'", "NULL", "'Full time engineer'", "'Engineer ' || o_orderstatus"])
_RAW_KINDS = chosen("o_orderkey % 4", ["'Part-time'", "'Regular'", "'temp'", "NULL"])


@query(
    "WITH x AS (SELECT o_orderkey, " + _KINDS + " AS a, " + _RAW_KINDS + " AS b, 'New Grad 20' || (24 + o_orderkey % 6) || ' or 2026' AS title FROM orders) SELECT o_orderkey, coalesce("
    + ", ".join("CASE " + " ".join(f"WHEN regexp_matches({c}, '(?i){p}') THEN '{k}'" for p, k in Q.WORK_KINDS) + " END" for c in "ab")
    + ", 'unknown') AS kind, CASE WHEN o_orderkey % 2 = 0 THEN CASE WHEN o_orderkey % 6 IN (1, 3, 4) AND o_orderkey % 6 <> 2 THEN least('20' || (24 + o_orderkey % 6), '2026') || '-' || greatest('20' || (24 + o_orderkey % 6), '2026') ELSE '2026' END END AS cohort FROM x"
)
def work_kinds(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.expr(_KINDS).alias("a"), F.expr(_RAW_KINDS).alias("b"), F.expr("'New Grad 20' || (24 + o_orderkey % 6) || ' or 2026'").alias("title"))
    return o.select("o_orderkey", Q.work_kind(F.col("a"), F.col("b")).alias("kind"), Q.title_window(F.col("title"), F.col("o_orderkey") % 2 == 0).alias("cohort"))


_NAMES = chosen("s_suppkey % 6", ["'The ' || s_name || ' Labs, Inc.'", "s_name || ' & Sons LLC'", "'Acme Capital ' || s_nationkey", "'Crypto Wallet ' || s_suppkey || ' Co.'", "'Deep Research Group'", "NULL"])


@query(
    "WITH x AS (SELECT s_suppkey, " + _NAMES + " AS n FROM supplier), y AS (SELECT s_suppkey, n, trim(regexp_replace(regexp_replace(replace(lower(coalesce(n, '')), '&', ' and '), " + quoted(Q.COMPANY_SUFFIX) + ", ' ', 'g'), '[^a-z0-9]+', ' ', 'g')) AS k FROM x) "
    "SELECT s_suppkey, k AS company_key, CASE " + " ".join(f"WHEN regexp_matches(n, '(?i){p}') THEN '{c}'" for p, c in Q.CATEGORY_HINTS) + " END AS hint, k = 'deep research' OR starts_with(k, 'acme capital ') AS listed FROM y"
)
def company_names(spark, d):
    x = table(spark, d, "supplier").select("s_suppkey", F.expr(_NAMES).alias("n"))
    key = Q.company_key(F.col("n"))
    return x.select("s_suppkey", key.alias("company_key"), Q.category_hint(F.col("n")).alias("hint"), Q.named_like(key, ["acme capital", "deep research", "sons"]).alias("listed"))


@query(
    "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'Acme ' || p_brand WHEN 1 THEN p_brand || ' Inc' WHEN 2 THEN p_type END AS company, CASE p_partkey % 4 WHEN 0 THEN 'Engineer for the ' || p_name WHEN 1 THEN 'Senior ' || p_name || ' and ' || p_name || ' maker' WHEN 2 THEN 'Maker of ' || p_name || ' and more' ELSE 'Engineer' END AS role FROM part"
)
def page_titles(spark, d):
    raw = chosen("p_partkey % 4", ["'Engineer for the ' || p_name || ' | Acme ' || p_brand", "p_brand || ' Inc - Senior ' || p_name || ' and ' || p_name || ' maker'", "'Maker of ' || p_name || ' and more at ' || p_type", "'Engineer'"])
    host = "CASE WHEN p_partkey % 4 = 0 THEN 'jobs.acme.com' ELSE 'x.org' END"
    split = Q.split_title(F.expr(raw), F.when(F.col("p_partkey") % 4 == 0, "jobs.acme.com").otherwise("zz.org"))
    return table(spark, d, "part").withColumn("_h", F.expr(host)).select("p_partkey", split.alias("s")).select("p_partkey", "s.company", "s.role")


_UUID = "'0a1b2c3d-0000-4000-8000-' || right('000000000000' || o_orderkey, 12)"
_URLS = chosen(
    "o_orderkey % 12",
    [
        "'https://www.Careers.Example.com/open?b=2&gh_jid=' || o_orderkey || '&a=1'",
        "'https://boards.greenhouse.io/acme/jobs/' || o_orderkey || '?gh_src=x'",
        f"'https://jobs.lever.co/acme/' || {_UUID} || '/apply'",
        f"'https://jobs.ashbyhq.com/acme/' || {_UUID}",
        "'https://acme.wd5.myworkdayjobs.com/en/Site/job/Place/Engineer_R-' || o_orderkey",
        "'https://apply.workable.com/acme/j/ab' || right('00000000' || o_orderkey, 8) || '/'",
        "'https://jobs.smartrecruiters.com/Acme/74' || right('00000000' || o_orderkey, 8) || '-engineer'",
        "'https://acme.fa.oraclecloud.com/hcmUI/job/' || o_orderkey || '/'",
        "'https://acme.recruitee.com/o/role-' || o_orderkey || '?source=x'",
        "'https://acme.icims.com/jobs/' || o_orderkey || '/engineer/job'",
        "'HTTPS://www.site.com/search/1' || right('00000' || o_orderkey, 5) || '/view/?utm_campaign=y'",
        "'http://plain.com/careers/?z=' || o_orderkey % 100 || '&a=b&ref=q'",
    ],
)
_URL_KEYS = chosen(
    "o_orderkey % 12",
    [
        "'greenhouse:' || o_orderkey",
        "'greenhouse:' || o_orderkey",
        f"'lever:' || {_UUID}",
        f"'ashby:' || {_UUID}",
        "'workday:acme:R-' || o_orderkey",
        "'workable:AB' || right('00000000' || o_orderkey, 8)",
        "'smartrecruiters:74' || right('00000000' || o_orderkey, 8)",
        "'oracle:acme:' || o_orderkey",
        "'recruitee:acme:role-' || o_orderkey",
        "'icims:acme:' || o_orderkey",
        "'site:site.com:1' || right('00000' || o_orderkey, 5)",
        "'http://plain.com/careers?a=b&z=' || o_orderkey % 100",
    ],
)


@query(
    f"SELECT o_orderkey, {_URL_KEYS} AS url_key, CASE o_orderkey % 12 WHEN 1 THEN 'greenhouse' WHEN 2 THEN 'lever' WHEN 3 THEN 'ashby' WHEN 4 THEN 'workday' WHEN 5 THEN 'workable' WHEN 6 THEN 'smartrecruiters' WHEN 7 THEN 'oracle' WHEN 8 THEN 'recruitee' WHEN 9 THEN 'icims' END AS provider, "
    "CASE o_orderkey % 12 WHEN 6 THEN 'Acme' WHEN 0 THEN NULL WHEN 10 THEN NULL WHEN 11 THEN NULL ELSE 'acme' END AS slug FROM orders"
)
def url_keys(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.expr(_URLS).alias("u"))
    return o.select("o_orderkey", U.url_key(F.col("u")).alias("url_key"), U.provider(F.col("u")).alias("p")).select("o_orderkey", "url_key", "p.provider", "p.slug")


@query(
    "WITH x AS (SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS id, o_custkey % 9 AS k FROM orders) "
    "SELECT o_orderkey, CASE k WHEN 0 THEN 'unverified' WHEN 1 THEN 'dead' WHEN 2 THEN 'unverified' WHEN 3 THEN 'dead' WHEN 4 THEN CASE WHEN length(id) >= 4 THEN 'live' ELSE 'dead' END WHEN 5 THEN 'dead' WHEN 6 THEN 'redirected' WHEN 7 THEN 'live' ELSE CASE WHEN length(id) >= 4 THEN 'live' ELSE 'unverified' END END AS status FROM x"
)
def link_verdicts(spark, d):
    k, i = F.col("o_custkey") % 9, F.col("o_orderkey").cast("string")
    of = lambda *texts: F.coalesce(*(F.when(k == n, t) for n, t in texts))
    url = F.when(k == 7, F.concat(F.lit("http://x.com/role/"), i)).otherwise(F.lit("http://x.com/role"))
    final = F.when(k == 3, F.lit("http://x.com/Careers/")).when(k == 5, F.lit("http://x.com/other/team")).when(k == 6, F.concat(F.lit("http://y.com/now/"), i, F.lit("/"))).otherwise(url)
    body = of((4, F.concat(F.lit("Sorry, this job is closed: "), i)), (8, F.concat(F.lit("<p>"), i, F.lit("</p>"))))
    status = F.when(k == 1, 410).when(k == 2, 503).when(k > 2, 200)
    v = U.link_verdict(status, url, final, body, F.array(i), F.when(k.isin(3, 5, 6), 1).otherwise(0))
    return table(spark, d, "orders").select("o_orderkey", v.alias("v")).select("o_orderkey", "v.status")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 AND o_orderkey >= 10000 THEN o_orderkey || ',1' || o_orderkey WHEN o_orderkey % 3 = 0 AND length('1' || o_orderkey) >= 5 THEN o_orderkey || ',1' || o_orderkey ELSE CAST(o_orderkey AS VARCHAR) END AS ids FROM orders")
def link_inputs(spark, d):
    url = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("http://x.com/1"), F.col("o_orderkey"), F.lit("?a=b")))
    return table(spark, d, "orders").select("o_orderkey", F.array_join(U.own_ids(F.col("o_orderkey"), url), ",").alias("ids"))


# postings over orders, in SQL that both sides read
POSTINGS = (
    "SELECT o_orderkey AS id, o_custkey AS company_id, o_custkey * 100 + o_orderkey % 40 AS cluster_id, CASE o_orderkey % 4 WHEN 0 THEN 'software_engineering' WHEN 1 THEN 'ml_ai' WHEN 2 THEN 'sales' END AS role_family, "
    "o_orderkey % 3 = 0 AS is_new_grad, o_custkey % 7 = 0 AS is_dream_list, o_orderkey % 11 <> 0 AS has_requirements, CASE WHEN o_orderkey % 13 = 0 THEN o_orderkey - 1 END AS repost_of_id, o_orderkey % 26 = 0 AS changed_since_first_seen, "
    "CASE WHEN o_totalprice > 300000 THEN 'clearly_better' WHEN o_totalprice > 100000 THEN 'worse' END AS beats_baseline, CASE WHEN o_orderkey % 5 = 0 THEN o_orderkey % 10 END AS est_days_to_close, "
    "CASE WHEN o_orderkey % 6 = 0 THEN CAST('1997-06-15' AS DATE) END AS application_deadline, o_orderdate AS first_seen_at, CASE o_orderpriority WHEN '1-URGENT' THEN 'shortlisted' WHEN '5-LOW' THEN 'dismissed' ELSE 'new' END AS status, "
    "o_totalprice AS priority, o_orderkey % 9 <> 0 AS in_scope, o_orderkey % 17 = 0 AS is_stretch, CASE WHEN o_orderkey % 8 = 0 THEN 'fail' ELSE 'pass' END AS floor_result, o_orderkey % 10 <> 7 AS is_cluster_canonical, CASE WHEN o_orderstatus = 'P' THEN o_orderdate END AS delisted_at FROM orders"
)
_NEW = "first_seen_at >= TIMESTAMP '1997-01-01' AND is_cluster_canonical AND delisted_at IS NULL AND in_scope AND NOT is_stretch AND floor_result IN ('pass', 'exempt') AND status NOT IN ('applied', 'dismissed')"
_TRIGGER = (
    "CASE WHEN repost_of_id IS NOT NULL AND NOT changed_since_first_seen THEN 'repost' WHEN NOT has_requirements THEN 'unenriched_needs_review' WHEN is_dream_list AND eng AND is_new_grad THEN 'dream_list_new_grad' "
    "WHEN better AND closing THEN 'clearly_better_closing' WHEN priority > 280000 AND company_id % 5 = 0 THEN 'saved_filter' WHEN better THEN 'clearly_better' WHEN watched AND eng THEN 'watchlist_company' ELSE 'not_alert_worthy' END"
)
_ALERTS = (
    f"WITH p AS ({POSTINGS}), c AS (SELECT *, coalesce(role_family IN ('software_engineering', 'ml_ai'), false) AS eng, coalesce(beats_baseline = 'clearly_better', false) AS better, "
    "coalesce(application_deadline - DATE '1997-06-12' BETWEEN 0 AND 4, false) OR coalesce(est_days_to_close > 0 AND est_days_to_close < 5, false) AS closing, company_id % 10 = 3 AS watched "
    f"FROM p WHERE {_NEW}), t AS (SELECT *, {_TRIGGER} AS trigger FROM c), a AS (SELECT *, CASE WHEN trigger IN ('dream_list_new_grad', 'clearly_better_closing', 'saved_filter') THEN 'p0' WHEN trigger IN ('clearly_better', 'watchlist_company') THEN 'p1' ELSE 'none' END AS tier FROM t)"
)


def postings(spark, d):
    sql = POSTINGS.replace("FROM orders", "FROM {orders}")
    return spark.sql(sql, orders=table(spark, d, "orders"))


def alerts(spark, d):
    watched = table(spark, d, "customer").where("c_custkey % 10 = 3").select(F.col("c_custkey").alias("company_id"))
    rows = R.candidates(postings(spark, d), F.lit("1997-01-01").cast("timestamp_ntz"))
    return R.triggers(rows, F.lit("1997-06-12").cast("date"), watched, "company_id", [("dear", (F.col("priority") > 280000) & (F.col("company_id") % 5 == 0))])


@query(_ALERTS + " SELECT id, tier, trigger, CASE WHEN trigger = 'saved_filter' THEN 'dear' END AS matched FROM a")
def alert_triggers(spark, d):
    return alerts(spark, d).select("id", "tier", "trigger", "matched")


@query(f"WITH p AS ({POSTINGS}) SELECT id FROM p WHERE status = 'shortlisted' AND application_deadline BETWEEN DATE '1997-06-13' AND DATE '1997-06-15'")
def shortlist_deadlines(spark, d):
    return R.shortlist_deadlines(postings(spark, d), F.lit("1997-06-12 12:00:00").cast("timestamp_ntz")).select("id")


@query(
    _ALERTS.replace("WITH p AS", "WITH RECURSIVE p AS") + ", o AS (SELECT id, tier, company_id, cluster_id, strftime(first_seen_at, '%Y-%m') AS m, row_number() OVER (PARTITION BY strftime(first_seen_at, '%Y-%m') ORDER BY priority DESC, id) AS rn FROM a WHERE tier <> 'none'), "
    "f AS (SELECT DISTINCT m, 0::BIGINT AS rn, NULL::BIGINT AS id, false AS sent, []::BIGINT[] AS p0, []::BIGINT[] AS p1, []::BIGINT[] AS companies, []::BIGINT[] AS p1s FROM o UNION ALL "
    "SELECT o.m, o.rn, o.id, ok, CASE WHEN ok AND tier = 'p0' THEN list_append(p0, cluster_id) ELSE p0 END, CASE WHEN ok AND tier = 'p1' THEN list_append(p1, cluster_id) ELSE p1 END, CASE WHEN ok THEN list_append(companies, company_id) ELSE companies END, p1s "
    "FROM (SELECT f.p0, f.p1, f.companies, f.p1s, o.*, NOT list_contains(f.p0, o.cluster_id) AND NOT (o.tier = 'p1' AND list_contains(f.p1, o.cluster_id)) AND (CASE WHEN o.tier = 'p0' THEN len(f.p0) < 6 ELSE len(f.p1) < 8 END) AND len(list_filter(f.companies, lambda c: c = o.company_id)) < 2 AS ok FROM f JOIN o ON o.m = f.m AND o.rn = f.rn + 1) o) "
    "SELECT id, m FROM f WHERE sent"
)
def alerts_within_caps(spark, d):
    rows = alerts(spark, d).select("id", "tier", "company_id", "cluster_id", "priority", F.date_format("first_seen_at", "yyyy-MM").alias("m"))
    return R.within_caps(rows, "m", "tier", "company_id", "cluster_id", [F.desc("priority"), F.asc("id")], {"p0": 6, "p1": 8}, 2).select("id", "m")


_OUTCOME = "CASE WHEN event_type IN ('click', 'purchase') AND event_id % 4 = 0 THEN 'engaged' WHEN ts < TIMESTAMP '2024-01-28' - INTERVAL 48 HOUR THEN 'ignored' ELSE 'pending' END"


@query(
    f"WITH x AS (SELECT user_id, ts, {_OUTCOME} AS o FROM events), l AS (SELECT user_id, max(ts) AS last FROM x WHERE o = 'engaged' GROUP BY 1) "
    "SELECT x.user_id, count(*) FILTER (o = 'ignored' AND (last IS NULL OR ts > last)) AS consecutive_ignored, count(*) FILTER (o = 'ignored' AND (last IS NULL OR ts > last)) >= 3 AS demoted FROM x LEFT JOIN l USING (user_id) GROUP BY 1"
)
def demoted_companies(spark, d):
    e = table(spark, d, "events").select("user_id", F.col("ts").alias("sent_at"), F.when(F.col("event_type").isin("click", "purchase") & (F.col("event_id") % 4 == 0), F.col("ts")).alias("engaged_at"))
    return R.demoted(R.ignored(e, F.lit("2024-01-28").cast("timestamp_ntz")), "user_id", "sent_at", "outcome")


@query(
    "WITH r AS (SELECT 'drift' AS key, 'error' AS severity, count(*) AS n FROM supplier WHERE s_acctbal < 0 HAVING n >= 1 UNION ALL SELECT 'dead_letters', 'warn', count(*) FROM events WHERE event_type = 'error' HAVING count(*) >= 50 UNION ALL SELECT 'failing', 'error', count(*) FROM supplier WHERE s_acctbal > 1e9 HAVING count(*) >= 1 UNION ALL SELECT 'volume', 'warn', count(*) FROM orders HAVING count(*) >= 50) "
    "SELECT *, 'sys:' || key || ':2024-01-02' AS dedupe_key FROM r WHERE key <> 'volume'"
)
def daily_alarms(spark, d):
    s, e, o = (table(spark, d, t) for t in ("supplier", "events", "orders"))
    rules = [("drift", "error", s.where("s_acctbal < 0"), 1), ("dead_letters", "warn", e.where("event_type = 'error'"), 50), ("failing", "error", s.where("s_acctbal > 1e9"), 1), ("volume", "warn", o, 50)]
    sent = spark.createDataFrame([("sys:volume:2024-01-02",), ("sys:drift:2024-01-01",)], "dedupe_key string")
    return R.alarms(rules, F.lit("2024-01-02").cast("date"), sent)


@query(
    "WITH x AS (SELECT p_partkey, p_partkey % 19 = 0 AS hard, CASE WHEN p_size % 4 > 0 THEN p_size % 4 END AS years, p_partkey % 5 AS f, p_partkey % 3 = 0 AS grad, p_partkey % 7 = 0 AS dream, p_partkey % 4 AS company FROM part) "
    "SELECT p_partkey, CASE WHEN hard OR coalesce(years, 0) >= 2 OR f > 1 THEN 'none' WHEN dream AND grad THEN 'p0' WHEN company = 1 AND grad THEN 'p1' WHEN dream AND years IS NOT NULL THEN 'p1' ELSE 'none' END AS tier FROM x"
)
def stream_prescore(spark, d):
    k, no = F.col("p_partkey"), F.lit(False)
    rows = table(spark, d, "part").select(
        "p_partkey", F.when(k % 19 == 0, "Senior").alias("hard_title"), F.when(F.col("p_size") % 4 > 0, F.col("p_size") % 4).alias("min_years_experience"), F.when(k % 5 == 0, "ml_ai").when(k % 5 == 1, "security").otherwise("sales").alias("role_family"),
        (k % 3 == 0).alias("is_new_grad"), F.lit("unknown").alias("seniority"), (k % 7 == 0).alias("is_dream_list"), (k % 4).alias("company_tier"), F.lit("full_time").alias("employment_type"), no.alias("is_international_only"), no.alias("requires_clearance"), no.alias("requires_advanced_degree"),
    )
    return rows.select("p_partkey", R.prescore().alias("s")).select("p_partkey", "s.tier")


@query(
    "SELECT c_custkey, CASE WHEN c_custkey % 31 = 0 OR c_custkey % 29 = 0 OR c_custkey % 23 = 0 OR (c_custkey % 50) > CASE c_custkey % 4 WHEN 0 THEN 2 WHEN 3 THEN 24 ELSE 6 END THEN 'full' ELSE 'incremental' END AS mode FROM customer"
)
def scan_modes(spark, d):
    k, now = F.col("c_custkey"), F.lit("2024-01-31 12:00:00").cast("timestamp")
    cadence = F.array(*map(F.lit, ("15min", "hourly", "6h", "daily")))[(k % 4).cast("int")]
    last = F.when(k % 29 != 0, now - F.make_dt_interval(hours=(k % 50).cast("int")))
    mode = R.scan_mode(cadence, last, now, F.when(k % 23 == 0, 10_000).otherwise(40), k % 31 == 0)
    return table(spark, d, "customer").select("c_custkey", mode.alias("mode"))


@query("SELECT o_orderkey, c_custkey FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderkey % 3 <> 0")
def resolved_callbacks(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.lit("p").alias("provider"), F.col("c_nationkey").cast("string").alias("slug"), F.col("c_name").alias("job"))
    o = table(spark, d, "orders").join(c.select(F.col("c_custkey").alias("o_custkey"), F.when(F.col("c_custkey") >= 0, R.short_hash(F.col("provider"), F.col("slug"), F.col("job"))).alias("h")), "o_custkey")
    asked = o.select("o_orderkey", F.when(F.col("o_orderkey") % 3 != 0, F.col("h")).otherwise(F.lit("000000000000")).alias("h"))
    return R.resolved(asked, "h", c, ["provider", "slug", "job"], "c_custkey").select("o_orderkey", "c_custkey")


@query(
    "SELECT event_id, CASE WHEN event_type = 'view' AND ts < TIMESTAMP '2024-01-20' - INTERVAL 12 HOUR THEN 'aborted' WHEN event_type = 'view' THEN 'running' ELSE 'done' END AS status, floor((epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts))) / 1e6)::BIGINT AS gap_seconds FROM events"
)
def run_ledger(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", F.when(F.col("event_type") == "view", "running").otherwise("done").alias("status"), F.col("ts").alias("started_at"), F.lit(None).cast("timestamp_ntz").alias("ended_at"))
    runs = R.gaps(R.ledger(e, F.lit("2024-01-20").cast("timestamp_ntz")), "started_at", ["user_id"])
    return runs.select("event_id", "status", F.floor(F.round(F.col("gap_hours") * 3600, 6)).alias("gap_seconds"))


@query("SELECT event_id FROM events WHERE ts > TIMESTAMP '2024-01-15 06:00:00'")
def after_watermark(spark, d):
    import datetime

    e = table(spark, d, "events")
    return R.since_mark(e, "ts", datetime.datetime(2024, 1, 15, 6)).unionByName(R.since_mark(e, "ts", None)).select("event_id")
