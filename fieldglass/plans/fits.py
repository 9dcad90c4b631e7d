"""Registered queries of the fit of resumes and postings, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import fit as K
from ..operators import rescore as R
from ..operators import upkeep as U
from ..operators.ranges import stored
from ..sources import pages as W
from .rules import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return register


PROFILE = K.Profile(
    {"the": K.Skill(0.9, "Articles"), "python": K.Skill(0.8, "Python", ("TION the", "ing and")), "cpp": K.Skill(0.0, "C++"), "of_the": K.Skill(0.65), "java": K.Skill(0.25, "Java", ("eau",)), "react": K.Skill(0.7, "React", ("erand", "with")), "csharp": K.Skill(1.0, "C#", ("zz", "is"))},
    edges=("csharp", "the"),
    gaps=("cpp", "distributed_systems"),
    domain="react",
    domain_categories=("ai_lab", "fintech_infrastructure"),
    stack_note="their stack is another",
)
ASKED = ["the", "python", "cpp", "of_the", "java", "with"]
_TERMS = [(t, i, s) for t in [*ASKED, "react", "csharp", "go"] for i, s in enumerate(PROFILE.terms(t))]

_FIT = """WITH line AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents WHERE text IS NOT NULL),
    b AS (SELECT doc_id, n, regexp_replace('• ' || trim(line), '^[●•\\-– ]+', '') AS bullet FROM line WHERE trim(line) <> ''),
    t(tag, i, term) AS (VALUES {terms}),
    e AS (SELECT doc_id, tag, arg_min(substr(bullet, 1, 220), (i, n)) AS ev FROM b JOIN t ON contains(lower(bullet), term) GROUP BY ALL),
    s(tag, p, label) AS (VALUES ('the', 0.9, 'Articles'), ('python', 0.8, 'Python'), ('cpp', 0.0, 'C++'), ('of_the', 0.65, 'of_the'), ('java', 0.25, 'Java'), ('react', 0.7, 'React'), ('csharp', 1.0, 'C#')),
    p AS (SELECT doc_id AS id, CASE doc_id % 5 WHEN 0 THEN 'big_tech_swe' WHEN 1 THEN 'quant_dev_research_trading' WHEN 2 THEN 'ai_lab' WHEN 3 THEN 'fintech_infrastructure' END AS cat, doc_id % 7 = 0 AS low, doc_id % 11 = 0 AS ops, CASE WHEN doc_id % 4 > 0 THEN CAST(doc_id % 100 AS DOUBLE) / 100 END AS sim,
        list_filter(['the', 'python', 'cpp', 'of_the', 'java', 'with'], lambda x, i: (doc_id // CAST(pow(2, i - 1) AS BIGINT)) % 2 = 1) || CASE WHEN doc_id % 3 = 0 THEN ['csharp', 'go'] ELSE ['react'] END AS tags FROM documents),
    g AS (SELECT id, i, tag, coalesce(s.p, 0.5) AS p, coalesce(s.label, tag) AS label, CASE WHEN tag IN ('csharp', 'the') THEN 1.6 WHEN tag = 'cpp' THEN 1.4 ELSE 1.0 END AS w FROM (SELECT id, unnest(tags) AS tag, generate_subscripts(tags, 1) AS i FROM p) LEFT JOIN s USING (tag)),
    k AS (SELECT id, CAST(sum(w * p) AS DOUBLE) / CAST(sum(w) AS DOUBLE) AS stack, bool_or(tag IN ('csharp', 'the')) AS edge, bool_or(tag IN ('java', 'python', 'cpp', 'go')) AS big, bool_or(tag = 'react') AS dom FROM g GROUP BY id),
    x AS (SELECT p.*, k.edge, k.big, CASE WHEN low OR ops THEN stack * CAST(0.8 AS DOUBLE) ELSE stack END AS stack, CASE WHEN cat IN ('ai_lab', 'fintech_infrastructure') THEN CASE WHEN dom THEN 0.12 ELSE 0.06 END ELSE 0.0 END AS bonus FROM p JOIN k USING (id)),
    m AS (SELECT id, 100 + i AS o, label, tag FROM g WHERE p >= 0.6 UNION ALL SELECT id, 1000, 'React', 'react' FROM x WHERE bonus > 0
        UNION ALL SELECT id, 1, 'Articles depth (edge)', 'the' FROM g WHERE tag = 'the' UNION ALL SELECT id, 2, 'C# depth (edge)', 'csharp' FROM g WHERE tag = 'csharp'),
    m1 AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY id, label ORDER BY o) = 1), m2 AS (SELECT * FROM m1 QUALIFY row_number() OVER (PARTITION BY id ORDER BY o) <= 6),
    mm AS (SELECT id, string_agg(label || '=' || coalesce(ev, '-'), '|' ORDER BY o) AS matched FROM m2 LEFT JOIN e ON e.doc_id = id AND e.tag = m2.tag GROUP BY id),
    l AS (SELECT id, i AS o, label || ':' || CASE WHEN p = 0 AND tag = 'cpp' THEN 'high' ELSE 'medium' END AS t FROM g WHERE p <= 0.3 UNION ALL SELECT id, 100, 'Big Tech stack mismatch:medium' FROM x WHERE cat = 'big_tech_swe' AND NOT edge AND big
        UNION ALL SELECT id, 101, 'deep infra / distributed systems:' || CASE WHEN low THEN 'high' ELSE 'medium' END FROM x WHERE low OR ops),
    ll AS (SELECT id, string_agg(t, '|' ORDER BY o) AS gaps FROM l GROUP BY id)
    SELECT x.id, CAST(floor(1000 * least(1, greatest(0, CASE WHEN sim IS NOT NULL THEN 0.5 * stack + 0.3 * least(1, greatest(0, (sim - 0.15) / 0.45)) + 0.2 * least(1, 0.5 + bonus * 2.5) ELSE 0.7 * stack + 0.3 * least(1, 0.5 + bonus * 2.5) END)) + 0.001) AS BIGINT) AS fit, CAST(floor(1000 * stack + 0.001) AS BIGINT) AS stack, coalesce(matched, '') AS matched, coalesce(gaps, '') AS gaps,
        CASE cat WHEN 'big_tech_swe' THEN 'leetcode_grind' WHEN 'quant_dev_research_trading' THEN 'leetcode_grind' WHEN 'ai_lab' THEN 'system_design' WHEN 'fintech_infrastructure' THEN 'system_design' ELSE 'behavioral_heavy' END AS archetype,
        CASE cat WHEN 'big_tech_swe' THEN 30 WHEN 'quant_dev_research_trading' THEN 40 WHEN 'ai_lab' THEN 25 WHEN 'fintech_infrastructure' THEN 18 ELSE 10 END AS hours
    FROM x LEFT JOIN mm USING (id) LEFT JOIN ll USING (id)""".format(terms=", ".join(f"('{t}', {i}, '{s}')" for t, i, s in _TERMS))


@query(_FIT)
def resume_fit(spark, d):
    """Every document as a resume, its lines as bullets, against a posting of its own."""
    docs, k = table(spark, d, "documents"), F.col("doc_id")
    lines = docs.select(k.alias("resume"), F.posexplode(F.split("text", "\n")).alias("pos", "line")).where(F.trim("line") != "")
    found = K.evidence(W.bullets(lines.withColumn("line", F.concat(F.lit("• "), F.trim("line"))), "resume", "pos", "line"), PROFILE, [*ASKED, "react", "csharp", "go"])
    tags = F.array_compact(F.array(*(F.when(F.shiftright(k, i) % 2 == 1, t) for i, t in enumerate(ASKED))))
    category = F.when(k % 5 == 0, "big_tech_swe").when(k % 5 == 1, "quant_dev_research_trading").when(k % 5 == 2, "ai_lab").when(k % 5 == 3, "fintech_infrastructure")
    names = F.when(k % 3 == 0, F.array(F.lit("C# "), F.lit("golang"))).otherwise(F.array(F.lit("React"), F.lit("unheard of")))
    p = docs.select(k.alias("id"), K.required_tags(tags, names).alias("tags"), category.alias("category"), F.when(k % 11 == 0, "devops_sre").alias("family"), F.when(k % 7 == 0, "low_latency_systems").alias("sub"), F.when(k % 4 > 0, (k % 100) / 100).alias("sim"))
    p = p.join(found, p.id == found.resume, "left")
    p = p.withColumn("f", K.fit(PROFILE, F.col("tags"), F.col("category"), F.col("family"), F.col("sub"), F.col("sim"), F.col("evidence")))
    fixed = lambda c: F.floor(F.col(c) * 1000 + 0.001).cast("bigint")
    matched = F.array_join(F.transform("f.matched", lambda m: F.concat(m["strength"], F.lit("="), F.coalesce(m["evidence"], F.lit("-")))), "|")
    gaps = F.array_join(F.transform("f.gaps", lambda g: F.concat_ws(":", g["gap"], g["severity"])), "|")
    return p.select("id", fixed("f.fit").alias("fit"), fixed("f.stack").alias("stack"), matched.alias("matched"), gaps.alias("gaps"), F.col("f.archetype").alias("archetype"), F.col("f.hours").alias("hours"))


@query("""WITH RECURSIVE f AS (SELECT CAST(quality AS DOUBLE) AS y, ln(1 + length(coalesce(text, ''))) AS a, CAST(length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g')) AS DOUBLE) AS b, CAST(length(regexp_replace(coalesce(text, ''), '[^A-Z]', '', 'g')) AS DOUBLE) AS c FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL),
    s AS (SELECT avg(a) AS ma, stddev_pop(a) AS sa, avg(b) AS mb, stddev_pop(b) AS sb, avg(c) AS mc, stddev_pop(c) AS sc, count(*) AS n FROM f),
    z AS MATERIALIZED (SELECT y, (a - ma) / coalesce(nullif(sa, 0), 1) AS a, (b - mb) / coalesce(nullif(sb, 0), 1) AS b, (c - mc) / coalesce(nullif(sc, 0), 1) AS c, CAST(n AS DOUBLE) AS n FROM f, s),
    g AS (SELECT 0 AS i, CAST(0 AS DOUBLE) AS wa, CAST(0 AS DOUBLE) AS wb, CAST(0 AS DOUBLE) AS wc, CAST(0 AS DOUBLE) AS w0
        UNION ALL SELECT i + 1, wa - 0.1 * (d.ga / d.n + 0.5 * wa / d.n), wb - 0.1 * (d.gb / d.n + 0.5 * wb / d.n), wc - 0.1 * (d.gc / d.n + 0.5 * wc / d.n), w0 - 0.1 * d.g0 / d.n
        FROM (SELECT i, wa, wb, wc, w0, max(n) AS n, sum(e * a) AS ga, sum(e * b) AS gb, sum(e * c) AS gc, sum(e) AS g0 FROM (SELECT g.*, z.a, z.b, z.c, z.n, 1 / (1 + exp(-greatest(-30, least(30, wa * a + wb * b + wc * c + w0)))) - y AS e FROM g, z WHERE i < 800) GROUP BY ALL) d)
    SELECT unnest(['length', 'symbols', 'capitals']) AS feature, CAST(floor(unnest([wa, wb, wc]) * 1000000 + 0.5) AS BIGINT) AS weight FROM g WHERE i = 800""")
def label_weights(spark, d):
    """What speaks for quality: 800 steps of descent on three features of every labelled text."""
    text = F.coalesce("text", F.lit(""))
    only = lambda kept: F.length(F.regexp_replace(text, f"[^{kept}]", ""))
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").select("quality", F.log(1.0 + F.length(text)).alias("length"), only("#*$%&|<>").alias("symbols"), only("A-Z").alias("capitals"))
    return U.descended_weights(rows, ["length", "symbols", "capitals"], "quality").select("feature", F.floor(F.col("weight") * 1_000_000 + 0.5).cast("bigint").alias("weight"))


def order_scores() -> R.Scores:
    c = F.col
    return R.Scores(
        R.Derived("pay", lambda s: F.least(F.lit(1.0), c("o_totalprice") / s["floor"]), ("o_totalprice",), ("floor",)),
        R.Derived("open", lambda s: c("o_orderstatus").isin("O", "P"), ("o_orderstatus",)),
        R.Derived("urgent", lambda s: F.when(c("open"), (6 - F.substring("o_orderpriority", 1, 1).cast("int")) * s["urgency"]).otherwise(0.0), ("open", "o_orderpriority"), ("urgency",)),
        R.Derived("score", lambda s: F.floor((c("pay") * s["pay_weight"] + c("urgent")) * 1000 + 0.001).cast("bigint"), ("pay", "urgent"), ("pay_weight",)),
    )


@query("""WITH o AS (SELECT o_orderkey, o_totalprice, CASE WHEN o_orderkey % 97 = 0 THEN 'F' WHEN o_orderkey % 89 = 0 THEN 'O' ELSE o_orderstatus END AS st, o_orderpriority FROM orders),
    x AS (SELECT o_orderkey, st, least(1.0, o_totalprice / 250000.0::DOUBLE) AS pay, st IN ('O', 'P') AS open, CASE WHEN st IN ('O', 'P') THEN (6 - CAST(substr(o_orderpriority, 1, 1) AS INTEGER)) * 0.125::DOUBLE ELSE 0.0 END AS urgent FROM o)
    SELECT o_orderkey, st AS o_orderstatus, open, CAST(floor((pay * 2.0::DOUBLE + urgent) * 1000 + 0.001) AS BIGINT) AS score FROM x""")
def targeted_rescore(spark, d):
    """Scores kept as a table; then some orders change status and one weight changes, and only what they reach is computed."""
    scores, settings = order_scores(), {"floor": 250000.0, "urgency": 0.25, "pay_weight": 2.0}
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus", "o_orderpriority")
    kept = stored(scores.computed(o, settings))
    k = F.col("o_orderkey")
    changes = o.where((k % 97 == 0) | (k % 89 == 0)).select(k, F.when(k % 97 == 0, "F").otherwise("O").alias("o_orderstatus"))
    kept = stored(R.patched(kept, "o_orderkey", scores.after_action(kept, "o_orderkey", changes, settings)))
    kept = R.patched(kept, "o_orderkey", scores.after_settings(kept, "o_orderkey", settings, settings | {"urgency": 0.125}))
    return kept.select("o_orderkey", "o_orderstatus", "open", "score")
