"""Text of web pages, newest payloads, wage files, calendar lines, and registries kept in tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Least letters of a description, most letters kept, least letters of a line.
LEAST_STATED, LEAST_BLOCK, MOST_TEXT, LEAST_LINE = 200, 400, 20_000, 3
CHROME = ("script", "style", "nav", "header", "footer", "noscript", "svg", "form")
#: HTML to Markdown as replacements in order; $1 is the group.
MARKDOWN = [
    (r"(?is)<!--.*?-->", " "),
    (r"\s+", " "),
    (r"(?i)<h([1-6])[^>]*>", "\n\n# "),
    (r"(?i)<li[^>]*>", "\n- "),
    (r"(?i)<br[^>]*>|</?(?:p|div|h[1-6]|ul|ol|li|tr|table|section|article|main)\b[^>]*>", "\n"),
    (r"(?i)</?(?:b|strong)\b[^>]*>", "**"),
    (r"<[^>]*>", ""),
    (r"&nbsp;|&#160;", " "),
    (r"&lt;", "<"),
    (r"&gt;", ">"),
    (r"&quot;|&#34;", '"'),
    (r"&#39;|&apos;", "'"),
    (r"&amp;", "&"),
    (r"[ \t]*\n[ \t]*", "\n"),
    (r"\n{3,}", "\n\n"),
]
# Pay units in hours and weeks of a year, what a wage row needs to count.
UNITS = {"Year": 1.0, "Hour": 2080.0, "Week": 52.0, "Bi-Weekly": 26.0, "Month": 12.0}
WAGE_FROM, WAGE_TO = 20_000, 1_500_000
CADENCE = {1: "15min", 2: "hourly"}


def markdown(html: Column) -> Column:
    out = html
    for pattern, to in MARKDOWN:
        out = F.regexp_replace(out, pattern, to)
    return F.trim(F.regexp_replace(out, r"^\s+|\s+$", ""))


def without_chrome(html: Column) -> Column:
    out = html
    for tag in CHROME:
        out = F.regexp_replace(out, rf"(?is)<{tag}[^>]*>.*?</{tag}>", " ")
    return out


def page_text(html: Column) -> Column:
    """struct(text, method): the description that the page states about itself (jsonld), else its longest
    main or article block (main_block), in Markdown; null and none where neither is long enough."""
    stated = F.regexp_extract_all(html, F.lit(r"(?is)<script[^>]+type=[\"']application/ld\+json[\"'][^>]*>(.*?)</script>"), 1)
    one = "struct<`@type`: string, description: string>"
    items = F.flatten(
        F.transform(stated, lambda s: F.concat(
            F.array(F.from_json(s, one)),
            F.coalesce(F.from_json(s, f"array<{one}>"), F.array().cast(f"array<{one}>")),
            F.coalesce(F.from_json(s, f"struct<`@graph`: array<{one}>>")["@graph"], F.array().cast(f"array<{one}>")),
        ))
    )
    fit = F.filter(F.transform(F.filter(items, lambda i: F.lower(i["@type"]) == "jobposting"), lambda i: markdown(i["description"])), lambda t: F.length(t) > LEAST_STATED)
    body = without_chrome(html)
    blocks = F.concat(*(F.regexp_extract_all(body, F.lit(rf"(?is)<{tag}[^>]*>(.*?)</{tag}>"), 1) for tag in ("main", "article")))
    blocks = F.when(F.size(blocks) > 0, blocks).otherwise(F.array(body))
    sized = F.transform(blocks, lambda b: F.struct(F.length(F.regexp_replace(b, "<[^>]+>", "")).alias("n"), b.alias("b")))
    longest = F.aggregate(sized, F.struct(F.lit(-1).alias("n"), F.lit("").alias("b")), lambda best, x: F.when(x["n"] > best["n"], x).otherwise(best))["b"]
    text = markdown(longest)
    lines = F.array_join(F.filter(F.split(text, "\n"), lambda s: F.length(F.trim(s)) >= LEAST_LINE), "\n")
    none = F.struct(F.lit(None).cast("string").alias("text"), F.lit("none").alias("method"))
    own = F.get(fit, F.lit(0))
    return F.when(own.isNotNull(), F.struct(own.alias("text"), F.lit("jsonld").alias("method"))).when(F.length(text) > LEAST_BLOCK, F.struct(F.substring(lines, 1, MOST_TEXT).alias("text"), F.lit("main_block").alias("method"))).otherwise(none)


def newest_payloads(payloads: DataFrame, key: list[str], order: str, content: str) -> DataFrame:
    """key, the order and content of the newest payload: a partial aggregate, no window."""
    return payloads.groupBy(*key).agg(F.max(order).alias(order), F.max_by(content, order).alias(content))


def wages(rows: DataFrame, prefixes: list[str]) -> DataFrame:
    """Certified full-time wages of the occupations with these prefixes, a year's pay within bounds.  Columns
    are found by their upper-case names; ones that a file lacks are null.  Rows: employer, title, soc, city,
    state, level, wage, prevailing, decided."""
    known = {c.strip().upper(): c for c in rows.columns}
    get = lambda name: F.trim(F.coalesce(F.col(f"`{known[name]}`").cast("string"), F.lit(""))) if name in known else F.lit("")
    units = F.create_map(*(F.lit(x) for kv in UNITS.items() for x in kv))

    def annual(value, unit):
        # a unit in any case; a hyphenated one has both its words in capitals
        name = F.array_join(F.transform(F.split(F.when(get(unit) == "", "Year").otherwise(get(unit)), "-"), F.initcap), "-")
        return F.regexp_replace(get(value), "[,$]", "").try_cast("double") * units[name]

    wage = annual("WAGE_RATE_OF_PAY_FROM", "WAGE_UNIT_OF_PAY")
    of_interest = reduce(lambda a, b: a | b, (F.startswith(get("SOC_CODE"), F.lit(p)) for p in prefixes))
    full_time = F.upper(F.when(get("FULL_TIME_POSITION") == "", "Y").otherwise(get("FULL_TIME_POSITION"))) == "Y"
    empty = lambda c: F.nullif(c, F.lit(""))
    kept = rows.where((F.lower(get("CASE_STATUS")) == "certified") & of_interest & full_time & wage.between(WAGE_FROM, WAGE_TO))
    return kept.select(
        get("EMPLOYER_NAME").alias("employer"), F.substring(get("JOB_TITLE"), 1, 120).alias("title"), get("SOC_CODE").alias("soc"), F.substring(get("WORKSITE_CITY"), 1, 60).alias("city"), F.substring(get("WORKSITE_STATE"), 1, 2).alias("state"),
        empty(F.upper(get("PW_WAGE_LEVEL"))).alias("level"), wage.alias("wage"), annual("PREVAILING_WAGE", "PW_UNIT_OF_PAY").alias("prevailing"), empty(F.substring(get("DECISION_DATE"), 1, 10)).alias("decided"),
    )


def calendar_lines(events: DataFrame, uid: str, day: str, summary: str, stamp: str) -> DataFrame:
    """events with event, the lines of an iCalendar entry; commas, semicolons and breaks in texts escaped."""
    said = F.regexp_replace(F.regexp_replace(F.coalesce(F.col(summary), F.lit("")), r"([\;,])", r"\\$1"), r"\r?\n", r"\\n")
    lines = F.concat_ws("\r\n", F.lit("BEGIN:VEVENT"), F.concat(F.lit("UID:"), F.col(uid)), F.lit(f"DTSTAMP:{stamp}"), F.concat(F.lit("DTSTART;VALUE=DATE:"), F.date_format(day, "yyyyMMdd")), F.concat(F.lit("SUMMARY:"), said), F.lit("END:VEVENT"))
    return events.where(F.col(day).isNotNull()).withColumn("event", lines)


def write_calendar(events: DataFrame, path: str) -> None:
    """One text file a partition, each a calendar of its own."""

    def whole(batches):
        import pyarrow as pa

        yield pa.RecordBatch.from_pydict({"value": ["BEGIN:VCALENDAR\r\nVERSION:2.0\r\nPRODID:-//calendar//EN"]})
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch["event"]], ["value"])
        yield pa.RecordBatch.from_pydict({"value": ["END:VCALENDAR"]})

    events.select("event").mapInArrow(whole, "value string").write.mode("overwrite").text(path)


def registry(curated: DataFrame, discovered: DataFrame, key: str, dream: list[str]) -> DataFrame:
    """Both lists, the curated row where both have a key, with the cadence of its tier."""
    both = curated.withColumn("_p", F.lit(0)).unionByName(discovered.withColumn("_p", F.lit(1)), allowMissingColumns=True)
    rest = [c for c in both.columns if c not in (key, "_p")]
    one = both.where(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(F.struct(*rest), "_p").alias("r")).select(key, "r.*")
    by_tier = F.create_map(*(F.lit(x) for kv in CADENCE.items() for x in kv))
    return one.withColumn("cadence", F.when(F.col(key).isin(*dream), "15min").otherwise(F.coalesce(by_tier[F.col("tier")], F.lit("6h"))))


def synced(state: DataFrame, config: DataFrame, key: list[str]) -> DataFrame:
    """The source table after a new configuration: its rows with the configured columns, enabled unless an
    audit disabled them (disabled_reason set) or the configuration does; rows it dropped are disabled, not lost."""
    values = [c for c in config.columns if c not in (*key, "enabled")]
    c = config.select(*key, *(F.col(v).alias(f"_{v}") for v in (*values, "enabled")), F.lit(True).alias("_in"))
    both = state.join(c, key, "full")
    enabled = F.coalesce(F.col("_in") & F.coalesce("_enabled", F.lit(True)) & F.col("disabled_reason").isNull(), F.lit(False))
    return both.select(*key, *(F.coalesce(f"_{v}", v).alias(v) for v in values), enabled.alias("enabled"), "disabled_reason")


def runs_in_month(log: DataFrame, at: str) -> DataFrame:
    return log.groupBy(F.to_date(F.date_trunc("month", at)).alias("month")).agg(F.count("*").alias("n"))


def bullets(lines: DataFrame, doc: str, pos: str, text: str) -> DataFrame:
    """(doc, n, bullet): bullets of a text given by lines in order.  A line with a bullet mark begins one; a
    line that begins in lower case, with a digit, or with and, for or to continues it; others end it."""
    said = lines.withColumn("_t", F.trim(text)).where("_t <> ''")
    order = Window.partitionBy(doc).orderBy(pos)
    starts = F.rlike("_t", F.lit("^[●•\\-–]"))
    goes_on = F.rlike("_t", F.lit(r"^(\p{Ll}|\p{Nd}|and|for|to)"))
    kind = F.when(starts, "start").when(goes_on, "on").otherwise("end")
    marked = said.withColumn("_k", kind).withColumn("_n", F.sum((F.col("_k") != "on").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    bare = F.regexp_replace("_t", "^[●•\\-– ]+", "")
    groups = marked.groupBy(doc, "_n").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), F.when(F.col("_k") == "start", bare).otherwise(F.col("_t")).alias("t")))), lambda x: x["t"]), " ").alias("bullet"), (F.count_if(F.col("_k") == "start") > 0).alias("_is"))
    return groups.where("_is").withColumn("n", F.row_number().over(Window.partitionBy(doc).orderBy("_n"))).select(doc, "n", "bullet")


def wants_detail(policy: str, needed: Column, seniority: Column, family: Column, skipped: list[str], families: list[str]) -> Column:
    """Whether a row's page is worth a visit: none, all_new, or by its title."""
    if policy == "none":
        return F.lit(False)
    by_title = ~F.coalesce(seniority.isin(*skipped), F.lit(False)) & family.isin(*families, "unknown")
    return F.coalesce(needed & (F.lit(True) if policy == "all_new" else by_title), F.lit(False))


def next_to_visit(rows: DataFrame, row_id: str, wanted: Column, failures: DataFrame, failed_id: str, failed_at: str, as_of: Column, order: list[Column], limit: int, days: int = 7) -> DataFrame:
    """The first wanted rows whose visit did not fail within days."""
    recent = failures.where(F.col(failed_at) > as_of - F.make_dt_interval(F.lit(days))).select(F.col(failed_id).alias("_f")).where("_f IS NOT NULL").distinct()
    return rows.where(wanted).join(recent, F.col(row_id) == F.col("_f"), "left_anti").orderBy(*order).limit(limit)


def alert_text(title: Column, company: Column, place: Column, pay_low: Column, pay_high: Column, reason: Column) -> Column:
    """The lines of an alert: what, where, what it pays, why."""
    pay = F.when(pay_low.isNotNull(), F.format_string("$%,d - $%,d", pay_low.cast("bigint"), F.coalesce(pay_high, pay_low).cast("bigint")))
    return F.concat_ws("\n", F.concat_ws(" at ", title, company), place, pay, reason)


def newest_union(new: Column, old: Column, most: int) -> Column:
    """Both arrays without repeats, the new one first, at most so many."""
    return F.slice(F.array_distinct(F.concat(new, old)), 1, most)
