"""Which rows are worth an alert, which alerts go out under the caps, and what became of them."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Families that count as engineering, days to a deadline, caps of a day, and what is ignored when.
ENGINEERING = ("software_engineering", "ml_ai", "data_engineering", "devops_sre", "security")
CLOSING_DAYS, SHORTLIST_DAYS = 5, 3
IGNORED_HOURS, DEMOTED_AFTER, ORPHANED_HOURS = 48, 3, 12
FULL_SCAN_HOURS = {"15min": 2, "hourly": 6, "6h": 6, "daily": 24}
EXCLUDED_KINDS, EXCLUDED_LEVELS = ("internship", "contract", "part_time"), ("senior", "staff", "principal", "manager", "executive", "internship")


def candidates(rows: DataFrame, since: Column) -> DataFrame:
    """New rows that stand for their cluster, are open, in scope, no stretch, above the floor and not settled."""
    return rows.where(
        (F.col("first_seen_at") >= since) & F.col("is_cluster_canonical") & F.col("delisted_at").isNull() & F.col("in_scope") & ~F.col("is_stretch") & F.col("floor_result").isin("pass", "exempt") & ~F.col("status").isin("applied", "dismissed")
    )


def triggers(rows: DataFrame, as_of: Column, watched: DataFrame, company: str, filters: list[tuple[str, Column]]) -> DataFrame:
    """rows with tier (p0, p1, none), trigger and, for a saved filter, its name (matched).  The first rule
    that holds decides.  filters: saved conditions that page; watched: company ids on the watch list."""
    watch = watched.select(F.col(company).alias("_watched")).where("_watched IS NOT NULL").distinct()
    rows = rows.join(watch, rows[company] == F.col("_watched"), "left")
    engineering = F.coalesce(F.col("role_family").isin(*ENGINEERING), F.lit(False))
    left = F.datediff(F.col("application_deadline"), as_of)
    closing = F.coalesce((left >= 0) & (left < CLOSING_DAYS), F.lit(False)) | F.coalesce((F.col("est_days_to_close") > 0) & (F.col("est_days_to_close") < CLOSING_DAYS), F.lit(False))
    better = F.coalesce(F.col("beats_baseline") == "clearly_better", F.lit(False))
    matched = F.lit(None).cast("string")
    for name, condition in reversed(filters):
        matched = F.when(condition, F.lit(name)).otherwise(matched)
    yes = lambda c: F.coalesce(F.col(c).cast("boolean"), F.lit(False))
    rules = [
        (F.col("repost_of_id").isNotNull() & ~yes("changed_since_first_seen"), "none", "repost"),
        (~yes("has_requirements"), "none", "unenriched_needs_review"),
        (yes("is_dream_list") & engineering & yes("is_new_grad"), "p0", "dream_list_new_grad"),
        (better & closing, "p0", "clearly_better_closing"),
        (F.col("_matched").isNotNull(), "p0", "saved_filter"),
        (better, "p1", "clearly_better"),
        (F.col("_watched").isNotNull() & engineering, "p1", "watchlist_company"),
    ]
    decided = F.struct(F.lit("none").alias("tier"), F.lit("not_alert_worthy").alias("trigger"))
    for rule, tier, trigger in reversed(rules):
        decided = F.when(rule, F.struct(F.lit(tier).alias("tier"), F.lit(trigger).alias("trigger"))).otherwise(decided)
    out = rows.withColumn("_matched", matched).withColumn("_d", decided)
    name = F.when(F.col("_d.trigger") == "saved_filter", F.col("_matched")).alias("matched")
    return out.select("*", "_d.tier", "_d.trigger", name).drop("_d", "_matched", "_watched")


def shortlist_deadlines(rows: DataFrame, as_of: Column) -> DataFrame:
    """Shortlisted rows whose deadline is at most SHORTLIST_DAYS ahead."""
    left = (F.unix_micros(F.col("application_deadline").cast("timestamp")) - F.unix_micros(as_of.cast("timestamp"))) / F.lit(86_400_000_000.0)
    return rows.where((F.col("status") == "shortlisted") & left.between(0, SHORTLIST_DAYS)).withColumns({"tier": F.lit("p0"), "trigger": F.lit("shortlist_deadline_72h")})


def within_caps(alerts: DataFrame, day: str, tier: str, company: str, cluster: str, order: list[Column], tier_caps: dict[str, int], company_cap: int) -> DataFrame:
    """The alerts that go out, taken in order within each day: one for each (tier, cluster), none for a
    cluster that went out as p0 that day, at most tier_caps of a tier and company_cap of a company.
    A cluster belongs to one company.

    Caps depend on each other, so a day is folded in order, but only over the rows that can matter.  Of a
    (day, tier, company), an alert held back by either cap holds back all after it, so the first
    company_cap and the clusters that p0 may take away from them suffice; of a (day, tier), as many as all
    caps together.  Both bounds are constants: no task holds a whole day."""
    caps = sum(tier_caps.values())
    rows = alerts.where(F.col(tier).isin(*tier_caps) & F.col(day).isNotNull())
    first = lambda by, k: F.row_number().over(Window.partitionBy(*by).orderBy(*order)) <= k
    rows = rows.withColumn("_first", first([day, tier, cluster], 1)).where("_first")
    rows = rows.withColumn("_first", first([day, tier, company], company_cap + caps)).where("_first")
    rows = rows.withColumn("_first", first([day, tier], 4 * caps * (company_cap + caps))).where("_first").drop("_first")
    rows = rows.withColumn("_place", F.row_number().over(Window.partitionBy(day).orderBy(*order)))

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        sent, by_tier, by_company, paged = [], {}, {}, set()
        for t, c, k in pdf.sort_values("_place")[[tier, company, cluster]].itertuples(index=False):
            c = None if pd.isna(c) else c
            ok = k not in paged and by_tier.get(t, 0) < tier_caps[t] and by_company.get(c, 0) < company_cap
            sent.append(ok)
            if ok:
                by_tier[t], by_company[c] = by_tier.get(t, 0) + 1, by_company.get(c, 0) + 1
                if t == "p0":
                    paged.add(k)
        return pdf.sort_values("_place")[sent].drop(columns="_place")

    schema = rows.drop("_place").schema
    return rows.groupBy(day).applyInPandas(fold, schema)


def ignored(sent: DataFrame, as_of: Column, hours: int = IGNORED_HOURS) -> DataFrame:
    """sent (sent_at, engaged_at) with outcome: engaged, ignored after hours without, else pending."""
    late = F.col("sent_at") < as_of - F.make_dt_interval(hours=F.lit(hours))
    return sent.withColumn("outcome", F.when(F.col("engaged_at").isNotNull(), "engaged").when(late, "ignored").otherwise("pending"))


def demoted(history: DataFrame, company: str, at: str, outcome: str, after: int = DEMOTED_AFTER) -> DataFrame:
    """(company, consecutive_ignored, demoted): alerts ignored since the last one that was engaged with.
    Two partial aggregates, no window over a company's history."""
    last = history.where(F.col(outcome) == "engaged").groupBy(company).agg(F.max(at).alias("_last"))
    rows = history.join(last.withColumnRenamed(company, "_c"), F.col(company).eqNullSafe(F.col("_c")), "left")
    counts = (F.col(outcome) == "ignored") & (F.col("_last").isNull() | (F.col(at) > F.col("_last")))
    return rows.groupBy(company).agg(F.count_if(counts).alias("consecutive_ignored")).withColumn("demoted", F.col("consecutive_ignored") >= after)


def alarms(rules: list[tuple[str, str, DataFrame, int]], day: Column, sent: DataFrame) -> DataFrame:
    """(key, severity, n) of the rules (key, severity, offending rows, how many it takes) that hold and were
    not sent that day.  sent: dedupe_key."""
    found = [rows.agg(F.count("*").alias("n")).select(F.lit(key).alias("key"), F.lit(severity).alias("severity"), "n").where(F.col("n") >= least) for key, severity, rows, least in rules]
    every = reduce(DataFrame.unionByName, found).withColumn("dedupe_key", F.concat_ws(":", F.lit("sys"), "key", day.cast("date").cast("string")))
    return every.join(sent.select("dedupe_key").distinct(), "dedupe_key", "left_anti")


def prescore() -> Column:
    """struct(tier, reason) of a row as it streams in, from its own columns alone."""
    yes = lambda c: F.coalesce(F.col(c).cast("boolean"), F.lit(False))
    one_of = lambda c, names: F.coalesce(F.col(c).isin(*names), F.lit(False))
    beginner = yes("is_new_grad") | one_of("seniority", ["new_grad"])
    years = F.coalesce("min_years_experience", F.lit(0))
    out = F.col("hard_title").isNotNull() | (years >= 2) | one_of("employment_type", EXCLUDED_KINDS) | yes("is_international_only") | yes("requires_clearance") | yes("requires_advanced_degree") | one_of("seniority", EXCLUDED_LEVELS) | ~one_of("role_family", ENGINEERING)
    said = lambda tier, why: F.struct(F.lit(tier).alias("tier"), F.lit(why).alias("reason"))
    return (
        F.when(out, said("none", "out of scope"))
        .when(yes("is_dream_list") & beginner, said("p0", "beginner at a dream company"))
        .when(F.coalesce(F.col("company_tier") == 1, F.lit(False)) & beginner, said("p1", "beginner at a top company"))
        .when(yes("is_dream_list") & F.col("min_years_experience").isNotNull(), said("p1", "dream company"))
        .otherwise(said("none", "in scope"))
    )


def scan_mode(cadence: Column, last_full: Column, as_of: Column, incremental_items: Column, forced: Column) -> Column:
    """full where forced, never done, due by its cadence, or the source is read in one request; else incremental."""
    hours = F.coalesce(F.create_map(*(F.lit(x) for kv in FULL_SCAN_HOURS.items() for x in kv))[cadence], F.lit(6))
    waited = F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(last_full.cast("timestamp"))
    return F.when(forced | (incremental_items >= 10_000) | last_full.isNull() | (waited > hours * 3_600_000_000), "full").otherwise("incremental")


def since_mark(rows: DataFrame, at: str, mark) -> DataFrame:
    """Rows after the watermark of the last run that succeeded.  The first run (mark None) has none: it only
    sets the mark.  The caller moves the mark once the run is through, so a failed run is done again."""
    return rows.limit(0) if mark is None else rows.where(F.col(at) > F.lit(mark))


def short_hash(*parts: Column) -> Column:
    return F.substring(F.sha1(F.concat_ws("|", *parts)), 1, 12)


def resolved(callbacks: DataFrame, short: str, rows: DataFrame, key: list[str], row_id: str) -> DataFrame:
    """callbacks with the row_id of the row whose key has that short hash; without one they are dropped.
    callbacks may be a stream."""
    known = rows.select(short_hash(*(F.col(k) for k in key)).alias("_short"), F.col(row_id))
    return callbacks.join(known, callbacks[short] == F.col("_short")).drop("_short")


def ledger(runs: DataFrame, as_of: Column, hours: int = ORPHANED_HOURS) -> DataFrame:
    """runs (status, started_at, ended_at) with those that began over hours ago and never ended aborted."""
    orphan = (F.col("status") == "running") & (F.col("started_at") < as_of - F.make_dt_interval(hours=F.lit(hours)))
    return runs.withColumn("_o", orphan).withColumns({"status": F.when(F.col("_o"), "aborted").otherwise(F.col("status")), "ended_at": F.when(F.col("_o"), as_of).otherwise(F.col("ended_at"))}).drop("_o")


def gaps(runs: DataFrame, at: str, source: list[str]) -> DataFrame:
    """runs with gap_hours since the run before of the same source; null for the first."""
    before = F.lag(at).over(Window.partitionBy(*source).orderBy(at))
    return runs.withColumn("gap_hours", (F.unix_micros(F.col(at).cast("timestamp")) - F.unix_micros(before.cast("timestamp"))) / F.lit(3_600_000_000.0))
