"""One row of a posting from its raw record: everything that title, text, places and pay state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import extract as X
from ..functions import places as P
from ..functions import quals as Q
from ..functions import text as T

#: Columns that only fill what is not known yet when a description comes later.
GUARDED = ("base_posted_min", "base_posted_max", "base_posted_interval", "comp_source", "graduation_window")


def read(df: DataFrame, text: str, earliest: tuple[int, int]) -> DataFrame:
    """df with what takes long to find in a text, each in a column of its own so that it is found once."""
    return df.withColumns({"_pay": X.posted_pay(F.col(text)), "_start": Q.start_signal(F.col(text), *earliest)})


def from_text(text: Column, title: Column, tags: list[tuple[str, str]]) -> dict[str, Column]:
    """What the description alone says; all null without one.  For rows that read() went over."""
    there = F.coalesce(F.length(text) > 0, F.lit(False))
    pay, start = F.col("_pay"), F.col("_start")
    out = {
        "requires_clearance": Q.needs_clearance(text),
        "requires_advanced_degree": Q.needs_degree(text, title),
        "min_years_experience": X.least_years(text),
        "start_flag": start["flag"],
        "start_evidence": start["evidence"],
        "sponsorship": Q.sponsorship(text),
        "graduation_window": Q.graduation_window(text),
        "base_posted_min": T.annual(pay["low"], pay["interval"]),
        "base_posted_max": T.annual(pay["high"], pay["interval"]),
        "base_posted_interval": pay["interval"],
        "comp_source": F.when(pay.isNotNull(), "posted_range_text"),
        "tech_tags": T.every_rule(text, tags),
    }
    return {name: F.when(there, c) for name, c in out.items()}


def built(
    rows: DataFrame,
    known: P.Places,
    families: list[tuple[str, str]],
    levels: list[tuple[str, str]],
    tags: list[tuple[str, str]],
    earliest: tuple[int, int],
    aggregators: list[str],
) -> DataFrame:
    """rows (provider, slug, source_job_id, company_name, company_tier, is_dream_list, target_category, title,
    description, employment_type, places, pay_min, pay_max, pay_interval, apply_url, posted_at, deadline,
    remote) with the derived columns of a posting.

    Pay that the record states goes before pay found in the text.  parse_confidence is 0.5, plus 0.2 each for
    a text and a place, and 0.1 for a known family.  content_hash changes with what a reader would see."""
    title = F.coalesce(F.nullif(T.squashed(F.col("title")), F.lit("")), F.lit("(untitled)"))
    out = rows.withColumns({"title": title, "title_normalized": T.title_key(title), "description_fetched": F.coalesce(F.length("description") > 0, F.lit(False))})
    out = out.withColumns({"role_family": T.first_rule(F.col("title"), families, "unknown"), "seniority": T.first_rule(F.col("title"), levels, "unknown"), "_places": F.transform(P.apart(F.col("places")), lambda x: P.place(x, known))})
    out = out.withColumn("_together", P.together(F.col("_places"), known))
    said = from_text(F.col("description"), F.col("title"), tags)
    out = read(out, "description", earliest).withColumns({f"_{name}": c for name, c in said.items()})
    stated = F.coalesce(F.col("pay_min"), F.col("pay_max")).isNotNull()
    by_year = lambda c: T.annual(F.col(c), F.coalesce("pay_interval", F.lit("year")))
    beginners = X.for_beginners(F.col("title"))
    kind = Q.work_kind(F.when(F.col("seniority") == "internship", "intern"), F.col("title"), F.col("employment_type"))
    metros = F.array_distinct(F.array_compact(F.transform("_places", lambda p: p["metro"])))
    remote = F.coalesce("remote", F.lit(False))
    mode = F.when(remote & F.col("_together.work_mode").isin("unknown", "onsite"), F.when(F.size("metros") > 0, "hybrid").otherwise("remote")).otherwise(F.col("_together.work_mode"))
    out = out.withColumns(
        {
            "metros": metros,
            "employment_type": kind,
            "primary_metro": F.col("_together.primary"),
            "is_international_only": F.col("_together.abroad_only"),
            "requires_clearance": F.col("_requires_clearance"),
            "requires_advanced_degree": F.coalesce("_requires_advanced_degree", F.when(F.rlike("title", F.lit(Q.DEGREE_TITLE)), True)),
            "min_years_experience": F.col("_min_years_experience"),
            "sponsorship": F.col("_sponsorship"),
            "start_flag": F.col("_start_flag"),
            "graduation_window": F.coalesce("_graduation_window", Q.title_window(F.col("title"), beginners)),
            "base_posted_min": F.when(stated, by_year("pay_min")).otherwise(F.col("_base_posted_min")),
            "base_posted_max": F.when(stated, F.coalesce(by_year("pay_max"), by_year("pay_min"))).otherwise(F.col("_base_posted_max")),
            "base_posted_interval": F.when(stated, F.coalesce("pay_interval", F.lit("year"))).otherwise(F.col("_base_posted_interval")),
            "comp_source": F.when(stated, "api").otherwise(F.col("_comp_source")),
            "tech_tags": F.array_sort(F.array_distinct(F.concat(T.every_rule(F.col("title"), tags), F.coalesce("_tech_tags", F.array().cast("array<string>"))))),
            "source": F.when(F.col("provider").isin(*aggregators), "aggregator").otherwise("company_direct"),
        }
    )
    out = out.withColumns(
        {
            "work_mode": mode,
            "is_new_grad": beginners | (F.coalesce(F.col("min_years_experience") <= 1, F.lit(False)) & F.col("seniority").isin("unknown", "new_grad")),
            "parse_confidence": F.round(0.5 + F.when(F.col("description_fetched"), 0.2).otherwise(0.0) + F.when((F.size("metros") > 0) | F.coalesce("is_international_only", F.lit(False)), 0.2).otherwise(0.0) + F.when(F.col("role_family") != "unknown", 0.1).otherwise(0.0), 2),
        }
    )
    seen = F.to_json(F.struct("title", "metros", F.substring("description", 1, 20_000).alias("description"), "base_posted_min", "base_posted_max", "employment_type", "deadline", "apply_url"))
    return out.withColumn("content_hash", F.sha2(seen, 256)).drop("_places", "_together", "_pay", "_start", *(f"_{n}" for n in said))


def backfilled(rows: DataFrame, texts: DataFrame, key: str, tags: list[tuple[str, str]], earliest: tuple[int, int]) -> DataFrame:
    """rows with what a description that came later (key, text) says: the GUARDED columns only where they are
    null, the others by the text.  Rows without a new text stay as they are; of several new texts of a key the
    first in order of the texts counts."""
    names = [n for n in from_text(F.lit(""), F.lit(""), tags) if n in rows.columns]
    new = texts.select(F.col(key).alias("_key"), F.col("text").alias("_text")).where("length(_text) > 0").groupBy("_key").agg(F.min("_text").alias("_text"))
    both = read(rows.join(new, rows[key] == F.col("_key"), "left"), "_text", earliest)
    said = from_text(F.col("_text"), F.col("title"), tags)
    fresh = both.withColumns({f"_new_{n}": said[n] for n in names})
    there = F.col("_key").isNotNull()
    columns = {n: F.coalesce(n, f"_new_{n}") if n in GUARDED else F.when(there, F.col(f"_new_{n}")).otherwise(F.col(n)) for n in names}
    columns["description"] = F.coalesce("_text", "description")
    columns["description_fetched"] = F.col("description_fetched") | there
    return fresh.withColumns(columns).select(*rows.columns)
