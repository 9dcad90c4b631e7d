"""What a cycle does with rows it has: derived fields, selection by bands, replays, reposts, digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.quals import MONTHS
from ..functions.text import tokens
from .joins import newest_earlier
from .ranges import stored

# Words that say nothing about a title, and which source of a row is trusted first.
STOP_WORDS = [
    "the", "a", "an", "and", "or", "of", "for", "to", "in", "at", "with", "on", "by", "we", "you", "our", "your", "is", "are", "be", "will", "as", "that", "this", "it", "from", "their", "they", "us",
    "new", "grad", "graduate", "2026", "2027", "early", "career", "university", "campus", "full", "time", "fulltime", "program", "i", "ii", "1", "2",
]
SOURCE_RANK = {"company_direct": 0, "aggregator": 1, "third_party": 2}
REPOST_DAYS, DESCRIBED = 90, 2000


def title_tokens(title: Column) -> Column:
    """Distinct words of a title, + # and . kept, without STOP_WORDS."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(title, F.lit(""))), F.lit("[a-z0-9+#.]+"), 0))
    return F.array_except(words, F.array(*map(F.lit, STOP_WORDS)))


def description_tokens(text: Column) -> Column:
    """Distinct words of over two letters in the first DESCRIBED characters, without STOP_WORDS; null without a text."""
    return F.when(F.length(text) > 0, tokens(F.substring(text, 1, DESCRIBED), STOP_WORDS, 3))


def computed(as_of: Column) -> dict[str, Column]:
    """Fields that follow from others: base, has_posted_comp, days_open, days_to_close, delisted, repost, snoozed."""
    days = lambda a, b: ((F.unix_micros(a.cast("timestamp")) - F.unix_micros(b.cast("timestamp"))) / F.lit(86_400_000_000.0)).cast("int")
    return {
        "base": F.coalesce("base_est", "base_posted_max", "base_posted_min"),
        "has_posted_comp": F.coalesce("base_posted_max", "base_posted_min").isNotNull(),
        "days_open": days(F.coalesce("delisted_at", as_of), F.col("first_seen_at")),
        "days_to_close": F.when(F.col("application_deadline").isNotNull(), days(F.col("application_deadline"), as_of)),
        "delisted": F.col("delisted_at").isNotNull(),
        "repost": F.col("repost_of_id").isNotNull(),
        "snoozed": F.coalesce((F.col("status") == "snoozed") & (F.col("snooze_until") > as_of), F.lit(False)),
    }


def in_bands(rows: DataFrame, bands: list[Column], order: list[Column], host: str, limit: int) -> DataFrame:
    """Up to limit rows of the 4 * limit first by the bands (rows that meet an earlier one go first) and the
    order, taken from the hosts in turn; hosts in the order of their first rows."""
    first = rows.orderBy(*(F.desc(F.coalesce(b, F.lit(False))) for b in bands), *order).limit(4 * limit)
    placed = first.withColumn("_place", F.row_number().over(Window.orderBy(*(F.desc(F.coalesce(b, F.lit(False))) for b in bands), *order)))  # 4 * limit rows
    by_host = Window.partitionBy(host)
    turn = placed.withColumn("_turn", F.row_number().over(by_host.orderBy("_place"))).withColumn("_host", F.min("_place").over(by_host))
    return turn.orderBy("_turn", "_host").limit(limit).drop("_place", "_turn", "_host")


def month_day(text: Column, as_of: Column) -> Column:
    """The date of "Aug 12" or "August 12, 2024"; without a year it is this year's, or last year's where
    that lies over two days ahead.  Null for others."""
    pattern = r"^\s*([A-Za-z]{3})[a-z]*\.?\s+(\d{1,2})(?:,?\s*(\d{4}))?\s*$"
    part = lambda k: F.nullif(F.regexp_extract(text, pattern, k), F.lit(""))
    month = F.nullif(F.array_position(F.array(*(F.lit(m[:3]) for m in MONTHS)), F.lower(part(1))), F.lit(0))
    date = lambda year: F.try_to_date(F.concat_ws("-", year.cast("string"), F.lpad(month.cast("string"), 2, "0"), F.lpad(part(2), 2, "0")))
    stated = part(3).try_cast("int")
    here = date(F.year(as_of))
    rolled = F.when(here > F.date_add(as_of, 2), date(F.year(as_of) - 1)).otherwise(here)
    return F.when(month > 0, F.when(stated.isNotNull(), date(stated)).otherwise(rolled))


def representative_order() -> list[Column]:
    """Which row of a cluster stands for it: source, a text, pay, first sighting (the id is the last word)."""
    rank = F.coalesce(F.create_map(*(F.lit(x) for kv in SOURCE_RANK.items() for x in kv))[F.col("source")], F.lit(3))
    return [rank, (~F.coalesce("description_fetched", F.lit(False))).cast("int"), F.coalesce("base_posted_min", "base_posted_max").isNull().cast("int"), F.coalesce(F.col("first_seen_at").cast("string"), F.lit(""))]


def reposts(rows: DataFrame, signature: list[str], row_id: str, begin: str, end: str, days: int = REPOST_DAYS) -> tuple[DataFrame, DataFrame]:
    """((row, repost_of), (row, repost_count)): each row that came within days after the newest row of the
    same signature had gone, and how often each row was followed so."""
    keyed = rows.withColumn("_sig", F.sha2(F.to_json(F.struct(*signature)), 256))
    links = newest_earlier(keyed, "_sig", begin, end, row_id, days).where(F.col(f"earlier_{row_id}").isNotNull()).select(row_id, F.col(f"earlier_{row_id}").alias("repost_of"))
    return links, links.groupBy(F.col("repost_of").alias(row_id)).agg(F.count("*").alias("repost_count"))


def with_details(rows: DataFrame, details: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """rows with what the newest detail page of each says in place of what the list says, where it says anything."""
    rest = details.groupBy(*key).agg(F.max_by(F.struct(*columns), "fetched_at").alias("_d"))
    return rows.join(rest, key, "left").withColumns({c: F.coalesce(F.col("_d")[c], F.col(c)) for c in columns}).select(*rows.columns)


def replayed(state: DataFrame, payloads: DataFrame, source: list[str], order: str, content: str, read, key: list[str], derived: list[str]) -> DataFrame:
    """The state with its derived columns computed anew from the newest stored payload of each source: by
    read(payloads) -> rows with key and derived.  Rows that no payload has stay as they are, and none is
    added or delisted."""
    newest = payloads.groupBy(*source).agg(F.max_by(content, order).alias(content))
    fresh = read(newest).select(*key, *(F.col(c).alias(f"_{c}") for c in derived), F.lit(True).alias("_in"))
    both = state.join(fresh, key, "left")
    return both.withColumns({c: F.when(F.col("_in"), F.col(f"_{c}")).otherwise(F.col(c)) for c in derived}).select(*state.columns)


def digest(rows: DataFrame, category: str, seen: str, gone: str, as_of: Column) -> DataFrame:
    """(category, opened, opened_before, closed): what came in the last week and the one before, and what went."""
    week = lambda c, a, b: F.count_if((F.col(c) >= as_of - F.make_dt_interval(F.lit(a))) & (F.col(c) < as_of - F.make_dt_interval(F.lit(b))))
    return rows.groupBy(category).agg(week(seen, 7, 0).alias("opened"), week(seen, 14, 7).alias("opened_before"), week(gone, 7, 0).alias("closed"))


def scope_funnel(rows: DataFrame, in_scope: Column, above_floor: Column, queued: Column) -> DataFrame:
    """One row: all, in scope, above the floor, in the queue, and the share that rules took out."""
    n, q = F.count("*"), F.count_if(in_scope & above_floor & queued)
    return rows.agg(n.alias("total"), F.count_if(in_scope).alias("in_scope"), F.count_if(in_scope & above_floor).alias("above_floor"), q.alias("queued"), F.try_divide((n - F.count_if(in_scope)).cast("double"), n.cast("double")).alias("eliminated"))


def write_once(payloads: DataFrame, content: str, folder: str) -> int:
    """Appends the payloads whose sha256 the folder does not have yet, each once; returns how many."""
    from pyspark.errors import AnalysisException

    spark = payloads.sparkSession
    new = payloads.withColumn("sha256", F.sha2(F.col(content).cast("string"), 256)).where("sha256 IS NOT NULL").dropDuplicates(["sha256"])
    try:
        known = spark.read.parquet(folder).select("sha256")
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        known = None
    new = stored(new if known is None else new.join(known, "sha256", "left_anti"))
    new.write.mode("append").parquet(folder)
    return new.count()
