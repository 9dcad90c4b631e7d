"""Pay estimates from the first source that has one, and the sub-scores beside the pay score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# How sure each source is, where in a range a beginner lands, the ceiling of inferred pay.
SURE = {"posted": 0.90, "company": 0.60, "peers": 0.45, "peers_wider": 0.35, "unknown": 0.15}
POINT, POINT_STRETCH, CEILING = 0.40, 0.55, 210_000.0
# Capital by rank of the category, location by bucket.
BY_RANK = {1: 1.0, 2: 0.9, 3: 0.8, 4: 0.65, 5: 0.5, 6: 0.35, 7: 0.3, 8: 0.25}
COHORTS = ("rotational", "new_grad_program", "analyst_program")
DEEP = ("backend", "distributed_infra", "generalist", "fullstack")


def peer_ranges(posted: DataFrame, keys: list[str], low: str, high: str, least: int) -> DataFrame:
    """Median low and high of groups with at least least ranges."""
    out = posted.where(F.col(low).isNotNull() & F.col(high).isNotNull()).groupBy(*keys)
    return out.agg(F.median(low).alias("low"), F.median(high).alias("high"), F.count("*").alias("n")).where(F.col("n") >= least)


def estimated_pay(rows: DataFrame, low: str, high: str, ladder: list[tuple[str, DataFrame, list[str]]], wide: tuple[float, float], stretch: Column, capped: Column) -> DataFrame:
    """rows with pay, pay_low, pay_high, pay_source, pay_sure.

    The posted range, else the first step of the ladder (label of SURE, ranges, keys) that has one,
    else the wide range.  The point taken lies POINT (POINT_STRETCH) into the range; where capped, pay
    that was not posted is held to CEILING.
    """
    own = F.when(F.coalesce(low, high).isNotNull(), F.struct(F.coalesce(low, high).cast("double").alias("low"), F.coalesce(high, low).cast("double").alias("high"), F.lit("posted").alias("source")))
    found, out = [own], rows
    for k, (label, ranges, keys) in enumerate(ladder):
        side = ranges.select(*(F.col(c).alias(f"_k{k}_{c}") for c in keys), F.struct(F.col("low").cast("double").alias("low"), F.col("high").cast("double").alias("high"), F.lit(label).alias("source")).alias(f"_r{k}"))
        out = out.join(side, [out[c].eqNullSafe(side[f"_k{k}_{c}"]) for c in keys], "left")
        found.append(F.col(f"_r{k}"))
    found.append(F.struct(F.lit(float(wide[0])).alias("low"), F.lit(float(wide[1])).alias("high"), F.lit("unknown").alias("source")))
    r = F.coalesce(*found)
    out = out.select(*rows.columns, r.alias("_r"), F.when(stretch, POINT_STRETCH).otherwise(POINT).alias("_p"), capped.alias("_c"))
    base = F.col("_r.low") + F.col("_p") * (F.col("_r.high") - F.col("_r.low"))
    over = F.coalesce(F.col("_c"), F.lit(False)) & (F.col("_r.source") != "posted") & (base > CEILING)
    sure = F.create_map(*(F.lit(x) for kv in SURE.items() for x in kv))[F.col("_r.source")]
    return out.select(
        *rows.columns,
        F.when(over, CEILING).otherwise(base).alias("pay"),
        F.when(over, F.least("_r.low", F.lit(CEILING))).otherwise(F.col("_r.low")).alias("pay_low"),
        F.when(over, F.least("_r.high", F.lit(CEILING * 1.1))).otherwise(F.col("_r.high")).alias("pay_high"),
        F.col("_r.source").alias("pay_source"),
        sure.alias("pay_sure"),
    )


def total_pay(base: Column, signing: Column, bonus: Column, equity: Column, kept: Column) -> Column:
    """First-year total: half of the signing bonus, 0.8 of the target bonus, equity after its haircut."""
    return base + 0.5 * signing + 0.8 * bonus * base + kept * equity


def _held(score: Column, least: float = 0.0) -> Column:
    return F.greatest(F.lit(least), F.least(F.lit(1.0), score))


def _if(condition: Column, points: float) -> Column:
    return F.when(condition, points).otherwise(0.0)


def career_score(rank: Column, tier: Column, family: Column, subfamily: Column, program: Column, dream: Column, dream_times: float = 1.1) -> Column:
    by_rank = F.coalesce(F.create_map(*(F.lit(x) for kv in BY_RANK.items() for x in kv))[rank], F.lit(0.25))
    s = by_rank + F.when(tier == 1, 0.12).when(tier == 2, 0.05).otherwise(0.0) + _if(subfamily.isin(*DEEP) & (family == "software_engineering"), 0.04) + _if(program.isin(*COHORTS), 0.04)
    return _held(s * F.when(dream, dream_times).otherwise(1.0))


def winnable_score(tier: Column, program: Column, beginners: Column, referral: Column, practice: float = 0.5, practice_share: float = 0.15, grades: bool = True, hard_seat: Column | None = None, hard_cap: float = 0.35) -> Column:
    """referral is secured, likely, possible or another value; practice from 0 to 1 takes practice_share of the score."""
    s = 0.5 + F.when(tier == 1, -0.12).when((tier == 3) | tier.isNull(), 0.08).otherwise(0.0) + _if(program.isin(*COHORTS), 0.10) + _if(beginners, 0.10)
    s = s + F.when(referral == "secured", 0.15).when(referral == "likely", 0.08).when(referral == "possible", 0.04).otherwise(0.0) + (0.04 if grades else 0.0)
    s = s * (1 - practice_share) + practice_share * practice
    return _held(F.when(hard_seat, F.least(s, F.lit(hard_cap))).otherwise(s) if hard_seat is not None else s, 0.02)


def location_score(bucket: Column, scores: dict[str, float], otherwise: float = 0.4) -> Column:
    return F.coalesce(F.create_map(*(F.lit(x) for kv in scores.items() for x in kv))[bucket], F.lit(otherwise))


def culture_score(repost_rate: Column, layoffs: Column, office_days: Column, work_mode: Column, repost: Column) -> Column:
    s = 0.6 - _if(repost_rate > 0.3, 0.1) - _if(layoffs > 0, 0.1) - _if(F.rlike(F.lower(office_days), F.lit("5|full")), 0.05)
    return _held(s + _if(work_mode.isin("hybrid", "remote"), 0.05) - _if(repost, 0.05))


def scope_gate(blocked: Column, senior: Column, level_ok: Column, family: Column, families: list[str], tags: Column, plain_tags: list[str], years: Column, signal: Column, pay_high: Column, floor: float, exempt: Column) -> Column:
    """struct(in_scope, stretch, reason): the first rule that applies.

    Rows go for a hard blocker, a senior title, a level or family that is not asked for (an unknown
    family stays with a tag that is not among plain_tags), no stated years without a sign of a
    beginners' role, three years or more, or a highest pay below the floor unless exempt.  More than
    one year up to two is a stretch.
    """
    telling = F.size(F.array_except(F.coalesce(tags, F.array().cast("array<string>")), F.array(*map(F.lit, plain_tags)).cast("array<string>"))) > 0
    known = F.coalesce(family, F.lit("unknown"))
    reason = (
        F.when(F.coalesce(blocked, F.lit(False)), "hard blocker")
        .when(senior.isNotNull(), "senior title")
        .when(~F.coalesce(level_ok, F.lit(False)), "level")
        .when((known == "unknown") & ~telling, "unknown family")
        .when((known != "unknown") & ~known.isin(*families), "family")
        .when(years.isNull() & ~F.coalesce(signal, F.lit(False)), "no sign of a beginners' role")
        .when(years > 2, "years")
        .when((pay_high < floor) & ~F.coalesce(exempt, F.lit(False)), "pay floor")
    )
    return F.struct(reason.isNull().alias("in_scope"), (reason.isNull() & F.coalesce(years > 1, F.lit(False))).alias("stretch"), reason.alias("reason"))
