"""Scores, verdicts and actions as expressions; knobs come in a typed, checked record."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the scoring rules.
NEUTRAL, NO_SIGNAL = 0.5, 0.45
OFFER_BASE, OFFER_SLOPE = 0.02, 0.18
POSTED = ("posted_range", "ashby_posted", "posted_range_text", "pay_transparency")


@dataclass(frozen=True)
class Gates:
    floor: float = 85_000.0
    parity: float = 95_000.0
    yes: float = 120_000.0
    sure: float = 0.7

    def __post_init__(self):
        if not 0 < self.floor < self.parity < self.yes:
            raise ValueError("floor, parity and yes must ascend from 0")


@dataclass(frozen=True)
class Home:
    """The place that all others are compared with."""

    base: float = 95_000.0
    rate: float = 0.2
    cost: float = 100.0
    uplift: float = 0.25


def whole(x: Column) -> Column:
    """Nearest whole number, halves up, the same on every engine."""
    return F.floor(x + 0.5)


def location_value(base: Column, rate: Column, cost: Column, premium: Column, home: Home) -> Column:
    """Pay after tax, in the home place's purchasing power (raised by at most home.uplift) and its
    pay before tax, plus the premium: struct(tax_delta, adjustment, adjusted, effective)."""
    taxed = base * (1 - rate) / (1 - home.rate)
    adjusted = taxed * F.least(F.lit(home.cost) / cost, F.lit(1 + home.uplift))
    parts = {"tax_delta": base - taxed, "adjustment": adjusted - taxed, "adjusted": adjusted, "effective": adjusted + premium}
    return F.struct(*(whole(v).alias(k) for k, v in parts.items()))


def pay_score(value: Column, sure: Column, gates: Gates) -> Column:
    """Piecewise linear between the gates, drawn to the middle by how unsure it is; null: neutral."""
    low = 0.3 * value / gates.floor
    middle = 0.3 + 0.3 * (value - gates.floor) / (gates.parity - gates.floor)
    high = 0.6 + 0.15 * (value - gates.parity) / max(1.0, gates.yes - gates.parity)
    top = F.least(F.lit(1.0), 0.75 + 0.25 * (value - gates.yes) / 40_000)
    raw = F.when(value <= gates.floor, low).when(value <= gates.parity, middle).when(value <= gates.yes, high).otherwise(top)
    return F.when(value.isNull(), F.lit(NO_SIGNAL)).otherwise(sure * raw + (1 - sure) * NEUTRAL)


def verdict(base: Column, effective: Column, premium: Column, sure: Column, source: Column, tier: Column, dream: Column, rank: Column, gates: Gates) -> Column:
    """struct(verdict, reason, confidence): the first rule that holds."""
    known = lambda c: F.coalesce(c, F.lit(False))
    posted, strong = known(source.isin(*POSTED)), known(dream) | known(tier == 1)
    better = strong | known(rank == 1)
    label = F.when(posted | (sure >= 0.8), "high").when(sure >= 0.5, "medium").otherwise("low")
    case = (premium > 0) | ((effective >= gates.parity) & (posted | (sure >= 0.5))) | better | (known(tier == 2) & known(rank <= 4)) | ((base >= gates.yes) & ~posted)

    def said(what, why, confidence=label):
        return F.struct(F.lit(what).alias("verdict") if isinstance(what, str) else what.alias("verdict"), F.lit(why).alias("reason"), confidence.alias("confidence"))

    return (
        F.when(base.isNull() | effective.isNull(), said(F.when(strong, "arguably_better").otherwise("worse"), "no_comp", F.lit("low")))
        .when((base >= gates.yes) & (posted | (sure >= gates.sure)), said("clearly_better", "instant_yes"))
        .when((effective >= gates.parity) & better, said("clearly_better", "parity_plus_tier"))
        .when((effective >= gates.floor) & known(case), said("arguably_better", "floor_to_parity_with_case"))
        .when(effective >= gates.floor, said("worse", "no_case"))
        .otherwise(said("worse", "below_floor"))
    )


def urgency(days_open: Column, median_close: Column, days_left: Column, batch: Column, autumn: Column, first: Column) -> Column:
    """From 0.1 to 1; null days_left is no deadline."""
    risk = F.least(F.lit(1.0), F.greatest(F.lit(0.0), days_open) / median_close)
    near = F.when(days_left <= 7, 1.0).when(days_left <= 14, 0.7).when(days_left <= 30, 0.4).when(days_left.isNotNull(), 0.1).otherwise(0.0)
    u = 0.25 + 0.25 * risk + 0.2 * near + F.when(batch, 0.15).otherwise(0.0) + 0.05 * F.when(autumn, 1.0).otherwise(0.5) + F.when(first, 0.3).otherwise(0.0)
    return F.greatest(F.lit(0.1), F.least(F.lit(1.0), u))


def expected_value(effective: Column, capital: Column, winnable: Column, hours: Column, friction: Column, years: float, point: float, hourly: float, home: Home, best: float = 1.0) -> Column:
    """Chance of an offer times what it brings, less the work for it; null without pay.  winnable goes from 0
    to best, and is divided last: (k % 10) / 10 times the slope is not always the double that slope * (k % 10) / 10 is."""
    chance = OFFER_BASE + OFFER_SLOPE * winnable / best
    return chance * (years * (effective - home.base) + (capital - 0.5) * 10 * point) - hours * hourly - chance * friction


def composite(parts: dict[str, tuple[Column, float]], unsure: Column, referred: Column) -> Column:
    """Weighted sum of sub-scores, 0.9 of it where unsure, 1.05 where referred, at most 1."""
    if abs(sum(w for _, w in parts.values()) - 1) > 1e-6:
        raise ValueError("weights must sum to 1")
    total = reduce(lambda a, b: a + b, (c * w for c, w in parts.values()))
    return F.least(F.lit(1.0), total * F.when(unsure, 0.9).otherwise(1.0) * F.when(referred, 1.05).otherwise(1.0))


def queue_action(active: Column, stretch: Column, judged: Column, fit: Column, gaps: Column, ask_first: Column, urgent: Column, ready: Column) -> Column:
    """What to do with a row; null for rows that are not queued."""
    when_ready = lambda what: F.when(ready, what).otherwise("needs_review")
    ladder = F.when(judged == "worse", "watch").when((fit < 0.35) | (gaps >= 2), "blocked_needs_prep").when(ask_first & (urgent < 0.6), "get_referral_first")
    ladder = ladder.when(urgent >= 0.6, when_ready("apply_today")).when(urgent >= 0.4, when_ready("apply_this_week")).otherwise("watch")
    return F.when(active & ~F.coalesce(stretch, F.lit(False)), ladder)


def coverage(tags: Column, weights: dict[str, float], have: list[str], usual: float = 1.0) -> Column:
    """Weight of the tags one has over that of all tags; 0.5 for no tags."""
    weight = F.create_map(*(F.lit(x) for kv in weights.items() for x in kv)) if weights else None
    of = lambda t: F.coalesce(F.get(F.array(weight), F.lit(0))[t], F.lit(usual)) if weight is not None else F.lit(usual)
    total = lambda a: F.aggregate(F.transform(a, of), F.lit(0.0), lambda x, y: x + y)
    return F.coalesce(F.try_divide(total(F.filter(tags, lambda t: t.isin(*have))), total(tags)), F.lit(0.5))


def proposed_weights(current: dict[str, float], learned: dict[str, float], share: float = 0.3) -> dict[str, float]:
    """Learned weights, negative ones as 0, normalised and blended into the current ones."""
    positive = {k: max(0.0, learned.get(k, 0.0)) for k in current}
    total = sum(positive.values())
    mixed = {k: (1 - share) * w + share * positive[k] / total if total else w for k, w in current.items()}
    return {k: w / sum(mixed.values()) for k, w in mixed.items()}


def preview(rows: DataFrame, key: str, now: Column, then: Column, top: int = 30) -> DataFrame:
    """Rows in the first top by either score: key, rank_now, rank_then (null: outside).  Each list is
    a bounded sort and limit; nothing is written back."""
    from pyspark.sql import Window

    def first(score, name):
        best = rows.select(key, score.alias("_s")).where("_s IS NOT NULL").orderBy(F.desc("_s"), key).limit(top)
        return best.select(key, F.row_number().over(Window.orderBy(F.desc("_s"), key)).cast("bigint").alias(name))

    return first(now, "rank_now").join(first(then, "rank_then"), key, "full")
