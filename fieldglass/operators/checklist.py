"""Requirements against a profile, explanations, saved views and modes of work."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .predicates import Fields

# Levels that never enter the queue, families that may, and how sure a skill counts as had.
NEVER = ("senior", "staff", "principal", "manager", "executive", "internship")
FAMILIES = ("software_engineering", "ml_ai", "data_engineering", "devops_sre", "security", "unknown")
HAVE, PARTIAL = 0.6, 0.3
REQUIREMENTS = "struct<languages: array<string>, frameworks: array<string>, degree_min: string, advanced_degree_required: boolean, min_years: double, clearance: string, sponsorship: string, graduation_window: string>"


def checklist(requirements: Column, skills: dict[str, float], cohort: str) -> Column:
    """array<struct(item, kind, status)> of a JSON of requirements: have, partial, gap or unknown.  skills:
    how well each tag (lower case) is known; cohort: the year that a graduation window has to name."""
    r = F.from_json(requirements, REQUIREMENTS)
    none = F.array().cast("array<struct<item: string, kind: string, status: string>>")
    item = lambda what, kind, status: F.struct(what.alias("item"), F.lit(kind).alias("kind"), status.alias("status"))
    known = F.create_map(*(F.lit(x) for kv in skills.items() for x in kv)) if skills else F.create_map().cast("map<string, double>")

    def tech(name):
        sure = known[F.lower(name)]
        return item(name, "tech", F.when(sure >= HAVE, "have").when(sure >= PARTIAL, "partial").when(sure.isNotNull(), "gap").otherwise("unknown"))

    names = F.concat(F.coalesce(r["languages"], F.array().cast("array<string>")), F.coalesce(r["frameworks"], F.array().cast("array<string>")))
    years = r["min_years"]
    single = [
        F.when(F.coalesce(r["degree_min"], F.lit("")) != "", item(F.concat(F.lit("degree: "), r["degree_min"]), "degree", F.when(F.coalesce(r["advanced_degree_required"], F.lit(False)), "gap").otherwise("have"))),
        F.when(years.isNotNull(), item(F.concat(F.regexp_replace(years.cast("string"), r"\.0$", ""), F.lit("+ years experience")), "years", F.when(years <= 1, "have").when(years <= 2, "partial").otherwise("gap"))),
        F.when(F.coalesce(r["clearance"], F.lit("none")) != "none", item(F.concat(F.lit("clearance: "), r["clearance"]), "clearance", F.when(r["clearance"] == "required", "gap").otherwise("partial"))),
        F.when(r["sponsorship"] == "does_not_offer", item(F.lit("no sponsorship"), "sponsorship", F.lit("have"))),
        F.when(F.coalesce(r["graduation_window"], F.lit("")) != "", item(F.concat(F.lit("graduation window "), r["graduation_window"]), "window", F.when(F.contains(r["graduation_window"], F.lit(cohort)), "have").otherwise("gap"))),
    ]
    return F.when(r.isNull(), none).otherwise(F.concat(F.transform(names, tech), F.array_compact(F.array(*single))))


def explanation(parts: dict[str, tuple[Column, float]], **more: Column) -> Column:
    """JSON of each sub-score with its value and weight, and of everything else that decided."""
    scores = F.struct(*(F.struct(value.alias("value"), F.lit(weight).alias("weight")).alias(name) for name, (value, weight) in parts.items()))
    return F.to_json(F.struct(scores.alias("sub_scores"), *(c.alias(name) for name, c in more.items())))


def first_unique(items: Column, most: int) -> Column:
    """Without repeats, in order, at most so many."""
    return F.slice(F.array_distinct(items), 1, most)


def own_place(places: Column, primary: Column) -> Column:
    """The place of an array of structs (metro, kind) that is the primary one, else the first."""
    mine = F.filter(places, lambda p: (p["metro"] == primary) | (p["kind"] == primary))
    return F.coalesce(F.get(mine, F.lit(0)), F.get(places, F.lit(0)))


class Presets:
    """Saved views by name: conditions on fields and an order; a view may be narrowed further, or turned to
    all rows instead of the default view."""

    def __init__(self, fields: Fields, orders: dict[str, list[Column]]):
        self.fields, self.orders, self.saved = fields, orders, {}

    def add(self, name: str, conditions: list[tuple], order: str, alert: str | None = None) -> None:
        if order not in self.orders:
            raise ValueError(f"unknown order {order!r}; known: {', '.join(sorted(self.orders))}")
        self.saved[name] = (conditions, order, alert)

    def condition(self, name: str, *more: tuple) -> Column:
        return reduce(lambda a, b: a & b, (self.fields.where(*c) for c in (*self.saved[name][0], *more)))

    def rows(self, df: DataFrame, name: str, *more: tuple, default_view: Column | None = None) -> DataFrame:
        out = df.where(self.condition(name, *more))
        return out if default_view is None else out.where(default_view)

    def page(self, df: DataFrame, name: str, limit: int, offset: int = 0, **kept) -> DataFrame:
        from .views import page

        return page(self.rows(df, name, **kept), self.orders[self.saved[name][1]], limit, offset)

    def alerting(self, tier: str) -> list[tuple[str, Column]]:
        """The views that page at a tier, as conditions for the alert rules."""
        return [(n, self.condition(n)) for n, (_, _, alert) in self.saved.items() if alert == tier]


def described(fields: Fields) -> list[dict]:
    """The catalogue of fields: name, kind, operators, other names and shorthands of values."""
    ops = {"number": "= != < <= > >=", "bool": "= !=", "enum": "= != ~", "text": "~ = !=", "date": "= != < <= > >=", "tags": "= ~ !="}
    aliases = {}
    for other, name in fields.aliases.items():
        aliases.setdefault(name, []).append(other)
    return [{"name": n, "kind": f.kind, "operators": ops[f.kind].split(), "aliases": sorted(aliases.get(n, [])), "shorthands": dict(fields.shorthands.get(n, {}))} for n, f in sorted(fields.fields.items())]


def to_score(rows: DataFrame, mode: str, version: str, ids: DataFrame | None = None, row_id: str = "id") -> DataFrame:
    """The rows that a scoring run takes: those of ids, the unscored, the eligible (that could enter the queue
    or hold a score), or all."""
    if mode == "ids":
        return rows.join(ids.select(row_id).distinct(), row_id, "left_semi")
    if mode == "unscored":
        return rows.where(F.col("scored_at").isNull() | ~F.col("score_version").eqNullSafe(F.lit(version)) | F.coalesce("needs_rescore", F.lit(False)))
    if mode == "eligible":
        may = ~F.col("seniority").isin(*NEVER) & F.col("role_family").isin(*FAMILIES) & (F.coalesce("employment_type", F.lit("")) != "internship")
        return rows.where(F.coalesce(may, F.lit(False)) | F.coalesce(F.col("composite_score") > 0, F.lit(False)) | F.col("scored_at").isNull())
    if mode == "full":
        return rows
    raise ValueError(f"unknown mode {mode!r}")


def company_profile(postings: DataFrame, company: str, is_open: Column, in_scope: Column, at: str, low: str, high: str, most: int = 20) -> DataFrame:
    """(company, n_open, n_in_scope, ranges): counts and the newest stated pay ranges."""
    from .tracker import newest_children

    counts = postings.groupBy(company).agg(F.count_if(is_open).alias("n_open"), F.count_if(is_open & in_scope).alias("n_in_scope"))
    stated = postings.where(F.col(low).isNotNull())
    ranges = newest_children(stated, company, [F.desc(at), F.asc(low), F.asc(high)], most, [low, high], "ranges")
    return counts.join(ranges.withColumnRenamed(company, "_c"), F.col(company).eqNullSafe(F.col("_c")), "left").drop("_c")
