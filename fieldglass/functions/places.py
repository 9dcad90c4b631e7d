"""Places named in free text: one text, a list of them, and the places of one posting together."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

# Words for work away from an office, in part or in many places, and for the home country.
REMOTE = r"(?i)\bremote\b|\banywhere\b|\bwork from home\b|\bwfh\b|\bdistributed\b|\bvirtual\b|\btelecommute\b"
HYBRID = r"(?i)\bhybrid\b"
MULTIPLE = r"(?i)\bmultiple (locations|cities|offices)\b|\bvarious( locations)?\b|\bother locations\b|\bmultiple\b|\bnationwide\b|\bopen to (any|all) (us )?locations?\b|\bany (us )?location\b|\bflexible location\b"
HOME_WORDS = r"(?i)\bunited states( of america)?\b|\busa\b|\bu\.s\.a?\.?\b|\bus\b|\bamerica\b"
STATE_MARK = r"(?:^|[,\s\-/(])([A-Z]{2})(?=$|[,\s)\-/.])"
APART = r"(?i)\s*(?:;|\||•|\n| or )\s*"


@dataclass(frozen=True)
class Places:
    """The gazetteer: small tables the caller gives."""

    #: metro -> (bucket, its states, aliases)
    metros: dict[str, tuple[str, list[str], list[str]]]
    states: dict[str, str]
    #: country code -> words
    countries: dict[str, list[str]]
    #: aliases that count only where no other alias is found
    weak: frozenset[str] = frozenset()
    #: buckets, best first
    buckets: list[str] = field(default_factory=list)

    def aliases(self, weak: bool) -> list[tuple[str, str]]:
        every = [(a.lower(), m) for m, (_, _, names) in self.metros.items() for a in names]
        return sorted((x for x in every if (x[0] in self.weak) == weak), key=lambda x: -len(x[0]))


def _word(w: str) -> str:
    return "(?<![a-z])" + re.escape(w) + "(?![a-z])"


def _first(text: Column, rules: list[tuple[str, str]]) -> Column:
    return F.coalesce(*(F.when(F.rlike(text, F.lit(_word(w))), F.lit(label)) for w, label in rules), F.lit(None).cast("string"))


def place(raw: Column, known: Places) -> Column:
    """struct(kind, metro, state, country, bucket, remote, hybrid, confidence) of one place.

    The longest alias names the metro; a state that is not one of its states rules it out, as does
    a foreign country beside a weak alias.  Null and empty texts are of kind unknown.
    """
    dashes = F.regexp_replace(F.regexp_replace(F.coalesce(raw, F.lit("")), "[–—]", "-"), r"\s+-\s+", ", ")
    text = F.btrim(F.regexp_replace(F.regexp_replace(dashes, "[()]", " "), r"\s+", " "), F.lit(" ,"))
    shared = {a for a, _ in known.aliases(True)}
    bucket_of = F.create_map(*(F.lit(x) for m, (b, _, _) in known.metros.items() for x in (m, b)))
    states_of = F.create_map(*(c for m, (_, s, _) in known.metros.items() for c in (F.lit(m), F.array(*map(F.lit, s)))))

    def marks(t):
        low, text = t["low"], t["text"]
        flags = {n: F.rlike(text, F.lit(p)) for n, p in (("remote", REMOTE), ("hybrid", HYBRID), ("many", MULTIPLE), ("home", HOME_WORDS))}
        abroad = _first(low, [(w.lower(), c) for c, words in known.countries.items() for w in words])
        named = _first(low, [(n.lower(), s) for s, n in known.states.items() if n.lower() not in shared])
        codes = F.filter(F.regexp_extract_all(text, F.lit(STATE_MARK), 1), lambda s: s.isin(*known.states))
        return F.struct(*(c.alias(n) for n, c in flags.items()), (text != "").alias("said"), abroad.alias("abroad"), named.alias("named"), codes.alias("codes"), _first(low, known.aliases(False)).alias("strong"), _first(low, known.aliases(True)).alias("weak"))

    def stated(f):
        codes = F.filter(f["codes"], lambda s: ~F.coalesce(s == f["abroad"], F.lit(False)))
        return F.struct(f.alias("f"), F.coalesce(F.try_element_at(codes, F.lit(1)), f["named"]).alias("state"), F.coalesce(f["strong"], f["weak"]).alias("metro"))

    def settled(x):
        f, state = x["f"], x["state"]
        elsewhere = F.coalesce(state.isNotNull() & ~F.array_contains(states_of[x["metro"]], state), F.lit(False))
        doubtful = f["strong"].isNull() & f["abroad"].isNotNull() & state.isNull()
        return F.struct(f.alias("f"), state.alias("state"), F.when(~elsewhere & ~doubtful, x["metro"]).alias("metro"), (f["abroad"].isNotNull() & state.isNull() & ~f["home"]).alias("foreign"))

    def sorted_out(x):
        f, state, metro, foreign = x["f"], x["state"], x["metro"], x["foreign"]
        kind = F.when(metro.isNotNull(), "metro").when(foreign, "international").when(f["remote"], "remote").when(f["many"], "multiple").when(state.isNotNull() | f["home"], "us_unknown").otherwise("unknown")
        return F.struct(x.alias("x"), kind.alias("kind"))

    def described(y):
        x, kind = y["x"], y["kind"]
        f, state, metro, foreign = x["f"], x["state"], x["metro"], x["foreign"]
        sure = F.when(metro.isNotNull(), F.when(f["strong"].isNull(), 0.6).otherwise(0.9)).when(foreign | f["remote"], 0.8).when(f["many"] | state.isNotNull(), 0.7).when(f["home"], 0.5).when(f["said"], 0.2).otherwise(0.0)
        at_home = kind.isin("metro", "remote", "multiple", "us_unknown")
        bucket = F.when(metro.isNotNull() & ~(f["remote"] & ~f["hybrid"]), bucket_of[metro]).when(metro.isNotNull() | (kind == "remote"), "remote").otherwise("elsewhere")
        return F.struct(
            kind.alias("kind"),
            metro.alias("metro"),
            F.when(metro.isNotNull(), F.coalesce(state, states_of[metro][0])).when(kind.isin("remote", "us_unknown"), state).alias("state"),
            F.when(at_home, "US").when(foreign, f["abroad"]).alias("country"),
            bucket.alias("bucket"),
            f["remote"].alias("remote"),
            f["hybrid"].alias("hybrid"),
            sure.alias("confidence"),
        )

    said = let(text, lambda t: F.struct(t.alias("text"), F.lower(t).alias("low")))
    for step in (marks, stated, settled, sorted_out, described):
        said = let(said, step)
    return said


def apart(raw: Column) -> Column:
    """The places of one text."""
    return F.filter(F.split(F.coalesce(raw, F.lit("")), APART), lambda p: F.trim(p) != "")


def together(places: Column, known: Places) -> Column:
    """struct(metros, countries, primary, abroad_only, many, work_mode) of an array of places.

    The primary place is the one in the best bucket, then the surest, then the earliest.
    """
    names = F.array_sort(F.array_distinct(F.filter(F.transform(places, lambda p: p["metro"]), lambda m: m.isNotNull())))
    countries = F.array_sort(F.array_distinct(F.filter(F.transform(places, lambda p: p["country"]), lambda m: m.isNotNull())))
    said = F.filter(places, lambda p: p["kind"] != "unknown")
    order = F.array(*map(F.lit, known.buckets))
    ranked = F.transform(places, lambda p, i: F.struct(F.when(F.array_contains(order, p["bucket"]), F.array_position(order, p["bucket"])).otherwise(1000).alias("b"), (-p["confidence"]).alias("c"), i.alias("i"), F.coalesce(p["metro"], p["kind"]).alias("name"), p["kind"].alias("kind")))
    best = F.array_min(F.filter(ranked, lambda p: p["kind"].isin("metro", "us_unknown", "remote")))
    hybrid, remote = F.exists(places, lambda p: p["hybrid"]), F.exists(places, lambda p: p["remote"])
    all_remote = (F.size(places) > 0) & F.forall(places, lambda p: p["remote"])
    office = F.exists(places, lambda p: p["kind"] == "metro")
    mode = F.when(all_remote & ~hybrid, "remote").when(hybrid | (office & remote), "hybrid").when(office, "onsite").otherwise("unknown")
    return F.struct(
        names.alias("metros"),
        countries.alias("countries"),
        best["name"].alias("primary"),
        ((F.size(said) > 0) & F.forall(said, lambda p: p["kind"] == "international")).alias("abroad_only"),
        (F.exists(places, lambda p: p["kind"] == "multiple") | (F.size(names) > 1)).alias("many"),
        mode.alias("work_mode"),
    )
