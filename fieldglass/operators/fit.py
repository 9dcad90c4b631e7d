"""How a resume fits a posting: weighed skills, gaps, and the bullet that stands behind each strength.

The profile (skills, edges, gaps, domain) is a few dozen literals; everything about postings and
resumes stays in columns.  Evidence is found in one pass over the bullets, each term in each bullet,
pre-aggregated to the first term and then the first bullet of every resume and tag; a posting
then looks its tags up in the map of its resume.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let

# Names of languages and tools, and their tags.
TAGS = {
    "c#": "csharp", ".net": "dotnet", "dotnet": "dotnet", "c++": "cpp", "golang": "go", "go": "go", "rust": "rust", "python": "python", "java": "java", "javascript": "javascript", "typescript": "typescript", "react": "react", "sql": "sql", "kubernetes": "kubernetes", "k8s": "kubernetes",
    "docker": "docker", "aws": "aws", "azure": "azure", "gcp": "gcp", "scala": "scala", "kotlin": "swift_kotlin", "swift": "swift_kotlin", "ruby": "ruby", "php": "php", "terraform": "terraform", "spark": "spark", "kafka": "spark", "angular": "angular", "linux": "linux", "c": "c",
}
# What a category's interviews ask for, and the hours that take.
PREPARATION = {
    "quant_dev_research_trading": ("leetcode_grind", 40), "big_tech_swe": ("leetcode_grind", 30), "bank_and_exchange_tech": ("domain_finance", 12), "fintech_infrastructure": ("system_design", 18), "elite_infra_startup": ("take_home", 15), "defense_and_gov_tech": ("behavioral_heavy", 10), "ai_lab": ("system_design", 25),
}
OTHER_PREPARATION = ("behavioral_heavy", 10)
# Fixed values of the score.
BIG_TECH = ["java", "python", "cpp", "go"]
EDGE, GAP, UNKNOWN, STRONG, WEAK, NO_TAGS, INFRA, SHOWN, LONGEST = 1.6, 1.4, 0.5, 0.6, 0.3, 0.55, 0.8, 6, 220
STRENGTH = "struct<strength: string, proficiency: double, evidence: string, edge: boolean>"
MISSING = "struct<gap: string, severity: string, note: string>"


@dataclass(frozen=True)
class Skill:
    """terms: texts that show the skill in a bullet, ignoring case; without any, the tag and the label."""

    proficiency: float
    label: str = ""
    terms: tuple[str, ...] = ()


@dataclass(frozen=True)
class Profile:
    skills: dict[str, Skill]
    edges: tuple[str, ...] = ()
    gaps: tuple[str, ...] = ()
    domain: str = ""
    domain_categories: tuple[str, ...] = ()
    stack_note: str = ""

    def label(self, tag: str) -> str:
        return (self.skills[tag].label if tag in self.skills else "") or tag

    def terms(self, tag: str) -> list[str]:
        skill = self.skills.get(tag)
        if skill and skill.terms:
            return [t.lower() for t in skill.terms]
        return [tag.replace("_", " ").lower(), *([skill.label.lower()] if skill and skill.label else [])]


def required_tags(tags: Column, names: Column) -> Column:
    """The posting's tags, and those of the languages and frameworks that it names."""
    known = F.create_map(*(F.lit(x) for pair in TAGS.items() for x in pair))
    named = F.array_compact(F.transform(F.coalesce(names, F.array().cast("array<string>")), lambda n: F.try_element_at(known, F.lower(F.trim(n)))))
    return F.array_union(F.coalesce(tags, F.array().cast("array<string>")), named)


def evidence(bullets: DataFrame, profile: Profile, tags: list[str], resume: str = "resume", n: str = "n", bullet: str = "bullet") -> DataFrame:
    """(resume, evidence): for each tag the beginning of the first bullet that has its first term, or else its next."""
    terms = [F.struct(F.lit(t).alias("tag"), F.lit(i).alias("i"), F.lit(term).alias("term")) for t in tags for i, term in enumerate(profile.terms(t))]
    said = F.filter(F.array(*terms), lambda t: F.contains(F.lower(bullet), t["term"]))
    hits = bullets.select(resume, n, bullet, F.explode(said).alias("t"))
    first = hits.groupBy(resume, "t.tag").agg(F.min_by(F.substring(bullet, 1, LONGEST), F.struct("t.i", n)).alias("text"))
    return first.groupBy(resume).agg(F.map_from_entries(F.collect_list(F.struct("tag", "text"))).alias("evidence"))


def fit(profile: Profile, tags: Column, category: Column, family: Column, subfamily: Column, similarity: Column, found: Column) -> Column:
    """struct(fit, stack, domain_bonus, matched, gaps, archetype, hours, explanation).  tags: distinct; found: map of
    tag to evidence, null where there is no resume; similarity: cosine of posting and resume, null where
    there is none."""
    edges, gaps = (F.array(*(F.lit(t) for t in x)).cast("array<string>") for x in (profile.edges, profile.gaps))
    skills = F.create_map(*(x for t, s in profile.skills.items() for x in (F.lit(t), F.struct(F.lit(s.proficiency).alias("p"), F.lit(s.label or t).alias("label"))))) if profile.skills else None

    def skill(tag):
        unknown = F.struct(F.lit(UNKNOWN).alias("p"), tag.alias("label"))
        return F.coalesce(F.try_element_at(skills, tag), unknown) if skills is not None else unknown

    def shown(tag):
        return F.try_element_at(found, tag)

    def strength(label, p, tag, edge):
        return F.struct(label.alias("strength"), p.alias("proficiency"), shown(tag).alias("evidence"), edge.alias("edge")).cast(STRENGTH)

    def missing(gap, severity, note):
        return F.struct(F.lit(gap).alias("gap"), severity.alias("severity"), F.lit(note).alias("note")).cast(MISSING)

    def listed(items, kind):
        return F.array_compact(F.array(*items)) if items else F.array().cast(f"array<{kind}>")

    weight = lambda t: F.when(F.array_contains(edges, t), EDGE).when(F.array_contains(gaps, t), GAP).otherwise(1.0)
    zero = F.struct(F.lit(0.0).alias("w"), F.lit(0.0).alias("got"))
    total = F.aggregate(tags, zero, lambda a, t: F.struct((a["w"] + weight(t)).alias("w"), (a["got"] + weight(t) * skill(t)["p"]).alias("got")))
    plain = F.coalesce(F.try_divide(total["got"], total["w"]), F.lit(NO_TAGS))
    deep = F.coalesce(subfamily.isin("low_latency_systems", "distributed_infra"), F.lit(False)) | F.coalesce(family == "devops_sre", F.lit(False))
    deep = deep & F.lit("distributed_systems" in profile.gaps)
    mismatch = (category == "big_tech_swe") & F.lit(bool(profile.stack_note)) & ~F.arrays_overlap(tags, edges) & (F.arrays_overlap(tags, F.array(*(F.lit(t) for t in BIG_TECH))) | (F.size(tags) == 0))
    in_domain = F.coalesce(category.isin(*profile.domain_categories), F.lit(False)) & F.lit(bool(profile.domain and profile.domain_categories))
    bonus = F.when(in_domain, F.when(F.array_contains(tags, profile.domain), 0.12).otherwise(0.06)).otherwise(0.0)

    strong = F.transform(F.filter(tags, lambda t: skill(t)["p"] >= STRONG), lambda t: strength(skill(t)["label"], skill(t)["p"], t, F.array_contains(edges, t)))
    domain, depth = F.lit(profile.domain), []
    for t in reversed(profile.edges):
        depth.append(F.when(F.array_contains(tags, t), strength(F.lit(f"{profile.label(t)} depth (edge)"), skill(F.lit(t))["p"], F.lit(t), F.lit(True))))
    by_domain = [F.when(in_domain, strength(skill(domain)["label"], skill(domain)["p"], domain, F.lit(True)))] if profile.domain else []
    every = F.concat(listed(depth, STRENGTH), strong, listed(by_domain, STRENGTH))
    once = F.aggregate(every, F.array().cast(f"array<{STRENGTH}>"), lambda a, x: F.when(F.exists(a, lambda y: y["strength"] == x["strength"]), a).otherwise(F.concat(a, F.array(x))))

    def lacking(t):
        none = skill(t)["p"] == 0.0
        severity = F.when(none & F.array_contains(gaps, t), "high").otherwise("medium")
        return F.struct(skill(t)["label"].alias("gap"), severity.alias("severity"), F.when(none, "absent from your stack").otherwise("light exposure only").alias("note")).cast(MISSING)

    lacks = F.transform(F.filter(tags, lambda t: skill(t)["p"] <= WEAK), lacking)
    severity = F.when(subfamily == "low_latency_systems", "high").otherwise("medium")
    more = [F.when(mismatch, missing("Big Tech stack mismatch", F.lit("medium"), profile.stack_note)), F.when(deep, missing("deep infra / distributed systems", severity, "large-scale distributed-systems depth is a stated gap"))]
    archetype, hours = F.lit(OTHER_PREPARATION[0]), F.lit(OTHER_PREPARATION[1])
    for name, (kind, time) in PREPARATION.items():
        archetype, hours = F.when(category == name, kind).otherwise(archetype), F.when(category == name, time).otherwise(hours)

    def told(x):
        stack, extra = x["stack"], F.least(F.lit(1.0), 0.5 + x["bonus"] * 2.5)
        near = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (x["similarity"] - 0.15) / 0.45))
        score = F.when(x["similarity"].isNotNull(), 0.5 * stack + 0.3 * near + 0.2 * extra).otherwise(0.7 * stack + 0.3 * extra)
        said = F.concat(F.format_string("stack %.2f over %d tags", stack, F.size(tags)), F.when(x["similarity"].isNotNull(), F.format_string("; embedding sim %.2f", x["similarity"])).otherwise(""), F.when(x["bonus"] > 0, F.format_string("; domain bonus +%.2f", x["bonus"])).otherwise(""))
        return F.struct(
            F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)).alias("fit"),
            stack.alias("stack"),
            x["bonus"].alias("domain_bonus"),
            F.slice(once, 1, SHOWN).alias("matched"),
            F.slice(F.concat(lacks, F.array_compact(F.array(*more))), 1, SHOWN).alias("gaps"),
            archetype.alias("archetype"),
            hours.alias("hours"),
            said.alias("explanation"),
        )

    return let(F.struct(F.when(deep, plain * INFRA).otherwise(plain).alias("stack"), bonus.alias("bonus"), similarity.cast("double").alias("similarity")), told)
