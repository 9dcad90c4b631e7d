"""What a posting's text and title demand: clearance, degree, sponsorship, graduation, start, kind of work."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# How the demands are phrased.
CLEARANCE = (
    r"(?i)\b(active|current)\s+(ts/?sci|top[- ]secret|secret|security clearance|dod clearance|clearance)\b"
    r"|\bmust (?:currently )?(?:hold|possess|have)\b[^.]{0,60}\b(clearance|ts/?sci|top secret|secret)\b"
    r"|\b(ts/?sci|top secret)\b[^.]{0,40}\b(required|is required|clearance)\b"
    r"|\bclearance (?:is )?required\b|\brequires? (?:an? )?(?:active )?(?:security )?clearance\b"
    r"|\bpolygraph\b"
)
DEGREE = (
    r"(?i)\b(ph\.?d|doctorate|doctoral)\b[^.]{0,40}\b(required|is required|in)\b"
    r"|\b(master'?s|ms|m\.s\.|msc|graduate degree)\b[^.]{0,30}\b(required|is required|minimum)\b"
    r"|\b(requires?|required:?|minimum (?:of )?)\s*(?:an? )?(master'?s|ms|m\.s\.|ph\.?d)\b"
)
DEGREE_SOFT = (
    r"(?i)\b(master'?s|ms|m\.s\.|ph\.?d)\b[^.]{0,25}\b(preferred|a plus|bonus|or equivalent|or bachelor|bs/ms|bs or ms)\b"
    r"|\b(bachelor'?s|bs|b\.s\.)\b[^.]{0,12}\b(or|/)\s*(master'?s|ms|m\.s\.)\b"
)
DEGREE_TITLE = r"(?i)\b(ph\.?d|doctora(l|te)|ms/phd|phd/ms|master'?s (required|only|degree)|m\.?s\.? (required|only))\b"
SPONSOR_NO = (
    r"(?i)\b(?:no|not|unable to|cannot|will not|won't|does not|do not)\b[^.]{0,60}\b(sponsor|sponsorship)\b"
    r"|\bwithout (?:the need for )?(?:visa )?sponsorship\b|\bsponsorship (?:is )?not (?:available|offered|provided)\b"
)
SPONSOR_YES = r"(?i)\b(?:will|can|does|able to|open to)\b[^.]{0,30}\bsponsor"
GRADUATION = r"(?i)(?:graduat\w+|degree)[^.]{0,80}?\b(?:between|by|before|in|from|on or before|no later than)\s+([A-Z][a-z]+\s+)?(20\d\d)(?:\s*(?:-|–|and|to|through)\s*([A-Z][a-z]+\s+)?(20\d\d))?"
TITLE_YEAR = r"\b(202[5-8])\b"
WORK_KINDS = [
    (r"intern|co-?op", "internship"),
    (r"contract|contingent|temporary|temp\b|freelance|fixed[- ]term", "contract"),
    (r"part[- ]?time", "part_time"),
    (r"full[- ]?time|regular|permanent|employee", "full_time"),
]
START_BAD = (
    r"(?i)not\s+a\s+new\s?[- ]?grad(?:uate)?\s+(?:role|position|job)"
    r"|start(?:ing)?\s+(?:full[- ]time\s+)?(?:immediately|right\s+away)"
    r"|can\s+start\s+full\s?[- ]?time\s+right\s+away"
    r"|immediate\s+start"
    r"|immediately\s+available"
    r"|available\s+(?:to\s+start\s+)?immediately"
    r"|currently\s+enrolled\s+students\s+are\s+not\s+eligible"
)
START_BY = (
    r"(?i)(?:must\s+(?:be\s+able\s+to\s+)?start|start(?:ing)?\s+(?:date\s+)?(?:by|no\s+later\s+than|on\s+or\s+before))\s+(?:\w+\s+)?"
    r"((?:january|february|march|april|may|june|july|august|september|october|november|december)\s+\d{4}|\d{1,2}/\d{4}|\d{4})"
)
START_GOOD = (
    r"(?i)class\s+of\s+2027"
    r"|2027\s+graduate|graduating\s+in\s+(?:\w+\s+)?2027"
    r"|(?:summer|spring|fall|winter)\s+2027(?:\s+start)?"
    r"|december\s+2026\s+or\s+spring\s+2027"
    r"|university\s+graduate[^.]{0,80}2027|2027[^.]{0,80}university\s+graduate"
)
MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]
COMPANY_SUFFIX = r"(?i)\b(inc|incorporated|llc|ltd|limited|corp|corporation|co|company|plc|group|holdings|technologies|technology|labs|ai|io|hq|the)\b\.?"
CATEGORY_HINTS = [
    (r"\b(bank|bancorp|capital|financial|securities|exchange|asset management|investments?|insurance|mutual|fidelity|schwab|trading|markets)\b", "bank_and_exchange_tech"),
    (r"\b(pay|fintech|lending|credit|card|wallet|crypto|coin|blockchain|treasury)\b", "fintech_infrastructure"),
    (r"\b(defense|aerospace|space|missile|radar|autonomy|drone|government|federal|national lab|laborator)", "defense_and_gov_tech"),
    (r"\b(ai|labs?|research|intelligence|ml)\b", "ai_lab"),
]


def _said(text: Column, pattern: str, group: int = 0) -> Column:
    """The first match, or null."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def _has(text: Column, pattern: str) -> Column:
    return F.coalesce(F.rlike(text, F.lit(pattern)), F.lit(False))


def _known(text: Column) -> Column:
    """Whether there is a text at all; without one nothing can be said."""
    return F.coalesce(F.length(text) > 0, F.lit(False))


def needs_clearance(text: Column) -> Column:
    return F.when(_known(text), _has(text, CLEARANCE))


def needs_degree(text: Column, title: Column) -> Column:
    """Whether an advanced degree is a must: by the title, or by the text without a softening phrase."""
    body = F.when(_known(text), _has(text, DEGREE) & ~_has(text, DEGREE_SOFT))
    return F.when(_has(title, DEGREE_TITLE), True).otherwise(body)


def sponsorship(text: Column) -> Column:
    stated = F.when(_has(text, SPONSOR_NO), "does_not_offer").when(_has(text, SPONSOR_YES), "offers").otherwise("unknown")
    return F.when(_known(text), stated)


def graduation_window(text: Column) -> Column:
    """"2026" or "2026-2027"; null where no year is stated."""
    first, last = _said(text, GRADUATION, 2), _said(text, GRADUATION, 4)
    return F.when(last.isNotNull(), F.concat_ws("-", first, last)).otherwise(first)


def title_window(title: Column, beginners: Column) -> Column:
    """The years that a beginners' title names, as in graduation_window."""
    years = F.regexp_extract_all(title, F.lit(TITLE_YEAR), 1)
    low, high = F.array_min(years), F.array_max(years)
    return F.when(beginners, F.when(low < high, F.concat_ws("-", low, high)).otherwise(low))


def work_kind(*sources: Column) -> Column:
    """Kind of employment by the first source that states one, in order; else unknown."""
    found = []
    for text in sources:
        kind = F.lit(None).cast("string")
        for pattern, label in reversed(WORK_KINDS):
            kind = F.when(F.rlike(text, F.lit(f"(?i){pattern}")), F.lit(label)).otherwise(kind)
        found.append(kind)
    return F.coalesce(*found, F.lit("unknown"))


def months_of(text: Column) -> Column:
    """Year times 12 plus month of "June 2026", "6/2026" or "2026" (its end); null for others."""
    low = F.lower(F.trim(text))
    month = F.array_position(F.array(*map(F.lit, MONTHS)), F.regexp_extract(low, r"^([a-z]+)\s+\d+$", 1))
    year = F.regexp_extract(low, r"(\d+)$", 1).try_cast("int")
    slashed = F.regexp_extract(low, r"^(\d+)/\d+$", 1).try_cast("int")
    return F.when(month > 0, year * 12 + month).when(slashed.isNotNull(), year * 12 + slashed).when(F.rlike(low, F.lit(r"^\d{4}$")), year * 12 + 12).cast("int")


def start_signal(text: Column, year: int, month: int) -> Column:
    """struct(flag, evidence): whether someone who can begin in that month at the earliest fits.  A demand
    to start at once, or before that month, outweighs a phrase that names the right cohort."""
    bad, by, good = _said(text, START_BAD), _said(text, START_BY), _said(text, START_GOOD)
    early = F.coalesce(months_of(_said(text, START_BY, 1)) < year * 12 + month, F.lit(False))
    flag = F.when(bad.isNotNull() | early, "incompatible").when(good.isNotNull(), "compatible")
    return F.struct(flag.alias("flag"), F.trim(F.when(bad.isNotNull(), bad).when(early, by).otherwise(good)).alias("evidence"))


def company_key(name: Column) -> Column:
    """Lower case, & as and, without corporate suffix words, other characters as single spaces."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), "&", " and "), COMPANY_SUFFIX, " ")
    return F.trim(F.regexp_replace(plain, "[^a-z0-9]+", " "))


def category_hint(name: Column) -> Column:
    """What kind of company a name suggests; null for none."""
    out = F.lit(None).cast("string")
    for pattern, label in reversed(CATEGORY_HINTS):
        out = F.when(F.rlike(name, F.lit(f"(?i){pattern}")), F.lit(label)).otherwise(out)
    return out


def named_like(key: Column, known: list[str]) -> Column:
    """Whether a company key is one of the known ones or, from five letters, continues one after a space."""
    longer = [F.startswith(key, F.lit(f"{k} ")) for k in known if len(k) >= 5]
    out = key.isin(*known)
    for c in longer:
        out = out | c
    return F.coalesce(out & (key != ""), F.lit(False))


SEPARATORS = [" | ", " - ", " – ", " — ", " at ", " @ ", " :: "]


def split_title(raw: Column, host: Column) -> Column:
    """struct(company, role) of a page title at its first known separator: the company is the side that
    holds the host's name, else the shorter one (the first on equal lengths).  Without one: the role alone."""
    parts = F.split(host, r"\.")
    core = F.lower(F.coalesce(F.get(parts, F.size(parts) - 2), host))
    out = F.struct(F.lit(None).cast("string").alias("company"), F.nullif(raw, F.lit("")).alias("role"))
    for sep in reversed(SEPARATORS):
        at = F.instr(raw, sep)
        a, b = F.trim(F.substring(raw, F.lit(1), at - 1)), F.trim(F.substring(raw, at + len(sep), F.length(raw)))
        in_a, in_b = ((core != "") & F.contains(F.lower(x), core) for x in (a, b))
        first = F.coalesce(in_a, F.lit(False)) | (~F.coalesce(in_b, F.lit(False)) & (F.length(b) >= F.length(a)))
        pair = F.struct(F.when(first, a).otherwise(b).alias("company"), F.when(first, b).otherwise(a).alias("role"))
        out = F.when(at > 0, pair).otherwise(out)
    return out
