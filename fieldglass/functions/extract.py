"""Facts stated in prose, as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

# How years of experience are stated.
YEARS_RANGE = r"(?i)(\d{1,2})\s*\+?\s*(?:-|–|to)?\s*(\d{1,2})?\s*\+?\s*(?:years|yrs)(?:'|’)?\s+(?:of\s+)?(?:relevant |professional |industry |related |hands[- ]on |work |software |full[- ]time |practical |prior |demonstrated |proven |overall )*(?:experience|exp\b)"
YEARS_MINIMUM = r"(?i)(?:minimum(?:\s+of)?|at\s+least|min\.?)\s+(\d{1,2})\s*\+?\s*(?:years|yrs)|(\d{1,2})\s+or\s+more\s+(?:years|yrs)"
YEARS_NEUTRAL = r"(?i)including\s+internship|internship(?:s)?\s+(?:experience\s+)?(?:count|counts|qualify|qualifies|included)|no\s+(?:prior\s+|previous\s+)?(?:work\s+|professional\s+)?experience\s+(?:required|necessary|needed)|new\s?[- ]?grad(?:uate)?s?\s+(?:are\s+)?(?:welcome|encouraged)|recent\s+graduates?\s+(?:are\s+)?(?:welcome|encouraged|eligible)"
MOST_YEARS, WAIVED_YEARS = 15, 3
# Numbers of years as they stand, whatever they are of: "3-5 years", "4+ years", "at least 6 years".  No space but
# these five characters, and possessive, so that a long run of digits is passed over once.
WRITTEN_YEARS = (r"(?iu)(?<!\d)(\d++)[ \t\n\f\r]*+-[ \t\n\f\r]*+\d++ years", r"(?iu)(?<!\d)(\d++)\+ years", r"(?iu)at least (\d++) years")


def least_written_years(text: Column) -> Column:
    """The smallest number of WRITTEN_YEARS up to MOST_YEARS, in whole numbers: 99+ after another number is 99 and
    nothing else; null where there is none."""
    said = F.concat(*(F.regexp_extract_all(text, F.lit(p), 1) for p in WRITTEN_YEARS))
    return F.array_min(F.filter(F.transform(said, lambda s: s.cast("double")), lambda y: y <= MOST_YEARS))


def least_years(text: Column) -> Column:
    """The smallest stated minimum of years up to MOST_YEARS; 0 where a phrase lets beginners in and
    the minimum is at most WAIVED_YEARS or none is stated; null where nothing is said."""
    groups = [(YEARS_RANGE, 1), (YEARS_MINIMUM, 1), (YEARS_MINIMUM, 2)]
    said = F.concat(*(F.regexp_extract_all(text, F.lit(p), g) for p, g in groups))
    years = F.array_min(F.filter(F.transform(said, lambda s: F.when(s != "", s.cast("double"))), lambda y: y <= MOST_YEARS))
    waived = F.rlike(text, F.lit(YEARS_NEUTRAL))
    return F.when(waived & F.coalesce(years <= WAIVED_YEARS, F.lit(True)), F.lit(0.0)).otherwise(years)


def days_ago(text: Column, today: Column) -> Column:
    """The date of "today", "yesterday", "3 days ago", "30+ days ago", "5h" or "2w"; null for others."""
    n = lambda unit: F.expr("null").cast("int") if unit is None else F.nullif(F.regexp_extract(text, rf"(?i)\b(\d+)\+?\s*{unit}\b", 1), F.lit("")).cast("int")
    back = F.coalesce(F.when(F.rlike(text, F.lit(r"(?i)\b(today|just posted)\b")), 0), F.when(F.rlike(text, F.lit(r"(?i)\byesterday\b")), 1), n("(?:d|days?)"), n("(?:w|weeks?)") * 7, F.when(n("(?:h|hours?|m|minutes?)").isNotNull(), 0))
    return F.date_sub(today, back)


# How pay ranges are written, and the words around them that matter.
PAY_NUMBER = r"\$?\s?(\d{2,3}(?:,\d{3})+|\d{2,3}(?:\.\d+)?\s?[kK]|\d{5,6}|\d{2,3}(?:\.\d{1,2})?)"
PAY_RANGE = "(?i)" + PAY_NUMBER + r"\s*(?:-|–|—|to|and|through)\s*" + PAY_NUMBER + r"(?!\s*(?:%|percent))"
PAY_HOURLY = r"(?i)(?:per\s+hour|/\s*hour|/hr|hourly|an hour)"
PAY_YEARLY = r"(?i)(?:per\s+(?:year|annum)|/\s*(?:year|yr)|annual|annually|base salary|salary range|pay range|compensation range|base pay)"
PAY_OTHER = r"(?i)(?:bonus|equity|stock|rsu|sign[- ]?on|relocation|total (?:target )?comp)"
PAY_FOREIGN = r"(?i)(?:€|£|CAD|C\$|A\$|INR|₹|GBP|EUR|SGD|CHF)"


def amount(text: Column) -> Column:
    """The number in "$150,000", "62.5k" or "32.19"; null for others."""
    bare = F.lower(F.regexp_replace(text, r"[$,\s]", ""))
    return F.when(F.endswith(bare, F.lit("k")), F.rtrim(bare, F.lit("k")).try_cast("double") * 1000).otherwise(bare.try_cast("double"))


def posted_pay(text: Column) -> Column:
    """The most credible pay range of a text as struct(low, high, interval, confidence), or null.

    Every range is judged with the 160 characters before it and 80 after.  Among equals a yearly
    range goes before an hourly one, then the earlier.  All of it is array expressions: the places
    of the ranges follow from the lengths of the texts between them.
    """
    found, gaps = F.regexp_extract_all(text, F.lit(PAY_RANGE), 0), F.split(text, PAY_RANGE)
    low, high = (F.regexp_extract_all(text, F.lit(PAY_RANGE), k) for k in (1, 2))
    places = F.aggregate(
        F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda g, m: F.struct(F.length(g).alias("gap"), F.length(m).alias("size"))),
        F.struct(F.lit(0).alias("end"), F.array().cast("array<int>").alias("begins")),
        lambda acc, x: F.struct((acc["end"] + x["gap"] + x["size"]).alias("end"), F.concat(acc["begins"], F.array(acc["end"] + x["gap"])).alias("begins")),
        lambda acc: acc["begins"],
    )
    ranges = F.arrays_zip(found.alias("said"), low.alias("lo"), high.alias("hi"), places.alias("at"))

    def around(r):
        near = F.substring(text, F.greatest(r["at"] - 159, F.lit(1)), F.least(r["at"], F.lit(160)) + F.length(r["said"]) + 80)
        shortly = F.substring(text, F.greatest(r["at"] - 59, F.lit(1)), F.least(r["at"], F.lit(60)))
        return F.struct(r.alias("r"), near.alias("around"), shortly.alias("shortly"), amount(r["lo"]).alias("lo"), amount(r["hi"]).alias("hi"))

    def judged(x):
        r, around, shortly, lo, hi = (x[n] for n in ("r", "around", "shortly", "lo", "hi"))
        dollars, hourly, yearly = F.contains(r["said"], F.lit("$")), F.rlike(around, F.lit(PAY_HOURLY)), F.rlike(around, F.lit(PAY_YEARLY))
        foreign = F.rlike(around, F.lit(PAY_FOREIGN)) & ~dollars & ~F.contains(around, F.lit("USD"))
        by_hour = hourly & (lo < 500)
        sane = (lo <= hi) & F.when(by_hour, (lo >= 7) & (hi <= 400)).otherwise((lo >= 20_000) & (hi <= 1_500_000))
        other = F.rlike(shortly, F.lit(PAY_OTHER)) & ~yearly
        points = 55 + F.when(yearly | hourly, 25).otherwise(0) + F.when(dollars, 10).otherwise(0) - F.when(other, 25).otherwise(0)
        return F.struct((~foreign & sane).alias("ok"), points.alias("points"), F.when(by_hour, 0).otherwise(1).alias("yearly"), (-r["at"]).alias("first"), lo.alias("low"), hi.alias("high"))

    fit = F.filter(F.transform(ranges, lambda r: let(around(r), judged)), lambda c: c["ok"] & (c["points"] >= 50))
    def said(best):
        return F.when(best.isNotNull(), F.struct(best["low"].alias("low"), best["high"].alias("high"), F.when(best["yearly"] == 1, "year").otherwise("hour").alias("interval"), (best["points"] / 100).alias("confidence")))

    return let(F.array_max(fit), said)


# Titles that are not for beginners, and titles that are.
SENIOR_WORDS = r"(?i)\b(senior|staff|principal|lead|sr\.?|manager|director|architect|vp|vice president|head of|distinguished|fellow)\b"
SENIOR_ROMAN = r"\b(II|III|IV|V|VI)\b"
SENIOR_LEVEL = r"(?i)\b(?:L|IC|E|P|T)[2-9]\b|\b(?:level|lvl)\s*[2-9]\b|(?:engineer|developer|swe|sde|analyst|scientist|consultant)\s+[2-9]\b"
BEGINNER_TITLE = r"(?i)new\s?[- ]?grad|entry[- ]level|university|campus|early\s+career|graduate\b|recent\s+graduate|junior\b|\bjr\.?\b"


def senior_mark(title: Column) -> Column:
    """What makes a title senior: a word, a roman numeral in capitals from II, or a level from 2; else null."""
    marks = [F.nullif(F.regexp_extract(title, p, k), F.lit("")) for p, k in ((SENIOR_WORDS, 1), (SENIOR_ROMAN, 1), (SENIOR_LEVEL, 0))]
    return F.trim(F.coalesce(*marks))


def for_beginners(title: Column) -> Column:
    return F.coalesce(F.rlike(title, F.lit(BEGINNER_TITLE)), F.lit(False))
