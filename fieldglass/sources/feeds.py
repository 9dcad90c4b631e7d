"""Posting feeds: one declaration a layout, read by one job; and pipe tables in text."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROW = ("source_job_id", "title", "apply_url", "locations", "department", "employment_type", "posted_at", "description", "pay_min", "pay_max", "pay_interval")


@dataclass(frozen=True)
class Feed:
    """schema: DDL of the payload.  items: SQL over `body` giving the array of items.  columns: SQL over
    `item` (and `body`) of the columns of ROW that the feed has.  keep: SQL of the items that count.
    must: the key that a payload has to have; empty where the payload is the list itself."""

    schema: str
    items: str
    columns: dict[str, str]
    must: str = ""
    keep: str = "true"
    #: SQL over body: whether all items are there, so that absent ones may be delisted
    complete: str = "true"
    types: dict[str, str] = field(default_factory=lambda: {"locations": "array<string>", "posted_at": "timestamp", "pay_min": "double", "pay_max": "double"})


# Country codes of feeds that give no names.
COUNTRY_NAMES = {
    "us": "United States", "gb": "United Kingdom", "ca": "Canada", "in": "India", "de": "Germany", "sg": "Singapore", "ie": "Ireland", "pl": "Poland", "au": "Australia", "fr": "France", "nl": "Netherlands", "es": "Spain", "br": "Brazil", "mx": "Mexico", "jp": "Japan", "il": "Israel",
    "ae": "United Arab Emirates", "ch": "Switzerland", "se": "Sweden", "it": "Italy", "pt": "Portugal", "cz": "Czech Republic", "ro": "Romania", "hu": "Hungary", "be": "Belgium", "dk": "Denmark", "no": "Norway", "fi": "Finland", "at": "Austria",
}
COUNTRIES = "map(" + ", ".join(f"'{code}', '{name}'" for code, name in COUNTRY_NAMES.items()) + ")"
# The published layouts of posting feeds.
FEEDS = {
    "offices_and_departments": Feed(
        "struct<jobs: array<struct<id: bigint, title: string, absolute_url: string, updated_at: string, content: string, location: struct<name: string>, offices: array<struct<name: string>>, departments: array<struct<name: string>>>>>",
        "body.jobs",
        {
            "source_job_id": "item.id",
            "title": "item.title",
            "apply_url": "item.absolute_url",
            "locations": "array_distinct(array_compact(concat(array(item.location.name), coalesce(item.offices.name, array()))))",
            "department": "get(item.departments.name, 0)",
            "posted_at": "try_to_timestamp(item.updated_at)",
            "description": "item.content",
        },
        must="jobs",
    ),
    "paged": Feed(
        "struct<pages: array<struct<total: bigint, jobPostings: array<struct<title: string, externalPath: string, locationsText: string, postedOn: string>>>>>",
        "flatten(transform(body.pages, p -> coalesce(p.jobPostings, array())))",
        {"source_job_id": "regexp_extract(item.externalPath, '_([^_/]+)$', 1)", "title": "item.title", "apply_url": "item.externalPath", "locations": "array(item.locationsText)"},
        must="pages",
        complete="size(flatten(transform(body.pages, p -> coalesce(p.jobPostings, array())))) >= coalesce(array_max(body.pages.total), 0)",
    ),
    "two_levels": Feed(
        "struct<items: array<struct<requisitionList: array<struct<Id: string, Title: string, PostedDate: string, PrimaryLocation: string, ShortDescriptionStr: string, secondaryLocations: array<struct<Name: string>>>>>>>",
        "flatten(transform(body.items, i -> coalesce(i.requisitionList, array())))",
        {
            "source_job_id": "item.Id",
            "title": "item.Title",
            "locations": "array_compact(concat(array(item.PrimaryLocation), coalesce(item.secondaryLocations.Name, array())))",
            "posted_at": "try_to_timestamp(item.PostedDate)",
            "description": "item.ShortDescriptionStr",
        },
        must="items",
    ),
    "bare_list": Feed(
        "array<struct<id: string, text: string, hostedUrl: string, createdAt: bigint, descriptionPlain: string, categories: struct<location: string, team: string, commitment: string>, lists: array<struct<text: string, content: string>>, salaryRange: struct<min: double, max: double, interval: string>>>",
        "body",
        {
            "source_job_id": "item.id",
            "title": "item.text",
            "apply_url": "item.hostedUrl",
            "locations": "array(item.categories.location)",
            "department": "item.categories.team",
            "employment_type": "item.categories.commitment",
            "posted_at": "timestamp_millis(item.createdAt)",
            "description": "array_join(concat(array(item.descriptionPlain), flatten(transform(coalesce(item.lists, array()), l -> array(l.text, l.content)))), '\n')",
            "pay_min": "item.salaryRange.min",
            "pay_max": "item.salaryRange.max",
            "pay_interval": "CASE WHEN item.salaryRange.interval LIKE '%hour%' THEN 'hour' WHEN item.salaryRange.interval LIKE '%month%' THEN 'month' WHEN item.salaryRange IS NOT NULL THEN 'year' END",
        },
    ),
    "pay_tiers": Feed(
        "struct<jobs: array<struct<id: string, title: string, jobUrl: string, isListed: boolean, department: string, location: string, publishedAt: string, descriptionPlain: string, compensation: struct<compensationTiers: array<struct<components: array<struct<compensationType: string, interval: string, minValue: double, maxValue: double>>>>>>>>",
        "transform(body.jobs, j -> named_struct('job', j, 'pay', array_max(transform(filter(flatten(transform(coalesce(j.compensation.compensationTiers, array()), t -> coalesce(t.components, array()))), c -> c.compensationType = 'Salary' AND c.maxValue IS NOT NULL), c -> named_struct('most', c.maxValue, 'least', c.minValue, 'every', c.interval)))))",
        {
            "source_job_id": "item.job.id",
            "title": "item.job.title",
            "apply_url": "item.job.jobUrl",
            "locations": "array(item.job.location)",
            "department": "item.job.department",
            "posted_at": "try_to_timestamp(item.job.publishedAt)",
            "description": "item.job.descriptionPlain",
            "pay_min": "item.pay.least",
            "pay_max": "item.pay.most",
            "pay_interval": "CASE WHEN upper(item.pay.every) LIKE '%HOUR%' THEN 'hour' WHEN upper(item.pay.every) LIKE '%MONTH%' THEN 'month' WHEN item.pay IS NOT NULL THEN 'year' END",
        },
        must="jobs",
        keep="coalesce(item.job.isListed, true)",
    ),
    "status_filtered": Feed(
        "struct<offers: array<struct<id: bigint, title: string, careers_url: string, status: string, city: string, country: string, department: string, description: string>>>",
        "body.offers",
        {"source_job_id": "item.id", "title": "item.title", "apply_url": "item.careers_url", "locations": "array(concat_ws(', ', item.city, item.country))", "department": "item.department", "description": "item.description"},
        must="offers",
        keep="coalesce(item.status, 'published') = 'published'",
    ),
    "coded_countries": Feed(
        "struct<content: array<struct<id: string, name: string, ref: string, releasedDate: string, location: struct<city: string, region: string, country: string, remote: boolean>, department: struct<label: string>, typeOfEmployment: struct<label: string>>>>",
        "body.content",
        {
            "source_job_id": "item.id",
            "title": "item.name",
            "apply_url": "item.ref",
            "locations": f"array(concat(CASE WHEN item.location.remote THEN 'Remote - ' ELSE '' END, concat_ws(', ', item.location.city, item.location.region, coalesce(element_at({COUNTRIES}, lower(item.location.country)), upper(item.location.country)))))",
            "department": "item.department.label",
            "employment_type": "item.typeOfEmployment.label",
            "posted_at": "try_to_timestamp(item.releasedDate)",
        },
        must="content",
    ),
    "widget": Feed(
        "struct<jobs: array<struct<shortcode: string, title: string, url: string, city: string, state: string, country: string, department: string, employment_type: string, published_on: string, description: string>>>",
        "body.jobs",
        {"source_job_id": "item.shortcode", "title": "item.title", "apply_url": "item.url", "locations": "array(concat_ws(', ', item.city, item.state, item.country))", "department": "item.department", "employment_type": "item.employment_type", "posted_at": "try_to_timestamp(item.published_on)", "description": "item.description"},
        must="jobs",
    ),
    "aggregated": Feed(
        "array<struct<id: string, company_name: string, title: string, url: string, active: boolean, is_visible: boolean, date_posted: bigint, locations: array<string>, degrees: array<string>>>",
        "body",
        {"source_job_id": "item.id", "title": "item.title", "apply_url": "item.url", "locations": "item.locations", "posted_at": "timestamp_seconds(item.date_posted)", "department": "item.company_name"},
        keep="coalesce(item.active, true) AND coalesce(item.is_visible, true)",
    ),
}


def read_feed(payloads: DataFrame, content: str, feed: Feed) -> tuple[DataFrame, DataFrame]:
    """(rows with the columns of ROW and complete beside those of payloads, quarantine with reason).

    A payload that is no JSON, or lacks the key of the list, is quarantined; a null list is an empty
    one.  Items without an id or a title are dropped; of equal ids in a payload the first counts, and
    equal payload rows count once.
    """
    keys = F.json_object_keys(content)
    shape = F.json_array_length(content) if not feed.must else F.when(F.array_contains(keys, feed.must), 1)
    known = F.json_array_length(content).isNotNull() | keys.isNotNull()
    reason = F.when(~F.coalesce(known, F.lit(False)), "not JSON").when(shape.isNull(), f"no {feed.must or 'list'}")
    parsed = payloads.withColumn("reason", reason)
    fine = parsed.where("reason IS NULL").drop("reason").withColumn("body", F.from_json(content, feed.schema)).withColumn("complete", F.expr(feed.complete))
    own = [c for c in payloads.columns if c != content]
    fine = fine.withColumn("payload", F.sha2(F.col(content), 256))
    items = fine.select(*own, "payload", "body", "complete", F.posexplode(F.filter(F.expr(feed.items), lambda x: x.isNotNull())).alias("pos", "item")).where(feed.keep)
    columns = [F.expr(feed.columns.get(c, "null")).cast(feed.types.get(c, "string")).alias(c) for c in ROW]
    rows = items.select(*own, "payload", "pos", "complete", *columns).where("source_job_id IS NOT NULL AND title IS NOT NULL")
    rest = [c for c in ("complete", *ROW) if c != "source_job_id"]
    first = rows.groupBy(*own, "payload", "source_job_id").agg(F.min_by(F.struct(*rest), "pos").alias("row"))
    return first.select(*own, "row.complete", *(c if c == "source_job_id" else f"row.{c}" for c in ROW)), parsed.where("reason IS NOT NULL")


# Marks of closed postings and of the company of the line before.
CLOSED, SAME_AS_ABOVE = "🔒|(?i)\\bclosed\\b", ("↳", "", "—")
LINK = r"\]\((https?://[^)\s]+)\)|href=\"(https?://[^\"\s]+)\""


def cell_text(cell: Column) -> Column:
    """A table cell without tags, link targets and emphasis."""
    shown = F.regexp_replace(F.regexp_replace(cell, r"!?\[([^\]]*)\]\([^)]*\)", "$1"), "<[^>]*>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(shown, r"[*`]", ""), r"\s+", " "))


def pipe_table(texts: DataFrame, key: str, text: str, trackers: str = "tracker") -> DataFrame:
    """Rows (key, pos, company, title, location, url) of the pipe tables in texts.

    A line naming a company and a role is the header of those that follow; a company cell that says
    "same as above" takes the company before it; closed rows go.  The link is that of the link
    cell, else of the role cell, those of trackers last.
    """
    lines = texts.select(key, F.posexplode(F.split(text, "\n")).alias("pos", "line")).where(F.startswith("line", F.lit("|")))
    cells = F.transform(F.split(F.regexp_replace(F.trim("line"), r"^\|+|\|+$", ""), r"\|"), F.trim)
    rows = lines.select(key, "pos", cells.alias("cells")).where("size(cells) >= 3")
    low = F.transform("cells", F.lower)
    is_header = F.exists(low, lambda c: F.contains(c, F.lit("company"))) & F.exists(low, lambda c: F.rlike(c, F.lit("role|title|position")))
    in_order = Window.partitionBy(key).orderBy("pos")
    rows = rows.withColumn("is_header", is_header).withColumn("header", F.last(F.when(is_header, low), ignorenulls=True).over(in_order))
    rows = rows.where(~F.col("is_header") & F.col("header").isNotNull() & ~F.rlike(F.col("cells")[0], F.lit(r"^[-:\s]+$")))
    at = lambda what: F.get("cells", F.nullif(F.array_position(F.transform("header", lambda c: F.rlike(c, F.lit(what))), True), F.lit(0).cast("bigint")).cast("int") - 1)
    rows = rows.select(key, "pos", at("company").alias("named"), at("role|title|position").alias("role"), at("location").alias("place"), F.coalesce(at("apply|link|application"), F.lit("")).alias("link"))
    company = cell_text(F.col("named"))
    rows = rows.withColumn("company", F.last(F.when(~company.isin(*SAME_AS_ABOVE), company), ignorenulls=True).over(in_order))
    links = lambda c: F.filter(F.transform(F.regexp_extract_all(c, F.lit(LINK), 0), lambda x: F.regexp_extract(x, "(https?://[^)\\s\"]+)", 1)), lambda u: u != "")
    found = F.when(F.size(links(F.col("link"))) > 0, links(F.col("link"))).otherwise(links(F.col("role")))
    direct = F.filter(found, lambda u: ~F.contains(u, F.lit(trackers)))
    rows = rows.where(~F.rlike("link", F.lit(CLOSED)) & ~F.rlike("role", F.lit(CLOSED)))
    rows = rows.select(key, "pos", "company", cell_text(F.col("role")).alias("title"), cell_text(F.col("place")).alias("location"), F.coalesce(F.get(direct, F.lit(0)), F.get(found, F.lit(0))).alias("url"))
    return rows.where("url IS NOT NULL AND title <> '' AND company IS NOT NULL")
