"""What a posting's URL says: vendor and id, provider, and whether a visited link is still open."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tracking parameters, and where vendors put the ids of postings.
TRACKING = ["utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "utm", "ref", "source", "src", "gh_src", "lever-source", "lever-source[]", "gh_jid_src", "oga", "spread", "_gl", "fbclid", "gclid", "trk", "trackingid", "refid"]
UUID = "[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"
#: host ending, pattern of the id in the path, name, whether the first label of the host belongs to it
VENDORS = [
    ("greenhouse.io", r"/jobs/(\d+)", "greenhouse", False),
    ("lever.co", f"/({UUID})", "lever", False),
    ("ashbyhq.com", f"/({UUID})", "ashby", False),
    ("myworkdayjobs.com", r"_([A-Za-z]{0,4}-?\d[\w-]*)$", "workday", True),
    ("workable.com", r"(?i)/j/([A-Z0-9]{8,12})", "workable", False),
    ("smartrecruiters.com", r"/(\d{9,})", "smartrecruiters", False),
    ("oraclecloud.com", r"/job/(\d+)", "oracle", True),
    ("recruitee.com", r"/o/([a-z0-9-]+)", "recruitee", True),
    ("icims.com", r"/jobs/(\d+)", "icims", True),
]
GENERIC_PATH = r"(?i)^/?(?:$|careers?/?$|jobs?/?$|search/?$|openings?/?$|positions?/?$|en(?:-us)?/?$|home/?$|job-search/?$|all-jobs/?$|opportunities/?$)"
NOT_FOUND = (
    r"(?i)(job (?:you(?:'re| are) looking for|posting)? ?(?:is )?(?:no longer|not) (?:available|accepting|active|found|open)|"
    r"this (?:job|position|role|posting|opportunity) (?:has been|is) (?:filled|closed|removed|expired|no longer)|"
    r"no longer accepting applications|position has been filled|posting has expired|job not found|page not found|"
    r"we couldn'?t find (?:that|the) (?:job|page)|this job is no longer|sorry,? this (?:job|position))"
)


def parts(url: Column) -> tuple[Column, Column, Column]:
    """(host without www, path without slashes at its end, query), each empty where there is none."""
    get = lambda what: F.coalesce(F.try_parse_url(F.trim(url), F.lit(what)), F.lit(""))
    return F.regexp_replace(F.lower(get("HOST")), r"^www\.", ""), F.regexp_replace(get("PATH"), "/+$", ""), get("QUERY")


def _found(text: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def url_key(url: Column) -> Column:
    """vendor:id where the vendor's id is in the URL; site:host:id where a path segment (the last) or a
    query value (the first) has five digits; else scheme, host, path and the other parameters in order.
    Null for null and empty URLs."""
    host, path, query = parts(url)
    pairs = F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.lower(F.split(p, "=")[0]).isin(TRACKING) & ~F.startswith(F.lower(p), F.lit("utm_")))
    keys = [F.concat(F.lit("greenhouse:"), _found(query, r"(?:^|&)gh_jid=(\d+)"))]
    for end, pattern, name, tenant in VENDORS:
        found = _found(path, pattern)
        found = F.upper(found) if name == "workable" else found
        label = F.concat_ws(":", F.lit(name), *([F.split(host, r"\.")[0]] if tenant else []), found)
        here = F.endswith(host, F.lit(end)) | (F.contains(path, F.lit("/o/")) if name == "recruitee" else F.lit(False))
        keys.append(F.when(here & found.isNotNull(), label))
    numbered = F.filter(F.split(path, "/"), lambda s: F.rlike(s, F.lit(r"\d{5,}")))
    segment = F.get(numbered, F.size(numbered) - 1)
    value = F.get(F.filter(F.transform(pairs, lambda p: F.regexp_extract(p, "=(.*)$", 1)), lambda v: F.rlike(v, F.lit(r"^\d{5,}$"))), F.lit(0))
    keys.append(F.concat_ws(":", F.lit("site"), host, F.coalesce(segment, value)))
    keys[-1] = F.when(F.coalesce(segment, value).isNotNull(), keys[-1])
    scheme = F.lower(F.coalesce(F.nullif(F.try_parse_url(F.trim(url), F.lit("PROTOCOL")), F.lit("")), F.lit("https")))
    rest = F.concat(scheme, F.lit("://"), host, path, F.when(F.size(pairs) > 0, F.concat(F.lit("?"), F.array_join(F.array_sort(pairs), "&"))).otherwise(""))
    return F.when(F.trim(url) != "", F.coalesce(*keys, rest))


def provider(url: Column) -> Column:
    """struct(provider, slug) of a vendor's board, from host and path; null for other sites."""
    host, path, _ = parts(url)
    first = F.nullif(F.get(F.split(path, "/"), F.lit(1)), F.lit(""))
    tenant = F.split(host, r"\.")[0]
    out = F.lit(None).cast("struct<provider: string, slug: string>")
    for end, _, name, by_host in reversed(VENDORS):
        slug = tenant if by_host else first
        out = F.when(F.endswith(host, F.lit(end)) & slug.isNotNull(), F.struct(F.lit(name).alias("provider"), slug.alias("slug"))).otherwise(out)
    return out


def own_ids(job_id: Column, url: Column) -> Column:
    """What a page that is still open should name: the job's id, and the digits at the end of its URL."""
    tail = _found(F.coalesce(url, F.lit("")), r"(\d{5,})(?:[/?#]|$)")
    return F.array_distinct(F.array_compact(F.array(job_id.cast("string"), tail)))


def link_verdict(status: Column, url: Column, final: Column, body: Column, ids: Column, hops: Column) -> Column:
    """struct(status, reason) of a visited link.  ids: strings that an open posting should name; hops:
    redirects followed; status null: the visit failed."""
    path = lambda u: F.regexp_replace(F.coalesce(F.try_parse_url(u, F.lit("PATH")), F.lit("")), "/+$", "")
    moved = (hops > 0) & (path(final) != path(url))
    body = F.coalesce(body, F.lit(""))
    in_url = F.exists(ids, lambda i: (i != "") & F.contains(final, i))
    in_body = F.exists(ids, lambda i: (F.length(i) >= 4) & F.contains(body, i))
    generic = F.rlike(F.coalesce(F.nullif(F.try_parse_url(final, F.lit("PATH")), F.lit("")), F.lit("/")), F.lit(GENERIC_PATH))
    said = lambda s, why: F.struct(F.lit(s).alias("status"), F.lit(why).alias("reason"))
    return (
        F.when(status.isNull(), said("unverified", "no answer"))
        .when(status.isin(404, 410), said("dead", "gone"))
        .when(status >= 400, said("unverified", "refused"))
        .when(moved & generic & ~in_url, said("dead", "redirected to a general page"))
        .when(F.rlike(body, F.lit(NOT_FOUND)) & ~in_body, said("dead", "the page says so"))
        .when((in_url | in_body) & moved, said("redirected", "names the posting after a redirect"))
        .when(in_url | in_body, said("live", "names the posting"))
        .when(moved, said("dead", "redirected and does not name the posting"))
        .otherwise(said("unverified", "does not name the posting"))
    )
