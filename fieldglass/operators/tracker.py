"""Applications: who is a company, what is a duplicate, actions and stages, and what is read from them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import chain

# Stages in order, and which of them end an application or are an answer to it.
STAGES = ("applied", "oa_pending", "oa_done", "screen", "onsite", "offer", "rejected", "ghosted", "withdrawn")
TERMINAL = ("offer", "rejected", "ghosted", "withdrawn")
RESPONSES = ("oa_pending", "oa_done", "screen", "onsite", "offer", "rejected")
GHOSTED_DAYS = 30
#: What each action does: the status it sets (null: none) and the columns it changes.
ACTION_STATUS = {"dismiss": "dismissed", "shortlist": "shortlisted", "unshortlist": "new", "snooze": "snoozed", "unsnooze": "new", "applied": "applied"}
REASONS = ("already applied to this exact posting", "already applied to the same role via another source (same cluster)", "already applied to an earlier posting of this same req (repost)", "an application with this exact URL already exists")


def matched_names(names: DataFrame, key: str, registry: DataFrame, known: str, order: str, value: str) -> DataFrame:
    """(key, value): the registry's value for a normalised name: by the whole name, else by the first
    registry row in order whose name, of four letters at least, begins or ends it on a word boundary.
    Every beginning and end of a name is looked up by equality, so no name meets the whole registry."""
    tokens = F.split(key, " ")
    some = F.transform(F.sequence(F.lit(1), F.size(tokens)), lambda n: F.array_join(F.slice(tokens, F.lit(1), n), " "))
    ends = F.transform(F.sequence(F.lit(1), F.size(tokens)), lambda n: F.array_join(F.slice(tokens, n, F.size(tokens)), " "))
    tried = names.select(key).distinct().where(F.length(key) > 0).withColumn("_try", F.explode(F.array_distinct(F.concat(some, ends))))
    one = registry.where(F.length(known) > 0).groupBy(F.col(known).alias("_try")).agg(F.min(F.struct(F.col(order).alias("o"), F.col(value).alias("v"))).alias("_r"))
    hits = tried.join(one, "_try").where((F.col("_try") == F.col(key)) | (F.length("_try") >= 4))
    best = F.min(F.struct((F.col("_try") != F.col(key)).alias("partly"), "_r.o", "_r.v"))
    return hits.groupBy(key).agg(best.alias("b")).select(key, F.col("b.v").alias(value))


def duplicates(postings: DataFrame, applications: DataFrame, posting_id: str, cluster: str, repost_of: str, url: str, application_id: str, applied_to: str, applied_url: str) -> DataFrame:
    """(posting_id, application_id, reason): the applications that make a new one to a posting a duplicate,
    by the first of four checks that finds any.  Earlier postings of the same job are followed for 20 steps,
    later ones for one."""
    p = postings.select(F.col(posting_id).alias("p"), F.col(cluster).alias("c"), F.col(repost_of).alias("r"), F.col(url).alias("u"))
    a = applications.select(F.col(application_id).alias("a"), F.col(applied_to).alias("to"), F.col(applied_url).alias("au"))
    direct = p.join(a, F.col("p") == F.col("to")).select("p", "a", F.lit(0).alias("check"))
    by_cluster = a.join(p.select(F.col("p").alias("s"), "c"), F.col("to") == F.col("s")).where("c IS NOT NULL").select("a", "s", F.col("c").alias("sc"))
    sibling = p.join(by_cluster, (F.col("c") == F.col("sc")) & (F.col("p") != F.col("s"))).select("p", "a", F.lit(1).alias("check"))
    earlier = chain(p.where("r IS NOT NULL"), "p", "r").select("p", F.col("ancestor").alias("e"))
    later = p.where("r IS NOT NULL").select(F.col("r").alias("p"), F.col("p").alias("e"))
    repost = earlier.unionByName(later).distinct().join(a, F.col("e") == F.col("to")).select("p", "a", F.lit(2).alias("check"))
    same = p.join(a, F.col("u") == F.col("au")).select("p", "a", F.lit(3).alias("check"))
    found = reduce(DataFrame.unionByName, [direct, sibling, repost, same]).distinct()
    best = found.groupBy("p").agg(F.min("check").alias("check"))
    reason = F.array(*map(F.lit, REASONS))[F.col("check")]
    return found.join(best, ["p", "check"]).select(F.col("p").alias(posting_id), F.col("a").alias(application_id), reason.alias("reason"))


def siblings(postings: DataFrame, posting_id: str, cluster: str, asked: DataFrame | None = None) -> DataFrame:
    """(posting_id, siblings): the other members of a posting's cluster, ascending, by one array a cluster.
    asked (posting_id): only for these, and no other cluster is gathered; for all postings the result
    has as many values as the squares of the clusters' sizes."""
    own = postings if asked is None else postings.join(asked.select(posting_id).distinct(), posting_id, "left_semi")
    members = postings.where(F.col(cluster).isNotNull())
    members = members if asked is None else members.join(own.select(cluster).distinct(), cluster, "left_semi")
    groups = members.groupBy(cluster).agg(F.array_sort(F.collect_set(posting_id)).alias("_all"))
    others = F.filter("_all", lambda x: x != F.col(posting_id))
    return own.join(groups, cluster, "left").select(posting_id, F.coalesce(others, F.array().cast(groups.schema["_all"].dataType)).alias("siblings"))


def state_of_actions(log: DataFrame, key: str, at: str, order: str) -> DataFrame:
    """The state that a log of actions (action, reason, until, text) leaves: one row a key, each column by the
    last action that sets it.  Partial aggregates over the log; nothing is rewritten."""
    newest = lambda actions, value: F.max_by(value, F.when(F.col("action").isin(*actions), F.struct(at, order)))
    status = F.create_map(*(F.lit(x) for kv in ACTION_STATUS.items() for x in kv))[F.col("action")]
    return log.groupBy(key).agg(
        F.coalesce(newest(ACTION_STATUS, status), F.lit("new")).alias("status"),
        newest(ACTION_STATUS, F.when(F.col("action") == "dismiss", F.coalesce("reason", F.lit("no reason given")))).alias("dismiss_reason"),
        newest(("snooze", "unsnooze"), F.when(F.col("action") == "snooze", F.col("until"))).alias("snooze_until"),
        F.coalesce(newest(("shortlist", "unshortlist"), F.col("action") == "shortlist"), F.lit(False)).alias("starred"),
        (F.count_if(F.col("action") == "referral") > 0).alias("referral_secured"),
        (F.count_if(F.col("action") == "override_floor") > 0).alias("override_floor"),
        newest(("note",), F.col("text")).alias("notes"),
    )


def state_of_stages(events: DataFrame, key: str, at: str, order: str) -> DataFrame:
    """(key, stage, applied_at, first_response_at, completed, outcome) after all stage events."""
    last = F.max_by("stage", F.struct(at, order))
    out = events.groupBy(key).agg(last.alias("stage"), F.min(at).alias("applied_at"), F.min(F.when(F.col("stage").isin(*RESPONSES), F.col(at))).alias("first_response_at"))
    return out.withColumns({"completed": F.col("stage").isin(*TERMINAL) & (F.col("stage") != "offer"), "outcome": F.when(F.col("stage").isin(*TERMINAL), F.col("stage"))})


def suggestions(applications: DataFrame, as_of: Column) -> DataFrame:
    """Open applications with what to do: follow up where due, ghosted where unanswered for GHOSTED_DAYS."""
    waited = (F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(F.col("applied_at").cast("timestamp"))) / F.lit(86_400_000_000.0)
    follow = F.when(F.col("follow_up_due") <= as_of, "follow_up")
    ghosted = F.when((F.col("stage") == "applied") & F.col("first_response_at").isNull() & (waited >= GHOSTED_DAYS), "ghosted")
    return applications.where(~F.col("completed")).withColumn("suggestion", F.explode(F.array_compact(F.array(follow, ghosted))))


def funnel(applications: DataFrame) -> DataFrame:
    """One row: total, active, completed, responded and the response rate."""
    n, answered = F.count("*"), F.count_if(F.col("first_response_at").isNotNull())
    return applications.agg(n.alias("total"), F.count_if(~F.col("completed")).alias("active"), F.count_if("completed").alias("completed"), answered.alias("responded"), F.try_divide(answered.cast("double"), n.cast("double")).alias("response_rate"))


def newest_children(children: DataFrame, parent: str, order: list[Column], most: int, columns: list[str], out: str) -> DataFrame:
    """(parent, out): an array of the first most children of each parent, in order."""
    first = children.withColumn("_r", F.row_number().over(Window.partitionBy(parent).orderBy(*order))).where(F.col("_r") <= most)
    rows = F.array_sort(F.collect_list(F.struct("_r", *columns)))
    return first.groupBy(parent).agg(F.transform(rows, lambda r: F.struct(*(r[c].alias(c) for c in columns))).alias(out))


def upcoming(rows: DataFrame, at: str, as_of: Column, order: list[Column], most: int = 30) -> DataFrame:
    """The next rows on or after a day."""
    return rows.where(F.to_date(at) >= F.to_date(as_of)).orderBy(*order).limit(most)


def queue(rows: DataFrame, dead: Column, order: list[Column], limit: int, most_dead: int = 20) -> DataFrame:
    """The first rows of the queue and up to most_dead rows with dead links, told apart by kind."""
    alive = rows.where(~dead).orderBy(*order).limit(limit).withColumn("kind", F.lit("queue"))
    return alive.unionByName(rows.where(dead).orderBy(*order).limit(most_dead).withColumn("kind", F.lit("dead")))


def autofilled(asked: DataFrame, url: str, postings: DataFrame, posting_id: str, posting_url: str, job_id: str) -> DataFrame:
    """asked with the posting that an URL names and how sure that is: 1.0 by the URL itself, 0.9 by a number
    of six digits that is a posting's id; of several the least posting id."""
    a = asked.select(F.col(url).alias("_u")).where("_u IS NOT NULL").distinct()
    known = postings.select(F.col(posting_id).alias("_p"), F.col(posting_url).alias("_pu"), F.col(job_id).cast("string").alias("_j"))
    exact = a.join(known, F.col("_u") == F.col("_pu")).select("_u", "_p", F.lit(1.0).alias("confidence"))
    number = a.withColumn("_d", F.nullif(F.regexp_extract("_u", r"(\d{6,})", 1), F.lit("")))
    by_id = number.join(known, F.col("_d") == F.col("_j")).select("_u", "_p", F.lit(0.9).alias("confidence"))
    best = exact.unionByName(by_id).groupBy("_u").agg(F.min(F.struct((-F.col("confidence")).alias("c"), "_p")).alias("b"))
    return asked.join(best, asked[url] == F.col("_u"), "left").select(*(asked[c] for c in asked.columns), F.col("b._p").alias(posting_id), (-F.col("b.c")).alias("confidence"))


def imported(current: DataFrame, saved: DataFrame, key: list[str]) -> DataFrame:
    """current with the workflow columns (status, notes) of a saved export by natural key; applied is never
    taken back, and rows that the export does not name stay."""
    s = saved.select(*key, F.col("status").alias("_status"), F.col("notes").alias("_notes"), F.lit(True).alias("_in")).dropDuplicates(key)
    both = current.join(s, key, "left")
    takes = F.col("_in").isNotNull() & (F.coalesce(F.col("status"), F.lit("")) != "applied")
    return both.withColumns({"status": F.when(takes, F.coalesce("_status", "status")).otherwise(F.col("status")), "notes": F.coalesce("_notes", "notes")}).select(*current.columns)


#: What a person decided about a posting; an export has the natural key and those of these that the rows have.
WORKFLOW = {"status": "string", "status_changed_at": "timestamp", "dismiss_reason": "string", "starred": "boolean", "snooze_until": "timestamp", "tags_user": "array<string>", "notes": "string", "referral_secured": "boolean"}


def export_workflow(postings: DataFrame, key: list[str], folder: str) -> None:
    """The postings on which anything was decided (another status than new, a star, notes, tags, a snooze, a
    referral) as compressed JSON lines; an export written again replaces its folder."""
    have = [c for c in WORKFLOW if c in postings.columns]
    said = {"status": F.col("status") != "new", "starred": F.col("starred"), "notes": F.col("notes") != "", "tags_user": F.size("tags_user") > 0, "snooze_until": F.col("snooze_until").isNotNull(), "referral_secured": F.col("referral_secured")} if have else {}
    decided = F.lit(False)
    for c in have:
        if c in said:
            decided = decided | F.coalesce(said[c], F.lit(False))
    postings.where(decided).select(*key, *have).write.mode("overwrite").option("compression", "gzip").json(folder)


def import_workflow(postings: DataFrame, key: list[str], folder: str) -> DataFrame:
    """postings with the decisions of an export by natural key.  A posting that is applied to now takes only
    those of one that was, too; status_changed_at is kept where the export has none; all others that the
    export names take all that it says, and the rest stays.  Of an export's rows with one key one counts."""
    have = [c for c in WORKFLOW if c in postings.columns]
    kinds = dict(postings.dtypes)
    saved = postings.sparkSession.read.schema(", ".join(f"`{c}` {kinds[c]}" for c in [*key, *have])).json(folder)
    saved = saved.groupBy(*key).agg(F.min(F.struct(*have)).alias("_in"))
    both = postings.join(saved, key, "left")
    takes = F.col("_in").isNotNull() & ((F.coalesce("status", F.lit("")) != "applied") | F.coalesce(F.col("_in.status") == "applied", F.lit(False)))
    new = {c: F.col(f"_in.{c}") for c in have}
    if "status_changed_at" in new:
        new["status_changed_at"] = F.coalesce(new["status_changed_at"], "status_changed_at")
    return both.withColumns({c: F.when(takes, v).otherwise(F.col(c)) for c, v in new.items()}).select(*postings.columns)


def cross_tab(rows: DataFrame, down: str, across: str, names: list[str]) -> DataFrame:
    """Counts of each value of down by the named values of across."""
    return rows.groupBy(down).agg(*(F.count_if(F.col(across) == v).alias(v) for v in names))


def rate_by_bucket(rows: DataFrame, score: str, edges: list[float], answered: Column) -> DataFrame:
    """(bucket, n, rate): the share answered in each bucket of a score; bucket is its lower edge."""
    bucket = F.lit(None).cast("double")
    for low in edges:
        bucket = F.when(F.col(score) >= low, F.lit(float(low))).otherwise(bucket)
    return rows.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"), F.avg(answered.cast("double")).alias("rate"))


def merged_counts(rows: DataFrame, column: str) -> DataFrame:
    """(name, n): counts of JSON objects added up by name over all rows."""
    return rows.select(F.explode(F.from_json(column, "map<string, bigint>")).alias("name", "n")).groupBy("name").agg(F.sum("n").alias("n"))
