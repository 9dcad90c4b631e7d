"""From names that nobody knows to registry entries.

Names that feeds give are queued by their key, with how often and since when they are seen.  A queued name is
linked if the registry knows it; else its URL says which board it has, and what a visit to that board
found decides: it becomes an entry, or waits until a failed board may be visited again (a negative
cache by time).  New entries are names that others may link to, so the queue is gone through until
nothing is added.  The registry is joined by equality of name beginnings and of boards, never crossed
with the queue.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import quals as Q
from ..functions import urls as L
from ..functions.text import slug
from .ranges import stored
from .tracker import matched_names

QUEUE = ["key", "name", "url", "seen", "first_at", "last_at"]


def queued(rows: DataFrame, name: str, url: str, at: str, before: DataFrame | None = None) -> DataFrame:
    """The queue (QUEUE) with the names of these rows: the first spelling and the first URL stay.  Empty names
    are not queued.  Applied to an empty queue or to any part of the rows, in any order of the parts, the
    sums are the same."""
    new = rows.select(Q.company_key(F.col(name)).alias("key"), F.trim(name).alias("name"), F.nullif(F.trim(url), F.lit("")).alias("url"), F.lit(1).cast("long").alias("seen"), F.col(at).alias("first_at"), F.col(at).alias("last_at"))
    new = new.where("key <> ''")
    both = new if before is None else before.select(*QUEUE).unionByName(new)
    first = lambda c: F.min(F.when(F.col(c).isNotNull(), F.struct("first_at", c)))[c]
    return both.groupBy("key").agg(first("name").alias("name"), first("url").alias("url"), F.sum("seen").alias("seen"), F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at"))


def numbered_slugs(new: DataFrame, taken: DataFrame) -> DataFrame:
    """new (key, base, seen) -> (key, slug): the base, or base-2, base-3, ..., the first that neither
    taken (slug) nor a row seen more often has."""
    done, left = None, new
    while not left.isEmpty():
        used = taken if done is None else taken.unionByName(done.select("slug"))
        number = F.when(F.col("slug").rlike(r"-\d+$"), F.regexp_extract("slug", r"-(\d+)$", 1).cast("long"))
        apart = used.select(F.col("slug").alias("base"), F.lit(1).cast("long").alias("n")).unionByName(used.where(number >= 2).select(F.regexp_replace("slug", r"-\d+$", "").alias("base"), number.alias("n")))
        held = apart.groupBy("base").agg(F.collect_set("n").alias("held"))
        place = F.row_number().over(Window.partitionBy("base").orderBy(F.desc("seen"), "key"))
        both = left.withColumn("r", place).join(held, "base", "left").withColumn("held", F.coalesce("held", F.array().cast("array<bigint>")))
        free = F.get(F.filter(F.sequence(F.lit(1).cast("long"), F.col("r") + F.size("held")), lambda n: ~F.array_contains(F.col("held"), n)), F.col("r") - 1)
        given = both.withColumn("slug", F.when(free == 1, F.col("base")).otherwise(F.concat_ws("-", "base", free)))
        # a base may itself end in a number: of two rows with one slug the one seen more often has it; the other,
        # and those after it with its base, are asked again
        turn = F.row_number().over(Window.partitionBy("slug").orderBy(F.desc("seen"), "key"))
        lost = F.min(F.when(F.col("turn") > 1, F.col("r"))).over(Window.partitionBy("base"))
        given = stored(given.withColumn("turn", turn).withColumn("fine", F.coalesce(F.col("r") < lost, F.lit(True))).select("key", "base", "seen", "slug", "fine"))
        some = given.where("fine").select("key", "slug")
        done = some if done is None else done.unionByName(some)
        left = given.where("NOT fine").select("key", "base", "seen")
    return done if done is not None else new.select("key", F.col("base").alias("slug"))


def discovered(queue: DataFrame, registry: DataFrame, visits: DataFrame, now: Column, retry_days: int = 30, least_seen: int = 1) -> tuple[DataFrame, DataFrame]:
    """(outcomes, entries).  registry: name, slug, provider, board, a row a board; visits: provider, board, ok,
    n, at, the last of each counts.

    outcomes: key, outcome and company (the registry's slug).  linked: the registry has the name;
    unresolvable: no board in the URL; known: the registry has the board; failed: a visit failed less than
    retry_days ago; waiting: not visited yet, or again due; added: an entry was made.
    entries: slug, name, category, provider, board, seen.  Of several names with one board the one seen
    most (then the first key) becomes the entry, the others know its board afterwards."""
    names = registry.select("name", "slug", "provider", "board", F.lit(None).cast("string").alias("category"), F.lit(0).cast("long").alias("seen"), F.lit(None).cast("string").alias("key"))
    latest = visits.groupBy("provider", "board").agg(F.max_by(F.struct("ok", "n", "at"), "at").alias("v"))
    spec = L.provider(F.col("url"))
    left = stored(queue.where(F.col("seen") >= least_seen).select("key", "name", "seen", spec["provider"].alias("provider"), spec["slug"].alias("board")))
    entries = None
    while True:
        known = names if entries is None else names.unionByName(entries)
        keyed = known.select(Q.company_key(F.col("name")).alias("known"), "slug")
        # of a name that the registry has twice the first slug; a round's own entry is not its own match
        links = matched_names(left, "key", keyed, "known", "slug", "slug").withColumnRenamed("slug", "company")
        boards = known.where("provider IS NOT NULL AND board IS NOT NULL").groupBy("provider", "board").agg(F.min("slug").alias("of"))
        joined = left.join(links, "key", "left").join(boards, ["provider", "board"], "left").join(latest, ["provider", "board"], "left")
        recent = F.col("v.at") > now - F.make_dt_interval(F.lit(retry_days))
        outcome = (
            F.when(F.col("company").isNotNull(), "linked")
            .when(F.col("provider").isNull(), "unresolvable")
            .when(F.col("of").isNotNull(), "known")
            .when(F.col("v.ok"), "found")
            .when(~F.coalesce(F.col("v.ok"), F.lit(True)) & recent, "failed")
            .otherwise("waiting")
        )
        told = stored(joined.select("key", "name", "seen", "provider", "board", outcome.alias("outcome"), F.coalesce("company", F.when(outcome == "known", F.col("of"))).alias("company")))
        best = told.where("outcome = 'found'").groupBy("provider", "board").agg(F.min_by(F.struct("key", "name", "seen"), F.struct(-F.col("seen"), F.col("key"))).alias("b"))
        new = best.select("provider", "board", "b.*").withColumn("base", F.coalesce(F.nullif(slug(F.col("name")), F.lit("")), slug(F.col("board"))))
        if new.isEmpty():
            break
        slugs = numbered_slugs(new.select("key", "base", "seen"), known.select("slug").distinct())
        made = stored(new.join(slugs, "key").select("name", "slug", "provider", "board", F.coalesce(Q.category_hint(F.col("name")), F.lit("other")).alias("category"), "seen", "key"))
        entries = made if entries is None else entries.unionByName(made)
        left = left.join(made.select("key"), "key", "left_anti")
    added = entries.select("key", F.lit("added").alias("outcome"), F.col("slug").alias("company")) if entries is not None else told.limit(0).select("key", "outcome", "company")
    outcomes = told.select("key", "outcome", "company").unionByName(added)
    return outcomes, (entries if entries is not None else names.limit(0)).select("slug", "name", "category", "provider", "board", "seen")
