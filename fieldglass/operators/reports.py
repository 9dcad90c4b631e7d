"""Reports as text, a row a section: what they show is chosen by bounded sorts, so a report stays a page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

VERDICTS = {"clearly_better": "clearly better", "arguably_better": "arguably better", "worse": "worse"}


def thousands(pay: Column) -> Column:
    """Whole thousands, halves to the even one."""
    return F.bround(pay / 1000, 0).cast("bigint").cast("string")


def pay_text(low: Column, high: Column, estimate: Column) -> Column:
    """The posted range, else the estimate, else that there is none; 0 counts as none."""
    stated = F.concat(F.lit("$"), thousands(low), F.lit("–"), thousands(high), F.lit("k"))
    return F.when((low != 0) & (high != 0), stated).when(estimate != 0, F.concat(F.lit("~$"), thousands(estimate), F.lit("k est"))).otherwise("no comp")


def posting_line(company: Column, title: Column, metro: Column, pay: Column, verdict: Column, url: Column) -> Column:
    said = F.coalesce(F.create_map(*(F.lit(x) for kv in VERDICTS.items() for x in kv))[verdict], F.lit("—"))
    where = F.replace(F.coalesce(F.nullif(metro, F.lit("")), F.lit("?")), F.lit("_"), F.lit(" "))
    first = F.array_join(F.array(F.concat(F.lit("• "), F.coalesce(company, F.lit("")), F.lit(" — "), F.coalesce(title, F.lit(""))), where, pay, said), " · ")
    return F.concat(first, F.lit("\n  "), F.coalesce(url, F.lit("")))


def daily(new: DataFrame, today: DataFrame, due: DataFrame, ranking: dict[str, int], hours: int = 24, most: int = 120, shown: int = 8, places: int = 10) -> DataFrame:
    """(place, section, n, body) of a day's report: a head, a section a category in the order of ranking (others
    after them, by name), today's queue, and the applications to follow up, if any.

    new: id, category, priority, line: of all of them the first ``most`` by category and falling priority count,
    and ``shown`` of each category are listed; today: rank, line, the first ``places`` count; due: id, line."""
    first = new.orderBy(F.asc_nulls_first("category"), F.desc("priority"), "id").limit(most)
    order = F.coalesce(F.create_map(*(F.lit(x) for kv in ranking.items() for x in kv))[F.col("category")], F.lit(9)) if ranking else F.lit(9)
    groups = first.withColumn("category", F.coalesce("category", F.lit("other"))).groupBy("category").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct((-F.col("priority")).alias("p"), "id", "line"))).alias("rows"))
    lines = F.transform(F.slice("rows", 1, shown), lambda r: r["line"])
    more = F.when(F.col("n") > shown, F.concat(F.lit("\n  … and "), F.col("n") - shown, F.lit(" more in the dashboard"))).otherwise("")
    name = F.upper(F.replace("category", F.lit("_"), F.lit(" ")))
    sections = groups.select(F.struct(F.lit(1).alias("part"), order.alias("rank"), F.col("category").alias("name")).alias("at"), F.col("category").alias("section"), "n", F.concat(name, F.lit(" ("), "n", F.lit(")\n"), F.array_join(lines, "\n"), more).alias("body"))

    def block(part: int, section: str, rows: DataFrame, order: str, title: Column) -> DataFrame:
        all_ = rows.agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct(order, "line"))).alias("rows"))
        said = F.array_join(F.concat(F.array(title), F.transform("rows", lambda r: r["line"])), "\n")
        return all_.select(F.struct(F.lit(part).alias("part"), F.lit(0).alias("rank"), F.lit("").alias("name")).alias("at"), F.lit(section).alias("section"), "n", said.alias("body"))

    at = F.struct(F.lit(0).alias("part"), F.lit(0).alias("rank"), F.lit("").alias("name")).alias("at")
    head = first.agg(F.count("*").alias("n")).select(at, F.lit("head").alias("section"), "n", F.concat("n", F.lit(f" new postings cleared the floor in the last {hours}h.")).alias("body"))
    queue = block(2, "today", today.orderBy("rank").limit(places), "rank", F.concat(F.lit("TODAY'S QUEUE ("), F.col("n"), F.lit(")")))
    follow = block(3, "follow_ups", due, "id", F.lit("FOLLOW-UPS DUE")).where("n > 0")
    every = head.unionByName(sections).unionByName(queue).unionByName(follow)
    return every.withColumn("place", F.row_number().over(Window.orderBy("at"))).select("place", "section", "n", "body")  # a row a section
