"""Durations, counts and states of uploads, folders, packages and jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def durations(events: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """key, first, last, seconds from the first event of type ``start`` to the last of type ``end`` (A6); null if one is missing."""
    first = F.min(F.when(F.col("event_type") == start, F.col("ts")))
    last = F.max(F.when(F.col("event_type") == end, F.col("ts")))
    out = events.groupBy(key).agg(first.alias("first"), last.alias("last"))
    return out.withColumn("seconds", F.unix_timestamp("last") - F.unix_timestamp("first"))


def status_sums(rows: DataFrame, key: str) -> DataFrame:
    """key, total, checked, ok of rows with a status: null is unchecked, 200 is found."""
    return rows.groupBy(key).agg(F.count("*").alias("total"), F.count("status").alias("checked"), F.count_if(F.col("status") == 200).alias("ok"))


def folder_uploads(contents: DataFrame, perms: DataFrame) -> DataFrame:
    """folder, group_fk, uploads: distinct uploads of a folder that a group may see."""
    return contents.join(perms.filter("perm >= 1").select("upload_fk", "group_fk").distinct(), "upload_fk").groupBy("folder", "group_fk").agg(F.countDistinct("upload_fk").alias("uploads"))


def removable(contents: DataFrame, folder: int) -> DataFrame:
    """Children that are in two folders or more, one of them the given one (A10)."""
    return contents.groupBy("child").agg(F.count("*").alias("n"), F.bool_or(F.col("folder") == folder).alias("here")).filter("n > 1 and here").select("child", "n")


def progress(runs: DataFrame) -> DataFrame:
    """upload_fk, per_second, eta_seconds: items a second, and the longest time that a running scanner still needs."""
    rate = F.when((F.col("seconds") > 0) & (F.col("processed") > 0), F.col("processed") / F.col("seconds"))
    return runs.withColumn("rate", rate).groupBy("upload_fk").agg(F.sum("rate").alias("per_second"), F.max(F.round((F.col("total") - F.col("processed")) / F.col("rate"))).alias("eta_seconds"))


def job_counts(jobs: DataFrame) -> DataFrame:
    """agent_name, status and how many jobs."""
    return jobs.groupBy("agent_name", "status").agg(F.count("*").alias("jobs"))


def ready_jobs(jobs: DataFrame, depends: DataFrame) -> DataFrame:
    """Waiting jobs whose every predecessor is done."""
    open_ = depends.join(jobs.filter("status != 'done'").select(F.col("job_fk").alias("depends_on")), "depends_on").select("job_fk").distinct()
    return jobs.filter("status = 'waiting'").join(open_, "job_fk", "left_anti")


def stale_jobs(jobs: DataFrame, now: str, seconds: int = 180) -> DataFrame:
    """Running jobs that gave no sign of life for so long."""
    return jobs.filter("status = 'running'").filter(F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp("beat") > seconds)


def package_counts(packages: DataFrame) -> DataFrame:
    """upload_fk, source, binary, binary_without_source: packages of an upload (Q13); a binary names its source package."""
    src = packages.filter("kind = 'source'").select("upload_fk", F.col("package").alias("source_package")).distinct().withColumn("_s", F.lit(1))
    rows = packages.join(src, ["upload_fk", "source_package"], "left")
    return rows.groupBy("upload_fk").agg(F.count_if(F.col("kind") == "source").alias("source"), F.count_if(F.col("kind") == "binary").alias("binary"), F.count_if((F.col("kind") == "binary") & F.col("_s").isNull()).alias("binary_without_source"))


def projects_of_contents(lookups: DataFrame, least: int = 1) -> DataFrame:
    """project and contents of an external lookup(pfile_fk, project) with a least count (Q16)."""
    return lookups.groupBy("project").agg(F.countDistinct("pfile_fk").alias("contents")).filter(F.col("contents") >= least)


def priorities(uploads: DataFrame, key: str, order: str) -> DataFrame:
    """uploads with whole-number priorities by an old order, from 1 in each group (Q15, renumbering)."""
    return uploads.withColumn("priority", F.row_number().over(Window.partitionBy(key).orderBy(order, "upload_fk")).cast("long"))


def moved_priorities(uploads: DataFrame, moves: DataFrame) -> DataFrame:
    """upload_fk and priority of moved uploads (Q15): the middle between two neighbours, one beyond where there is one only, else 0.

    uploads: upload_fk, priority; moves: upload_fk, before, after (uploads, null: none).
    """
    at = lambda side: uploads.select(F.col("upload_fk").alias(side), F.col("priority").cast("double").alias(f"_{side}"))
    rows = moves.join(at("before"), "before", "left").join(at("after"), "after", "left")
    middle = (F.col("_before") + F.col("_after")) / 2
    return rows.select("upload_fk", F.coalesce(middle, F.col("_before") + 1, F.col("_after") - 1, F.lit(0.0)).alias("priority"))


def clearing_progress(items: DataFrame, decisions: DataFrame) -> DataFrame:
    """upload_fk, files, cleared, percent (Q21)."""
    done = decisions.filter("decision_type > 0").select("item").distinct().withColumn("_d", F.lit(1))
    out = items.join(done, "item", "left").groupBy("upload_fk").agg(F.count("*").alias("files"), F.count("_d").alias("cleared"))
    return out.withColumn("percent", F.round(100 * F.col("cleared") / F.col("files"), 2))


def newest_candidates(candidates: DataFrame, events: DataFrame) -> DataFrame:
    """Candidate licenses that no current event of any item uses, and so may be deleted (Q18)."""
    last = events.groupBy("item", "rf_fk").agg(F.max_by("removed", "event_pk").alias("removed")).filter("not removed").select(F.col("rf_fk").alias("rf_pk"))
    return candidates.join(last, "rf_pk", "left_anti")


def without_uploads(items: DataFrame, gone: DataFrame, by_item: dict[str, DataFrame], by_content: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """What is left when uploads(upload_fk) are deleted (I28): items, tables with an item, tables with a pfile_fk.

    Contents that a remaining item has stay, and so do rows about them; rows whose item or content is null stay.
    All of it is anti-joins, so it takes one pass over each table.
    """
    kept = items.join(gone.select("upload_fk"), "upload_fk", "left_anti")
    lost_items = items.join(gone.select("upload_fk"), "upload_fk", "left_semi").select("item")
    lost = items.join(gone.select("upload_fk"), "upload_fk", "left_semi").filter("pfile_fk is not null").select("pfile_fk").distinct()
    lost = lost.join(kept.select("pfile_fk"), "pfile_fk", "left_anti")
    left = {"items": kept}
    left |= {name: df.join(lost_items, "item", "left_anti") for name, df in by_item.items()}
    return left | {name: df.join(lost, "pfile_fk", "left_anti") for name, df in by_content.items()}
