"""Findings of scanners: joins with the tree, histograms, latest runs, overlays.

A finding has fl_pk, pfile_fk, rf_fk (null: scanned, nothing found), agent_fk and pct; licenses have rf_pk,
shortname. Sums are partial before they shuffle. Dimensions (licenses, agents) are small in practice but grow
with their users; no broadcast is forced on them, Spark's size check or a count decides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.content import is_plain
from ledgerline.functions.text import NO_LICENSE, VOID, overlaid
from ledgerline.storage import broadcast_if_few


def file_matches(items: DataFrame, findings: DataFrame, licenses: DataFrame, agents: DataFrame) -> DataFrame:
    """item, shortname, agent_name, pct of all findings on files."""
    return items.join(findings, "pfile_fk").join(licenses, F.col("rf_fk") == F.col("rf_pk")).join(broadcast_if_few(agents), "agent_fk").select("item", "shortname", "agent_name", "pct")


def license_histogram(items: DataFrame, findings: DataFrame, licenses: DataFrame, agents: list[int] | None = None) -> DataFrame:
    """shortname, files, contents (A1).

    Files are kept where nothing was found: they count as the name for "nothing". The agents' filter belongs to
    the join, so a file with findings of other agents only counts as such, too. Void is left out.
    """
    found = findings if agents is None else findings.filter(F.col("agent_fk").isin(agents))
    named = found.join(licenses, F.col("rf_fk") == F.col("rf_pk")).select("pfile_fk", "shortname").withColumnRenamed("pfile_fk", "_of")
    files = items.filter(is_plain(F.col("mode"))).select("item", "pfile_fk")
    rows = files.join(named, files["pfile_fk"] == named["_of"], "left").select("pfile_fk", F.coalesce("shortname", F.lit(NO_LICENSE)).alias("shortname"))
    per_content = rows.filter(F.col("shortname") != VOID).groupBy("shortname", "pfile_fk").agg(F.count("*").alias("n"))
    return per_content.groupBy("shortname").agg(F.sum("n").alias("files"), F.count("pfile_fk").alias("contents"))


def concluded_multiplicity(decisions: DataFrame, decided_licenses: DataFrame) -> DataFrame:
    """shortname, items: items concluded with each license (A2); removed licenses do not count."""
    return decisions.join(decided_licenses.filter("not removed"), "decision_pk").groupBy("shortname").agg(F.countDistinct("item").alias("items"))


def merged_histogram(scanned: DataFrame, concluded: DataFrame) -> DataFrame:
    """shortname, scanner_count, unique_count, concluded_count of both histograms, 0 where one lacks it (A3)."""
    both = scanned.join(concluded, "shortname", "full")
    return both.select("shortname", *[F.coalesce(a, F.lit(0)).alias(b) for a, b in (("files", "scanner_count"), ("contents", "unique_count"), ("items", "concluded_count"))])


def with_overlay(texts: DataFrame, events: DataFrame) -> DataFrame:
    """Text findings with the content, hash and state that an event on the same finding and item gives them.

    texts: fk, item, content, hash, is_enabled; events: fk, item, content, is_enabled. An event without content
    keeps the finding's; an event's is_enabled wins.
    """
    e = events.select("fk", "item", F.col("content").alias("_content"), F.col("is_enabled").alias("_enabled"))
    content = overlaid(F.col("_content"), F.col("content"))
    return texts.join(e, ["fk", "item"], "left").select("fk", "item", content.alias("content"), F.md5(content).alias("hash"), F.coalesce("_enabled", "is_enabled").alias("is_enabled"))


def content_histogram(texts: DataFrame, search: str | None = None, enabled: bool = True) -> DataFrame:
    """content, hash and copies of overlaid findings, most frequent first (A4, A5)."""
    rows = texts.filter(F.col("is_enabled") == enabled).filter("trim(content) != ''")
    rows = rows.filter(F.col("content").ilike(f"%{search}%")) if search else rows
    return rows.groupBy("content", "hash").agg(F.count("*").alias("copies")).orderBy(F.desc("copies"), "content")


def license_lists(items: DataFrame, findings: DataFrame, licenses: DataFrame, sep: str = ", ") -> DataFrame:
    """item and license_list: the distinct short names of its content in order; files without any have the name for "nothing" (A17)."""
    named = findings.join(licenses, F.col("rf_fk") == F.col("rf_pk")).groupBy("pfile_fk").agg(F.array_join(F.sort_array(F.collect_set("shortname")), sep).alias("license_list"))
    return items.join(named, "pfile_fk", "left").select("item", F.coalesce("license_list", F.lit(NO_LICENSE)).alias("license_list"))


def files_with_license(items: DataFrame, findings: DataFrame, licenses: DataFrame, shortname: str) -> DataFrame:
    """item, pfile_fk and the newest agent that found the license."""
    wanted = licenses.filter(F.col("shortname") == shortname).select("rf_pk")
    hits = findings.join(wanted, F.col("rf_fk") == F.col("rf_pk"), "left_semi").groupBy("pfile_fk").agg(F.max("agent_fk").alias("agent_fk"))
    return items.join(hits, "pfile_fk").select("item", "pfile_fk", "agent_fk")


def best_match(findings: DataFrame) -> DataFrame:
    """pfile_fk, rf_fk, agent_fk, pct, fl_pk of the best match of each file, license and agent (A21); of equals the newest."""
    best = F.max(F.struct("pct", "fl_pk")).alias("b")
    return findings.filter("rf_fk is not null").groupBy("pfile_fk", "rf_fk", "agent_fk").agg(best).select("pfile_fk", "rf_fk", "agent_fk", "b.pct", "b.fl_pk")


def latest_runs(runs: DataFrame) -> DataFrame:
    """upload_fk, agent_name, agent_fk, run_pk of the newest successful run of each agent on each upload (W3w)."""
    newest = runs.filter("success").groupBy("upload_fk", "agent_name").agg(F.max(F.struct("agent_fk", "run_pk")).alias("r"))
    return newest.select("upload_fk", "agent_name", "r.agent_fk", "r.run_pk")


def latest_findings(items: DataFrame, findings: DataFrame, runs: DataFrame) -> DataFrame:
    """Findings on items by the agents of the latest successful runs of the item's upload only."""
    return items.join(findings, "pfile_fk").join(latest_runs(runs), ["upload_fk", "agent_fk"], "left_semi")


def orphans(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Rows whose key no parent has (J7); a null key is no orphan."""
    return children.filter(F.col(key).isNotNull()).join(parents.select(key), key, "left_anti")


def deactivated(texts: DataFrame, items: DataFrame) -> DataFrame:
    """An event that disables it, for every item with the content of a disabled finding (S32): fk, item, hash, is_enabled."""
    return texts.filter("not is_enabled").select("fk", "pfile_fk", "hash").join(items.select("item", "pfile_fk"), "pfile_fk").select("fk", "item", "hash", F.lit(False).alias("is_enabled"))


def region(highlights: DataFrame) -> DataFrame:
    """fl_fk, first and last byte of a finding's highlights."""
    return highlights.groupBy("fl_fk").agg(F.min("start").alias("region_start"), F.max(F.col("start") + F.col("len")).alias("region_end"))


def merged_highlights(highlights: DataFrame) -> DataFrame:
    """pfile_fk, start, end of the maximal stretches that highlights cover (S36); touching ones merge.

    Equal highlights are numbered as one, so that it doesn't matter which of them comes first in either window.
    """
    by_start = Window.partitionBy("pfile_fk").orderBy("start", "len")
    reach = F.max(F.col("start") + F.col("len")).over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    marked = highlights.withColumn("_new", F.when(F.col("start") <= reach, 0).otherwise(1))
    grouped = marked.withColumn("_n", F.sum("_new").over(by_start.rangeBetween(Window.unboundedPreceding, Window.currentRow)))
    return grouped.groupBy("pfile_fk", "_n").agg(F.min("start").alias("start"), F.max(F.col("start") + F.col("len")).alias("end")).drop("_n")


def highlight_sections(highlights: DataFrame) -> DataFrame:
    """pfile_fk, start, end, level: the text cut at every highlight's edge, with how many highlights lie over each piece."""
    edges = highlights.filter("len > 0").select("pfile_fk", F.explode(F.array(F.struct(F.col("start").alias("at"), F.lit(1).alias("d")), F.struct((F.col("start") + F.col("len")).alias("at"), F.lit(-1).alias("d")))).alias("e"))
    sums = edges.groupBy("pfile_fk", F.col("e.at").alias("start")).agg(F.sum("e.d").alias("d"))
    order = Window.partitionBy("pfile_fk").orderBy("start")
    return sums.select("pfile_fk", "start", F.lead("start").over(order).alias("end"), F.sum("d").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("level")).filter("level > 0")


def two_tree_histogram(left: DataFrame, right: DataFrame) -> DataFrame:
    """shortname with the files of two histograms (Q5)."""
    return left.select("shortname", F.col("files").alias("files_1")).join(right.select("shortname", F.col("files").alias("files_2")), "shortname", "full").na.fill(0)


def files_with_text(items: DataFrame, texts: DataFrame, hash_value: str) -> DataFrame:
    """Items whose content has a finding of that hash (Q8)."""
    return items.join(texts.filter(F.col("hash") == hash_value).select("pfile_fk"), "pfile_fk", "left_semi")


def text_lines(texts: DataFrame, include: str | None = None, exclude: str | None = None, licensed: DataFrame | None = None) -> DataFrame:
    """Distinct item and content that match ``include`` and not ``exclude``; licensed: contents with a license, left out (Q9)."""
    rows = texts if include is None else texts.filter(F.col("content").rlike(include))
    rows = rows if exclude is None else rows.filter(~F.col("content").rlike(exclude))
    rows = rows if licensed is None else rows.join(licensed.filter("rf_fk is not null").select("pfile_fk"), "pfile_fk", "left_anti")
    return rows.select("item", "content").distinct()
