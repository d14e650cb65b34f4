"""Row models of reports: groupings of findings and decisions, summaries, bills of material."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.content import is_plain
from ledgerline.functions.text import license_expression, natural_key
from ledgerline.storage import broadcast_if_few

from .decisions import DO_NOT_USE, IDENTIFIED, IRRELEVANT, NON_FUNCTIONAL


def verification_codes(items: DataFrame, contents: DataFrame) -> DataFrame:
    """upload_fk and code: SHA1 of the joined, sorted, lower-case SHA1s of all files below the root.

    The code is one hash over all files of an upload, so one task reads an upload's hashes; it takes them in order
    from the sort, one after the other, and holds none of them.
    """
    rows = items.filter("parent is not null").join(contents, F.col("pfile_fk") == F.col("pfile_pk")).select(F.col("upload_fk").alias("upload"), F.lower("sha1").alias("h"))

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        upload, code = None, None
        for rows in batches:
            done = []
            for key, part in rows.groupby("upload", sort=False, dropna=False):
                if code is None or not (key == upload or key != key and upload != upload):
                    if code is not None:
                        done.append((upload, code.hexdigest()))
                    upload, code = key, hashlib.sha1()
                code.update("".join(part["h"]).encode())
            yield pd.DataFrame(done, columns=["upload_fk", "code"])
        if code is not None:
            yield pd.DataFrame([(upload, code.hexdigest())], columns=["upload_fk", "code"])

    kind = rows.schema["upload"].dataType.simpleString()
    known = rows.filter("upload is not null and h is not null")
    return known.repartition("upload").sortWithinPartitions("upload", "h").mapInPandas(stream, f"upload_fk {kind}, code string")


def grouped_statements(rows: DataFrame) -> DataFrame:
    """content, text, files, hashes, acknowledgements, comment of statements.

    rows: content, text, comment, acknowledgement, path, hash, pk. Statements of equal content and text are one
    row with distinct values in order; those with a comment stay single.
    """
    alone = F.when(F.trim(F.coalesce("comment", F.lit(""))) != "", F.col("pk")).otherwise(F.lit(-1))
    joined = lambda c, name: F.array_join(F.sort_array(F.collect_set(F.nullif(F.col(c), F.lit("")))), "; ").alias(name)
    return rows.groupBy("content", "text", alone.alias("_alone")).agg(joined("path", "files"), joined("hash", "hashes"), joined("acknowledgement", "acknowledgements"), F.max(F.coalesce("comment", F.lit(""))).alias("comment"), F.count("*").alias("n")).drop("_alone")


def acknowledgement_groups(rows: DataFrame) -> DataFrame:
    """content, acknowledgement, files in natural order, keyed by the md5 of content and text."""
    key = F.md5(F.concat_ws(".", "content", "text"))
    files = F.array_join(F.transform(F.array_sort(F.collect_set(F.struct(natural_key(F.col("path")).alias("k"), F.col("path").alias("p")))), lambda x: x["p"]), ", ")
    return rows.groupBy(key.alias("group_key"), "content", "acknowledgement").agg(files.alias("files"))


def obligation_groups(used: DataFrame, obligations: DataFrame, bridge: DataFrame, allowed_topics: list[str] | None = None) -> DataFrame:
    """topic, text, licenses of the obligations of used licenses(rf_fk, shortname), grouped by text (A15); allowed_topics: left out."""
    o = obligations if allowed_topics is None else obligations.filter(~F.col("topic").isin(allowed_topics))
    rows = used.select("rf_fk", "shortname").distinct().join(bridge, "rf_fk").join(o, "ob_fk")
    return rows.groupBy("topic", "text").agg(F.array_join(F.sort_array(F.collect_set("shortname")), ", ").alias("licenses"))


def expression_files(rows: DataFrame) -> DataFrame:
    """expression, path: one row for each file of files(item, path, shortname), with the expression of its licenses."""
    return rows.groupBy("item", "path").agg(license_expression(F.collect_set("shortname")).alias("expression")).select("expression", "path")


def licenses_with_files(rows: DataFrame) -> DataFrame:
    """expression, files, n_files: the files of each expression as one text, as a report has them.

    A text of all paths is as long as they are many; expression_files has a row for each.
    """
    return expression_files(rows).groupBy("expression").agg(F.array_join(F.sort_array(F.collect_list("path")), "\n").alias("files"), F.count("*").alias("n_files"))


def files_with_licenses(items: DataFrame, scanned: DataFrame, concluded: DataFrame, copyrights: DataFrame, decisions: DataFrame) -> DataFrame:
    """item, scanner_licenses, concluded_licenses, copyrights, is_cleared for each plain file.

    scanned: pfile_fk, shortname; concluded: item, shortname; copyrights: pfile_fk, content. Each side is grouped
    on its own before the join, so lists do not multiply.
    """
    joined = lambda df, key, col, name: df.groupBy(key).agg(F.array_join(F.sort_array(F.collect_set(col)), "; ").alias(name))
    files = items.filter(is_plain(F.col("mode"))).select("item", "pfile_fk")
    out = files.join(joined(scanned, "pfile_fk", "shortname", "scanner_licenses"), "pfile_fk", "left").join(joined(copyrights, "pfile_fk", "content", "copyrights"), "pfile_fk", "left")
    cleared = decisions.filter(F.col("decision_type").isin(IDENTIFIED, IRRELEVANT, DO_NOT_USE, NON_FUNCTIONAL)).select("item").distinct().withColumn("_c", F.lit(True))
    out = out.join(joined(concluded, "item", "shortname", "concluded_licenses"), "item", "left").join(cleared, "item", "left")
    blank = F.lit("")
    return out.select("item", F.coalesce("scanner_licenses", blank).alias("scanner_licenses"), F.coalesce("concluded_licenses", blank).alias("concluded_licenses"), F.coalesce("copyrights", blank).alias("copyrights"), F.coalesce("_c", F.lit(False)).alias("is_cleared"))


def clearing_section(decisions: DataFrame, items: DataFrame, section: str) -> DataFrame:
    """Decided items of a report's section: cleared, irrelevant, do_not_use or non_functional."""
    kind = {"cleared": IDENTIFIED, "irrelevant": IRRELEVANT, "do_not_use": DO_NOT_USE, "non_functional": NON_FUNCTIONAL}[section]
    return decisions.filter(F.col("decision_type") == kind).join(items.select("item", "name"), "item").select("item", "name", "decision_pk")


def main_licenses(items: DataFrame, concluded: DataFrame, main: DataFrame) -> DataFrame:
    """upload_fk, shortname, files: how many files carry each main license(upload_fk, shortname) of an upload."""
    rows = items.select("upload_fk", "item").join(concluded, "item").groupBy("upload_fk", "shortname").agg(F.countDistinct("item").alias("files"))
    return main.select("upload_fk", "shortname").distinct().join(rows, ["upload_fk", "shortname"], "left").na.fill(0, ["files"])


def upload_summary(items: DataFrame, findings: DataFrame, decisions: DataFrame, texts: DataFrame) -> DataFrame:
    """upload_fk, files, license_findings, unique_licenses, files_to_clear, files_cleared, copyrights.

    Findings are counted for each content first and weighted with its files, so that distinct counts see one row
    a license and upload.
    """
    files = items.filter(is_plain(F.col("mode"))).select("upload_fk", "item", "pfile_fk")
    real = findings.filter("rf_fk is not null")
    per_upload = files.groupBy("upload_fk", "pfile_fk").agg(F.count("*").alias("w"))
    lic = per_upload.join(real.groupBy("pfile_fk", "rf_fk").agg(F.count("*").alias("c")), "pfile_fk").groupBy("upload_fk", "rf_fk").agg(F.sum(F.col("w") * F.col("c")).alias("c"))
    lic = lic.groupBy("upload_fk").agg(F.sum("c").alias("license_findings"), F.count("*").alias("unique_licenses"))
    need = files.join(real.select("pfile_fk"), "pfile_fk", "left_semi")
    done = decisions.filter(F.col("decision_type") > 0).select("item").distinct()
    todo = need.join(done, "item", "left_anti").groupBy("upload_fk").agg(F.count("*").alias("files_to_clear"))
    ready = files.join(done, "item", "left_semi").groupBy("upload_fk").agg(F.count("*").alias("files_cleared"))
    copy = per_upload.join(texts.groupBy("pfile_fk").agg(F.count("*").alias("t")), "pfile_fk").groupBy("upload_fk").agg(F.sum(F.col("w") * F.col("t")).alias("copyrights"))
    out = files.groupBy("upload_fk").agg(F.count("*").alias("files"))
    for part in (lic, todo, ready, copy):
        out = out.join(part, "upload_fk", "left")
    return out.na.fill(0)


def export_licenses(licenses: DataFrame, obligations: DataFrame, bridge: DataFrame, parents: DataFrame) -> DataFrame:
    """One row for each license with its parent's name and its obligations' topics, for export."""
    topics = bridge.join(obligations.select("ob_fk", "topic"), "ob_fk").groupBy("rf_fk").agg(F.array_join(F.sort_array(F.collect_list("topic")), "; ").alias("obligations"))
    named = parents.join(licenses.select(F.col("rf_pk").alias("rf_parent"), F.col("shortname").alias("parent_name")), "rf_parent").select("rf_fk", "parent_name")
    out = licenses.join(topics, licenses["rf_pk"] == topics["rf_fk"], "full").drop("rf_fk")
    return out.join(named, out["rf_pk"] == named["rf_fk"], "left").drop("rf_fk")


def newest_texts(bulks: DataFrame) -> DataFrame:
    """text and the newest bulk_pk of each bulk text."""
    return bulks.groupBy("text").agg(F.max("bulk_pk").alias("bulk_pk"), F.count("*").alias("uses"))


def package_files(items: DataFrame, contents: DataFrame, licenses: DataFrame) -> DataFrame:
    """Rows of a bill of materials: upload_fk, name, sha1, license_concluded."""
    per = licenses.groupBy("pfile_fk").agg(license_expression(F.collect_set("shortname")).alias("license_concluded"))
    return items.filter(is_plain(F.col("mode"))).join(contents.select(F.col("pfile_pk").alias("pfile_fk"), "sha1"), "pfile_fk").join(per, "pfile_fk", "left").select("upload_fk", "name", "sha1", F.coalesce("license_concluded", F.lit("NOASSERTION")).alias("license_concluded"))


def listing(children: DataFrame, licenses: DataFrame, decided: DataFrame, counts: DataFrame) -> DataFrame:
    """A folder's children with license list, decision and files to clear (Q1): item, name, license_list, decision_type, files."""
    return children.join(licenses, "item", "left").join(decided.select("item", "decision_type"), "item", "left").join(counts.select("item", "files"), "item", "left").select("item", "name", F.coalesce("license_list", F.lit("")).alias("license_list"), "decision_type", F.coalesce("files", F.lit(0)).alias("files"))


def excluded_by(value: Column, patterns: list[str]) -> Column:
    """Whether any of the patterns occurs in a value."""
    hit = F.lit(False)
    for p in patterns:
        hit = hit | value.rlike(p)
    return hit


def export_obligations(obligations: DataFrame, bridge: DataFrame, licenses: DataFrame, sep: str = ";") -> DataFrame:
    """One row for each obligation(ob_fk, type, topic, text, classification) with the names of its licenses, for export."""
    names = bridge.join(licenses.select(F.col("rf_pk").alias("rf_fk"), "shortname"), "rf_fk").groupBy("ob_fk").agg(F.array_join(F.sort_array(F.collect_set("shortname")), sep).alias("licnames"))
    return obligations.join(names, "ob_fk", "left").select("type", "topic", "text", "classification", F.coalesce("licnames", F.lit("")).alias("licnames"))


def bucket_list(paths: DataFrame, leaves: DataFrame, names: DataFrame) -> DataFrame:
    """path and bucket_name of every file in a bucket (I27): paths(item, path), leaves(item, bucket), names(bucket, bucket_name)."""
    return paths.select("item", "path").join(leaves, "item").join(broadcast_if_few(names), "bucket").select("path", "bucket_name")
