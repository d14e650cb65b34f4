"""Carrying decisions and edits over from one upload to another."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .decisions import DO_NOT_USE, IDENTIFIED, IRRELEVANT, NON_FUNCTIONAL, TO_BE_DISCUSSED, WIP

#: Of several decisions on a content the one that comes first here is carried over; of equals the newest.
PRIORITY = [IDENTIFIED, DO_NOT_USE, NON_FUNCTIONAL, IRRELEVANT, TO_BE_DISCUSSED, WIP]


def reusable_decisions(decisions: DataFrame) -> DataFrame:
    """pfile_fk, decision_pk, decision_type: the best decision on each content."""
    rank = F.array_position(F.array(*[F.lit(x) for x in PRIORITY]), F.col("decision_type"))
    best = decisions.filter((rank > 0) & F.col("pfile_fk").isNotNull()).groupBy("pfile_fk").agg(F.min_by(F.struct("decision_pk", "decision_type"), F.struct(rank, -F.col("decision_pk"))).alias("d"))
    return best.select("pfile_fk", "d.decision_pk", "d.decision_type")


def reused_by_content(items: DataFrame, cleared: DataFrame, old_decisions: DataFrame) -> DataFrame:
    """item, decision_pk, decision_type for items of the same content that are not cleared yet (C11)."""
    return items.join(cleared.select("item"), "item", "left_anti").join(reusable_decisions(old_decisions), "pfile_fk").select("item", "decision_pk", "decision_type")


def line_changes(old: np.ndarray, new: np.ndarray, most: int) -> int:
    """Lines taken out and put in between two texts, given as arrays of line hashes, counted up to ``most``.

    The fewest changes: with each further change the reach on every diagonal of the table of lines (lines of old less
    lines of new) is known from that on its neighbours, so no more than 2 * most - 1 diagonals are ever looked at.
    """
    if abs(len(old) - len(new)) >= most:
        return most

    def alike(i: int, j: int) -> int:
        """Equal lines from two places on, sought in stretches that double."""
        n, step = 0, 16
        while i + n < len(old) and j + n < len(new):
            size = min(step, len(old) - i - n, len(new) - j - n)
            unlike = np.flatnonzero(old[i + n : i + n + size] != new[j + n : j + n + size])
            if len(unlike):
                return n + int(unlike[0])
            n, step = n + size, 2 * step
        return n

    goal, reach = len(old) - len(new), {0: alike(0, 0)}
    for changes in range(most):
        if reach.get(goal, -1) >= len(old):
            return changes
        reach = {d: i for d in range(-changes - 1, changes + 2, 2) if (i := max(reach.get(d - 1, -2) + 1, reach.get(d + 1, -1))) >= 0 and i - d >= 0}
        reach = {d: min(i, len(old)) for d, i in reach.items() if min(i, len(old)) - d <= len(new)}
        reach = {d: i + alike(i, i - d) for d, i in reach.items()}
    return most


def _near(most: int):
    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            old, new = ([x.values.to_numpy(zero_copy_only=False) for x in batch.column(c)] for c in ("old_lines", "new_lines"))
            keep = pa.array([line_changes(a, b, most) < most for a, b in zip(old, new, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(keep) for c in ("new_fk", "old_fk")], ["new_fk", "old_fk"])

    return near


def reused_by_name(new_items: DataFrame, old_items: DataFrame, cleared: DataFrame, old_decisions: DataFrame, contents: DataFrame, most: int = 5) -> DataFrame:
    """item, decision_pk for items not cleared whose namesake in the other upload differs in fewer than ``most`` lines.

    new_items, old_items: item, name, pfile_fk; contents: pfile_fk, text (null: empty). Namesakes meet by name and number
    of lines, which may differ by less than ``most``, so a name that very many files have is spread over their sizes.
    Each pair of different contents is compared once, as arrays of line hashes; of several namesakes the newest decision
    is taken.
    """
    lines = contents.select("pfile_fk", F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.xxhash64(x)).alias("lines")).withColumn("n", F.size("lines"))
    sizes = lines.select("pfile_fk", "n")
    new = new_items.join(cleared.select("item"), "item", "left_anti").join(sizes, "pfile_fk").select("item", "name", F.col("pfile_fk").alias("new_fk"), "n")
    old = old_items.join(reusable_decisions(old_decisions), "pfile_fk").join(sizes, "pfile_fk").select("name", F.col("pfile_fk").alias("old_fk"), "decision_pk", "n").distinct()
    around = old.withColumn("n", F.explode(F.sequence(F.col("n") - most + 1, F.col("n") + most - 1)))
    pairs = new.select("name", "new_fk", "n").distinct().join(around, ["name", "n"]).filter("new_fk != old_fk").select("name", "new_fk", "old_fk", "decision_pk")
    of = lambda side: lines.select(F.col("pfile_fk").alias(f"{side}_fk"), F.col("lines").alias(f"{side}_lines"))
    texts = pairs.select("new_fk", "old_fk").distinct().join(of("new"), "new_fk").join(of("old"), "old_fk")
    close = texts.mapInArrow(_near(most), "new_fk long, old_fk long")
    best = pairs.join(close, ["new_fk", "old_fk"]).groupBy("name", "new_fk").agg(F.max("decision_pk").alias("decision_pk"))
    return new.join(best, ["name", "new_fk"]).select("item", "decision_pk")


def reused_texts(new: DataFrame, old_overlay: DataFrame, own_overlay: DataFrame) -> DataFrame:
    """Edits of the other upload for findings (fk, item, hash) of equal hash that have no edit yet (C13): fk, item, content, is_enabled."""
    newest = old_overlay.groupBy("hash").agg(F.max_by(F.struct("content", "is_enabled"), "event_pk").alias("e"))
    return new.join(own_overlay.select("fk", "item"), ["fk", "item"], "left_anti").join(newest, "hash").select("fk", "item", "e.content", "e.is_enabled")


def reused_settings(settings: DataFrame, source: int, target: int) -> DataFrame:
    """Settings (upload_fk, key, value) of an upload that the target lacks, as the target's."""
    own = settings.filter(F.col("upload_fk") == target).select("key")
    return settings.filter(F.col("upload_fk") == source).join(own, "key", "left_anti").select(F.lit(target).cast(settings.schema["upload_fk"].dataType).alias("upload_fk"), "key", "value")


def reused_main_licenses(main: DataFrame, reuse: DataFrame) -> DataFrame:
    """upload_fk, group_fk, rf_fk: main licenses that uploads take over and do not have yet.

    main: upload_fk, group_fk, rf_fk; reuse: upload_fk, group_fk, reused_upload_fk, reused_group_fk.
    """
    old = main.select(F.col("upload_fk").alias("reused_upload_fk"), F.col("group_fk").alias("reused_group_fk"), "rf_fk")
    return reuse.join(old, ["reused_upload_fk", "reused_group_fk"]).select("upload_fk", "group_fk", "rf_fk").distinct().join(main, ["upload_fk", "group_fk", "rf_fk"], "left_anti")


def sidecars(items: DataFrame, suffix: str = ".license") -> DataFrame:
    """sidecar, base: items ``X.license`` and the item ``X`` of the same folder."""
    side = items.filter(F.col("name").endswith(suffix)).select("upload_fk", "parent", F.expr(f"substring(name, 1, length(name) - {len(suffix)})").alias("name"), F.col("item").alias("sidecar"), F.col("pfile_fk").alias("sidecar_fk"))
    return side.join(items.select("upload_fk", "parent", "name", F.col("item").alias("base"), F.col("pfile_fk").alias("base_fk")), ["upload_fk", "parent", "name"]).select("sidecar", "base", "sidecar_fk", "base_fk")


def sidecar_findings(items: DataFrame, findings: DataFrame) -> DataFrame:
    """pfile_fk, rf_fk that files take over from their sidecar and do not have yet (C14)."""
    pairs = sidecars(items)
    taken = pairs.join(findings.filter("rf_fk is not null").select(F.col("pfile_fk").alias("sidecar_fk"), "rf_fk"), "sidecar_fk").select(F.col("base_fk").alias("pfile_fk"), "rf_fk").distinct()
    return taken.join(findings.select("pfile_fk", "rf_fk"), ["pfile_fk", "rf_fk"], "left_anti")


def by_hash(entries: DataFrame, items: DataFrame, algorithm: str = "sha1") -> DataFrame:
    """Entries of a list with a hash, and the items of that content (J16); case does not matter."""
    i = items.select("item", F.lower(algorithm).alias("_hash"))
    return entries.join(i, F.lower(F.col("hash")) == i["_hash"]).drop("_hash")


def remapped(rows: DataFrame, mapping: DataFrame, column: str) -> DataFrame:
    """rows with the ids of a column replaced as mapping(old_id, new_id) says; rows without one drop out."""
    return rows.join(mapping, rows[column] == mapping["old_id"]).withColumn(column, F.col("new_id")).drop("old_id", "new_id")


def content_mapping(exported: DataFrame, contents: DataFrame) -> DataFrame:
    """old_id and new_id of contents of equal sha1, md5 and size."""
    return exported.select(F.col("pfile_pk").alias("old_id"), "sha1", "md5", "size").join(contents.select(F.col("pfile_pk").alias("new_id"), "sha1", "md5", "size"), ["sha1", "md5", "size"]).select("old_id", "new_id")


def declared_licenses(paths: DataFrame) -> DataFrame:
    """upload_fk, license: names of files in a LICENSES folder, without .txt."""
    inside = F.regexp_extract("path", r"/LICENSES/([^/]+)$", 1)
    return paths.filter(inside != "").select("upload_fk", F.regexp_replace(inside, r"\.txt$", "").alias("license")).distinct()


def reuse_summary(declared: DataFrame, concluded: DataFrame) -> DataFrame:
    """upload_fk, license, status of declared and concluded licenses: used, unused or missing."""
    d = declared.select("upload_fk", "license").distinct().withColumn("_d", F.lit(1))
    c = concluded.select("upload_fk", "license").distinct().withColumn("_c", F.lit(1))
    status = F.when(F.col("_d").isNull(), "missing").when(F.col("_c").isNull(), "unused").otherwise("used")
    return d.join(c, ["upload_fk", "license"], "full").select("upload_fk", "license", status.alias("status"))
