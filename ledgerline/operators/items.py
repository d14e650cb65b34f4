"""Selecting items: searches, attribute filters, access, pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.content import is_container, is_plain


def plain_files(items: DataFrame) -> DataFrame:
    """Items with a content that are neither container nor artifact."""
    return items.filter(is_plain(F.col("mode")) & (F.coalesce("pfile_fk", F.lit(0)) != 0))


def by_attributes(items: DataFrame, *, extension: str | None = None, head: str | None = None, parent: int | None = None, findings: DataFrame | None = None, license: int | None = None, decided: DataFrame | None = None) -> DataFrame:
    """Items that meet all conditions given: extension and name head (any case), parent, a license found, not yet decided."""
    if extension is not None:
        items = items.filter(F.col("name").ilike(f"%.{extension}"))
    if head is not None:
        items = items.filter(F.col("name").ilike(f"{head}%"))
    if parent is not None:
        items = items.filter(F.col("parent") == parent)
    if findings is not None:
        hits = findings.filter("rf_fk is not null" if license is None else F.col("rf_fk") == license)
        items = items.join(hits.select("pfile_fk"), "pfile_fk", "left_semi")
    if decided is not None:
        items = items.join(decided.select("item"), "item", "left_anti")
    return items


def without_findings(items: DataFrame, *findings: DataFrame) -> DataFrame:
    """Plain files of whose content none of the tables has a finding (a row with a null license is none)."""
    rows = plain_files(items)
    for found in findings:
        if "rf_fk" in found.columns:
            found = found.filter("rf_fk is not null")
        rows = rows.join(found.select("pfile_fk"), "pfile_fk", "left_anti")
    return rows


def not_cleared(items: DataFrame, decisions: DataFrame, by_content: bool = False) -> DataFrame:
    """Plain files without a final decision, on the item or on its content; work in progress is not final."""
    key = "pfile_fk" if by_content else "item"
    return plain_files(items).join(decisions.filter("decision_type > 0").select(key), key, "left_anti")


def search(items: DataFrame, *, name: str | None = None, kind: str = "all", size: tuple[int | None, int | None] = (None, None), tags: DataFrame | None = None, licenses: DataFrame | None = None, texts: DataFrame | None = None, upload: int | None = None, bounds: tuple[int, int] | None = None) -> DataFrame:
    """Distinct items that meet all criteria given.

    name: a pattern of LIKE, any case. kind: ``containers``, ``files`` or ``all``. size: least and most bytes of
    the content (column size). tags: item; licenses and texts: pfile_fk of contents that hold a wanted finding.
    """
    if name is not None:
        items = items.filter(F.col("name").ilike(name))
    if kind != "all":
        items = items.filter(is_container(F.col("mode")) if kind == "containers" else ~is_container(F.col("mode")))
    for bound, test in zip(size, (Column.__ge__, Column.__le__), strict=True):
        if bound is not None:
            items = items.filter(test(F.col("size"), F.lit(bound)))
    if upload is not None:
        items = items.filter(F.col("upload_fk") == upload)
    if bounds is not None:
        items = items.filter(F.col("lft").between(*bounds))
    if tags is not None:
        items = items.join(tags.select("item"), "item", "left_semi")
    for found in (licenses, texts):
        if found is not None:
            items = items.join(found.select("pfile_fk"), "pfile_fk", "left_semi")
    return items.distinct()


def page(rows: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """One page of a total order; Spark keeps offset + limit rows of each task only."""
    return rows.orderBy(*order).offset(offset).limit(limit)


def licenses_named(licenses: DataFrame, pattern: str | None = None, exclude: list[int] | None = None) -> DataFrame:
    """License rows by a part of the short name (any case) without those excluded, in order of name."""
    if pattern:
        licenses = licenses.filter(F.col("shortname").ilike(f"%{pattern}%"))
    if exclude:
        licenses = licenses.filter(~F.col("rf_pk").isin(exclude))
    return licenses.orderBy("shortname", "rf_pk")


def accessible(uploads: DataFrame, group_perms: DataFrame, group: int, least: int = 1) -> DataFrame:
    """Uploads(upload_fk, public_perm) that a group may read: by its own permission, else by the public one."""
    own = group_perms.filter((F.col("group_fk") == group) & (F.col("perm") >= least)).select("upload_fk")
    public = uploads.filter(F.col("public_perm") >= least).select("upload_fk")
    return uploads.join(own.union(public), "upload_fk", "left_semi")


def without_mime(items: DataFrame, contents: DataFrame, excluded: list[str]) -> DataFrame:
    """Items whose content is not of an excluded MIME type; contents of unknown type stay."""
    return items.join(contents.filter(F.col("mime").isin(excluded)).select("pfile_fk"), "pfile_fk", "left_anti")


def tags_of(items: DataFrame, file_tags: DataFrame, item_tags: DataFrame) -> DataFrame:
    """upload_fk and tag: tags of the contents and of the items, each once."""
    by_file = items.join(file_tags, "pfile_fk").select("upload_fk", "tag")
    return by_file.union(items.join(item_tags, "item").select("upload_fk", "tag")).distinct()


def sightings(items: DataFrame) -> DataFrame:
    """item, other: further items of other uploads with the same content, as the content's list of uploads (Q11).

    Returns pfile_fk, n_items, n_uploads for contents seen in two or more uploads, one row a content instead of
    pairs of items.
    """
    return items.filter("pfile_fk is not null").groupBy("pfile_fk").agg(F.count("*").alias("n_items"), F.countDistinct("upload_fk").alias("n_uploads")).filter("n_uploads > 1")


def browse(uploads: DataFrame, allowed: DataFrame, folders: DataFrame, name: str | None = None) -> DataFrame:
    """Uploads of a folder that may be seen, by name and newest first (Q14)."""
    rows = uploads.join(allowed.select("upload_fk"), "upload_fk", "left_semi").join(folders.select("upload_fk"), "upload_fk", "left_semi")
    rows = rows.filter(F.col("upload_name").ilike(f"%{name}%")) if name else rows
    return rows.orderBy(F.desc("upload_ts"), "upload_fk")
