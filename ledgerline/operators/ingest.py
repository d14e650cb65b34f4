"""From raw files to distinct contents and tree rows."""

from __future__ import annotations

import mimetypes

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.content import ARTIFACT, CONTAINER, fingerprint
from ledgerline.functions.text import clean_name

from .magic import by_content

# Names of version-control metadata that are not ingested.
SCM_NAMES = ["CVS", ".cvsignore", ".svn", ".git", ".gitignore", ".hg", ".bzr"]
# MIME types by extension.
MIME_BY_EXTENSION = {
    "c": "text/x-csrc", "h": "text/x-chdr", "py": "text/x-python", "txt": "text/plain", "md": "text/markdown", "html": "text/html",
    "xml": "application/xml", "json": "application/json", "gz": "application/gzip", "zip": "application/zip", "tar": "application/x-tar", "pdf": "application/pdf",
}
DEFAULT_MIME = "application/octet-stream"


def with_fingerprint(files: DataFrame, content: Column) -> DataFrame:
    return files.select("*", *fingerprint(content))


def distinct_contents(files: DataFrame, item: str, content: Column) -> tuple[DataFrame, DataFrame]:
    """Distinct contents and the content of each item.

    Returns contents(pfile_pk, sha1, md5, size, copies) and items(item, pfile_pk), where pfile_pk is the least
    item of the content. Contents shuffle as 30-byte keys with map-side sums, so any number of copies is cheap.
    Items without content (null) are in neither.
    """
    keyed = files.filter(content.isNotNull()).select(item, F.sha1(content).alias("sha1"), F.md5(content).alias("md5"), F.octet_length(content).cast("long").alias("size"))
    contents = keyed.groupBy("sha1", "md5", "size").agg(F.min(item).alias("pfile_pk"), F.count("*").alias("copies"))
    return contents, keyed.join(contents.select("sha1", "md5", "size", "pfile_pk"), ["sha1", "md5", "size"]).select(item, "pfile_pk")


def without_scm(files: DataFrame, name: str = "name") -> DataFrame:
    """Files that are no version-control metadata; rows without a name stay."""
    return files.filter(~F.coalesce(F.col(name).isin(SCM_NAMES), F.lit(False)))


def mime_type(name: Column, content: Column | None = None, types: dict[str, str] | None = None) -> Column:
    """By the rules of magic.py if there is a content, then by extension, then the default.

    types: further types by extension (without dot); Python's own table of a system's types if none are given.
    """
    extension = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    known = ({k[1:]: v for k, v in mimetypes.types_map.items()} if types is None else types) | MIME_BY_EXTENSION
    by_name = F.create_map(*[F.lit(x) for pair in sorted(known.items()) for x in pair])[extension]
    if content is None:
        return F.coalesce(by_name, F.lit(DEFAULT_MIME))
    return F.coalesce(by_content(content), by_name, F.lit(DEFAULT_MIME))


def tree_rows(files: DataFrame, upload: int = 1) -> DataFrame:
    """Tree rows for files(path, pfile_pk): every folder of a path becomes a container.

    Ids are hashes of the path, so that no numbering pass over all rows is needed; the root has a null parent.
    Repeated paths give one row, that of the least pfile_pk.
    """
    key = lambda p: F.xxhash64(F.lit(upload), p)
    parts = F.split(F.regexp_replace("path", "^/+|/+$", ""), "/+")
    leaves = files.filter("path is not null").select(F.array_join(parts, "/").alias("path"), "pfile_pk").groupBy("path").agg(F.min("pfile_pk").alias("pfile_fk"))
    steps = F.transform(F.sequence(F.lit(0), F.size(F.split("path", "/")) - 1), lambda n: F.array_join(F.slice(F.split("path", "/"), 1, n), "/"))
    folders = leaves.select(F.explode(steps).alias("path")).distinct().withColumn("pfile_fk", F.lit(None).cast("long"))
    rows = leaves.withColumn("mode", F.lit(0)).union(folders.withColumn("mode", F.lit(CONTAINER)))
    parent = F.regexp_replace("path", "(^|/)[^/]*$", "")
    name = clean_name(F.regexp_extract("path", "([^/]*)$", 1))
    return rows.select(
        F.lit(upload).alias("upload_fk"), key(F.col("path")).alias("item"), F.when(F.col("path") != "", key(parent)).alias("parent"), "pfile_fk",
        F.when(name.startswith("artifact."), F.col("mode").bitwiseOR(F.lit(ARTIFACT))).otherwise(F.col("mode")).alias("mode"), name.alias("name"),
    )
