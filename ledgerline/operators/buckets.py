"""Rules that put files into buckets by their licenses and names.

Rules are a short ordered list written by a user, so they are plan-time values; a file's licenses are an array.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.content import is_container, is_plain


@dataclass
class Bucket:
    """bucket: its id. kind: every, only, regex, exec, file, default. stop: no later rule is tried after a hit.

    sets: for ``every`` lists of short names of which one must be held in full; for ``only`` one list of those
    allowed. pattern: for ``regex``, on any license name. tests: for ``file`` rows (field, pattern, op, field,
    pattern) with field ``name`` or ``license`` and op ``and``, ``or``, ``not`` or None; one row must hold.
    predicate: for ``exec``, from the name and the array of licenses to a boolean column (a pandas UDF, say).
    """

    bucket: int
    kind: str
    sets: list[list[str]] = field(default_factory=list)
    pattern: str = ""
    tests: list[tuple] = field(default_factory=list)
    predicate: Callable[[Column, Column], Column] | None = None
    stop: bool = False
    packages_only: bool = False


def _names(values: list[str]) -> Column:
    return F.array(*[F.lit(x) for x in values]).cast("array<string>")


def _any_license(licenses: Column, pattern: str) -> Column:
    return F.exists(licenses, lambda x: x.rlike(pattern))


def _row(test: tuple, name: Column, licenses: Column) -> Column:
    def one(what: str, pattern: str) -> Column:
        return name.rlike(pattern) if what == "name" else _any_license(licenses, pattern)

    left, op = one(*test[:2]), (test[2] if len(test) > 2 else None)
    if op is None:
        return left
    right = one(*test[3:])
    return {"and": left & right, "or": left | right, "not": left & ~right}[op]


def hit(rule: Bucket, name: Column, licenses: Column) -> Column:
    """Whether a rule holds, for a rule that looks at the file itself."""
    if rule.kind == "every":
        tests = [F.size(F.array_except(_names(s), licenses)) == 0 for s in rule.sets]
        return F.coalesce(F.array_contains(F.array(*tests), True), F.lit(False)) if tests else F.lit(False)
    if rule.kind == "only":
        return (F.size(licenses) > 0) & (F.size(F.array_except(licenses, _names(rule.sets[0]))) == 0)
    if rule.kind == "regex":
        return _any_license(licenses, rule.pattern)
    if rule.kind == "file":
        return F.array_contains(F.array(*[_row(t, name, licenses) for t in rule.tests]), True)
    if rule.kind == "exec":
        return rule.predicate(name, licenses)
    return F.lit(False)


def leaf_buckets(files: DataFrame, rules: list[Bucket]) -> DataFrame:
    """item and bucket for files(item, name, licenses array, is_package) (C17).

    Rules are tried in order; one with ``stop`` that holds ends the list. The default bucket takes files that no
    rule took. Both operands of a two-part test are always evaluated. Where licenses are null nothing is known of them:
    no test of a license holds, neither one that asks for it nor one that rules it out. No shuffle.
    """
    open_, any_hit, kept = F.lit(True), F.lit(False), []
    for rule in rules:
        fits = F.coalesce(hit(rule, F.col("name"), F.col("licenses")), F.lit(False)) if rule.kind != "default" else ~any_hit
        if rule.packages_only:
            fits = fits & F.col("is_package")
        fits = open_ & fits
        kept.append(F.when(fits, F.lit(rule.bucket)))
        any_hit = any_hit | fits
        if rule.stop:
            open_ = open_ & ~fits
    return files.select("item", F.explode(F.filter(F.array(*kept), lambda x: x.isNotNull())).alias("bucket"))


def container_buckets(items: DataFrame, leaves: DataFrame) -> DataFrame:
    """upload_fk, item, bucket: the buckets of anything below a container.

    items: upload_fk, item, mode, parent_ids (array of all ancestors). Buckets are handed to ancestors by one
    explode of distinct (ancestor, bucket) pairs, summed before the shuffle.
    """
    own = leaves.join(items.select("upload_fk", "item", "parent_ids"), "item")
    return own.select("upload_fk", F.explode("parent_ids").alias("item"), "bucket").distinct().join(items.filter(is_container(F.col("mode"))).select("item"), "item", "left_semi").select("upload_fk", "item", "bucket")


def bucket_histogram(items: DataFrame, leaves: DataFrame, order: DataFrame | None = None) -> DataFrame:
    """bucket and files: plain files of each bucket, in the order of a report (bucket, rank) or by number (Q3)."""
    counts = items.filter(is_plain(F.col("mode"))).join(leaves, "item").groupBy("bucket").agg(F.count("*").alias("files"))
    return counts.orderBy("bucket") if order is None else counts.join(order, "bucket", "left").orderBy("rank", "bucket").select("bucket", "files")


def has_bucket(items: DataFrame, leaves: DataFrame, bucket: int) -> DataFrame:
    """upload_fk of trees in which a file is in the bucket (Q4)."""
    return items.join(leaves.filter(F.col("bucket") == bucket), "item", "left_semi").select("upload_fk").distinct()
