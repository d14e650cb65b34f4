"""URL rules by a sort-merge range join over reversed-host keys.

A rule (host, path) fits a URL if its host is the URL's or a parent domain of it and the URL's path starts with the
rule's. A host is written with its labels reversed and followed by a slash, which no host holds, and the path. For
each of its parent domains a URL is a point of this form; a rule is the interval of all keys that begin with its own.
Intervals nest or are apart, so a sweep over rules and points in sorted order needs a stack of the open ones only.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import table, written

#: The rules of the registered query: verdict, host, path.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
#: The verdict of a URL that no rule fits.
DEFAULT = "allow"
_EVENT = "key string, kind int, target long, rule_host string, rule_path string, rule_verdict string"
_FOUND = "target long, rule_host string, rule_path string, rule_verdict string"
_FIELDS = [pa.int64(), pa.string(), pa.string(), pa.string()]


def host_of(url: Column) -> Column:
    """What follows the first :// up to /, ?, # or the end, A-Z lower-cased; null or without ://: empty."""
    return F.translate(F.regexp_extract(_after(url), r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _after(url: Column) -> Column:
    """What follows the first ://, else the empty string."""
    at = F.locate("://", F.coalesce(url, F.lit("")))
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end."""
    return F.regexp_extract(_after(url), r"^[^/?#]*([^?#]*)", 1)


def _key(host: Column, path: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("/"), path)


def _points(urls: DataFrame) -> DataFrame:
    """One row for each host of a URL and its parent domains."""
    labels = F.split("host", r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size("labels")), lambda i: F.array_join(F.slice("labels", i, F.size("labels")), "."))
    none = [F.lit(None).cast("string").alias(c) for c in ("rule_host", "rule_path", "rule_verdict")]
    rows = urls.withColumn("labels", labels).select("target", "path", F.explode(parents).alias("domain"))
    return rows.select(_key(F.col("domain"), F.col("path")).alias("key"), F.lit(1).alias("kind"), "target", *none)


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each point the innermost rule whose interval holds it; rows come sorted by part, key and kind."""
    stack: list[tuple] = []
    part = None
    for batch in batches:
        out = []
        for here, key, kind, target, *rule in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if here != part:
                part, stack = here, []
            while stack and not key.startswith(stack[-1][0]):
                stack.pop()
            if kind == 0:
                stack.append((key, rule))
            elif stack:
                out.append((target, *stack[-1][1]))
        columns = list(zip(*out, strict=True)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _FIELDS, strict=True)], ["target", "rule_host", "rule_path", "rule_verdict"])


def innermost_rules(points: DataFrame, rules: DataFrame) -> DataFrame:
    """target and its rule for every point that a rule's interval holds.

    points and rules: the columns of _EVENT, kind 1 and 0. All are sorted over all partitions by key and target, so
    a key that many URLs share is dealt over many tasks. Rules that begin before a partition and are still open at its
    first key have a key that is a prefix of it: those are found by an equi-join on the prefixes of the first keys, of
    which there is one a partition.
    """
    salt = F.xxhash64("target")
    events = written(rules.unionByName(points).repartitionByRange(F.col("key"), F.col("kind"), salt).withColumn("part", F.spark_partition_id()), "url-events")
    firsts = events.groupBy("part").agg(F.min("key").alias("first"))
    prefixes = firsts.select("part", F.explode(F.transform(F.sequence(F.lit(1), F.length("first")), lambda i: F.substring("first", F.lit(1), i))).alias("key"))
    still_open = rules.join(prefixes, "key").select("part", *rules.columns)
    sorted_rows = events.select("part", *rules.columns).unionByName(still_open).repartition("part").sortWithinPartitions("part", "key", "kind")
    return sorted_rows.mapInArrow(_sweep, _FOUND)


def with_rules(pages: DataFrame, url: Column, rules: DataFrame, default: str = DEFAULT) -> DataFrame:
    """pages with host, path, rule (host and path of the rule that decides, else null) and verdict.

    rules: verdict (allow or block), host, path. The longest fitting rule wins (code points of host and path), of
    equally long ones that of the longer host; of rules with the same host and path a block. A rule's host is
    lower-cased (A-Z), rules with a null in any column are left out. Null urls and those without :// have an empty
    host and path, which only a rule with an empty host and path fits. Every row stays, with its columns; those of the
    names host, path, rule and verdict are replaced. Rows of the same host and path are judged once.
    """
    mark = "_" * (1 + max(len(c) for c in pages.columns))  # longer than any name, so it clashes with none
    rows = pages.withColumns({mark + "host": host_of(url), mark + "path": path_of(url)})
    distinct = rows.select(F.col(mark + "host").alias("host"), F.col(mark + "path").alias("path")).distinct()
    urls = written(distinct.withColumn("target", F.monotonically_increasing_id()), "urls")
    lower = F.translate("host", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    known = rules.select("verdict", lower.alias("host"), "path").dropna().groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    none = F.lit(None).cast("long").alias("target")
    openings = written(known.select(_key(F.col("host"), F.col("path")).alias("key"), F.lit(0).alias("kind"), none, F.col("host").alias("rule_host"), F.col("path").alias("rule_path"), F.col("verdict").alias("rule_verdict")), "url-rules")
    hits = innermost_rules(_points(urls), openings)
    rank = F.struct(F.length("rule_host") + F.length("rule_path"), F.length("rule_host"))
    best = hits.groupBy("target").agg(F.max_by(F.struct("rule_host", "rule_path", "rule_verdict"), rank).alias("best"))
    decided = urls.join(best, "target").select(F.col("host").alias(mark + "h"), F.col("path").alias(mark + "p"), F.col("best").alias(mark + "best"))
    joined = rows.join(decided, (F.col(mark + "host") == F.col(mark + "h")) & (F.col(mark + "path") == F.col(mark + "p")), "left")
    own = [F.col(f"`{c}`") for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    best = F.col(mark + "best")
    return joined.select(*own, F.col(mark + "host").alias("host"), F.col(mark + "path").alias("path"), F.concat(best["rule_host"], best["rule_path"]).alias("rule"), F.coalesce(best["rule_verdict"], F.lit(default)).alias("verdict"))


def op13_url_rules(spark, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of the url of every page."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    rules = spark.createDataFrame(RULES, "verdict string, host string, path string")
    return with_rules(pages, F.col("url"), rules).select("page_id", "host", "path", "rule", "verdict")


_SQL_RULES = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)
OP13_SQL = rf"""
WITH r(verdict, rule_host, rule_path) AS (VALUES {_SQL_RULES}),
     a AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
     p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM a)
SELECT page_id, any_value(host) AS host, any_value(path) AS path, max_by(rule_host || rule_path, (length(rule_host || rule_path), length(rule_host))) AS rule,
       coalesce(max_by(verdict, (length(rule_host || rule_path), length(rule_host))), '{DEFAULT}') AS verdict
FROM p LEFT JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY page_id
"""
