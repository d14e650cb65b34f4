"""Line deduplication by site-relative frequency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import table, written

#: A line goes if it is on more than this percentage of its host's other pages, to which PRIOR_PAGES without it are
#: added: so a host of one page loses nothing, and what is rare needs more pages to look like boilerplate.
PERCENT = 10
PRIOR_PAGES = 9
#: Hosts' line hashes up to this number (16 MB) are broadcast; more are joined by host, with a host's pages dealt
#: over so many parts.
BROADCAST_LINES, PARTS = 1_000_000, 32


def _key(line: Column) -> Column:
    """What is compared: the hash of the trimmed line."""
    return F.xxhash64(F.trim(line))


def boilerplate_lines(pages: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(host, line hash) of lines with 100 * (pages with the line - 1) > percent * (pages of the host + PRIOR_PAGES).

    pages: host, lines (array). A line counts once a page; blank lines never count. The counts are pre-aggregated
    before the shuffle, so a host that holds a third of all pages spreads by its lines.
    """
    keys = F.array_distinct(F.transform(F.filter("lines", lambda x: F.trim(x) != ""), _key))
    on_pages = pages.select("host", F.explode(keys).alias("line")).groupBy("host", "line").agg(F.count("*").alias("on_pages"))
    totals = pages.groupBy(F.col("host").alias("_host")).agg(F.count("*").alias("of_pages"))
    frequent = on_pages.filter(100 * (F.col("on_pages") - 1) > percent * (PRIOR_PAGES + 1))
    joined = frequent.join(totals, F.col("host").eqNullSafe(F.col("_host")))
    return joined.filter(100 * (F.col("on_pages") - 1) > percent * (F.col("of_pages") + PRIOR_PAGES)).select("host", "line")


def drop_boilerplate(docs: DataFrame, lines: Column, host: Column, percent: int = PERCENT, broadcast_lines: int = BROADCAST_LINES) -> DataFrame:
    """Adds host, n_lines, n_dropped and clean_text (the kept lines, joined by newlines) to docs.

    lines: an array column of a row's lines; host: the site. A null or empty line array has no lines and an
    empty clean_text; a null host is a site of its own. Rows that repeat count as pages each. Blank lines
    stay; a line just at the percentage stays. Every row stays, with all its columns; those of the same names are
    replaced. The number of boilerplate lines of a host is at most its mean number of lines times 100 / ``percent``;
    their sum is checked before it is broadcast, and beyond ``broadcast_lines`` each host's array is joined by host
    and part, so that no task gets a large host whole.
    """
    mark = "_" * (1 + max(len(c) for c in docs.columns))  # longer than any name, so it clashes with none
    own, bad_name, kept_name, part, site = (mark + x for x in ("lines", "bad", "kept", "part", "host"))
    rows = docs.withColumns({"host": host, own: F.coalesce(lines, F.array().cast("array<string>"))})
    bad = written(boilerplate_lines(rows.select("host", F.col(own).alias("lines")), percent), "boilerplate")
    by_host = bad.groupBy("host").agg(F.collect_list("line").alias(bad_name)).withColumnRenamed("host", site)
    same = F.col("host").eqNullSafe(F.col(site))
    if bad.count() <= broadcast_lines:
        joined = rows.join(F.broadcast(by_host), same, "left")
    else:
        by_host = by_host.withColumn(part, F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
        rows = rows.withColumn(part + "_", F.pmod(F.hash(own), F.lit(PARTS)))
        joined = rows.join(by_host, same & (F.col(part) == F.col(part + "_")), "left").drop(part, part + "_")
    stays = lambda x: (F.trim(x) == "") | ~F.array_contains(bad_name, _key(x))
    kept = F.when(F.col(bad_name).isNull(), F.col(own)).otherwise(F.filter(own, stays))
    out = joined.withColumn(kept_name, kept).withColumns({"n_lines": F.size(own).cast("long"), "n_dropped": (F.size(own) - F.size(kept_name)).cast("long")})
    return out.withColumn("clean_text", F.array_join(kept_name, "\n")).drop(kept_name, own, bad_name, site)


def html_lines(html: Column) -> Column:
    """The text lines of raw HTML: what stands between tags, trimmed, without blank ones and scripts."""
    bare = F.regexp_replace(html, r"(?s)<(script|style)[^>]*>.*?</(script|style)>|<[^>]*>", "\n")
    return F.filter(F.transform(F.split(bare, "\n"), lambda x: F.trim(x)), lambda x: x != "")


def host_of(url: Column) -> Column:
    """The host of an absolute URL, else null."""
    return F.nullif(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.lit(""))


def text_lines(text: Column) -> Column:
    return F.split(text, "\n")


def op9_line_dedup(spark, sf_dir: str) -> DataFrame:
    """All pages with the lines that are boilerplate on their host removed."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return drop_boilerplate(pages, html_lines(F.col("html")), host_of(F.col("url"))).select("page_id", "host", "n_lines", "n_dropped", "clean_text")


OP9_SQL = rf"""
WITH p AS (SELECT page_id, nullif(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), '') AS host,
                  list_filter(list_transform(string_split(regexp_replace(coalesce(html, ''), '(?s)<(script|style)[^>]*>.*?</(script|style)>|<[^>]*>', chr(10), 'g'), chr(10)), lambda x: trim(x)), lambda x: x <> '') AS lines FROM pages),
     n AS (SELECT host, count(*) AS of_pages FROM p GROUP BY host),
     c AS (SELECT host, line, count(DISTINCT page_id) AS on_pages FROM (SELECT page_id, host, unnest(lines) AS line FROM p) GROUP BY host, line),
     b AS (SELECT c.host, list(line) AS bad FROM c JOIN n ON c.host IS NOT DISTINCT FROM n.host WHERE 100 * (on_pages - 1) > {PERCENT} * (of_pages + {PRIOR_PAGES}) GROUP BY c.host),
     k AS (SELECT page_id, p.host, lines, CASE WHEN bad IS NULL THEN lines ELSE list_filter(lines, lambda x: NOT list_contains(bad, x)) END AS kept FROM p LEFT JOIN b ON p.host IS NOT DISTINCT FROM b.host)
SELECT page_id, host, len(lines)::BIGINT AS n_lines, (len(lines) - len(kept))::BIGINT AS n_dropped, array_to_string(kept, chr(10)) AS clean_text FROM k
"""
