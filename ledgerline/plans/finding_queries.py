"""Queries over findings, histograms, text findings and runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline.operators import findings as O
from ledgerline.operators import progress as P

from . import model as m
from .registry import query

_AGENTS = "(SELECT * FROM (VALUES (1, 'keyword'), (2, 'phrase'), (3, 'tag')) t(agent_fk, agent_name))"
_HISTOGRAM = """SELECT coalesce(shortname, 'No_license_found') AS shortname, count(*) AS files, count(DISTINCT i.pfile_fk) AS contents
    FROM m_files i LEFT JOIN (SELECT pfile_fk, shortname FROM m_findings JOIN m_licenses ON rf_fk = rf_pk WHERE agent_fk IN (1, 2)) f ON i.pfile_fk = f.pfile_fk GROUP BY 1"""
_CONCLUDED = "SELECT license_type || ' ' || l.rf_pk % 5 AS shortname, count(DISTINCT item) AS items FROM m_events e JOIN m_licenses l ON e.rf_fk = l.rf_pk WHERE NOT removed GROUP BY 1"


def _histogram(spark, sf):
    return O.license_histogram(m.items(spark, sf), m.findings(spark, sf), m.licenses(spark, sf), [1, 2])


@query(f"SELECT agent_name, count(*) AS n, CAST(sum(pct) AS BIGINT) AS pct FROM m_items i JOIN m_findings f ON i.pfile_fk = f.pfile_fk JOIN m_licenses ON rf_fk = rf_pk JOIN {_AGENTS} a ON a.agent_fk = f.agent_fk GROUP BY 1")
def file_matches(spark, sf):
    agents = spark.createDataFrame([(1, "keyword"), (2, "phrase"), (3, "tag")], "agent_fk int, agent_name string")
    return O.file_matches(m.items(spark, sf), m.findings(spark, sf), m.licenses(spark, sf), agents).groupBy("agent_name").agg(F.count("*").alias("n"), F.sum("pct").alias("pct"))


@query(_HISTOGRAM)
def license_histogram(spark, sf):
    return _histogram(spark, sf)


@query(_CONCLUDED)
def license_multiplicity(spark, sf):
    named = m.events(spark, sf).join(m.licenses(spark, sf), F.col("rf_fk") == F.col("rf_pk")).selectExpr("event_pk decision_pk", "concat(license_type, ' ', rf_pk % 5) shortname", "removed")
    return O.concluded_multiplicity(m.decisions(spark, sf), named)


@query(f"""SELECT coalesce(a.shortname, b.shortname) AS shortname, coalesce(files, 0) AS scanner_count, coalesce(contents, 0) AS unique_count, coalesce(items, 0) AS concluded_count
    FROM ({_HISTOGRAM}) a FULL JOIN (SELECT shortname, count(DISTINCT item) AS items FROM m_events JOIN m_licenses ON rf_fk = rf_pk WHERE NOT removed GROUP BY 1) b ON a.shortname = b.shortname""")
def merged_histogram(spark, sf):
    named = m.events(spark, sf).join(m.licenses(spark, sf), F.col("rf_fk") == F.col("rf_pk")).selectExpr("event_pk decision_pk", "shortname", "removed")
    return O.merged_histogram(_histogram(spark, sf), O.concluded_multiplicity(m.decisions(spark, sf), named))


_OVERLAID = "SELECT t.fk, t.item, coalesce(nullif(trim(o.content), ''), t.content) AS content, coalesce(o.is_enabled, t.is_enabled) AS is_enabled FROM m_texts t LEFT JOIN m_overlay o ON t.fk = o.fk AND t.item = o.item"


def _overlaid(spark, sf):
    return O.with_overlay(m.texts(spark, sf), m.overlay(spark, sf))


@query(f"SELECT fk, item, content, md5(content) AS hash, is_enabled FROM ({_OVERLAID})")
def overlay_content(spark, sf):
    return _overlaid(spark, sf)


@query(f"SELECT content, md5(content) AS hash, count(*) AS copies FROM ({_OVERLAID}) WHERE is_enabled AND trim(content) <> '' GROUP BY 1, 2")
def copyright_histogram(spark, sf):
    return O.content_histogram(_overlaid(spark, sf))


@query(f"SELECT content, md5(content) AS hash, count(*) AS copies FROM ({_OVERLAID}) WHERE NOT is_enabled AND content ILIKE '%urgent%' GROUP BY 1, 2")
def user_findings_histogram(spark, sf):
    return O.content_histogram(_overlaid(spark, sf), "urgent", enabled=False)


@query("SELECT i.item, coalesce(string_agg(DISTINCT shortname, ', ' ORDER BY shortname), 'No_license_found') AS license_list FROM m_files i LEFT JOIN m_findings f ON i.pfile_fk = f.pfile_fk LEFT JOIN m_licenses ON rf_fk = rf_pk GROUP BY 1")
def file_license_lists(spark, sf):
    return O.license_lists(m.items(spark, sf).filter("mode & 805306368 = 0"), m.findings(spark, sf), m.licenses(spark, sf))


@query("SELECT i.item, i.pfile_fk, max(f.agent_fk) AS agent_fk FROM m_items i JOIN m_findings f ON i.pfile_fk = f.pfile_fk JOIN m_licenses ON rf_fk = rf_pk WHERE shortname LIKE 'small ring %' AND shortname = 'small ring Brand#2' GROUP BY 1, 2")
def files_with_license(spark, sf):
    return O.files_with_license(m.items(spark, sf), m.findings(spark, sf), m.licenses(spark, sf), "small ring Brand#2")


@query("SELECT pfile_fk, rf_fk, agent_fk, max(pct) AS pct FROM m_findings WHERE rf_fk IS NOT NULL GROUP BY 1, 2, 3")
def best_match(spark, sf):
    return O.best_match(m.findings(spark, sf)).select("pfile_fk", "rf_fk", "agent_fk", "pct")


@query("SELECT upload_fk, agent_name, agent_fk, max(run_pk) AS run_pk FROM m_runs WHERE success GROUP BY 1, 2, 3")
def latest_agent_run(spark, sf):
    return O.latest_runs(m.runs(spark, sf))


@query("SELECT i.upload_fk, f.agent_fk, count(*) AS n FROM m_items i JOIN m_findings f ON i.pfile_fk = f.pfile_fk WHERE (i.upload_fk, f.agent_fk) IN (SELECT upload_fk, agent_fk FROM m_runs WHERE success) GROUP BY 1, 2")
def latest_findings(spark, sf):
    return O.latest_findings(m.items(spark, sf), m.findings(spark, sf), m.runs(spark, sf)).groupBy("upload_fk", "agent_fk").agg(F.count("*").alias("n"))


@query("SELECT fk, item FROM m_texts WHERE item NOT IN (SELECT item FROM m_events)")
def orphaned_rows(spark, sf):
    return O.orphans(m.texts(spark, sf), m.events(spark, sf), "item").select("fk", "item")


@query("SELECT t.fk, i.item, t.hash, FALSE AS is_enabled FROM m_texts t JOIN m_items i ON t.pfile_fk = i.pfile_fk WHERE NOT t.is_enabled")
def deactivated_findings(spark, sf):
    return O.deactivated(m.texts(spark, sf), m.items(spark, sf))


@query("SELECT l_orderkey AS fl_fk, min(CAST(l_quantity AS INTEGER)) AS region_start, max(CAST(l_quantity AS INTEGER) + l_linenumber) AS region_end FROM lineitem GROUP BY 1")
def highlight_region(spark, sf):
    return O.region(m.table(spark, sf, "lineitem").selectExpr("l_orderkey fl_fk", "cast(l_quantity as int) start", "l_linenumber len"))


@query("""SELECT pfile_fk, min(s) AS start, max(e) AS "end" FROM (SELECT *, sum(new) OVER (PARTITION BY pfile_fk ORDER BY s, e ROWS UNBOUNDED PRECEDING) g FROM (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY pfile_fk ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END new
    FROM (SELECT l_orderkey AS pfile_fk, CAST(l_quantity AS INTEGER) AS s, CAST(l_quantity AS INTEGER) + l_linenumber AS e FROM lineitem))) GROUP BY pfile_fk, g""")
def merged_highlights(spark, sf):
    return O.merged_highlights(m.table(spark, sf, "lineitem").selectExpr("l_orderkey pfile_fk", "cast(l_quantity as int) start", "l_linenumber len"))


@query("""SELECT pfile_fk, s AS start, e AS "end", CAST(level AS BIGINT) AS level FROM (SELECT pfile_fk, edge AS s, lead(edge) OVER (PARTITION BY pfile_fk ORDER BY edge) AS e, sum(d) OVER (PARTITION BY pfile_fk ORDER BY edge) AS level FROM (
    SELECT pfile_fk, edge, sum(d) AS d FROM (SELECT l_orderkey AS pfile_fk, CAST(l_quantity AS INTEGER) AS edge, 1 AS d FROM lineitem UNION ALL SELECT l_orderkey, CAST(l_quantity AS INTEGER) + l_linenumber, -1 FROM lineitem) GROUP BY 1, 2)) WHERE level > 0""")
def highlight_sections(spark, sf):
    return O.highlight_sections(m.table(spark, sf, "lineitem").selectExpr("l_orderkey pfile_fk", "cast(l_quantity as int) start", "l_linenumber len"))


_HALF = "SELECT shortname, count(*) AS files FROM m_files i JOIN m_findings f ON i.pfile_fk = f.pfile_fk JOIN m_licenses ON rf_fk = rf_pk WHERE upload_fk = {} GROUP BY 1"


@query(f"SELECT coalesce(a.shortname, b.shortname) AS shortname, coalesce(a.files, 0) AS files_1, coalesce(b.files, 0) AS files_2 FROM ({_HALF.format(0)}) a FULL JOIN ({_HALF.format(1)}) b ON a.shortname = b.shortname")
def two_tree_histogram(spark, sf):
    half = lambda n: O.license_histogram(m.items(spark, sf).filter(f"upload_fk = {n}"), m.findings(spark, sf), m.licenses(spark, sf)).filter("shortname != 'No_license_found'")
    return O.two_tree_histogram(half(0), half(1))


@query("SELECT item, pfile_fk FROM m_items WHERE pfile_fk IN (SELECT pfile_fk FROM m_texts WHERE hash = md5('Copyright 1997 1-URGENT'))")
def files_with_text(spark, sf):
    import hashlib

    return O.files_with_text(m.items(spark, sf), m.texts(spark, sf), hashlib.md5(b"Copyright 1997 1-URGENT").hexdigest()).select("item", "pfile_fk")


@query("SELECT DISTINCT item, content FROM m_texts WHERE regexp_matches(content, '199[5-7]') AND NOT regexp_matches(content, 'LOW$') AND pfile_fk NOT IN (SELECT pfile_fk FROM m_findings WHERE rf_fk % 3 = 0)")
def text_lines(spark, sf):
    return O.text_lines(m.texts(spark, sf), "199[5-7]", "LOW$", m.findings(spark, sf).filter("rf_fk % 3 = 0"))


@query("SELECT user_id, min(ts) FILTER (event_type = 'signup') AS \"first\", max(ts) FILTER (event_type = 'purchase') AS \"last\" FROM events GROUP BY 1")
def event_durations(spark, sf):
    return P.durations(m.table(spark, sf, "events"), "user_id", "signup", "purchase").select("user_id", "first", "last")


@query("SELECT o_custkey AS upload_fk, count(*) AS total, count(s) AS checked, count(*) FILTER (s = 200) AS ok FROM (SELECT o_custkey, CASE o_orderstatus WHEN 'F' THEN 200 WHEN 'O' THEN 404 END AS s FROM orders) GROUP BY 1")
def status_sums(spark, sf):
    return P.status_sums(m.table(spark, sf, "orders").selectExpr("o_custkey upload_fk", "case o_orderstatus when 'F' then 200 when 'O' then 404 end status"), "upload_fk")


@query("SELECT c_nationkey AS folder, o_orderpriority AS group_fk, count(DISTINCT c_custkey) AS uploads FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_orderstatus <> 'O' GROUP BY 1, 2")
def folder_upload_counts(spark, sf):
    contents = m.table(spark, sf, "customer").selectExpr("c_nationkey folder", "c_custkey upload_fk")
    perms = m.table(spark, sf, "orders").selectExpr("o_custkey upload_fk", "o_orderpriority group_fk", "if(o_orderstatus = 'O', 0, 1) perm")
    return P.folder_uploads(contents, perms)


@query("SELECT l_partkey AS child, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 1 AND bool_or(l_suppkey = 7)")
def removable_contents(spark, sf):
    return P.removable(m.table(spark, sf, "lineitem").selectExpr("l_partkey child", "l_suppkey folder"), 7)


@query("SELECT l_partkey AS upload_fk, max(round((100 - l_quantity) / (l_quantity / l_linenumber))) AS eta_seconds FROM lineitem GROUP BY 1")
def scan_progress(spark, sf):
    runs = m.table(spark, sf, "lineitem").selectExpr("l_partkey upload_fk", "l_quantity processed", "100 total", "l_linenumber seconds")
    return P.progress(runs).select("upload_fk", "eta_seconds")


@query("SELECT o_orderpriority AS agent_name, o_orderstatus AS status, count(*) AS jobs FROM orders GROUP BY 1, 2")
def job_counts(spark, sf):
    return P.job_counts(m.table(spark, sf, "orders").selectExpr("o_orderpriority agent_name", "o_orderstatus status"))


@query("SELECT o_orderkey AS job_fk FROM orders WHERE o_orderstatus = 'P' AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem JOIN orders ON l_partkey = o_orderkey WHERE o_orderstatus <> 'F')")
def ready_jobs(spark, sf):
    jobs = m.table(spark, sf, "orders").selectExpr("o_orderkey job_fk", "case o_orderstatus when 'P' then 'waiting' when 'F' then 'done' else 'running' end status")
    return P.ready_jobs(jobs, m.table(spark, sf, "lineitem").selectExpr("l_orderkey job_fk", "l_partkey depends_on")).select("job_fk")


@query("SELECT o_custkey AS upload_fk, count(*) FILTER (o_orderstatus = 'F') AS source, count(*) FILTER (o_orderstatus = 'P') AS \"binary\", count(*) FILTER (o_orderstatus = 'P' AND NOT EXISTS (SELECT 1 FROM orders s WHERE s.o_custkey = o.o_custkey AND s.o_orderstatus = 'F' AND s.o_orderpriority = o.o_orderpriority)) AS binary_without_source FROM orders o GROUP BY 1")
def package_counts(spark, sf):
    p = m.table(spark, sf, "orders").selectExpr("o_custkey upload_fk", "case o_orderstatus when 'F' then 'source' when 'P' then 'binary' else 'other' end kind", "o_orderpriority package", "o_orderpriority source_package")
    return P.package_counts(p)


@query("SELECT s_name AS project, count(DISTINCT l_orderkey // 2) AS contents FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1 HAVING count(DISTINCT l_orderkey // 2) >= 550")
def projects_of_contents(spark, sf):
    lookups = m.table(spark, sf, "lineitem").join(m.table(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).selectExpr("l_orderkey div 2 pfile_fk", "s_name project")
    return P.projects_of_contents(lookups, 550)


@query("SELECT c_custkey AS upload_fk, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) AS priority FROM customer")
def renumbered_priorities(spark, sf):
    return P.priorities(m.table(spark, sf, "customer").selectExpr("c_custkey upload_fk", "c_nationkey", "c_acctbal"), "c_nationkey", "c_acctbal").select("upload_fk", "priority")


@query("SELECT upload_fk, count(*) AS files, count(d.item) AS cleared FROM m_files f LEFT JOIN (SELECT DISTINCT item FROM m_decisions WHERE decision_type > 0) d ON f.item = d.item GROUP BY 1")
def clearing_progress(spark, sf):
    return P.clearing_progress(m.items(spark, sf).filter("mode & 805306368 = 0"), m.decisions(spark, sf)).select("upload_fk", "files", "cleared")


@query("SELECT rf_pk FROM m_licenses WHERE rf_pk NOT IN (SELECT rf_fk FROM (SELECT item, rf_fk, arg_max(removed, event_pk) AS r FROM m_events GROUP BY 1, 2) WHERE NOT r)")
def deletable_candidates(spark, sf):
    return P.newest_candidates(m.licenses(spark, sf), m.events(spark, sf)).select("rf_pk")
