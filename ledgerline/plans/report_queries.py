"""Queries that make the tables of reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline.functions.text import license_expression, risk_band
from ledgerline.operators import findings as O
from ledgerline.operators import reports as R
from ledgerline.operators import tree as T
from ledgerline.sources import sbom as S
from ledgerline.sources import tables as C

from . import model as m
from .registry import query


@query("SELECT source AS upload_fk, sha1(string_agg(sha1(text), '' ORDER BY sha1(text))) AS code FROM documents WHERE text IS NOT NULL GROUP BY 1")
def verification_code(spark, sf):
    docs = m.table(spark, sf, "documents")
    rows = docs.filter("text is not null").selectExpr("source upload_fk", "doc_id pfile_fk", "0 parent")
    return R.verification_codes(rows, docs.select(F.col("doc_id").alias("pfile_pk"), F.sha1("text").alias("sha1")))


_STATEMENTS = "SELECT o_orderkey AS pk, o_orderpriority AS content, o_orderstatus AS text, CASE WHEN o_custkey % 50 = 0 THEN 'see ' || o_custkey END AS comment, CASE WHEN o_custkey % 3 = 0 THEN 'thanks ' || o_custkey % 5 ELSE '' END AS acknowledgement, 'dir/' || o_custkey AS path, md5(CAST(o_custkey AS VARCHAR)) AS hash FROM orders"


def _statements(spark, sf):
    return m.table(spark, sf, "orders").selectExpr("o_orderkey pk", "o_orderpriority content", "o_orderstatus text", "if(o_custkey % 50 = 0, concat('see ', o_custkey), null) comment", "if(o_custkey % 3 = 0, concat('thanks ', o_custkey % 5), '') acknowledgement", "concat('dir/', o_custkey) path", "md5(cast(o_custkey as string)) hash")


@query(f"""SELECT content, text, string_agg(DISTINCT path, '; ' ORDER BY path) AS files, string_agg(DISTINCT hash, '; ' ORDER BY hash) AS hashes, coalesce(string_agg(DISTINCT nullif(acknowledgement, ''), '; ' ORDER BY nullif(acknowledgement, '')), '') AS acknowledgements,
    max(coalesce(comment, '')) AS comment, count(*) AS n FROM ({_STATEMENTS}) GROUP BY content, text, CASE WHEN trim(coalesce(comment, '')) <> '' THEN pk ELSE -1 END""")
def report_grouping(spark, sf):
    return R.grouped_statements(_statements(spark, sf))


@query(f"SELECT md5(content || '.' || text) AS group_key, content, acknowledgement, string_agg(path, ', ' ORDER BY length(path), path) AS files FROM (SELECT DISTINCT content, text, acknowledgement, path FROM ({_STATEMENTS})) GROUP BY 1, 2, 3")
def acknowledgement_groups(spark, sf):
    return R.acknowledgement_groups(_statements(spark, sf))


@query("SELECT s_name AS topic, CAST(s_nationkey AS VARCHAR) AS text, string_agg(DISTINCT p_name, ', ' ORDER BY p_name) AS licenses FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey WHERE s_name NOT IN ('Supplier#000000003') GROUP BY 1, 2")
def obligation_groups(spark, sf):
    used = m.table(spark, sf, "part").selectExpr("p_partkey rf_fk", "p_name shortname")
    obligations = m.table(spark, sf, "supplier").selectExpr("s_suppkey ob_fk", "s_name topic", "cast(s_nationkey as string) text")
    bridge = m.table(spark, sf, "lineitem").selectExpr("l_partkey rf_fk", "l_suppkey ob_fk").distinct()
    return R.obligation_groups(used, obligations, bridge, ["Supplier#000000003"])


@query("SELECT string_agg(DISTINCT l_returnflag, ' AND ' ORDER BY l_returnflag) AS expression, 'f' || l_orderkey AS path FROM lineitem GROUP BY l_orderkey")
def expression_files(spark, sf):
    return R.expression_files(m.table(spark, sf, "lineitem").selectExpr("l_orderkey item", "concat('f', l_orderkey) path", "l_returnflag shortname"))


@query("SELECT expression, string_agg(path, chr(10) ORDER BY path) AS files, count(*) AS n_files FROM (SELECT 'f' || l_orderkey AS path, string_agg(DISTINCT l_returnflag, ' AND ' ORDER BY l_returnflag) AS expression FROM lineitem GROUP BY 1) GROUP BY 1")
def licenses_with_files(spark, sf):
    return R.licenses_with_files(m.table(spark, sf, "lineitem").selectExpr("l_orderkey item", "concat('f', l_orderkey) path", "l_returnflag shortname"))


@query("SELECT l_orderkey, CASE WHEN count(DISTINCT l_returnflag) = 3 THEN 'N OR R' ELSE string_agg(DISTINCT CASE l_returnflag WHEN 'A' THEN 'Dual-license' ELSE l_returnflag END, ' AND ' ORDER BY CASE l_returnflag WHEN 'A' THEN 'Dual-license' ELSE l_returnflag END) END AS expression FROM lineitem GROUP BY 1")
def license_expressions(spark, sf):
    names = F.collect_set(F.when(F.col("l_returnflag") == "A", "Dual-license").otherwise(F.col("l_returnflag")))
    return m.table(spark, sf, "lineitem").groupBy("l_orderkey").agg(license_expression(names).alias("expression"))


_FLAT = """SELECT f.item, coalesce(s.l, '') AS scanner_licenses, coalesce(e.l, '') AS concluded_licenses, coalesce(t.l, '') AS copyrights, d.item IS NOT NULL AS is_cleared FROM m_files f
    LEFT JOIN (SELECT pfile_fk, string_agg(DISTINCT license_type, '; ' ORDER BY license_type) l FROM m_findings JOIN m_licenses ON rf_fk = rf_pk GROUP BY 1) s ON f.pfile_fk = s.pfile_fk
    LEFT JOIN (SELECT item, string_agg(DISTINCT CAST(rf_fk % 9 AS VARCHAR), '; ' ORDER BY CAST(rf_fk % 9 AS VARCHAR)) l FROM m_events WHERE NOT removed GROUP BY 1) e ON f.item = e.item
    LEFT JOIN (SELECT pfile_fk, string_agg(DISTINCT content, '; ' ORDER BY content) l FROM m_texts GROUP BY 1) t ON f.pfile_fk = t.pfile_fk
    LEFT JOIN (SELECT DISTINCT item FROM m_decisions WHERE decision_type > 3) d ON f.item = d.item"""


@query(_FLAT)
def files_with_licenses(spark, sf):
    scanned = m.findings(spark, sf).join(m.licenses(spark, sf), F.col("rf_fk") == F.col("rf_pk")).selectExpr("pfile_fk", "license_type shortname")
    concluded = m.events(spark, sf).filter("not removed").selectExpr("item", "cast(rf_fk % 9 as string) shortname")
    return R.files_with_licenses(m.items(spark, sf), scanned, concluded, m.texts(spark, sf), m.decisions(spark, sf))


@query("SELECT d.item, i.name, d.decision_pk FROM m_decisions d JOIN m_items i ON d.item = i.item WHERE decision_type = 6")
def clearing_section(spark, sf):
    return R.clearing_section(m.decisions(spark, sf), m.items(spark, sf), "do_not_use")


@query("SELECT a.upload_fk, a.shortname, coalesce(b.files, 0) AS files FROM (SELECT DISTINCT upload_fk, 'lic' || pfile_fk % 7 AS shortname FROM m_files) a LEFT JOIN (SELECT upload_fk, 'lic' || rf_fk % 20 AS shortname, count(DISTINCT i.item) AS files FROM m_items i JOIN m_events e ON i.item = e.item GROUP BY 1, 2) b ON a.upload_fk = b.upload_fk AND a.shortname = b.shortname")
def main_licenses(spark, sf):
    files = m.items(spark, sf).filter("mode & 805306368 = 0")
    return R.main_licenses(m.items(spark, sf), m.events(spark, sf).selectExpr("item", "concat('lic', rf_fk % 20) shortname"), files.selectExpr("upload_fk", "concat('lic', pfile_fk % 7) shortname"))


@query("""SELECT f.upload_fk, f.files, coalesce(l.n, 0) AS license_findings, coalesce(l.u, 0) AS unique_licenses, coalesce(c.n, 0) AS files_to_clear, coalesce(d.n, 0) AS files_cleared, coalesce(t.n, 0) AS copyrights FROM (SELECT upload_fk, count(*) AS files FROM m_files GROUP BY 1) f
    LEFT JOIN (SELECT upload_fk, count(*) AS n, count(DISTINCT rf_fk) AS u FROM m_files JOIN m_findings USING (pfile_fk) WHERE rf_fk IS NOT NULL GROUP BY 1) l USING (upload_fk)
    LEFT JOIN (SELECT upload_fk, count(*) AS n FROM m_files WHERE pfile_fk IN (SELECT pfile_fk FROM m_findings WHERE rf_fk IS NOT NULL) AND item NOT IN (SELECT item FROM m_decisions WHERE decision_type > 0) GROUP BY 1) c USING (upload_fk)
    LEFT JOIN (SELECT upload_fk, count(*) AS n FROM m_files WHERE item IN (SELECT item FROM m_decisions WHERE decision_type > 0) GROUP BY 1) d USING (upload_fk)
    LEFT JOIN (SELECT upload_fk, count(*) AS n FROM m_files JOIN m_texts USING (pfile_fk) GROUP BY 1) t USING (upload_fk)""")
def upload_summary(spark, sf):
    return R.upload_summary(m.items(spark, sf), m.findings(spark, sf), m.decisions(spark, sf), m.texts(spark, sf))


@query("""SELECT l.rf_pk, l.shortname, t.o AS obligations, p.shortname AS parent_name FROM m_licenses l LEFT JOIN (SELECT l_partkey AS rf_fk, string_agg(s_name, '; ' ORDER BY s_name) AS o FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1) t ON l.rf_pk = t.rf_fk
    LEFT JOIN m_licenses p ON l.risk < 3 AND p.rf_pk = l.rf_pk // 10""")
def license_export(spark, sf):
    obligations = m.table(spark, sf, "supplier").selectExpr("s_suppkey ob_fk", "s_name topic")
    bridge = m.table(spark, sf, "lineitem").selectExpr("l_partkey rf_fk", "l_suppkey ob_fk").distinct()
    parents = m.licenses(spark, sf).filter("risk < 3").selectExpr("rf_pk rf_fk", "rf_pk div 10 rf_parent")
    return R.export_licenses(m.licenses(spark, sf), obligations, bridge, parents).select("rf_pk", "shortname", "obligations", "parent_name")


@query("SELECT p_name AS text, max(p_partkey) AS bulk_pk, count(*) AS uses FROM part GROUP BY 1")
def bulk_text_export(spark, sf):
    return R.newest_texts(m.table(spark, sf, "part").selectExpr("p_name text", "p_partkey bulk_pk"))


_PACKAGE = """SELECT i.upload_fk, i.name, c.sha1, coalesce(l.e, 'NOASSERTION') AS license_concluded FROM m_files i JOIN (SELECT doc_id, sha1(text) AS sha1 FROM documents WHERE text IS NOT NULL) c ON i.pfile_fk = c.doc_id
    LEFT JOIN (SELECT pfile_fk, string_agg(DISTINCT license_type, ' AND ' ORDER BY license_type) e FROM m_findings JOIN m_licenses ON rf_fk = rf_pk WHERE agent_fk = 1 GROUP BY 1) l ON i.pfile_fk = l.pfile_fk"""


def _package(spark, sf):
    contents = m.table(spark, sf, "documents").filter("text is not null").select(F.col("doc_id").alias("pfile_pk"), F.sha1("text").alias("sha1"))
    lic = m.findings(spark, sf).filter("agent_fk = 1").join(m.licenses(spark, sf), F.col("rf_fk") == F.col("rf_pk")).selectExpr("pfile_fk", "license_type shortname")
    return R.package_files(m.items(spark, sf), contents, lic)


@query(_PACKAGE)
def package_files(spark, sf):
    return _package(spark, sf)


@query(f"SELECT 'FileName: ./' || name || chr(10) || 'SPDXID: SPDXRef-item-' || sha1 || chr(10) || 'FileChecksum: SHA1: ' || sha1 || chr(10) || 'LicenseConcluded: ' || license_concluded || chr(10) || 'FileCopyrightText: NOASSERTION' || chr(10) AS value FROM ({_PACKAGE})")
def spdx_tag_value(spark, sf):
    return S.spdx_tag_lines(_package(spark, sf))


@query(f"""SELECT '{{"type":"file","name":"' || name || '","hashes":[{{"alg":"SHA-1","content":"' || sha1 || '"}}],"licenses":[{{"expression":"' || license_concluded || '"}}]}}' AS value FROM ({_PACKAGE})""")
def cyclonedx_components(spark, sf):
    return S.cyclonedx_components(_package(spark, sf))


@query("SELECT i.item, i.name, coalesce(l.l, 'No_license_found') AS license_list, d.t AS decision_type, coalesce(k.n, 0) AS files FROM m_items i LEFT JOIN (SELECT pfile_fk, string_agg(DISTINCT shortname, ', ' ORDER BY shortname) AS l FROM m_findings JOIN m_licenses ON rf_fk = rf_pk GROUP BY 1) l ON i.pfile_fk = l.pfile_fk LEFT JOIN (SELECT item, arg_max(decision_type, decision_pk) AS t FROM m_decisions GROUP BY 1) d ON i.item = d.item LEFT JOIN (SELECT parent, count(*) AS n FROM m_files GROUP BY 1) k ON i.item = k.parent WHERE i.parent IN (SELECT item FROM m_items WHERE parent = 5)")
def directory_listing(spark, sf):
    tree = m.items(spark, sf)
    children = tree.join(tree.filter("parent = 5").select(F.col("item").alias("parent")), "parent", "left_semi")
    lists = O.license_lists(children, m.findings(spark, sf), m.licenses(spark, sf))
    decided = m.decisions(spark, sf).groupBy("item").agg(F.max_by("decision_type", "decision_pk").alias("decision_type"))
    counts = tree.filter("mode & 805306368 = 0").groupBy("parent").agg(F.count("*").alias("files")).withColumnRenamed("parent", "item")
    return R.listing(children, lists, decided, counts)


@query("SELECT risk AS level, CASE WHEN risk IN (2, 3) THEN 'yellow' WHEN risk IN (4, 5) THEN 'red' ELSE 'white' END AS band, count(*) AS n FROM m_licenses GROUP BY 1, 2")
def risk_bands(spark, sf):
    return m.licenses(spark, sf).groupBy(F.col("risk").alias("level"), risk_band(F.col("risk")).alias("band")).agg(F.count("*").alias("n"))


@query("SELECT coalesce(k.p_partkey, n.p_partkey) AS rf_pk, coalesce(nullif(n.v, ''), k.p_brand) AS brand, CASE WHEN k.p_partkey IS NULL THEN 'new' WHEN n.p_partkey IS NULL THEN 'kept' WHEN coalesce(nullif(n.v, ''), k.p_brand) <> k.p_brand THEN 'updated' ELSE 'same' END AS state FROM (SELECT p_partkey, p_brand FROM part WHERE p_partkey % 5 <> 0) k FULL JOIN (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'Brand#2' ELSE p_brand END AS v FROM part WHERE p_partkey % 2 = 0) n ON k.p_partkey = n.p_partkey")
def license_import(spark, sf):
    part = m.table(spark, sf, "part")
    known = part.filter("p_partkey % 5 <> 0").selectExpr("p_partkey rf_pk", "p_brand brand")
    new = part.filter("p_partkey % 2 = 0").selectExpr("p_partkey rf_pk", "case p_partkey % 3 when 0 then '' when 1 then 'Brand#2' else p_brand end brand")
    return C.upserted(known, new, "rf_pk", ["brand"])


@query("SELECT p_partkey AS pfile_fk, p_name AS package, CAST(p_size AS VARCHAR) AS version, 'lib' || p_size || '|' || p_brand AS requires FROM part")
def debian_packages(spark, sf):
    text = F.expr("concat('Package: ', p_name, char(10), 'Version: ', p_size, char(10), 'Depends: lib', p_size, ',', char(10), ' ', p_brand, char(10))")
    out = C.debian_packages(m.table(spark, sf, "part").select(F.col("p_partkey").alias("pfile_fk"), text.alias("text")))
    return out.select("pfile_fk", "package", "version", F.array_join("requires", "|").alias("requires"))
