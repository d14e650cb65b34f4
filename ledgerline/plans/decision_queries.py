"""Queries over decisions, reuse, compatibility and buckets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline.operators import buckets as B
from ledgerline.operators import compare as N
from ledgerline.operators import compatibility as C
from ledgerline.operators import decisions as D
from ledgerline.operators import reuse as R

from . import model as m
from .registry import query

_APPLICABLE = """(SELECT i.item, d.decision_pk, d.decision_type, d.scope, d.ts FROM m_items i JOIN m_decisions d ON i.item = d.item WHERE d.scope = 0 AND d.group_fk = 1
    UNION ALL SELECT i.item, d.decision_pk, d.decision_type, d.scope, d.ts FROM m_items i JOIN m_decisions d ON i.pfile_fk = d.pfile_fk WHERE d.scope = 1 AND i.upload_fk < 3)"""


def _current(spark, sf, order, keys=("item",)):
    uploads = m.items(spark, sf).filter("upload_fk < 3").select("upload_fk").distinct()
    return D.current_decisions(m.items(spark, sf), m.decisions(spark, sf), 1, order, uploads, keys).select("item", "decision_pk", "decision_type", "scope")


def _first(order, keys="item"):
    return f"SELECT item, decision_pk, decision_type, scope FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {order}) n FROM {_APPLICABLE}) WHERE n = 1"


@query(_first("decision_pk DESC"))
def latest_decision_per_item(spark, sf):
    return _current(spark, sf, D.NEWEST)


@query(_first("decision_pk DESC", "item, scope"))
def latest_decision_per_scope(spark, sf):
    return _current(spark, sf, D.NEWEST, ("item", "scope"))


@query(_first("scope, decision_pk DESC"))
def item_before_repository(spark, sf):
    return _current(spark, sf, D.ITEM_FIRST)


@query(_first("scope, ts DESC, decision_pk DESC"))
def item_first_by_date(spark, sf):
    return _current(spark, sf, D.ITEM_FIRST_BY_DATE)


@query("SELECT pfile_fk, rf_fk, event_pk FROM (SELECT *, rank() OVER (PARTITION BY pfile_fk, rf_fk ORDER BY event_pk DESC) n FROM m_events) WHERE n = 1")
def ranked_conclusions(spark, sf):
    return D.ranked_first(m.events(spark, sf), ["pfile_fk", "rf_fk"], ["-event_pk"]).select("pfile_fk", "rf_fk", "event_pk")


_EFFECTIVE = "SELECT item, rf_fk, max(event_pk) AS event_pk, arg_max(removed, event_pk) AS removed FROM m_events GROUP BY 1, 2"
_FOUND = "SELECT DISTINCT i.item, f.rf_fk % 100 AS rf_fk FROM m_files i JOIN m_findings f ON i.pfile_fk = f.pfile_fk WHERE f.rf_fk IS NOT NULL"
_CLEARINGS = f"SELECT coalesce(e.item, f.item) AS item, coalesce(e.rf_fk, f.rf_fk) AS rf_fk, coalesce(e.removed, FALSE) AS removed, e.item IS NOT NULL AS by_event, f.item IS NOT NULL AS by_scanner FROM ({_EFFECTIVE}) e FULL JOIN ({_FOUND}) f ON e.item = f.item AND e.rf_fk = f.rf_fk"


def _found(spark, sf):
    files = m.items(spark, sf).filter("mode & 805306368 = 0")
    return files.join(m.findings(spark, sf), "pfile_fk").filter("rf_fk is not null").selectExpr("item", "rf_fk % 100 rf_fk").distinct()


@query(_EFFECTIVE)
def effective_events(spark, sf):
    return D.effective_events(m.events(spark, sf)).select("item", "rf_fk", "event_pk", "removed")


@query(_CLEARINGS)
def current_clearings(spark, sf):
    return D.current_clearings(m.events(spark, sf), _found(spark, sf))


@query(f"SELECT item, rf_fk FROM ({_FOUND}) f WHERE NOT EXISTS (SELECT 1 FROM m_events e WHERE e.item = f.item AND e.rf_fk = f.rf_fk)")
def unhandled_findings(spark, sf):
    return D.unhandled(_found(spark, sf), m.events(spark, sf))


@query(f"SELECT i.item, 5 AS decision_type, coalesce(string_agg(CAST(rf_fk AS VARCHAR), ',' ORDER BY rf_fk), '') AS licenses FROM m_files i LEFT JOIN (SELECT * FROM ({_CLEARINGS}) WHERE NOT removed) c ON i.item = c.item GROUP BY 1")
def decisions_from_events(spark, sf):
    out = D.decide(m.items(spark, sf).filter("mode & 805306368 = 0"), m.events(spark, sf), _found(spark, sf), D.IDENTIFIED)
    return out.select("item", "decision_type", F.array_join("licenses", ",").alias("licenses"))


@query("""SELECT item, coalesce(a, b).pk AS decision_pk, coalesce(a, b).t AS decision_type FROM (SELECT i.item, a, b FROM m_items i LEFT JOIN (SELECT item, arg_max({pk: decision_pk, t: decision_type}, decision_pk) AS a FROM m_decisions WHERE scope = 0 GROUP BY 1) x ON i.item = x.item
    LEFT JOIN (SELECT pfile_fk, arg_max({pk: decision_pk, t: decision_type}, decision_pk) AS b FROM m_decisions WHERE scope = 1 GROUP BY 1) y ON i.pfile_fk = y.pfile_fk) WHERE coalesce(a, b).t <> 4""")
def decision_map(spark, sf):
    return D.decision_map(m.items(spark, sf), m.decisions(spark, sf))


@query("SELECT projected_fk, count(*) AS n FROM (SELECT coalesce(p.rf_parent, f.rf_fk) AS projected_fk FROM m_findings f LEFT JOIN (SELECT rf_pk, rf_pk // 10 AS rf_parent FROM m_licenses WHERE risk < 3) p ON f.rf_fk = p.rf_pk) GROUP BY 1")
def projected_licenses(spark, sf):
    license_map = m.licenses(spark, sf).filter("risk < 3").selectExpr("rf_pk rf_fk", "rf_pk div 10 rf_parent", "1 usage")
    return D.projected(m.findings(spark, sf), license_map, 1).groupBy("projected_fk").agg(F.count("*").alias("n"))


@query("SELECT item, decision_pk FROM m_decisions WHERE NOT (decision_type = 4 AND item IN (SELECT item FROM m_items WHERE upload_fk = 1))")
def unmarked_directory(spark, sf):
    return D.without_directory_marks(m.decisions(spark, sf), m.items(spark, sf).filter("upload_fk = 1"), D.IRRELEVANT).select("item", "decision_pk")


@query("SELECT item, 4 AS decision_type, 0 AS scope FROM m_files WHERE upload_fk = 1 AND item NOT IN (SELECT item FROM m_decisions WHERE decision_type = 4)")
def marked_directory(spark, sf):
    return D.marked_directory(m.items(spark, sf).filter("mode & 805306368 = 0 and upload_fk = 1"), m.decisions(spark, sf), D.IRRELEVANT)


@query("""SELECT coalesce(t.bulk_pk, h.bulk_pk) AS bulk_pk, coalesce(t.item, h.item) AS item, t.item IS NOT NULL AS tried, h.item IS NOT NULL AS matched FROM
    (SELECT b.item AS bulk_pk, i.item FROM m_nested b JOIN m_nested i ON b.upload_fk = i.upload_fk AND i.lft BETWEEN b.lft AND b.rgt WHERE b.depth = 1) t
    FULL JOIN (SELECT DISTINCT 4 * (event_pk % 7) + 1 AS bulk_pk, item FROM m_events WHERE event_type = 2) h ON t.bulk_pk = h.bulk_pk AND t.item = h.item""")
def bulk_history(spark, sf):
    n = m.nested(spark, sf)
    bulks = n.filter("depth = 1").withColumnRenamed("item", "bulk_pk")
    return D.bulk_history(bulks, n, m.events(spark, sf).filter("event_type = 2").selectExpr("4 * (event_pk % 7) + 1 bulk_pk", "item"))


@query("SELECT fk, item, content, is_enabled FROM m_overlay WHERE fk NOT IN (SELECT fk FROM m_texts) UNION ALL SELECT t.fk, t.item, o.content, FALSE FROM m_texts t LEFT JOIN m_overlay o ON t.fk = o.fk")
def edited_texts(spark, sf):
    old = m.overlay(spark, sf).select("fk", "item", F.lit("").alias("hash"), "content", "is_enabled")
    return D.edited_texts(old, m.texts(spark, sf).select("fk", "item", "hash"), "delete").select("fk", "item", "content", "is_enabled")


_COVERED = "SELECT item FROM (SELECT item, license, count(*) FILTER (scanner = 'tag') > 0 AND count(*) FILTER (scanner = 'keyword' AND rf_fk NOT IN (SELECT x.rf_fk FROM m_matches x WHERE x.item = m.item AND x.license = m.license AND x.scanner = 'tag')) = 0 AS ok FROM m_matches m GROUP BY 1, 2) GROUP BY 1 HAVING bool_and(ok)"
_INSIDE = """SELECT item FROM (SELECT item, license, bool_or(scanner = 'keyword') AND bool_or(scanner = 'phrase') AS twice FROM m_matches GROUP BY 1, 2) GROUP BY 1 HAVING bool_and(twice)
    EXCEPT SELECT item FROM m_matches k WHERE scanner = 'keyword' AND NOT EXISTS (SELECT 1 FROM m_matches p WHERE p.scanner = 'phrase' AND p.item = k.item AND p.license = k.license AND k.region_start >= p.region_start AND k.region_end <= p.region_end)"""


@query(_COVERED)
def tag_without_contradiction(spark, sf):
    return D.tag_without_contradiction(m.matches(spark, sf))


@query(_INSIDE)
def keyword_inside_phrase(spark, sf):
    return D.keyword_inside_phrase(m.matches(spark, sf))


def _types(spark, sf):
    return m.licenses(spark, sf).selectExpr("rf_pk", "if(rf_pk % 4 in (1, 2), 'Permissive', 'Other') license_type")


@query("SELECT item FROM m_matches GROUP BY item HAVING bool_and(license IN (1, 2)) EXCEPT SELECT 4 * run_pk + 3 FROM m_runs")
def one_license_type(spark, sf):
    return D.one_license_type(m.matches(spark, sf), _types(spark, sf), "Permissive", m.runs(spark, sf).selectExpr("4 * run_pk + 3 as item"))


@query("SELECT item FROM (SELECT item, license, rf_fk, count(DISTINCT scanner) AS n FROM m_matches GROUP BY 1, 2, 3) GROUP BY 1 HAVING min(n) = 3")
def scanners_agree(spark, sf):
    return D.scanners_agree(m.matches(spark, sf), ("keyword", "phrase", "tag"))


_COVERED_BY = """SELECT item FROM (SELECT item, license, count(*) FILTER (scanner = '{0}') > 0 AND count(*) FILTER (scanner = 'keyword' AND rf_fk NOT IN (SELECT x.rf_fk FROM m_scans x WHERE x.item = m.item AND x.license = m.license AND x.scanner = '{0}')) = 0 AS ok
    FROM m_scans m GROUP BY 1, 2) GROUP BY 1 HAVING bool_and(ok)"""
_CASCADE = f"""WITH last AS (SELECT item, arg_max(decision_type, decision_pk) AS t, [max(decision_pk) % 2] AS known FROM m_decisions GROUP BY 1),
    ev AS (SELECT item, event_type, rf_fk FROM m_order_events),
    news AS (SELECT DISTINCT s.item FROM m_scans s JOIN last ON s.item = last.item WHERE t <> 4 AND NOT list_contains(known, license)),
    phrase AS (SELECT item FROM ev WHERE event_type = 1 AND NOT EXISTS (SELECT 1 FROM m_scans s WHERE s.item = ev.item AND s.license <> ev.rf_fk)),
    agreed AS (SELECT item FROM (SELECT item, license, rf_fk, count(DISTINCT scanner) FILTER (scanner IN ('keyword', 'phrase', 'sentence')) AS n, bool_and(scanner IN ('tag', 'sidecar')) AS other FROM m_scans GROUP BY 1, 2, 3)
               GROUP BY item HAVING min(CASE WHEN other THEN 3 ELSE n END) = 3 AND count(DISTINCT license) = count(DISTINCT license) FILTER (NOT other)),
    kind AS (SELECT item FROM m_scans GROUP BY item HAVING bool_and(license = 1))
    SELECT item, rule FROM (SELECT item, CASE WHEN item IN (SELECT item FROM last) THEN CASE WHEN item IN (FROM news) THEN 'update' END WHEN item IN (SELECT item FROM ev) THEN CASE WHEN item IN (FROM phrase) THEN 'phrase events' END
        WHEN item IN ({_COVERED_BY.format("tag")}) THEN 'tag' WHEN item IN ({_COVERED_BY.format("sidecar")}) THEN 'sidecar' WHEN item IN ({_INSIDE.replace("m_matches", "m_scans")}) THEN 'keyword in phrase'
        WHEN item IN (FROM agreed) THEN 'agreement' WHEN item IN (FROM kind) THEN 'license type' END AS rule FROM m_files) WHERE rule IS NOT NULL"""


@query(_CASCADE)
def decision_cascade(spark, sf):
    """All rules over all files: users' items have decisions, urgent orders an event each, the rest neither."""
    last = m.decisions(spark, sf).groupBy("item").agg(F.max_by("decision_type", "decision_pk").alias("decision_type"), F.array(F.max("decision_pk") % 2).alias("licenses"))
    files = m.items(spark, sf).filter("mode & 805306368 = 0")
    types = m.licenses(spark, sf).selectExpr("rf_pk % 2 rf_pk", "if(rf_pk % 2 = 1, 'Permissive', 'Other') license_type").distinct()
    return D.auto_decisions(files, m.scans(spark, sf), m.order_events(spark, sf), last, types, phrase_type=1)


@query("SELECT item FROM (SELECT item, arg_min(event_type, event_pk) AS kind, arg_min(rf_fk, event_pk) % 4 AS license, arg_min(removed, event_pk) AS removed FROM m_events GROUP BY 1) ev WHERE kind = 3 AND NOT EXISTS (SELECT 1 FROM m_matches mm WHERE mm.item = ev.item AND (mm.license <> ev.license OR ev.removed))")
def phrases_cover_all(spark, sf):
    first = m.events(spark, sf).groupBy("item").agg(F.min_by(F.struct("event_pk", F.expr("rf_fk % 4 as rf_fk"), "removed", "event_type", "ts"), "event_pk").alias("e")).select("item", "e.*")
    return D.phrases_cover_all(m.matches(spark, sf), first, 3)


@query(_COVERED.replace("scanner = 'tag'", "scanner = 'phrase'"))
def sidecar_without_contradiction(spark, sf):
    """The sidecar rule, on matches of the phrase scanner taken for those of sidecars."""
    own = m.matches(spark, sf).withColumn("scanner", F.when(F.col("scanner") == "phrase", "sidecar").otherwise(F.col("scanner")))
    return D.sidecar_without_contradiction(own)


@query("""SELECT i.item, r.decision_pk, r.decision_type FROM m_items i JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pfile_fk ORDER BY list_position([5, 6, 7, 4, 3, 0], decision_type), decision_pk DESC) n FROM m_decisions) WHERE n = 1) r ON i.pfile_fk = r.pfile_fk
    WHERE i.item NOT IN (SELECT item FROM m_decisions GROUP BY 1 HAVING arg_max(decision_type, decision_pk) = 5)""")
def reuse_by_content(spark, sf):
    d = m.decisions(spark, sf)
    cleared = d.groupBy("item").agg(F.max_by("decision_type", "decision_pk").alias("t")).filter("t = 5")
    return R.reused_by_content(m.items(spark, sf), cleared, d)


@query()
def reuse_by_name(spark, sf):
    """Documents of a new upload, each with some lines put before it, and the decisions on their namesakes of the old one; every name is that of three."""
    docs = m.table(spark, sf, "documents").selectExpr("doc_id", "concat('file-', doc_id div 3) name", "text")
    old = docs.selectExpr("-doc_id - 1 item", "name", "2 * doc_id pfile_fk")
    new = docs.selectExpr("doc_id item", "name", "2 * doc_id + 1 pfile_fk")
    contents = docs.selectExpr("2 * doc_id pfile_fk", "text").unionByName(docs.selectExpr("2 * doc_id + 1 pfile_fk", "concat(repeat('A line.\\n', cast(doc_id % 7 as int)), text) text"))
    decisions = docs.selectExpr("doc_id decision_pk", "2 * doc_id pfile_fk", "if(doc_id % 2 = 0, 5, 6) decision_type")
    cleared = m.table(spark, sf, "labels").filter("toxic = 1").selectExpr("doc_id item")
    return R.reused_by_name(new, old, cleared, decisions, contents)


_SIDES = """WITH own AS (SELECT upload_fk, item, parent, pfile_fk, name FROM m_items WHERE mode & 536870912 = 0 UNION ALL
    SELECT upload_fk, -item, parent, -pfile_fk, replace(name, '.license', '') FROM m_items WHERE mode & 536870912 = 0 AND name LIKE '%.license' AND item % 3 = 0)"""


def _with_bases(spark, sf):
    """Files, and for every third sidecar the file that it stands beside."""
    i = m.items(spark, sf).filter("mode & 536870912 = 0")
    return i.unionByName(i.filter("name like '%.license' and item % 3 = 0").selectExpr("upload_fk", "-item item", "parent", "-pfile_fk pfile_fk", "mode", "replace(name, '.license', '') name"))


@query(f"{_SIDES} SELECT s.item AS sidecar, b.item AS base FROM own s JOIN own b ON s.upload_fk = b.upload_fk AND s.parent = b.parent AND s.name = b.name || '.license'")
def sidecar_files(spark, sf):
    return R.sidecars(_with_bases(spark, sf)).select("sidecar", "base")


@query(f"""{_SIDES} SELECT DISTINCT b.pfile_fk, f.rf_fk FROM own s JOIN own b ON s.upload_fk = b.upload_fk AND s.parent = b.parent AND s.name = b.name || '.license' JOIN m_findings f ON f.pfile_fk = s.pfile_fk
    WHERE f.rf_fk IS NOT NULL AND NOT EXISTS (SELECT 1 FROM m_findings g WHERE g.pfile_fk = b.pfile_fk AND g.rf_fk = f.rf_fk)""")
def sidecar_findings(spark, sf):
    return R.sidecar_findings(_with_bases(spark, sf), m.findings(spark, sf))


@query("SELECT p.doc_id AS entry, c.doc_id AS item FROM (SELECT doc_id, sha1(text) AS h FROM documents) p JOIN (SELECT doc_id, sha1(text) AS h FROM documents) c ON p.h = c.h")
def files_by_hash(spark, sf):
    docs = m.table(spark, sf, "documents").select("doc_id", F.sha1("text").alias("sha1"))
    entries = docs.select(F.col("doc_id").alias("entry"), F.upper("sha1").alias("hash"))
    return R.by_hash(entries, docs.withColumnRenamed("doc_id", "item")).select("entry", "item")


@query("SELECT coalesce(d.u, c.u) AS upload_fk, coalesce(d.l, c.l) AS license, CASE WHEN d.u IS NULL THEN 'missing' WHEN c.u IS NULL THEN 'unused' ELSE 'used' END AS status FROM (SELECT DISTINCT l_orderkey AS u, l_returnflag AS l FROM lineitem WHERE l_linenumber < 4) d FULL JOIN (SELECT DISTINCT l_orderkey AS u, l_returnflag AS l FROM lineitem WHERE l_linenumber >= 4) c ON d.u = c.u AND d.l = c.l")
def set_used_unused_missing(spark, sf):
    l = m.table(spark, sf, "lineitem").selectExpr("l_orderkey upload_fk", "l_returnflag license", "l_linenumber")
    return R.reuse_summary(l.filter("l_linenumber < 4"), l.filter("l_linenumber >= 4"))


_PAIRS = "SELECT DISTINCT x.pfile_fk, x.rf_fk AS a, y.rf_fk AS b FROM (SELECT DISTINCT pfile_fk, rf_fk FROM m_findings WHERE rf_fk IS NOT NULL) x JOIN (SELECT DISTINCT pfile_fk, rf_fk FROM m_findings WHERE rf_fk IS NOT NULL) y ON x.pfile_fk = y.pfile_fk AND x.rf_fk < y.rf_fk"
_RULES = "(SELECT least(p_type, CASE WHEN p_size % 2 = 0 THEN 'STANDARD' ELSE 'PROMO' END) AS t1, greatest(p_type, CASE WHEN p_size % 2 = 0 THEN 'STANDARD' ELSE 'PROMO' END) AS t2, min(p_size % 4 <> 0) AS c FROM part GROUP BY 1, 2)"
_VERDICTS = f"SELECT p.a, p.b, coalesce(CASE WHEN p.b = p.a + 1 THEN p.a % 2 = 0 END, r.c, FALSE) AS compatible FROM (SELECT DISTINCT a, b FROM ({_PAIRS})) p JOIN m_licenses la ON la.rf_pk = p.a JOIN m_licenses lb ON lb.rf_pk = p.b LEFT JOIN {_RULES} r ON least(la.license_type, lb.license_type) = r.t1 AND greatest(la.license_type, lb.license_type) = r.t2"


def _rules(spark, sf):
    kinds = m.table(spark, sf, "part").selectExpr("cast(null as bigint) first_rf_fk", "cast(null as bigint) second_rf_fk", "p_type first_type", "if(p_size % 2 = 0, 'STANDARD', 'PROMO') second_type", "p_size % 4 <> 0 compatibility")
    ids = m.licenses(spark, sf).selectExpr("rf_pk + 1 first_rf_fk", "rf_pk second_rf_fk", "cast(null as string) first_type", "cast(null as string) second_type", "rf_pk % 2 = 0 compatibility")
    return kinds.union(ids)


def _pairs(spark, sf):
    return C.license_pairs(m.findings(spark, sf), m.licenses(spark, sf))


@query(_PAIRS)
def license_pairs(spark, sf):
    return _pairs(spark, sf)


@query(_VERDICTS)
def pairwise_compatibility(spark, sf):
    return C.verdicts(_pairs(spark, sf), m.licenses(spark, sf), _rules(spark, sf))


@query(f"SELECT p.pfile_fk, count(*) AS pairs, count(*) FILTER (NOT compatible) AS conflicts, bool_and(compatible) AS compatible FROM ({_PAIRS}) p JOIN ({_VERDICTS}) v ON p.a = v.a AND p.b = v.b GROUP BY 1")
def file_compatibility(spark, sf):
    pairs = _pairs(spark, sf)
    return C.file_verdicts(pairs, C.verdicts(pairs, m.licenses(spark, sf), _rules(spark, sf)))


@query("SELECT item, 1 AS bucket FROM m_fileset WHERE list_has_all(licenses, ['ECONOMY', 'PROMO']) OR list_has_all(licenses, ['STANDARD', 'SMALL', 'LARGE'])")
def bucket_match_every(spark, sf):
    return B.leaf_buckets(m.fileset(spark, sf), [B.Bucket(1, "every", sets=[["ECONOMY", "PROMO"], ["STANDARD", "SMALL", "LARGE"]])])


@query("SELECT item, 2 AS bucket FROM m_fileset WHERE len(licenses) > 0 AND list_has_all(['ECONOMY', 'PROMO', 'STANDARD'], licenses)")
def bucket_match_only(spark, sf):
    return B.leaf_buckets(m.fileset(spark, sf), [B.Bucket(2, "only", sets=[["ECONOMY", "PROMO", "STANDARD"]])])


_LEAVES = """SELECT item, bucket FROM (SELECT item, CASE WHEN regexp_matches(array_to_string(licenses, '|'), 'ECO.*') THEN 3 WHEN regexp_matches(name, '\\.c$') AND regexp_matches(array_to_string(licenses, '|'), 'PROMO') THEN 5
    WHEN regexp_matches(name, '\\.h$') AND NOT regexp_matches(array_to_string(licenses, '|'), 'SMALL') THEN 5 ELSE 99 END AS bucket FROM m_fileset)"""


def _leaves(spark, sf):
    rules = [B.Bucket(3, "regex", pattern="ECO.*", stop=True), B.Bucket(5, "file", tests=[("name", r"\.c$", "and", "license", "PROMO"), ("name", r"\.h$", "not", "license", "SMALL")]), B.Bucket(99, "default")]
    return B.leaf_buckets(m.fileset(spark, sf), rules)


@query(_LEAVES)
def bucket_regex_default(spark, sf):
    return _leaves(spark, sf)


@query(f"SELECT upload_fk, a AS item, bucket FROM (SELECT DISTINCT w.upload_fk, unnest(w.ids) AS a, l.bucket FROM ({_LEAVES}) l JOIN m_walk w ON l.item = w.item) WHERE a % 4 <> 3")
def bucket_containers(spark, sf):
    from ledgerline.operators.tree import levels

    tree = m.items(spark, sf)
    found = levels(tree, {"parent_ids": (F.array("item"), F.array_append("p_parent_ids", F.col("item")))})
    whole = found[0]
    for x in found[1:]:
        whole = whole.unionByName(x)
    return B.container_buckets(whole, _leaves(spark, sf))


@query(f"SELECT bucket, count(*) AS files FROM ({_LEAVES}) GROUP BY 1")
def bucket_histogram(spark, sf):
    return B.bucket_histogram(m.items(spark, sf), _leaves(spark, sf))


@query()
def fuzzy_name_match(spark, sf):
    """Orders of two statuses of a customer, paired by name."""
    i = m.items(spark, sf).filter("mode & 536870912 = 0").selectExpr("parent folder", "item", "name", "mode")
    return N.matched_names(i.filter("mode = 0"), i.filter("mode != 0"))


@query(f"SELECT t.item, coalesce(string_agg(CAST(rf_fk AS VARCHAR), ',' ORDER BY rf_fk), '') AS licenses FROM (SELECT DISTINCT item FROM m_events WHERE job_fk = 7) t LEFT JOIN (SELECT * FROM ({_CLEARINGS}) WHERE NOT removed) c ON t.item = c.item GROUP BY 1")
def decisions_of_job(spark, sf):
    return D.decisions_of_job(m.events(spark, sf), 7, _found(spark, sf)).select("item", F.array_join("licenses", ",").alias("licenses"))
