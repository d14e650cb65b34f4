"""Queries over file trees and items."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline.functions.text import natural_key
from ledgerline.operators import items as I
from ledgerline.operators import tree as T
from ledgerline.operators.decisions import duplicates

from . import model as m
from .registry import query


@query("SELECT upload_fk, item, depth, CAST(lft AS BIGINT) lft, CAST(rgt AS BIGINT) rgt FROM m_nested")
def nested_set(spark, sf):
    return T.nested_set(m.items(spark, sf)).select("upload_fk", "item", "depth", "lft", "rgt")


@query("SELECT item, path, depth FROM m_walk")
def full_path(spark, sf):
    return T.full_paths(m.items(spark, sf))


@query("SELECT item, shown AS path FROM m_walk")
def full_path_without_artifacts(spark, sf):
    return T.full_paths(m.items(spark, sf), skip_artifacts=True).select("item", "path")


@query("SELECT item, realparent FROM m_walk")
def real_parent(spark, sf):
    return T.real_parents(m.items(spark, sf))


@query("SELECT realparent, item FROM m_walk WHERE mode & 268435456 = 0 AND realparent IS NOT NULL")
def visible_children(spark, sf):
    return T.visible_children(m.items(spark, sf))


@query("SELECT a AS item, CAST(count(*) AS BIGINT) AS files FROM (SELECT unnest(ids) a, item FROM m_walk WHERE mode & 805306368 = 0) WHERE a <> item GROUP BY a HAVING a % 4 <> 3")
def subtree_counts(spark, sf):
    tree = m.nested(spark, sf)
    return T.subtree_counts(tree, tree.filter("mode & 536870912 != 0")).select("item", "files").filter("files > 0")


@query("SELECT o.item AS outer_item, count(*) AS files FROM m_nested o JOIN m_nested i ON o.upload_fk = i.upload_fk AND i.lft BETWEEN o.lft AND o.rgt WHERE o.depth = 1 AND i.mode & 805306368 = 0 GROUP BY 1")
def containment_join(spark, sf):
    n = m.nested(spark, sf)
    return T.contained(n.filter("mode & 805306368 = 0"), n.filter("depth = 1")).groupBy("outer_item").agg(F.count("*").alias("files"))


@query("SELECT i.item, i.name FROM m_nested i JOIN m_nested r ON i.upload_fk = r.upload_fk AND i.lft BETWEEN r.lft AND r.rgt WHERE r.item = 5")
def subtree_items(spark, sf):
    n = m.nested(spark, sf)
    root = n.filter("item = 5").first()
    return T.under(n, root.lft, root.rgt, root.upload_fk).select("item", "name")


@query("""SELECT upload_fk, arg_max(item, lft) AS item FROM (SELECT n.*, min(CASE WHEN mode & 805306368 = 0 THEN lft END) OVER (PARTITION BY upload_fk) lo, max(CASE WHEN mode & 805306368 = 0 THEN rgt END) OVER (PARTITION BY upload_fk) hi FROM m_nested n) WHERE lft <= lo AND rgt >= hi GROUP BY upload_fk""")
def covering_item(spark, sf):
    return T.covering_items(m.nested(spark, sf))


@query("SELECT upload_fk, item, lag(item) OVER w AS previous_item, lead(item) OVER w AS next_item FROM m_nested WHERE mode & 805306368 = 0 WINDOW w AS (PARTITION BY upload_fk, parent ORDER BY lft)")
def neighbour_items(spark, sf):
    return T.neighbours(m.nested(spark, sf))


@query("""SELECT c_custkey AS upload_fk, 10 * c_custkey + CASE WHEN c_acctbal < 0 THEN 0 WHEN c_nationkey < 8 THEN 1 WHEN c_nationkey < 16 THEN 2 ELSE 3 END AS item FROM customer""")
def fat_item(spark, sf):
    """A tree for each customer: folders in folders, one to three deep, above the orders; those in debt have a second folder at the top."""
    c = m.table(spark, sf, "customer")
    depth = "case when c_nationkey < 8 then 1 when c_nationkey < 16 then 2 else 3 end"
    chain = c.withColumn("n", F.explode(F.sequence(F.lit(0), F.expr(depth)))).selectExpr("c_custkey upload_fk", "10 * c_custkey + n item", "if(n = 0, null, 10 * c_custkey + n - 1) parent", "536870912 mode")
    second = c.filter("c_acctbal < 0").selectExpr("c_custkey upload_fk", "10 * c_custkey + 9 item", "10 * c_custkey parent", "536870912 mode")
    files = m.table(spark, sf, "orders").join(c, F.col("o_custkey") == F.col("c_custkey")).selectExpr("c_custkey upload_fk", "-o_orderkey - 1 item", f"10 * c_custkey + {depth} parent", "0 mode")
    return T.fat_items(chain.union(second).union(files))


@query("""WITH f AS (SELECT * FROM m_items WHERE mode & 536870912 <> 0), e AS (SELECT parent, item AS child FROM f WHERE parent IS NOT NULL UNION ALL SELECT 4 * ((n_regionkey + 1) % 5), 4 * n_nationkey + 1 FROM nation WHERE n_name LIKE 'I%' UNION ALL SELECT 4 * n_nationkey + 1, 4 * n_regionkey FROM nation WHERE n_name = 'CHINA'),
    w AS (SELECT item AS folder, [item] AS ids, [name] AS names, FALSE AS cycle FROM f WHERE parent IS NULL UNION ALL SELECT child, list_append(ids, child), list_append(names, name), list_contains(ids, child) FROM w JOIN e ON w.folder = e.parent JOIN f ON f.item = e.child WHERE NOT cycle)
    SELECT array_to_string(ids, '/') AS id_path, array_to_string(names, '/') AS name_path, CAST(len(ids) - 1 AS INTEGER) AS depth, cycle FROM w""")
def folder_tree(spark, sf):
    """All folders with their paths. Some nations are in two regions, and one holds its own region, which closes a cycle."""
    f, nation = m.items(spark, sf).filter("mode & 536870912 != 0"), m.table(spark, sf, "nation")
    edges = f.filter("parent is not null").selectExpr("parent", "item child")
    edges = edges.union(nation.filter("n_name like 'I%'").selectExpr("cast(4 * ((n_regionkey + 1) % 5) as bigint)", "cast(4 * n_nationkey + 1 as bigint)")).union(nation.filter("n_name = 'CHINA'").selectExpr("cast(4 * n_nationkey + 1 as bigint)", "cast(4 * n_regionkey as bigint)"))
    out = T.folder_tree(f.select(F.col("item").alias("folder"), "name"), edges, f.filter("parent is null").select(F.col("item").alias("folder")))
    return out.select("id_path", "name_path", "depth", "cycle")


@query("SELECT item AS folder FROM m_items WHERE mode & 536870912 <> 0 AND item NOT IN (SELECT unnest(ids) FROM m_walk WHERE upload_fk <> 0)")
def detached_folders(spark, sf):
    f = m.items(spark, sf).filter("mode & 536870912 != 0")
    edges = f.filter("parent is not null").select("parent", F.col("item").alias("child"))
    return T.detached(f.select(F.col("item").alias("folder")), edges, f.filter("parent is null and upload_fk != 0").select(F.col("item").alias("folder")))


@query("SELECT shown AS path, c.files AS sharing FROM m_walk w JOIN (SELECT pfile_fk, count(*) AS files FROM m_items GROUP BY 1) c ON w.pfile_fk = c.pfile_fk WHERE mode & 805306368 = 0")
def content_by_path(spark, sf):
    tree = m.items(spark, sf)
    shared = tree.groupBy("pfile_fk").agg(F.count("*").alias("sharing"))
    return T.contents_by_path(tree, shared).select("path", "sharing")


@query("SELECT upload_fk, count(*) AS files FROM m_files WHERE coalesce(pfile_fk, 0) <> 0 GROUP BY 1")
def plain_files(spark, sf):
    return I.plain_files(m.items(spark, sf)).groupBy("upload_fk").agg(F.count("*").alias("files"))


@query("SELECT item, name FROM m_items WHERE name ILIKE '%.c' AND pfile_fk IN (SELECT pfile_fk FROM m_findings WHERE rf_fk = 5) AND item NOT IN (SELECT item FROM m_decisions)")
def filtered_items(spark, sf):
    return I.by_attributes(m.items(spark, sf), extension="c", findings=m.findings(spark, sf), license=5, decided=m.decisions(spark, sf)).select("item", "name")


@query("SELECT item, pfile_fk FROM m_files WHERE coalesce(pfile_fk, 0) <> 0 AND NOT EXISTS (SELECT 1 FROM m_findings f WHERE f.pfile_fk = m_files.pfile_fk AND rf_fk IS NOT NULL)")
def files_without_finding(spark, sf):
    return I.without_findings(m.items(spark, sf), m.findings(spark, sf)).select("item", "pfile_fk")


@query("SELECT upload_fk, count(*) AS open_files FROM m_files WHERE coalesce(pfile_fk, 0) <> 0 AND item NOT IN (SELECT item FROM m_decisions WHERE decision_type > 0) GROUP BY 1")
def files_not_cleared(spark, sf):
    return I.not_cleared(m.items(spark, sf), m.decisions(spark, sf)).groupBy("upload_fk").agg(F.count("*").alias("open_files"))


@query("""SELECT item, name FROM m_items WHERE name ILIKE '%9%.c' AND mode & 536870912 = 0 AND upload_fk = 1 AND pfile_fk IN (SELECT pfile_fk FROM m_findings WHERE rf_fk % 7 = 0)
    ORDER BY name, item LIMIT 20 OFFSET 5""")
def file_search_page(spark, sf):
    found = I.search(m.items(spark, sf), name="%9%.c", kind="files", upload=1, licenses=m.findings(spark, sf).filter("rf_fk % 7 = 0"))
    return I.page(found, [F.col("name"), F.col("item")], 20, 5).select("item", "name")


@query("SELECT rf_pk, shortname FROM m_licenses WHERE shortname ILIKE '%ring%' AND rf_pk NOT IN (4, 8)")
def license_search(spark, sf):
    return I.licenses_named(m.licenses(spark, sf), "ring", [4, 8]).select("rf_pk", "shortname")


@query("SELECT u.upload_fk FROM (SELECT CAST(c_custkey AS BIGINT) upload_fk, c_acctbal > 5000 AS pub FROM customer) u WHERE pub OR upload_fk IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P' AND o_totalprice > 300000)")
def accessible_uploads(spark, sf):
    uploads = m.table(spark, sf, "customer").selectExpr("c_custkey upload_fk", "if(c_acctbal > 5000, 1, 0) public_perm")
    perms = m.table(spark, sf, "orders").selectExpr("o_custkey upload_fk", "if(o_orderstatus = 'P', 2, 1) group_fk", "if(o_totalprice > 300000, 1, 0) perm")
    return I.accessible(uploads, perms, 2).select("upload_fk")


@query("SELECT pfile_fk, count(*) AS n_items, count(DISTINCT upload_fk) AS n_uploads FROM m_items WHERE pfile_fk IS NOT NULL GROUP BY 1 HAVING count(DISTINCT upload_fk) > 1")
def content_sightings(spark, sf):
    return I.sightings(m.items(spark, sf))


@query("SELECT DISTINCT upload_fk, tag FROM (SELECT upload_fk, 'type-' || (rf_fk % 9) AS tag FROM m_items i JOIN m_findings f ON i.pfile_fk = f.pfile_fk WHERE rf_fk IS NOT NULL UNION ALL SELECT upload_fk, 'job-' || job_fk FROM m_items i JOIN m_events e ON i.item = e.item)")
def subtree_tags(spark, sf):
    file_tags = m.findings(spark, sf).filter("rf_fk is not null").selectExpr("pfile_fk", "concat('type-', rf_fk % 9) tag").distinct()
    item_tags = m.events(spark, sf).selectExpr("item", "concat('job-', job_fk) tag").distinct()
    return I.tags_of(m.items(spark, sf), file_tags, item_tags)


_NATURAL = r"array_to_string(list_transform(regexp_extract_all(lower(name), '\d+|\D+'), lambda x: CASE WHEN regexp_matches(x, '^\d') THEN lpad(len(regexp_replace(x, '^0+', ''))::VARCHAR, 4, '0') || regexp_replace(x, '^0+', '') ELSE x END), '')"


@query(f"SELECT item, name, row_number() OVER (PARTITION BY upload_fk ORDER BY {_NATURAL}, item) AS place FROM m_items WHERE mode & 805306368 = 0")
def natural_order(spark, sf):
    """The place of every file among those of its upload, in natural order."""
    keyed = m.items(spark, sf).filter("mode & 805306368 = 0").select("upload_fk", "item", "name", natural_key(F.col("name")).alias("_key"), F.lit(1).cast("long").alias("_one"))
    placed = T.running_total(keyed, "upload_fk", [F.col("_key"), F.col("item")], "_one", "_earlier")
    return placed.select("item", "name", (F.col("_earlier") + 1).alias("place"))


@query("SELECT upload_fk, item, name, lft FROM (SELECT *, row_number() OVER (ORDER BY lft) AS n FROM m_nested WHERE upload_fk = 1 AND mode & 805306368 = 0 AND lft > 10) WHERE n = 1")
def next_file(spark, sf):
    """The file that a user who works through an upload sees next."""
    return T.next_item(m.nested(spark, sf), 10, 1).select("upload_fk", "item", "name", "lft")


@query("SELECT item, CAST(event_pk AS BIGINT) event_pk FROM (SELECT item, event_pk, row_number() OVER (PARTITION BY item, rf_fk ORDER BY event_pk) n FROM m_events) WHERE n > 1")
def duplicate_events(spark, sf):
    return duplicates(m.events(spark, sf), ["item", "rf_fk"], ["event_pk"]).select("item", "event_pk")
