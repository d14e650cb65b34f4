"""The model tables in SQL, for comparison with model.py: the same tables, written for DuckDB."""

TABLES = {
    "m_items": """
        SELECT CAST(r_regionkey AS BIGINT) upload_fk, 4 * CAST(r_regionkey AS BIGINT) item, CAST(NULL AS BIGINT) parent, CAST(NULL AS BIGINT) pfile_fk, 536870912 AS mode, r_name AS name FROM region
        UNION ALL SELECT n_regionkey, 4 * CAST(n_nationkey AS BIGINT) + 1, 4 * CAST(n_regionkey AS BIGINT), NULL, CASE WHEN n_nationkey % 5 = 0 THEN 805306368 ELSE 536870912 END, n_name FROM nation
        UNION ALL SELECT n_regionkey, 4 * c_custkey + 2, 4 * CAST(c_nationkey AS BIGINT) + 1, NULL, 536870912, c_name FROM customer JOIN nation ON c_nationkey = n_nationkey
        UNION ALL SELECT n_regionkey, 4 * o_orderkey + 3, 4 * o_custkey + 2, o_orderkey // 2, CASE WHEN o_orderstatus = 'O' THEN 268435456 ELSE 0 END,
            'order-' || o_orderkey || CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN '.c' WHEN '2' THEN '.h' WHEN '3' THEN '.txt' WHEN '4' THEN '.c.license' ELSE '' END
            FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""",
    "m_walk": r"""
        SELECT i.*, [CASE WHEN mode & 536870912 <> 0 THEN '0' ELSE '1' END || name || chr(1) || lpad(CAST(item AS VARCHAR), 20, '0')] AS sort_path, [item] AS ids, '/' || name AS path,
            CASE WHEN mode & 268435456 <> 0 THEN '' ELSE '/' || name END AS shown, CAST(NULL AS BIGINT) AS realparent, CASE WHEN mode & 268435456 = 0 THEN item END AS seen, 0 AS depth FROM m_items i WHERE parent IS NULL
        UNION ALL SELECT c.*, list_append(w.sort_path, CASE WHEN c.mode & 536870912 <> 0 THEN '0' ELSE '1' END || c.name || chr(1) || lpad(CAST(c.item AS VARCHAR), 20, '0')), list_append(w.ids, c.item), w.path || '/' || c.name,
            w.shown || CASE WHEN c.mode & 268435456 <> 0 THEN '' ELSE '/' || c.name END, w.seen, CASE WHEN c.mode & 268435456 = 0 THEN c.item ELSE w.seen END, w.depth + 1 FROM m_walk w JOIN m_items c ON c.parent = w.item""",
    "m_sizes": "SELECT a AS item, count(*) AS size FROM (SELECT unnest(ids) AS a FROM m_walk) GROUP BY a",
    "m_nested": """
        SELECT upload_fk, w.item, parent, pfile_fk, mode, name, depth, 2 * (row_number() OVER (PARTITION BY upload_fk ORDER BY sort_path) - 1) - depth AS lft,
            2 * (row_number() OVER (PARTITION BY upload_fk ORDER BY sort_path) - 1) - depth + 2 * size - 1 AS rgt FROM m_walk w JOIN m_sizes s ON w.item = s.item""",
    "m_files": "SELECT * FROM m_items WHERE mode & 805306368 = 0",
    "m_findings": "SELECT l_orderkey * 8 + l_linenumber AS fl_pk, l_orderkey // 2 AS pfile_fk, CASE WHEN l_linenumber <> 7 THEN l_partkey END AS rf_fk, CAST(l_suppkey % 3 + 1 AS INTEGER) AS agent_fk, 2 * CAST(l_quantity AS INTEGER) AS pct FROM lineitem",
    "m_licenses": "SELECT p_partkey AS rf_pk, p_name || ' ' || p_brand AS shortname, p_type AS license_type, p_size % 6 AS risk FROM part",
    "m_events": """
        SELECT event_id AS event_pk, 4 * user_id + 3 AS item, user_id // 2 AS pfile_fk, CAST(floor(value) AS BIGINT) AS rf_fk, event_type = 'error' AS removed,
            CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 WHEN 'purchase' THEN 3 WHEN 'signup' THEN 6 ELSE 5 END AS event_type, event_id % 50 AS job_fk, ts FROM events""",
    "m_decisions": """
        SELECT event_id AS decision_pk, 4 * user_id + 3 AS item, user_id // 2 AS pfile_fk, CAST(event_id % 3 AS INTEGER) AS group_fk,
            CASE event_type WHEN 'click' THEN 5 WHEN 'view' THEN 0 WHEN 'purchase' THEN 4 WHEN 'signup' THEN 6 ELSE 7 END AS decision_type, CAST(event_id // 3 % 2 AS INTEGER) AS scope, ts FROM events""",
    "m_texts": """
        SELECT o_orderkey AS fk, 4 * o_orderkey + 3 AS item, o_orderkey // 2 AS pfile_fk, 'Copyright ' || extract(year FROM o_orderdate) || ' ' || o_orderpriority AS content,
            md5('Copyright ' || extract(year FROM o_orderdate) || ' ' || o_orderpriority) AS hash, o_totalprice > 50000 AS is_enabled FROM orders""",
    "m_overlay": """
        SELECT user_id AS fk, 4 * user_id + 3 AS item, CASE arg_max(event_type, event_id) WHEN 'click' THEN 'Edited ' || max(event_id) % 10 WHEN 'view' THEN '  ' END AS content, arg_max(event_type, event_id) <> 'error' AS is_enabled, max(event_id) AS event_pk FROM events GROUP BY user_id""",
    "m_runs": "SELECT s_suppkey AS run_pk, CAST(s_nationkey % 5 AS BIGINT) AS upload_fk, CASE s_suppkey % 3 WHEN 0 THEN 'keyword' WHEN 1 THEN 'phrase' ELSE 'tag' END AS agent_name, CAST(s_suppkey % 3 + 1 AS INTEGER) AS agent_fk, s_acctbal > 0 AS success FROM supplier",
    "m_tagged": "SELECT p_partkey AS pfile_fk, 'x' || chr(10) || ' * SPDX-License-Identifier: ' || replace(p_name, ' ', '-') || CASE p_size % 3 WHEN 0 THEN '' WHEN 1 THEN ' OR ' || p_type ELSE ' AND GPL-2.0+' END || chr(10) || 'end' AS text FROM part",
    "m_matches": """
        SELECT DISTINCT 4 * l_orderkey + 3 AS item, l_partkey % 4 AS license, CASE l_suppkey % 3 WHEN 0 THEN 'keyword' WHEN 1 THEN 'phrase' ELSE 'tag' END AS scanner, l_partkey % 4 AS rf_fk,
            CAST(l_quantity AS INTEGER) AS region_start, CAST(l_quantity AS INTEGER) + CASE WHEN l_suppkey % 3 = 1 THEN 30 ELSE 3 END AS region_end FROM lineitem""",
    "m_scans": """
        SELECT DISTINCT 4 * l_orderkey + 3 AS item, l_partkey % 2 AS license, (['keyword', 'phrase', 'tag', 'sidecar', 'sentence'])[(l_suppkey % 5 + 1)::INT] AS scanner, l_partkey % 2 AS rf_fk,
            CAST(l_quantity AS INTEGER) AS region_start, CAST(l_quantity AS INTEGER) + CASE WHEN l_suppkey % 5 = 1 THEN 30 ELSE 3 END AS region_end FROM lineitem""",
    "m_order_events": "SELECT o_orderkey AS event_pk, 4 * o_orderkey + 3 AS item, o_custkey % 2 AS rf_fk, CASE WHEN o_orderstatus = 'O' THEN 2 ELSE 1 END AS event_type FROM orders WHERE o_orderpriority LIKE '1%'",
    "m_fileset": "SELECT i.item, i.name, list_sort(list(DISTINCT l.license_type) FILTER (l.license_type IS NOT NULL)) AS licenses FROM m_files i LEFT JOIN m_findings f ON i.pfile_fk = f.pfile_fk LEFT JOIN m_licenses l ON f.rf_fk = l.rf_pk GROUP BY i.item, i.name",
    "m_contents": "SELECT sha1(text) AS sha1, md5(text) AS md5, CAST(strlen(text) AS BIGINT) AS size, min(doc_id) AS pfile_pk, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY 1, 2, 3",
}
