"""Queries over contents: fingerprints, tags, phrases, keywords."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline.functions import text as X
from ledgerline.functions.content import fingerprint
from ledgerline.operators import ingest as G
from ledgerline.operators import phrases as P
from ledgerline.operators import scanners as S
from ledgerline.operators import statements as C
from ledgerline.streaming.incremental import to_scan

from . import model as m
from .registry import query


def _docs(spark, sf, *more):
    return m.table(spark, sf, "documents").select("doc_id", "text", *more)


def _contents(spark, sf):
    return G.distinct_contents(_docs(spark, sf), "doc_id", F.col("text"))


_RULES = " ".join(f"UNION ALL SELECT doc_id, text, '{n}' AS shortname, {i} AS interest FROM documents WHERE contains(lower(text), '{seed}') AND regexp_matches(text, '{S.rule_pattern(rule)}')" for n, i, seed, rule in S.RULES)[10:]
_PHRASES = f"SELECT doc_id, text, shortname, interest FROM (SELECT *, max(interest) OVER (PARTITION BY doc_id) AS top FROM ({_RULES})) WHERE top < 2 OR interest >= 2"


@query("SELECT doc_id, upper(sha1(text)) AS sha1, upper(md5(text)) AS md5, upper(sha256(text)) AS sha256, CAST(strlen(text) AS BIGINT) AS size, upper(sha1(text)) || '.' || upper(md5(text)) || '.' || strlen(text) AS fuid FROM documents")
def pfile_fingerprint(spark, sf):
    return _docs(spark, sf).select("doc_id", *fingerprint(F.col("text")))


@query("SELECT sha1, md5, size, pfile_pk, copies FROM m_contents")
def pfile_dedup(spark, sf):
    return _contents(spark, sf)[0].select("sha1", "md5", "size", "pfile_pk", "copies")


@query("SELECT d.doc_id, c.pfile_pk FROM documents d JOIN m_contents c ON sha1(d.text) = c.sha1 AND md5(d.text) = c.md5")
def item_contents(spark, sf):
    return _contents(spark, sf)[1]


@query("SELECT o_orderkey, CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'text/x-csrc' WHEN '2' THEN 'text/x-chdr' WHEN '3' THEN 'text/plain' ELSE 'application/octet-stream' END AS mime FROM orders")
def mime_types(spark, sf):
    name = F.expr("concat('f', case substr(o_orderpriority, 1, 1) when '1' then '.c' when '2' then '.H' when '3' then '.txt' when '4' then '.x' else '' end)")
    return m.table(spark, sf, "orders").select("o_orderkey", G.mime_type(name).alias("mime"))


#: Beginnings of contents (hex), what follows them, and their types.
_CONTENTS = [
    ("1F8B08", "", "application/gzip"), ("504B0304" + "00" * 26, "word/document.xml", "application/vnd.openxmlformats-officedocument.wordprocessingml.document"),
    ("504B0304" + "00" * 26, "a/xl/workbook.xml", "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet"), ("504B0304" + "00" * 26, "META-INF/MANIFEST.MF", "application/java-archive"),
    ("504B0304" + "00" * 26, "META-INF/MANIFEST.MF and WEB-INF/web.xml", "application/x-webarchive"), ("504B0304" + "00" * 26, "mimetypeapplication/vnd.oasis.opendocument.text", "application/vnd.oasis.opendocument.text"),
    ("504B0304" + "00" * 26, "other.txt", "application/zip"), ("7F454C46" + "00" * 12 + "0300", "", "application/x-sharedlib"), ("7F454C46" + "00" * 12 + "0900", "", "application/x-elf"), ("CAFEBABE00000034", "", "application/x-java-applet"),
    ("CAFEBABE00000002", "", "application/x-mach-binary"), ("00" * 257 + "7573746172", "", "application/x-tar"), ("", "#!/usr/bin/env python3\n", "text/x-python"), ("", "#!/bin/sh\npython\n", "text/x-shellscript"),
    ("", "<?xml version='1.0'?>\n<svg>", "image/svg+xml"), ("", "<?xml version='1.0'?>\n<a>", "text/xml"), ("", "\n\n<!DOCTYPE html>", "text/html"), ("525949461C", "", "application/octet-stream"), ("524946460000000057454250", "", "image/webp"),
    ("213C617263683E0A", "debian-binary", "application/vnd.debian.binary-package"), ("213C617263683E0A", "x", "application/x-archive"),
]


@query("SELECT doc_id, ([" + ", ".join(f"'{t}'" for _, _, t in _CONTENTS) + f"])[(doc_id % {len(_CONTENTS)} + 1)::INT] AS mime FROM documents")
def content_types(spark, sf):
    """Types of contents by their bytes: what stands before the text of each document tells its type, names tell nothing."""
    place = (F.col("doc_id") % len(_CONTENTS) + 1).cast("int")
    begin = F.unhex(F.element_at(F.array(*[F.lit(h) for h, _, _ in _CONTENTS]), place))
    follow = F.encode(F.concat(F.element_at(F.array(*[F.lit(t) for _, t, _ in _CONTENTS]), place), F.lit("\n"), F.coalesce("text", F.lit(""))), "UTF-8")
    return _docs(spark, sf).select("doc_id", G.mime_type(F.lit("name"), F.concat(begin, follow)).alias("mime"))


@query("SELECT page_id, regexp_replace(url, '[^\\x20-\\x7E]|[/\\\\]', '~', 'g') AS name FROM pages")
def clean_names(spark, sf):
    return m.table(spark, sf, "pages").select("page_id", X.clean_name(F.col("url")).alias("name"))


@query(f"SELECT p.shortname, count(*) AS files, count(DISTINCT md5(p.text)) AS contents FROM ({_PHRASES} UNION ALL SELECT doc_id, text, 'No_license_found', 0 FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM ({_RULES}))) p GROUP BY 1")
def document_license_histogram(spark, sf):
    """Each license with the documents and the distinct contents it is in: texts are scanned where they are read, and only hashes meet."""
    docs = _docs(spark, sf).filter("text is not null").withColumn("content", F.struct(F.sha1("text"), F.md5("text"), F.octet_length("text")))
    found = S.phrase_rules(docs, "content", F.col("text")).groupBy("content", "shortname").agg(F.count("*").alias("copies"))
    return found.groupBy("shortname").agg(F.sum("copies").alias("files"), F.count("*").alias("contents"))


@query(f"SELECT doc_id, shortname, interest FROM ({_PHRASES}) UNION ALL SELECT doc_id, 'No_license_found', 0 FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM ({_RULES}))")
def phrase_rule_scan(spark, sf):
    return S.phrase_rules(_docs(spark, sf), "doc_id", F.col("text"))


_KEYWORDS = ["license", "copyright", "rights reserved", "warranty", "public"]


@query("SELECT doc_id, " + " + ".join(f"CAST(regexp_matches(text, '(?i){k}') AS INTEGER)" for k in _KEYWORDS) + " AS score FROM documents")
def keyword_score(spark, sf):
    return _docs(spark, sf).select("doc_id", S.keyword_score(F.col("text"), _KEYWORDS).alias("score"))


@query("SELECT doc_id FROM documents WHERE regexp_matches(CASE length(text) % 7 WHEN 0 THEN 'LICENCE' WHEN 1 THEN 'copying.txt' ELSE 'file.' || lang END, '(?i)licen[cs]e|copying') OR " + " OR ".join(f"regexp_matches(text, '(?i){k}')" for k in _KEYWORDS))
def scan_worthy_files(spark, sf):
    """Documents worth a scan by their names, of which some tell of a license, or by a keyword."""
    name = F.expr("case length(text) % 7 when 0 then 'LICENCE' when 1 then 'copying.txt' else concat('file.', lang) end")
    worth = S.scan_worthy(name, S.keyword_score(F.col("text"), _KEYWORDS), ["licen[cs]e", "copying"])
    return _docs(spark, sf, "lang").filter(worth).select("doc_id")


def _quoted(pattern):
    return pattern.replace("'", "''")


@query(f"SELECT doc_id, 'email' AS type, unnest(regexp_extract_all(text, '[A-Za-z0-9._+-]+@[A-Za-z0-9-]+\\.[A-Za-z.]+')) AS content FROM documents")
def email_findings(spark, sf):
    return S.regex_findings(_docs(spark, sf), "doc_id", F.col("text"), r"[A-Za-z0-9._+-]+@[A-Za-z0-9-]+\.[A-Za-z.]+", "email")


@query(f"SELECT doc_id, 'keyword' AS type, trim(regexp_replace(c, '[\\s\\x00-\\x1f]{{2,}}', ' ', 'g')) AS content, md5(trim(regexp_replace(c, '[\\s\\x00-\\x1f]{{2,}}', ' ', 'g'))) AS hash FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{_quoted(S.PATTERNS['keyword'])}')) AS c FROM documents)")
def keyword_findings(spark, sf):
    return S.contact_findings(_docs(spark, sf), "doc_id", F.col("text"), ("keyword",))


@query()
def contact_findings(spark, sf):
    """URLs, addresses, authors, export-control and patent phrases; look-around is beyond the oracle's dialect."""
    return S.contact_findings(_docs(spark, sf), "doc_id", F.col("text"), ("url", "email", "author", "ecc", "ipra"))


@query("""SELECT fk, 'statement' AS type, content || '.' AS content, md5(content || '.') AS hash, 3 AS start, CAST(4 + length(content) AS INTEGER) AS "end", TRUE AS is_enabled FROM m_texts""")
def copyright_statements(spark, sf):
    """Statements in comments, before a reservation of rights and a line that uses the word otherwise."""
    text = F.concat(F.lit("/* "), "content", F.lit(". All rights reserved. */\nThe copyright holders are not liable for them.\n"))
    return C.copyright_findings(m.texts(spark, sf).select("fk", text.alias("text")), "fk")


_LISTS = f"(SELECT pfile_fk, unnest(regexp_extract_all(text, '{S.TAG_LIST}', 1)) AS list FROM m_tagged)"


@query(f"SELECT pfile_fk, unnest(list_concat(regexp_extract_all(list, '{S.TAG_NAMES}', 1), list_transform(regexp_extract_all(list, '{S.TAG_DUAL}'), lambda x: 'Dual-license'))) AS name FROM {_LISTS}")
def license_tags(spark, sf):
    return S.license_tags(m.tagged(spark, sf), "pfile_fk", F.col("text")).select("pfile_fk", "name")


_KEY = "regexp_replace(regexp_replace(lower({}), '(\\+|-or-later)$', '+'), '-only$', '')"
_KNOWN = "SELECT p_partkey AS rf_pk, CASE p_partkey % 4 WHEN 0 THEN upper(replace(p_name, ' ', '-')) WHEN 1 THEN replace(p_name, ' ', '-') || '-only' WHEN 2 THEN p_type || '-or-later' ELSE replace(p_name, ' ', '-') END AS shortname, p_size % 5 AS group_fk FROM part"


@query(f"""SELECT t.pfile_fk, t.name, k.rf_pk FROM (SELECT pfile_fk, unnest(regexp_extract_all(list, '{S.TAG_NAMES}', 1)) AS name FROM {_LISTS}) t LEFT JOIN
    (SELECT name, rf_pk FROM (SELECT n.name, k.rf_pk, row_number() OVER (PARTITION BY n.name ORDER BY k.group_fk <> 0, lower(n.name) <> lower(k.shortname), k.rf_pk) AS place
        FROM (SELECT DISTINCT unnest(regexp_extract_all(list, '{S.TAG_NAMES}', 1)) AS name FROM {_LISTS}) n JOIN ({_KNOWN}) k ON {_KEY.format("n.name")} = {_KEY.format("k.shortname")} WHERE k.group_fk IN (0, 1)) WHERE place = 1) k ON t.name = k.name""")
def resolved_tags(spark, sf):
    """Parts stand for licenses: those of group 0 are the main ones, the others candidates of their groups."""
    tags = S.license_tags(m.tagged(spark, sf), "pfile_fk", F.col("text")).filter(F.col("name") != S.DUAL)
    names = "case p_partkey % 4 when 0 then upper(replace(p_name, ' ', '-')) when 1 then concat(replace(p_name, ' ', '-'), '-only') when 2 then concat(p_type, '-or-later') else replace(p_name, ' ', '-') end shortname"
    known = m.table(spark, sf, "part").selectExpr("p_partkey rf_pk", names, "p_size % 5 group_fk")
    return S.resolved_tags(tags, known.filter("group_fk = 0"), known.filter("group_fk != 0"), 1).select("pfile_fk", "name", "rf_pk")


@query("SELECT d.doc_id, h.line, h.pos, h.content FROM documents d LEFT JOIN (SELECT doc_id, CAST(n AS INTEGER) AS line, CAST(instr(content, regexp_extract(content, '[Ll]icense[d]?')) AS INTEGER) AS pos, content FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS content, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents) WHERE regexp_matches(content, '[Ll]icense[d]?')) h ON d.doc_id = h.doc_id")
def regex_scan_lines(spark, sf):
    return S.line_scan(_docs(spark, sf), "doc_id", F.col("text"), "[Ll]icense[d]?")


@query("SELECT doc_id, CAST(len(regexp_extract_all(text, '[^\\s\\x0B]+')) AS BIGINT) AS words, upper(hex(encode(text)[1:32])) AS head FROM documents")
def word_counts(spark, sf):
    return _docs(spark, sf).select("doc_id", X.word_count(F.col("text")).alias("words"), X.head_hex(F.col("text")).alias("head"))


def _steps_sql(column, steps):
    for pattern, to in steps:
        column = f"regexp_replace({column}, '{_quoted(pattern)}', '{_quoted(to)}', 'g')"
    return column


@query(f"SELECT page_id, {_steps_sql('html', S.clean_up_steps(markup=True))} AS text FROM pages")
def doctored_pages(spark, sf):
    return m.table(spark, sf, "pages").select("page_id", S.doctored(F.col("html"), markup=True).alias("text"))


@query(f"SELECT doc_id, {_steps_sql('text', S.clean_up_steps())} AS text FROM documents")
def doctored_documents(spark, sf):
    return _docs(spark, sf).select("doc_id", S.doctored(F.col("text")).alias("text"))


def _phrases(spark):
    return spark.createDataFrame(_PHRASE_ROWS, "rf_pk long, shortname string, text string")


_TOKENS = "list_filter(regexp_split_to_array({}, '(//|/\\*|\\*/|::|\"\"\"|''''''|dnl|[ \\t\\n\\r\\f#^%,*\\x00])+'), lambda x: x <> '' AND x <> 'rem')"
_LOW = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PHRASE_ROWS = [(i + 1, n, t) for i, (n, t) in enumerate([
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."), ("MIT", "Released under the MIT License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."), ("CC", "Licensed under CC BY-NC 4.0."), ("Short", "rights reserved"),
])]
_PHRASE_SQL = "(VALUES " + ", ".join(f"({k}, '{t}')" for k, _, t in _PHRASE_ROWS) + ") p(rf_pk, text)"


@query(f"""SELECT pfile_fk, rf_pk, CAST(i - 1 AS INTEGER) AS start, CAST(i - 1 + len(w) AS INTEGER) AS "end" FROM
    (SELECT pfile_fk, rf_pk, t, w, unnest(range(1, len(t) - len(w) + 2)) AS i FROM (SELECT doc_id AS pfile_fk, {_TOKENS.format(_LOW)} AS t FROM documents) d
     JOIN (SELECT rf_pk, {_TOKENS.format(_LOW)} AS w FROM {_PHRASE_SQL}) p ON contains(chr(31) || array_to_string(t, chr(31)) || chr(31), chr(31) || array_to_string(w, chr(31)) || chr(31)))
    WHERE t[i:i + len(w) - 1] = w""")
def token_full_matches(spark, sf):
    """Where license texts stand in documents without a difference, in tokens; overlapping ones too."""
    files = _docs(spark, sf).select(F.col("doc_id").alias("pfile_fk"), P.token_array(F.col("text")).alias("tokens"))
    return P.token_matches(files, P.searched(_phrases(spark))).filter("full").select("pfile_fk", "rf_pk", "start", "end")


_AT = "SELECT {k}, w, unnest(range(1, len(w) + 1)) AS i FROM (SELECT {k}, {tokens} AS w FROM {rows})"
_FILE_AT, _PHRASE_AT = _AT.format(k="doc_id", tokens=_TOKENS.format(_LOW), rows="documents"), _AT.format(k="rf_pk", tokens=_TOKENS.format(_LOW), rows=_PHRASE_SQL)


@query(f"""SELECT f.doc_id AS pfile_fk, p.rf_pk, CAST(f.i - 1 AS INTEGER) AS t, CAST(p.i - 1 AS INTEGER) AS s FROM ({_FILE_AT}) f JOIN ({_PHRASE_AT}) p
    ON f.w[f.i] = p.w[p.i] AND f.w[f.i:f.i + 2] = p.w[p.i:p.i + 2] WHERE len(p.w) > 3 AND p.i <= 11 AND p.i + 2 <= len(p.w)
    UNION ALL SELECT f.doc_id, p.rf_pk, CAST(f.i - 1 AS INTEGER), 0 FROM ({_FILE_AT}) f JOIN ({_PHRASE_AT}) p ON f.w[f.i] = p.w[1] AND f.w[f.i:f.i + len(p.w) - 1] = p.w WHERE len(p.w) <= 3 AND p.i = 1""")
def phrase_candidates(spark, sf):
    """Where a run of three tokens of a document is one at the first eleven positions of a phrase; short phrases whole."""
    files = _docs(spark, sf).select(F.col("doc_id").alias("pfile_fk"), P.token_array(F.col("text")).alias("tokens"))
    return P.candidates(files, P.searched(_phrases(spark)))


@query(f"""SELECT pfile_fk, rf_pk, start, "end" FROM ({token_full_matches.sql}) b WHERE NOT EXISTS (SELECT 1 FROM ({token_full_matches.sql}) a WHERE a.pfile_fk = b.pfile_fk AND a.start <= b.start AND a."end" >= b."end"
    AND (a.start < b.start OR a."end" > b."end" OR a.rf_pk < b.rf_pk))""")
def surviving_full_matches(spark, sf):
    """Full matches that no other one holds."""
    files = _docs(spark, sf).select(F.col("doc_id").alias("pfile_fk"), P.token_array(F.col("text")).alias("tokens"))
    found = P.token_matches(files, P.searched(_phrases(spark))).filter("full")
    return P.surviving(found, spark.createDataFrame([], "big long, small long")).select("pfile_fk", "rf_pk", "start", "end")


@query("SELECT doc_id, 'rights' AS type, unnest(regexp_extract_all(text, '(?i)(all|some)[\\t ]+rights[\\t ]+reserved')) AS content FROM documents")
def configured_findings(spark, sf):
    """A scanner from a configuration text in which values refer to earlier ones."""
    config = S.parse_config("SPACES=[\\t ]+\nwho=(all|some)\nrights=__who____SPACES__rights\nrights=(?i)__rights____SPACES__reserved")
    kind, group, pattern = S.described_scanner("rights@@0@@" + X.java_regex(config["rights"]))
    return S.regex_findings(_docs(spark, sf), "doc_id", F.col("text"), pattern, kind, group)


@query()
def token_fingerprint_match(spark, sf):
    """License texts in documents, with differences, by the three-token index and the diff."""
    files = _docs(spark, sf).withColumnRenamed("doc_id", "pfile_fk")
    return P.matches(files, _phrases(spark)).select("pfile_fk", "rf_pk", "full", "pct", "start", "end")


@query(f"SELECT doc_id AS pfile_fk, doc_id AS item FROM documents WHERE contains(chr(31) || array_to_string({_TOKENS.format(_LOW)}, chr(31)) || chr(31), chr(31) || 'released' || chr(31) || 'under' || chr(31) || 'the' || chr(31) || 'mit' || chr(31) || 'license.' || chr(31))")
def bulk_phrase_matches(spark, sf):
    docs = _docs(spark, sf)
    files = docs.select(F.col("doc_id").alias("pfile_fk"), "text")
    return P.bulk_matches(docs.selectExpr("doc_id item", "doc_id pfile_fk"), files, "Released  under the # MIT License.").select("pfile_fk", "item")


@query(f"""SELECT doc_id AS pfile_fk, p.k AS phrase_pk FROM (SELECT doc_id, chr(31) || array_to_string({_TOKENS.format(_LOW)}, chr(31)) || chr(31) AS t FROM documents) d
    JOIN (VALUES (1, 'all rights reserved.'), (2, 'licensed under'), (3, 'license.')) p(k, w) ON contains(t, chr(31) || replace(w, ' ', chr(31)) || chr(31))""")
def phrase_hits(spark, sf):
    phrases = spark.createDataFrame([(1, "All rights reserved."), (2, "Licensed under"), (3, "License.")], "phrase_pk int, text string")
    return P.phrase_hits(_docs(spark, sf).withColumnRenamed("doc_id", "pfile_fk"), phrases)


@query("SELECT DISTINCT pfile_fk FROM m_items WHERE pfile_fk IS NOT NULL AND item NOT IN (SELECT item FROM m_decisions WHERE decision_type = 4) AND pfile_fk IN (SELECT pfile_fk FROM m_findings WHERE rf_fk IS NOT NULL)")
def bulk_scan_candidates(spark, sf):
    return P.scan_candidates(m.items(spark, sf), m.decisions(spark, sf), m.findings(spark, sf), only_with_findings=True)


@query("SELECT DISTINCT pfile_fk FROM m_items WHERE pfile_fk IS NOT NULL AND pfile_fk NOT IN (SELECT pfile_fk FROM m_findings WHERE agent_fk = 2)")
def incremental_anti_join(spark, sf):
    return to_scan(m.items(spark, sf).filter("pfile_fk is not null").select("pfile_fk").distinct(), m.findings(spark, sf), 2)


@query("SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'LicenseRef-local-' || regexp_replace(regexp_replace(replace(p_name || ' ' || p_brand, ' ', '-'), '[^a-zA-Z0-9.\\-]', '-', 'g'), '-+', '-', 'g') ELSE replace(p_name, ' ', '-') END AS spdx_id FROM part")
def spdx_id_normalise(spark, sf):
    known = F.expr("if(p_size % 3 = 0, '', p_name)")
    return m.table(spark, sf, "part").select("p_partkey", X.spdx_id(F.concat_ws(" ", "p_name", "p_brand"), known).alias("spdx_id"))
