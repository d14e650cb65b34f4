"""Queries of the license decision tree, over documents behind which a license statement stands."""

from __future__ import annotations

import re
import uuid

import pandas as pd
from pyspark.sql import functions as F

from ledgerline.operators import automaton as A
from ledgerline.operators import phrase_index as PI
from ledgerline.operators import rule_graph as L
from ledgerline.operators import scanner_functions as SF
from ledgerline.operators.phrases import token_array
from ledgerline.sources import charsets as CS
from ledgerline.sources import rdf as R
from ledgerline.storage import shared_folder

from . import model as m
from .registry import query
from .scan_queries import _phrases, phrase_candidates

_RULES = L.in_order(L.own_rules())
_PHRASES = L.phrases_of(_RULES)
#: Every way to say each rule, as it may be laid out in a comment: other case, punctuation and line ends.
_STATEMENTS = [" by this or that ".join(("-\n * " if i % 2 else ", ").join(w.upper() if i % 3 else w.title() for w in p.split()) for p in says) for r in _RULES for i, says in enumerate(r.says)]


def _with_statements(spark, sf):
    """doc_id and body: each document with one of the statements at its end."""
    said = F.element_at(F.array(*[F.lit(s) for s in _STATEMENTS]), (F.col("doc_id") % len(_STATEMENTS) + 1).cast("int"))
    return m.table(spark, sf, "documents").select("doc_id", F.concat(F.coalesce("text", F.lit("")), F.lit("\n"), said).alias("body"))


_BODY = f"SELECT doc_id, coalesce(text, '') || chr(10) || (list_value({', '.join(repr(s).replace(chr(92) + 'n', chr(10)) for s in _STATEMENTS)}))[(doc_id % {len(_STATEMENTS)} + 1)::INT] AS body FROM documents"
_CLEAN = f"SELECT doc_id, ' ' || trim(regexp_replace(translate(body, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9+]+', ' ', 'g')) || ' ' AS c FROM ({_BODY})"


def _says(parts) -> str:
    if len(parts) == 1:
        return f"contains(c, ' {parts[0]} ')"
    return f"regexp_matches(c, ' {f'( .{{0,{L.GAP - 2}}})? '.join(p.replace('+', chr(92) + '+') for p in parts)} ')"


def _condition(rule, by_name) -> str:
    own = [f"({' OR '.join(_says(s) for s in rule.says)})"] if rule.says else []
    return " AND ".join([*own, *[f"({_condition(by_name[n], by_name)})" for n in rule.needs], *[f"NOT ({_condition(by_name[n], by_name)})" for n in rule.unless]])


_BY_NAME = {r.name: r for r in _RULES}
_FOUND = ", ".join(f"CASE WHEN {_condition(r, _BY_NAME)} THEN {{'shortname': '{r.license}', 'interest': {r.interest}}} END" for r in _RULES if r.license)


@query(f"""WITH f AS (SELECT doc_id, list_distinct(list_filter(list_value({_FOUND}), lambda x: x IS NOT NULL)) AS l FROM ({_CLEAN})),
    k AS (SELECT doc_id, CASE WHEN len(l) = 0 THEN [{{'shortname': '{L.NOTHING}', 'interest': 0}}] WHEN len(list_filter(l, lambda x: x.interest >= 2)) > 0 THEN list_filter(l, lambda x: x.interest >= 2) ELSE l END AS l FROM f)
    SELECT doc_id, s.shortname, s.interest FROM (SELECT doc_id, unnest(l) AS s FROM k)""")
def license_rule_tree(spark, sf):
    """The licenses of every document by the decision tree."""
    return L.rule_findings(_with_statements(spark, sf), ["doc_id"], F.col("body")).select("doc_id", "shortname", "interest")


_EDGE = "[^A-Za-z0-9+]"
_EACH = " UNION ALL ".join(f"SELECT doc_id, '{p}' AS phrase, unnest(regexp_extract_all(body, '(?i)(?:^|{_EDGE})({(_EDGE + '+').join(map(re.escape, p.split(' ')))})(?:$|{_EDGE})', 1)) AS piece FROM b" for p in _PHRASES)


@query(f"WITH b AS ({_BODY}) SELECT * FROM ({_EACH})")
def license_phrase_spans(spark, sf):
    """What stands in the original text where the cleaned one holds a phrase of a rule."""
    found = A.scanned(_with_statements(spark, sf), ["doc_id", "body"], F.col("body"), _PHRASES)
    each = found.select("doc_id", "body", "hits.phrase", A.original_spans(F.col("starts"), F.col("shifts"), F.col("hits")).alias("spans"))
    each = each.select("doc_id", "body", F.explode(F.arrays_zip("phrase", "spans")).alias("h"))
    name = F.element_at(F.array(*[F.lit(p) for p in _PHRASES]), F.col("h.phrase") + 1)
    span = F.col("h.spans")
    return each.select("doc_id", name.alias("phrase"), F.substring("body", span["start"] + 1, span["end"] - span["start"]).alias("piece"))


@query("SELECT doc_id, trim(regexp_replace(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9+]+', ' ', 'g')) AS clean FROM documents WHERE text IS NOT NULL")
def cleaned_for_rules(spark, sf):
    """The form of every document in which rules search, as the scanner makes it."""
    docs = m.table(spark, sf, "documents").filter("text is not null")
    return A.scanned(docs, ["doc_id"], F.col("text"), ["license"], clean=True).select("doc_id", F.trim("clean").alias("clean"))


#: Files of one RDF bill of material: a bill is parsed by one task, so more files make more bills, not larger ones.
_FILES_OF_A_BILL = 5000
_RDF_LICENSES = "['MIT', 'Apache-2.0', 'GPL-2.0+', 'BSD 3']"


@query(f"""SELECT 'docs/' || doc_id || ' & more.txt' AS name, sha1(text) AS hash, array_to_string(CASE doc_id % 4 WHEN 0 THEN ['Apache-2.0', 'MIT'] WHEN 1 THEN ['BSD 3', '{R.DUAL}', 'GPL-2.0+'] WHEN 2 THEN ['MIT-or-later'] ELSE [({_RDF_LICENSES})[(length(text) % 4 + 1)::INT]] END, ';') AS concluded,
    lang AS found, replace(text[:40], chr(13), chr(10)) AS copyright FROM documents WHERE text IS NOT NULL""")
def spdx_rdf_round_trip(spark, sf):
    """Every document as a file of an RDF bill of materials, one bill for some thousand files, read again by its triples."""
    docs = m.table(spark, sf, "documents").filter("text is not null").select("doc_id", "lang", "text")
    two = F.when(F.expr("doc_id % 4") == 0, F.array(F.lit("Apache-2.0"), F.lit("MIT"))).when(F.expr("doc_id % 4") == 1, F.array(F.lit("GPL-2.0+"), F.lit("BSD 3"))).when(F.expr("doc_id % 4") == 2, F.array(F.lit("MIT")))
    one = F.array(F.element_at(F.array(*[F.lit(x) for x in ("MIT", "Apache-2.0", "GPL-2.0+", "BSD 3")]), (F.length("text") % 4 + 1).cast("int")))
    how = F.element_at(F.array(F.lit("AND"), F.lit("OR"), F.lit("LATER"), F.lit(None)), F.expr("cast(doc_id % 4 + 1 as int)"))
    files = docs.select(F.col("doc_id").alias("id"), F.concat(F.lit("docs/"), "doc_id", F.lit(" & more.txt")).alias("name"), F.sha1("text").alias("sha1"), how.alias("operator"), F.coalesce(two, one).alias("licenses"), F.array_compact(F.array("lang")).alias("found"), F.substring("text", 1, 40).alias("copyright"))
    path = f"{shared_folder(spark)}/core/{spark.sparkContext.applicationId}/rdf-{uuid.uuid4().hex}"
    R.write_spdx_rdf(files.repartition(max(8, -(-docs.count() // _FILES_OF_A_BILL)), "id"), path)
    bill = R.files_of(R.triples(spark.read.text(path, wholetext=True).select(F.input_file_name().alias("doc"), F.col("value").alias("text"))))
    return bill.select("name", "hash", F.array_join("concluded", ";").alias("concluded"), F.nullif(F.array_join("found", ";"), F.lit("")).alias("found"), "copyright")


@query(f"""SELECT doc_id, 'year' AS type, content, CAST(instr(text, content) AS INTEGER) > 0 AS inside FROM (SELECT doc_id, text, unnest(regexp_extract_all(text, '(?:19|20)[0-9][0-9]')) AS content FROM documents)
    UNION ALL SELECT doc_id, 'phrase', '{_PHRASES[0]}', TRUE FROM documents WHERE contains(' ' || trim(regexp_replace(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9+]+', ' ', 'g')) || ' ', ' {_PHRASES[0]} ')
    UNION ALL SELECT doc_id, 'phrase', 'all rights reserved', TRUE FROM (SELECT doc_id, unnest(regexp_extract_all(' ' || trim(regexp_replace(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9+]+', ' ', 'g')) || ' ', ' all rights reserved ')) FROM documents)""")
def scanners_in_sql(spark, sf):
    """Two scanners called from SQL, one row for each finding in every document."""
    SF.register_scanners(spark)
    m.table(spark, sf, "documents").createOrReplaceTempView("_scanned_documents")
    return spark.sql(
        f"""SELECT doc_id, f.type, f.content, substring(text, f.start + 1, f.end - f.start) = f.content AS inside FROM _scanned_documents, LATERAL scan_pattern(text, '(?:19|20)[0-9][0-9]', 'year') f
        UNION ALL SELECT doc_id, 'phrase', f.phrase, regexp_replace(lower(substring(text, f.start + 1, f.end - f.start)), '[^a-z0-9+]+', ' ') = f.phrase FROM _scanned_documents, LATERAL scan_phrases(text, '{_PHRASES[0]}|all rights reserved') f"""
    )


@query(f"SELECT c.* FROM ({phrase_candidates.sql}) c WHERE rf_pk = 5 OR pfile_fk NOT IN (SELECT doc_id FROM labels)")
def candidates_of_new_phrases(spark, sf):
    """Labelled documents have been scanned before the last phrase came: they meet that one only, the others meet all."""
    table = f"phrase_index_{uuid.uuid4().hex}"
    phrases = _phrases(spark)
    first = PI.extend_index(spark, table, phrases.filter("rf_pk < 5"))
    PI.extend_index(spark, table, phrases)
    files = m.table(spark, sf, "documents").select(F.col("doc_id").alias("pfile_fk"), token_array(F.col("text")).alias("tokens"))
    seen = PI.marked_scanned(m.table(spark, sf, "labels").select(F.col("doc_id").alias("pfile_fk")), first)
    return PI.new_candidates(files, seen, table)


#: Charsets, and their letters for a to z: words keep their lengths and repeats.
_LETTERS = {"cp1251": "абцдефгхийклмнопярстувжыьз", "koi8_r": "абцдефгхийклмнопярстувжыьз", "euc_jp": "あきくけこしすせそたちつてとなにぬねのはひふまやらん", "big5": "的一是不了人我在有他這為之大來以個中上們到說國和地"}
_OTHER_TEXT = "translate(lower(regexp_replace(text, '[^\\x01-\\x7F]', '', 'g')), 'abcdefghijklmnopqrstuvwxyz', ([{}])[(doc_id % {} + 1)::INT])".format(", ".join(f"'{x}'" for x in _LETTERS.values()), len(_LETTERS))


def _encoded(batches):
    names = list(_LETTERS)
    for rows in batches:
        made = [t.encode(names[i % len(names)]) for i, t in zip(rows.doc_id, rows.text, strict=True)]
        yield pd.DataFrame({"doc_id": rows.doc_id, "content": made})


@query(f"SELECT doc_id, {_OTHER_TEXT} AS text FROM documents WHERE text IS NOT NULL")
def texts_of_other_charsets(spark, sf):
    """Documents in other letters, written in four charsets and read without being told which."""
    docs = m.table(spark, sf, "documents").filter("text is not null")
    text = F.lower(F.regexp_replace("text", r"[^\x01-\x7F]", ""))
    each = [F.when(F.col("doc_id") % len(_LETTERS) == i, F.translate(text, "abcdefghijklmnopqrstuvwxyz", x)) for i, x in enumerate(_LETTERS.values())]
    content = docs.select("doc_id", F.coalesce(*each).alias("text")).mapInPandas(_encoded, "doc_id long, content binary")
    return CS.with_charset(content, "doc_id").select("doc_id", "text")
