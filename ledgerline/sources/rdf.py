"""SPDX 2 as RDF: documents as triples, files and licenses by joins on them, and documents written from rows."""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import reduce
from xml.parsers import expat

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.storage import settled

# Namespaces, and the marker of licenses that are not on the SPDX list.
RDF, TERMS, LICENSES = "http://www.w3.org/1999/02/22-rdf-syntax-ns#", "http://spdx.org/rdf/terms#", "http://spdx.org/licenses/"
REF_PREFIX, DUAL = "LicenseRef-", "Dual-license"
#: Sets within sets.
MOST_LEVELS = 30


def parse(text: str) -> Iterator[tuple[str, str, str, bool]]:
    """(subject, predicate, object, whether the object is a literal) of an RDF/XML text; nothing of one that is no XML.

    Nodes without a name get one each, ``_:`` and a number; rdf:ID="x" is "#x". Node and property elements alternate;
    a property holds a reference, a node, or text.
    """
    found: list[tuple[str, str, str, bool]] = []
    frames: list[list] = []  # [kind, subject, predicate, text, whether a node was inside]
    blank = (f"_:b{i}" for i in itertools.count())
    full = lambda name: name.replace(" ", "", 1)
    of = lambda attrs, local: attrs.get(RDF + " " + local)

    def name_of(attrs: dict) -> str:
        if (node := of(attrs, "nodeID")) is not None:
            return f"_:n{node}"
        if (own := of(attrs, "ID")) is not None:
            return f"#{own}"
        return of(attrs, "about") if of(attrs, "about") is not None else next(blank)

    def start(name: str, attrs: dict) -> None:
        kind = frames[-1][0] if frames else None
        if kind is None and full(name) == RDF + "RDF":
            frames.append(["root", "", "", [], False])
        elif kind == "node":
            subject, predicate = frames[-1][1], full(name)
            frames.append(["property", subject, predicate, [], False])
            target = of(attrs, "resource")
            if target is None and of(attrs, "nodeID") is not None:
                target = name_of(attrs)
            if target is not None or of(attrs, "parseType") == "Resource":
                frames[-1][4] = True
                found.append((subject, predicate, next(blank) if target is None else target, False))
            if of(attrs, "parseType") == "Resource":
                frames[-1][:2] = "node", found[-1][2]
        else:
            subject = name_of(attrs)
            if full(name) != RDF + "Description":
                found.append((subject, RDF + "type", full(name), False))
            found.extend((subject, full(k), v, True) for k, v in attrs.items() if " " in k and not k.startswith((RDF, "http://www.w3.org/XML")))
            if kind == "property":
                frames[-1][4] = True
                found.append((frames[-1][1], frames[-1][2], subject, False))
            frames.append(["node", subject, "", [], False])

    def end(_: str) -> None:
        kind, subject, predicate, text, inside = frames.pop()
        if kind == "property" and not inside:
            found.append((subject, predicate, "".join(text), True))

    def data(chars: str) -> None:
        if frames and frames[-1][0] == "property":
            frames[-1][3].append(chars)

    parser = expat.ParserCreate(namespace_separator=" ")
    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, end, data
    try:
        parser.Parse(text.encode(), True)
    except expat.ExpatError:
        return iter(())
    return iter(found)


_TRIPLE = "doc string, s string, p string, o string, literal boolean"


def triples(documents: DataFrame, rows_at_once: int = 20_000) -> DataFrame:
    """doc, s, p, o, literal of documents(doc, text) in RDF/XML. A document is parsed by one task, many documents by many."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for doc, text in zip(rows.doc, rows.text, strict=True):
                found = parse(text or "")
                while held := [(doc, *t) for t in itertools.islice(found, rows_at_once)]:
                    yield pd.DataFrame(held, columns=["doc", "s", "p", "o", "literal"])

    return documents.select(F.col("doc").cast("string"), F.col("text").cast("string")).filter("doc is not null").mapInPandas(read, _TRIPLE)


def _pairs(t: DataFrame, term: str, subject: str, to: str, literal: bool = False) -> DataFrame:
    """doc, subject and object of the triples of one SPDX term."""
    return t.filter((F.col("p") == TERMS + term) & (F.col("literal") == literal)).select("doc", F.col("s").alias(subject), F.col("o").alias(to))


def _type_of(t: DataFrame, *names: str) -> DataFrame:
    return t.filter((F.col("p") == RDF + "type") & F.col("o").isin(*[TERMS + n for n in names])).select("doc", F.col("s").alias("node"), F.regexp_extract("o", "([^#]*)$", 1).alias("kind"))


def listed_files(t: DataFrame) -> DataFrame:
    """doc and file of the files of documents that describe exactly one SPDX document: what the element related to it
    has, or what it contains by a relationship where it has none."""
    single = _type_of(t, "SpdxDocument").distinct().groupBy("doc").agg(F.count("*").alias("n"), F.first("node").alias("node")).filter("n = 1").drop("n")
    links = _pairs(t, "relationship", "node", "link").join(_pairs(t, "relatedSpdxElement", "link", "element"), ["doc", "link"])
    element = single.join(links, ["doc", "node"]).select("doc", F.col("element").alias("node")).distinct()
    has = element.join(_pairs(t, "hasFile", "node", "file"), ["doc", "node"]).select("doc", "file")
    kinds = _pairs(t, "relationshipType", "link", "kind").filter(F.col("kind").endswith("contains")).select("doc", "link")
    inside = element.join(links.join(kinds, ["doc", "link"]).withColumnRenamed("element", "file"), ["doc", "node"]).select("doc", "file")
    return has.union(inside.join(has.select("doc").distinct(), "doc", "left_anti")).distinct()


def _license_id(raw: Column, extracted: Column, tool: str) -> Column:
    """An id without its marker and that of a tool, if it has one; that of an own text without the hash at its end, too."""
    bare = F.when(raw.startswith(REF_PREFIX), F.substring(raw, len(REF_PREFIX) + 1, 1 << 20)).otherwise(raw)
    if tool:
        bare = F.when(raw.startswith(REF_PREFIX + tool), F.substring(raw, len(REF_PREFIX + tool) + 1, 1 << 20)).otherwise(bare)
    bare = F.try_url_decode(F.replace(bare, F.lit("+"), F.lit("%2B")))
    return F.when(extracted, F.regexp_replace(bare, "^(.+)-[A-Za-z0-9]{32}$", "$1")).otherwise(bare)


def licenses_of(t: DataFrame, refs: DataFrame, tool: str = "") -> DataFrame:
    """refs(doc, file, use, node) with license for each license that a node stands for.

    Sets of licenses are followed level by level: members of a conjunctive set, those of a disjunctive one behind the
    name for a choice, those of an "or later" with its ending. A license is told by its own id if it is described with
    id, name and text, else by its address in the SPDX list; others and NOASSERTION are none. tool: what the ids of the
    tool that wrote the documents begin with, behind the marker of own licenses (``name-``). RuntimeError beyond
    MOST_LEVELS, which a set that holds itself would cause.
    """
    t = t.filter(F.col("p").isin(RDF + "type", *[TERMS + x for x in ("member", "licenseId", "name", "extractedText", "licenseText")]))
    described = _type_of(t, "ExtractedLicensingInfo", "License", "ListedLicense")
    literal = lambda term, to: _pairs(t, term, "node", to, True).groupBy("doc", "node").agg(F.first(to).alias(to))
    text = literal("extractedText", "text").withColumn("extracted", F.lit(True)).union(literal("licenseText", "text").withColumn("extracted", F.lit(False)))
    own = described.withColumn("extracted", F.col("kind") == "ExtractedLicensingInfo").join(literal("licenseId", "id"), ["doc", "node"], "left").join(literal("name", "title"), ["doc", "node"], "left").join(text, ["doc", "node", "extracted"], "left")
    own = settled(own.groupBy("doc", "node").agg(F.max(F.when(F.col("title").isNotNull() & F.col("text").isNotNull(), _license_id(F.col("id"), F.col("extracted"), tool))).alias("own")), "described")
    sets = _type_of(t, "DisjunctiveLicenseSet", "ConjunctiveLicenseSet", "OrLaterOperator").withColumnRenamed("kind", "set")
    members = _pairs(t, "member", "node", "member").distinct()
    members = settled(sets.join(members.groupBy("doc", "node").agg(F.collect_set("member").alias("members")), ["doc", "node"], "left"), "sets")
    listed = F.when(F.col("node").startswith(LICENSES), F.try_url_decode(F.replace(F.substring("node", len(LICENSES) + 1, 1 << 20), F.lit("+"), F.lit("%2B"))))
    nothing = F.lower("node").isin(TERMS + "noassertion", LICENSES + "noassertion")
    rest = settled(refs.withColumn("ending", F.lit("")).distinct(), "refs")
    found: list[DataFrame] = []
    for _ in range(MOST_LEVELS):
        at = rest.filter(~nothing).join(own.withColumn("is_own", F.lit(True)), ["doc", "node"], "left").join(members, ["doc", "node"], "left")
        name = F.when(F.col("is_own"), F.col("own")).when(F.col("set").isNull(), listed)
        choice = F.when((F.col("set") == "DisjunctiveLicenseSet") & (F.size("members") > 1) & F.col("is_own").isNull(), F.lit(DUAL))
        out = at.select("doc", "file", "use", F.explode(F.array_compact(F.array(F.concat(name, "ending"), choice))).alias("license"))
        found.append(settled(out.distinct(), "licenses"))
        later = F.when(F.col("set") == "OrLaterOperator", F.concat(F.lit("-or-later"), "ending")).otherwise(F.col("ending"))
        rest = settled(at.filter("is_own is null").select("doc", "file", "use", F.explode("members").alias("node"), later.alias("ending")).distinct(), "refs")
        if rest.isEmpty():
            return reduce(DataFrame.union, found).distinct()
    raise RuntimeError(f"more than {MOST_LEVELS} levels of license sets; does one hold itself?")


def files_of(t: DataFrame, tool: str = "") -> DataFrame:
    """doc, file, name, hash (SHA-1, lower case), concluded, found (sorted arrays of licenses), copyright of triples' files.

    References are resolved wherever the document describes what they name. A file without a name is none. A copyright
    text counts if there is exactly one.
    """
    t = settled(t.filter(F.col("p").startswith(TERMS) | (F.col("p") == RDF + "type")).distinct(), "triples")
    names = _pairs(t, "fileName", "file", "name", True).groupBy("doc", "file").agg(F.trim(F.min("name")).alias("name"))
    files = listed_files(t).join(names, ["doc", "file"])
    sums = _pairs(t, "checksum", "file", "sum").join(_pairs(t, "algorithm", "sum", "algorithm").filter(F.lower("algorithm").endswith("checksumalgorithm_sha1")), ["doc", "sum"]).join(_pairs(t, "checksumValue", "sum", "value", True), ["doc", "sum"])
    sums = sums.groupBy("doc", "file").agg(F.lower(F.trim(F.max("value"))).alias("hash"))
    uses = [_pairs(t, term, "file", "node").withColumn("use", F.lit(use)) for term, use in (("licenseConcluded", "concluded"), ("licenseInfoInFile", "found"))]
    refs = uses[0].unionByName(uses[1]).join(files.select("doc", "file"), ["doc", "file"], "left_semi")
    by_use = lambda use: F.sort_array(F.collect_set(F.when(F.col("use") == use, F.col("license")))).alias(use)
    licenses = licenses_of(t, refs, tool).groupBy("doc", "file").agg(by_use("concluded"), by_use("found"))
    rights = _pairs(t, "copyrightText", "file", "copyright", True).groupBy("doc", "file").agg(F.count("*").alias("n"), F.min("copyright").alias("copyright")).filter("n = 1").drop("n")
    none = F.array().cast("array<string>")
    out = files.join(sums, ["doc", "file"], "left").join(licenses, ["doc", "file"], "left").join(rights, ["doc", "file"], "left")
    return out.select("doc", "file", "name", "hash", F.coalesce("concluded", none).alias("concluded"), F.coalesce("found", none).alias("found"), "copyright")


def read_spdx_rdf(spark: SparkSession, path: str, tool: str = "") -> DataFrame:
    """name, hash, concluded (one string), found, copyright of the files of SPDX 2 RDF/XML documents."""
    documents = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("doc"), F.col("value").alias("text"))
    return files_of(triples(documents), tool).select("name", "hash", F.nullif(F.array_join("concluded", " AND "), F.lit("")).alias("concluded"), "found", "copyright")


def _escaped(c: Column) -> Column:
    return reduce(lambda x, pair: F.replace(x, F.lit(pair[0]), F.lit(pair[1])), [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")], c)


def rdf_rows(files: DataFrame) -> DataFrame:
    """value: the RDF/XML of each of files(id, name, sha1, operator, licenses, found, copyright).

    operator says how the concluded licenses (ids of the SPDX list) go together: AND, OR, LATER (or later) or null for
    the first only. The concluded set and the package's list of files are nodes of their own, referred to by name.
    """
    ident = _escaped(F.col("id").cast("string"))
    url = lambda x: F.concat(F.lit(f'rdf:resource="{LICENSES}'), _escaped(x), F.lit('"/>'))
    members = F.array_join(F.transform("licenses", lambda x: F.concat(F.lit("<spdx:member "), url(x))), "")
    node = F.when(F.col("operator") == "AND", "ConjunctiveLicenseSet").when(F.col("operator") == "OR", "DisjunctiveLicenseSet").when(F.col("operator") == "LATER", "OrLaterOperator")
    concluded = F.when(node.isNotNull(), F.concat(F.lit('rdf:nodeID="L'), ident, F.lit('"/>'))).otherwise(url(F.get("licenses", F.lit(0))))
    seen = F.array_join(F.transform("found", lambda x: F.concat(F.lit("<spdx:licenseInfoInFile "), url(x))), "")
    text = F.coalesce(F.concat(F.lit("<spdx:copyrightText>"), _escaped(F.col("copyright")), F.lit("</spdx:copyrightText>")), F.lit(""))
    return files.select(F.concat(
        F.lit('<spdx:Package rdf:about="#package"><spdx:hasFile rdf:resource="#F'), ident, F.lit('"/></spdx:Package>\n<spdx:File rdf:about="#F'), ident, F.lit('"><spdx:fileName>'), _escaped(F.col("name")),
        F.lit(f'</spdx:fileName><spdx:checksum><spdx:Checksum><spdx:algorithm rdf:resource="{TERMS}checksumAlgorithm_sha1"/><spdx:checksumValue>'), F.lower("sha1"),
        F.lit("</spdx:checksumValue></spdx:Checksum></spdx:checksum>"), F.coalesce(F.concat(F.lit("<spdx:licenseConcluded "), concluded), F.lit("")), seen, text, F.lit("</spdx:File>"),
        F.coalesce(F.concat(F.lit("\n<spdx:"), node, F.lit(' rdf:nodeID="L'), ident, F.lit('">'), members, F.lit("</spdx:"), node, F.lit(">")), F.lit("")),
    ).alias("value"))


_HEAD = (
    f'<?xml version="1.0" encoding="UTF-8"?>\n<rdf:RDF xmlns:rdf="{RDF}" xmlns:spdx="{TERMS}">\n'
    '<spdx:SpdxDocument rdf:about="#document"><spdx:specVersion>SPDX-2.3</spdx:specVersion><spdx:relationship><spdx:Relationship>'
    f'<spdx:relationshipType rdf:resource="{TERMS}relationshipType_describes"/><spdx:relatedSpdxElement rdf:resource="#package"/></spdx:Relationship></spdx:relationship></spdx:SpdxDocument>'
)


def write_spdx_rdf(files: DataFrame, path: str) -> None:
    """One SPDX 2 RDF/XML document for each partition of files (see rdf_rows()), written by the task that holds it."""

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame({"value": [_HEAD]})
        yield from batches
        yield pd.DataFrame({"value": ["</rdf:RDF>"]})

    # Characters that XML can't hold are left out.
    rows = rdf_rows(files).select(F.regexp_replace("value", "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\uFFFE\\uFFFF]", "").alias("value"))
    rows.mapInPandas(whole, "value string").write.text(path)
