"""RDF bills of materials: triples, files and licenses by reference, and documents written from rows."""

import pytest
from pyspark.sql import functions as F

from ledgerline.sources import rdf as R

HEAD = f'<rdf:RDF xmlns:rdf="{R.RDF}" xmlns:spdx="{R.TERMS}" xmlns:rdfs="http://www.w3.org/2000/01/rdf-schema#">'
MD5 = "0123456789abcdef0123456789ABCDEF"
DOCUMENT = f"""{HEAD}
<spdx:SpdxDocument rdf:about="http://x/doc"><spdx:relationship><spdx:Relationship>
  <spdx:relationshipType rdf:resource="{R.TERMS}relationshipType_describes"/><spdx:relatedSpdxElement><spdx:Package rdf:about="http://x/package">
    <spdx:hasFile rdf:resource="http://x/one"/><spdx:hasFile><spdx:File rdf:about="http://x/two"/></spdx:hasFile><spdx:hasFile rdf:nodeID="three"/><spdx:hasFile rdf:resource="http://x/nameless"/>
  </spdx:Package></spdx:relatedSpdxElement></spdx:Relationship></spdx:relationship></spdx:SpdxDocument>
<spdx:File rdf:about="http://x/one"><spdx:fileName> a &amp; b.c </spdx:fileName>
  <spdx:checksum rdf:resource="#sum"/><spdx:checksum><spdx:Checksum><spdx:algorithm rdf:resource="{R.TERMS}checksumAlgorithm_md5"/><spdx:checksumValue>ffff</spdx:checksumValue></spdx:Checksum></spdx:checksum>
  <spdx:licenseConcluded rdf:nodeID="set"/><spdx:licenseInfoInFile rdf:resource="{R.LICENSES}NOASSERTION"/><spdx:licenseInfoInFile rdf:resource="{R.LICENSES}GPL-2.0%2B"/><spdx:licenseInfoInFile rdf:resource="http://elsewhere/X"/>
  <spdx:licenseInfoInFile rdf:resource="#own"/><spdx:copyrightText>(c) &lt;me&gt;</spdx:copyrightText></spdx:File>
<spdx:Checksum rdf:ID="sum" spdx:checksumValue=" ABCD "><spdx:algorithm rdf:resource="{R.TERMS}checksumAlgorithm_sha1"/></spdx:Checksum>
<spdx:ConjunctiveLicenseSet rdf:nodeID="set"><spdx:member rdf:resource="{R.LICENSES}MIT"/><spdx:member><spdx:DisjunctiveLicenseSet><spdx:member rdf:resource="{R.LICENSES}ISC"/><spdx:member rdf:nodeID="later"/></spdx:DisjunctiveLicenseSet></spdx:member></spdx:ConjunctiveLicenseSet>
<spdx:OrLaterOperator rdf:nodeID="later"><spdx:member><spdx:ConjunctiveLicenseSet><spdx:member rdf:resource="{R.LICENSES}LGPL-2.1"/><spdx:member rdf:resource="#plain"/></spdx:ConjunctiveLicenseSet></spdx:member></spdx:OrLaterOperator>
<spdx:ExtractedLicensingInfo rdf:ID="own" spdx:licenseId="LicenseRef-tool-My%20Own-{MD5}"><spdx:name>My Own</spdx:name><spdx:extractedText>text</spdx:extractedText></spdx:ExtractedLicensingInfo>
<spdx:License rdf:ID="plain"><spdx:licenseId>LicenseRef-Plain-{MD5}</spdx:licenseId><spdx:name>Plain</spdx:name><spdx:licenseText>text</spdx:licenseText></spdx:License>
<spdx:ExtractedLicensingInfo rdf:ID="textless" spdx:licenseId="LicenseRef-Lost"><spdx:name>Lost</spdx:name></spdx:ExtractedLicensingInfo>
<rdf:Description rdf:about="http://x/two"><spdx:fileName>two</spdx:fileName><spdx:licenseConcluded rdf:resource="#textless"/><spdx:copyrightText>a</spdx:copyrightText><spdx:copyrightText>b</spdx:copyrightText></rdf:Description>
<spdx:File rdf:nodeID="three" spdx:fileName="three"><spdx:licenseConcluded><spdx:DisjunctiveLicenseSet><spdx:member rdf:resource="{R.LICENSES}MIT"/></spdx:DisjunctiveLicenseSet></spdx:licenseConcluded></spdx:File>
<spdx:File rdf:about="http://x/unlisted"><spdx:fileName>unlisted</spdx:fileName></spdx:File>
</rdf:RDF>"""
CONTAINS = f"""{HEAD}<spdx:SpdxDocument rdf:about="#d"><spdx:relationship rdf:parseType="Resource"><spdx:relatedSpdxElement rdf:resource="#p"/></spdx:relationship></spdx:SpdxDocument>
<spdx:Package rdf:about="#p"><spdx:relationship><spdx:Relationship><spdx:relationshipType rdf:resource="{R.TERMS}relationshipType_contains"/><spdx:relatedSpdxElement><spdx:File rdf:about="#f"><spdx:fileName>inside</spdx:fileName></spdx:File></spdx:relatedSpdxElement></spdx:Relationship></spdx:relationship>
<spdx:relationship><spdx:Relationship><spdx:relationshipType rdf:resource="{R.TERMS}relationshipType_other"/><spdx:relatedSpdxElement><spdx:File rdf:about="#g"><spdx:fileName>beside</spdx:fileName></spdx:File></spdx:relatedSpdxElement></spdx:Relationship></spdx:relationship></spdx:Package></rdf:RDF>"""


def read(spark, **documents):
    return R.files_of(R.triples(spark.createDataFrame(list(documents.items()), "doc string, text string")), "tool-").orderBy("doc", "name").collect()


def test_references_sets_and_own_texts(spark):
    rows = read(spark, a=DOCUMENT, b=CONTAINS, c="<broken", d=None, e=f"{HEAD}</rdf:RDF>", f=DOCUMENT.replace("</rdf:RDF>", '<spdx:SpdxDocument rdf:about="#second"/></rdf:RDF>'))
    got = {(r.doc, r.name): (r.hash, r.concluded, r.found, r.copyright) for r in rows}
    assert got == {
        ("a", "a & b.c"): ("abcd", ["Dual-license", "ISC", "LGPL-2.1-or-later", "MIT", f"Plain-{MD5}-or-later"], ["GPL-2.0+", "My Own"], "(c) <me>"),
        ("a", "two"): (None, [], [], None),
        ("a", "three"): (None, ["MIT"], [], None),
        ("b", "inside"): (None, [], [], None),
    }


def test_a_set_that_holds_itself(spark):
    loop = DOCUMENT.replace(f'<spdx:member rdf:resource="{R.LICENSES}ISC"/>', '<spdx:member rdf:nodeID="set"/>')
    with pytest.raises(RuntimeError, match="holds? itself"):
        read(spark, a=loop)


def test_triples_of_a_document():
    text = f'{HEAD}<rdf:Description rdf:about="s" spdx:name="n"><spdx:member rdf:parseType="Resource"><spdx:name>x</spdx:name></spdx:member><spdx:note>two <!-- no --> words</spdx:note><spdx:empty/></rdf:Description></rdf:RDF>'
    t = R.TERMS
    assert list(R.parse(text)) == [("s", t + "name", "n", True), ("s", t + "member", "_:b0", False), ("_:b0", t + "name", "x", True), ("s", t + "note", "two  words", True), ("s", t + "empty", "", True)]


def test_documents_written_and_read(spark, tmp_path):
    rows = [(1, "a<b>.c", "AB", "AND", ["MIT", "X 1"], ["MIT"], 'says "&"\n\u0001'), (2, "b", "CD", None, [], [], None), (3, "é", "EF", "OR", ["MIT", "ISC"], [], ""), (4, "d", "01", "LATER", ["GPL-2.0"], ["A", "B+"], None)]
    files = spark.createDataFrame(rows, "id long, name string, sha1 string, operator string, licenses array<string>, found array<string>, copyright string")
    R.write_spdx_rdf(files.repartition(3, "id"), str(tmp_path / "out"))
    got = {r.name: (r.hash, r.concluded, r.found, r.copyright) for r in R.read_spdx_rdf(spark, str(tmp_path / "out")).collect()}
    assert got == {"a<b>.c": ("ab", "MIT AND X 1", ["MIT"], 'says "&"\n'), "b": ("cd", None, [], None), "é": ("ef", "Dual-license AND ISC AND MIT", [], ""), "d": ("01", "GPL-2.0-or-later", ["A", "B+"], None)}
    assert R.files_of(R.triples(spark.createDataFrame([], "doc string, text string"))).count() == 0
    assert files.select(F.col("id").alias("doc"), "name").count() == 4
