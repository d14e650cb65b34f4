"""Operators on small tables: trees, names, decisions, sources, sinks, streams."""

import gzip
import io
import json
import lzma
import random
import struct
import tarfile
import zipfile

import pytest
import zstandard
from pyspark.sql import functions as F

from ledgerline.functions.content import CONTAINER
from ledgerline.operators import buckets as B
from ledgerline.operators import compare as N
from ledgerline.operators import compatibility as C
from ledgerline.operators import decisions as D
from ledgerline.operators import ingest as G
from ledgerline.operators import progress as Z
from ledgerline.operators import reuse as R
from ledgerline.operators import tree as T
from ledgerline.sources import archives as A
from ledgerline.sources import sbom as S
from ledgerline.sources import tables as L
from ledgerline.streaming import incremental as I


def test_nested_set_of_random_trees(spark):
    rng = random.Random(1)
    rows, children = [(0, 0, None, CONTAINER, "r"), (1, 1000, None, CONTAINER, "s")], {}
    for up, base in ((0, 0), (1, 1000)):
        for i in range(1, 40):
            parent = base + rng.randrange(max(0, i - 6), i)
            rows.append((up, base + i, parent, 0, f"n{rng.randrange(9)}"))
            children.setdefault(parent, []).append(base + i)
    rows = [(u, i, p, CONTAINER if i in children else 0, n) for u, i, p, _, n in rows]
    by = {r[1]: r for r in rows}
    wanted, n = {}, 0

    def walk(i):
        nonlocal n
        left, n = n, n + 1
        for c in sorted(children.get(i, []), key=lambda c: (by[c][3] == 0, by[c][4], c)):
            walk(c)
        wanted[i] = (left, n)
        n += 1

    for root in (0, 1000):
        n = 0
        walk(root)
    tree = spark.createDataFrame(rows, "upload_fk long, item long, parent long, mode int, name string")
    got = {r.item: (r.lft, r.rgt) for r in T.nested_set(tree).collect()}
    assert got == wanted


def test_cycle_is_told(spark):
    tree = spark.createDataFrame([(0, 1, None, CONTAINER, "r"), (0, 2, 1, CONTAINER, "a"), (0, 3, 2, 0, "b")], "upload_fk long, item long, parent long, mode int, name string")
    with pytest.raises(RuntimeError):
        T.full_paths(tree, depth=1)
    assert T.fat_items(tree).collect()[0].item == 2
    edges = spark.createDataFrame([(1, 2), (2, 1)], "parent long, child long")
    out = T.folder_tree(tree.select(F.col("item").alias("folder"), "name"), edges, tree.filter("item = 1").select(F.col("item").alias("folder"))).collect()
    assert sorted((r.id_path, r.cycle) for r in out) == [("1", False), ("1/2", False), ("1/2/1", True)]


def test_tree_rows(spark):
    files = spark.createDataFrame([("a/b/c.txt", 1), ("a/d.c", 2), ("a/d.c", 1), (None, 3)], "path string, pfile_pk long")
    rows = G.tree_rows(files).collect()
    assert sorted(r.name for r in rows) == ["", "a", "b", "c.txt", "d.c"]
    assert sum(r.parent is None for r in rows) == 1
    assert sorted(r.path for r in T.full_paths(G.tree_rows(files)).collect())[-1].endswith("d.c")


def test_names(spark):
    kind = "folder long, item long, name string"
    a = spark.createDataFrame([(1, 1, "x-1.c"), (1, 2, "same"), (1, 3, "hello.c"), (1, 4, "lonely"), (1, 5, "stem.c"), (1, 6, None)], kind)
    b = spark.createDataFrame([(1, 11, "x-2.c"), (1, 12, "same"), (1, 13, "hallo.c"), (1, 14, "other"), (1, 15, "stem.java"), (2, 16, "lonely")], kind)
    got = {(r.item_1, r.item_2, r.stage) for r in N.matched_names(a, b).collect()}
    assert {(2, 12, "name"), (1, 11, "fuzzy"), (3, 13, "one letter"), (5, 15, "stem"), (4, None, "alone"), (6, None, "alone"), (None, 14, "alone"), (None, 16, "alone")} == got
    many = N.matched_many([a, b, b.withColumn("item", F.col("item") + 100)]).collect()
    assert (2, 12, 112) in {(r.item_1, r.item_2, r.item_3) for r in many}


def test_buckets_in_order(spark):
    files = spark.createDataFrame([(1, "a.c", ["GPL", "MIT"], False), (2, "COPYRIGHT", ["BSD-3-clause"], True), (3, "z", [], False)], "item long, name string, licenses array<string>, is_package boolean")
    rules = [B.Bucket(1, "every", sets=[["GPL", "MIT"]], stop=True), B.Bucket(2, "only", sets=[["GPL", "MIT", "BSD-3-clause"]]), B.Bucket(3, "file", tests=[("name", "COPYRIGHT", "and", "license", "BSD.*clause")]), B.Bucket(4, "exec", predicate=lambda n, l: n == "COPYRIGHT", packages_only=True), B.Bucket(9, "default")]
    got = sorted((r.item, r.bucket) for r in B.leaf_buckets(files, rules).collect())
    assert got == [(1, 1), (2, 2), (2, 3), (2, 4), (3, 9)]


def test_nothing_known_of_licenses_holds_no_test_of_them(spark):
    files = spark.createDataFrame([(1, "a.h", None), (2, "b.h", []), (3, "c.h", ["SMALL"]), (4, "d.h", ["GPL"])], "item long, name string, licenses array<string>").withColumn("is_package", F.lit(False))
    rules = [B.Bucket(1, "every", sets=[["GPL"]]), B.Bucket(2, "only", sets=[["GPL"]]), B.Bucket(5, "file", tests=[("name", r"\.h$", "not", "license", "SMALL")]), B.Bucket(99, "default")]
    assert sorted(tuple(r) for r in B.leaf_buckets(files, rules).collect()) == [(1, 99), (2, 5), (3, 99), (4, 1), (4, 2), (4, 5)]


def test_files_without_findings_have_unknown_licenses(spark, tmp_path):
    from ledgerline.plans import model as m

    tables = {"region": "select 0 r_regionkey, 'R' r_name", "nation": "select 0 n_nationkey, 'N' n_name, 0 n_regionkey", "customer": "select 1L c_custkey, 'C' c_name, 0 c_nationkey",
              "orders": "select id o_orderkey, 1L o_custkey, 'F' o_orderstatus, '2' o_orderpriority from range(2, 8)", "part": "select 1L p_partkey, 'n' p_name, 'b' p_brand, 'PROMO' p_type, 1 p_size",
              "lineitem": "select * from values (2L, 1L, 1L, 1, 1.0), (4L, 1L, 1L, 7, 1.0) t(l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity)"}
    for name, sql in tables.items():
        spark.sql(sql).write.parquet(f"{tmp_path}/{name}.parquet")
    got = {r.item: r.licenses for r in m.fileset(spark, str(tmp_path)).collect()}
    assert got == {11: ["PROMO"], 15: ["PROMO"], 19: None, 23: None, 27: None, 31: None}



def test_compatibility(spark):
    licenses = spark.createDataFrame([(1, "MIT", "Permissive"), (2, "BSD", "Permissive"), (3, "GPL", "Strong"), (4, "LGPL", "Weak"), (5, "Void", "x")], "rf_pk long, shortname string, license_type string")
    findings = spark.createDataFrame([(1, 1), (1, 2), (2, 3), (2, 4), (2, 1), (3, 5), (3, 1), (4, None)], "pfile_fk long, rf_fk long")
    default, rules = L.parse_rules('---\ndefault: false\nrules:\n  - firstname: ~\n    secondname: ~\n    firsttype: "Permissive"\n    secondtype: "Permissive"\n    compatibility: true\n  - firstname: GPL\n    secondtype: Permissive\n    compatibility: true\n')
    assert L.parse_rules(L.format_rules(default, rules)) == (default, rules)
    pairs = C.license_pairs(findings, licenses)
    got = {(r.a, r.b): r.compatible for r in C.verdicts(pairs, licenses, L.rule_rows(spark, rules, licenses), default).collect()}
    assert got == {(1, 2): True, (3, 4): False, (1, 3): True, (1, 4): False}
    conflicts = {(r.pfile_fk, r.rf_fk): r.compatible for r in C.license_conflicts(pairs, C.verdicts(pairs, licenses, L.rule_rows(spark, rules, licenses))).collect()}
    assert conflicts[1, 1] and not conflicts[2, 4]


def test_decisions(spark):
    events = spark.createDataFrame([(1, 1, 7, False, 6, 0), (2, 1, 8, False, 6, 0), (3, 1, 8, True, 6, 0), (4, 2, 7, False, 1, 5)], "event_pk long, item long, rf_fk long, removed boolean, event_type int, job_fk int").withColumn("ts", F.lit("2024-01-01").cast("timestamp"))
    found = spark.createDataFrame([(1, 9), (3, 7)], "item long, rf_fk long")
    items = spark.createDataFrame([(1,), (2,), (3,), (4,)], "item long")
    new = {r.item: list(r.licenses) for r in D.decide(items, events, found, D.IDENTIFIED).collect()}
    assert new == {1: [7, 9], 2: [7], 3: [7], 4: []}
    old = D.decide(items, events, found, D.IDENTIFIED)
    assert D.decide(items, events, found, D.IDENTIFIED, previous=old).count() == 0
    matches = spark.createDataFrame([(1, 7), (2, 7)], "item long, license long")
    assert [r.item for r in D.phrases_cover_all(matches, events, 6).collect()] == [1]
    full = matches.withColumns({"scanner": F.lit("tag"), "rf_fk": F.col("license"), "region_start": F.lit(0), "region_end": F.lit(1)}).union(spark.createDataFrame([(3, 7, "tag", 7, 0, 1), (4, 7, "keyword", 7, 0, 1)], "item long, license long, scanner string, rf_fk long, s int, e int"))
    decided = spark.createDataFrame([(9, 5, [1])], "item long, decision_type int, licenses array<long>")
    types = spark.createDataFrame([(7, "Permissive")], "rf_pk long, license_type string")
    got = {r.item: r.rule for r in D.auto_decisions(items, full, events, decided, types).collect()}
    assert got == {1: "phrase events", 3: "tag", 4: "license type"}


def test_reuse_by_name(spark):
    kind = "item long, name string, pfile_fk long"
    new, old = spark.createDataFrame([(1, "a", 10), (2, "b", 11), (3, "c", 20)], kind), spark.createDataFrame([(4, "a", 20), (5, "b", 21), (6, "c", 20)], kind)
    text = "\n".join(map(str, range(50)))
    contents = spark.createDataFrame([(10, text + "\nx"), (20, text), (11, "other"), (21, text)], "pfile_fk long, text string")
    d = spark.createDataFrame([(100, 20, 4), (101, 20, 5), (102, 21, 5)], "decision_pk long, pfile_fk long, decision_type int")
    none = spark.createDataFrame([], "item long")
    assert [(r.item, r.decision_pk) for r in R.reused_by_name(new, old, none, d, contents).collect()] == [(1, 101)]


def test_archives(spark):
    inner = io.BytesIO()
    with zipfile.ZipFile(inner, "w") as z:
        z.writestr("b.txt", "two")
    outer = io.BytesIO()
    with tarfile.open(fileobj=outer, mode="w") as t:
        for name, data in (("a.txt", b"one"), ("in.zip", inner.getvalue())):
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
    files = spark.createDataFrame([("x.tar.gz", gzip.compress(outer.getvalue())), ("bad.zip", b"PK\x03\x04oops"), ("p.txt", "é".encode("latin-1")), ("n", None)], "path string, content binary")
    got = {r.path: r.content for r in A.unpacked(files).collect()}
    assert bytes(got["x.tar/a.txt"]) == b"one" and bytes(got["x.tar/in.zip/b.txt"]) == b"two" and got["n"] is None and len(got) == 5
    assert A.decoded(files.filter("path = 'p.txt'")).first().text == "é"


def cpio(files):
    """A portable cpio archive, written by the format's description."""
    out = b""
    for name, mode, data in [*files, ("TRAILER!!!", 0, b"")]:
        fields = [0, mode, 0, 0, 1, 0, len(data), 0, 0, 0, 0, len(name) + 1, 0]
        head = b"070701" + "".join(f"{x:08x}" for x in fields).encode() + name.encode() + b"\0"
        out += head + b"\0" * (-len(head) % 4) + data + b"\0" * (-len(data) % 4)
    return out


def rpm(payload):
    """A small RPM package: a lead, an empty signature header, a header with strings and a list, a payload."""

    def header(tags):
        store, index = b"", b""
        for tag, kind, values in tags:
            index += struct.pack(">IIII", tag, kind, len(store), len(values))
            store += b"".join(v.encode() + b"\0" for v in values)
        return b"\x8e\xad\xe8\x01" + b"\0" * 4 + struct.pack(">II", len(tags), len(store)) + index + store

    signature = header([(1000, 6, ["signed"])])
    main = header([(1000, 6, ["tool"]), (1001, 6, ["1.2"]), (1014, 6, ["MIT"]), (1049, 8, ["libc", "sh"]), (1005, 9, ["long"])])
    lead = b"\xed\xab\xee\xdb" + b"\0" * 92
    return lead + signature + b"\0" * (-(len(lead) + len(signature)) % 8) + main + payload


def test_cpio_lzma_zstd_and_rpm(spark):
    tree = cpio([("usr", 0o040755, b""), ("usr/a.txt", 0o100644, b"one"), ("usr/empty", 0o100644, b"")])
    package = rpm(zstandard.ZstdCompressor().compress(tree))
    files = [("t.cpio", tree), ("l.txt.lzma", lzma.compress(b"two", format=lzma.FORMAT_ALONE)), ("p.rpm", package), ("broken.rpm", b"\xed\xab\xee\xdb" + b"x" * 40), ("cut.gz", gzip.compress(b"x" * 999)[:15]), ("z", zstandard.ZstdCompressor().compress(b"three"))]
    got = {r.path: bytes(r.content) for r in A.unpacked(spark.createDataFrame(files, "path string, content binary")).collect()}
    assert got["t.cpio/usr/a.txt"] == b"one" and got["t.cpio/usr/empty"] == b"" and got["l.txt"] == b"two"
    assert got["p.rpm/usr/a.txt"] == b"one" and got["broken.rpm"] == files[3][1] and got["cut.gz"] == files[4][1] and got["z"] == b"three"
    rows = A.rpm_packages(spark.createDataFrame([(1, package), (2, b"none"), (3, files[3][1]), (4, None)], "pfile_fk int, content binary")).collect()
    assert [(r.pfile_fk, r.package, r.version, r.license, r.requires, r.vendor) for r in rows] == [(1, "tool", "1.2", "MIT", ["libc", "sh"], None)]


def test_charsets_and_types(spark):
    texts = [("é".encode("latin-1"), "é"), ("é日".encode(), "é日"), ("\ufeffab".encode("utf-16-le"), "ab"), ("plain ascii text".encode("utf-16-be"), "plain ascii text"), ("\ufeffab".encode("utf-32-le"), "ab"), (b"", ""), (None, None)]
    df = spark.createDataFrame([(i, c, t) for i, (c, t) in enumerate(texts)], "id int, content binary, want string")
    assert all(r.text == r.want for r in A.decoded(df).collect())
    rows = spark.createDataFrame([("a.c", b"x"), ("a.svg", b"x"), ("a", b"\x89PNG\r\n\x1a\n"), ("b", b"none"), (None, None)], "name string, content binary")
    assert [r.t for r in rows.select(G.mime_type(F.col("name"), F.col("content")).alias("t")).collect()] == ["text/x-csrc", "image/svg+xml", "image/png", G.DEFAULT_MIME, G.DEFAULT_MIME]


def test_members_that_no_row_can_hold_stay_packed(spark, monkeypatch):
    monkeypatch.setattr(A, "LARGEST_ROW", 10)
    assert A.inflated(gzip.compress(b"x" * 10)) == b"x" * 10
    with pytest.raises(A.TooLarge):
        A.inflated(gzip.compress(b"x" * 11))


def test_deleting_an_upload_keeps_shared_contents(spark):
    items = spark.createDataFrame([(1, 10, 100), (1, 11, 101), (2, 20, 100), (2, 21, None)], "upload_fk int, item int, pfile_fk int")
    left = Z.without_uploads(items, spark.createDataFrame([(1,)], "upload_fk int"), {"events": spark.createDataFrame([(10,), (20,), (None,)], "item int")}, {"findings": spark.createDataFrame([(100,), (101,), (None,)], "pfile_fk int")})
    assert {r.item for r in left["items"].collect()} == {20, 21}
    assert {r.item for r in left["events"].collect()} == {20, None} and {r.pfile_fk for r in left["findings"].collect()} == {100, None}


def test_imports(spark, tmp_path):
    (tmp_path / "l.csv").write_text('Short Name,Full Text\nMIT,"a ""q""\nb"\nGPL,\n')
    rows = L.read_catalogue(spark, str(tmp_path / "l.csv"), L.LICENSE_ALIASES).collect()
    assert {(r.shortname, r.text) for r in rows} == {("MIT", 'a "q"\nb'), ("GPL", None)}
    known = spark.createDataFrame([("MIT", "old"), ("BSD", "x")], "shortname string, text string")
    state = {r.shortname: r.state for r in L.upserted(known, L.read_catalogue(spark, str(tmp_path / "l.csv"), L.LICENSE_ALIASES), "shortname", ["text"]).collect()}
    assert state == {"MIT": "updated", "BSD": "kept", "GPL": "new"}


def test_bills_of_material(spark, tmp_path):
    files = spark.createDataFrame([(1, "a.c", "AB", "MIT AND GPL"), (1, "b.c", "CD", "NOASSERTION")], "upload_fk long, name string, sha1 string, license_concluded string")
    contents = spark.createDataFrame([(1, "ab"), (2, "cd")], "pfile_pk long, sha1 string")
    licenses = spark.createDataFrame([(1, "mit"), (2, "GPL")], "rf_pk long, shortname string")
    S.spdx_tag_lines(files).coalesce(1).write.text(str(tmp_path / "tv"))
    back = S.read_spdx_tags(spark, str(tmp_path / "tv"))
    assert sorted((r.pfile_fk, r.rf_fk) for r in S.imported_findings(back, contents, licenses, "concluded").collect()) == [(1, 1), (1, 2)]
    (tmp_path / "s.json").write_text(json.dumps({"files": [json.loads(r.value) for r in S.spdx_json_rows(files).collect()]}))
    assert sorted(r.hash for r in S.read_spdx_json(spark, str(tmp_path / "s.json")).collect()) == ["ab", "cd"]
    assert json.loads(S.cyclonedx_components(files).first().value)["hashes"][0]["content"] == "ab"
    dump = S.decision_dump(l=licenses, c=contents)
    assert sorted(map(tuple, S.from_dump(dump, "l", "rf_pk long, shortname string").collect())) == [(1, "mit"), (2, "GPL")]


def test_spdx3_and_xml(spark, tmp_path):
    graph = {"@graph": [{"type": "software_File", "spdxId": "f", "name": "a", "verifiedUsing": [{"algorithm": "sha1", "hashValue": "AB"}]}, {"type": "x", "spdxId": "l", "simplelicensing_licenseExpression": "MIT"}, {"type": "Relationship", "from": "f", "relationshipType": "hasConcludedLicense", "to": ["l"]}]}
    (tmp_path / "3.json").write_text(json.dumps(graph))
    assert [(r.name, r.hash, r.concluded) for r in S.read_spdx3_json(spark, str(tmp_path / "3.json")).collect()] == [("a", "ab", "MIT")]
    (tmp_path / "c.xml").write_text('<ComponentLicenseInformation><License type="global" name="MIT"><Content>text</Content><Files>a\nb</Files><FileHash>11\n22</FileHash></License></ComponentLicenseInformation>')
    assert sorted((r.license, r.file, r.hash) for r in S.read_component_xml(spark, str(tmp_path / "c.xml")).collect()) == [("MIT", "a", "11"), ("MIT", "b", "22")]


def test_stream_scans_each_content_once(spark, tmp_path):
    source, found, runs = (str(tmp_path / x) for x in ("in", "found", "runs"))
    schema = "pfile_fk long, text string"
    scan = lambda df: df.select("pfile_fk", F.length("text").cast("long").alias("rf_fk"))
    for rows in ([(1, "a"), (1, "a"), (2, "bb")], [(2, "bb"), (3, "ccc")]):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(source)
        I.scan_stream(spark.readStream.schema(schema).parquet(source), scan, 5, found, runs, str(tmp_path / "cp")).awaitTermination()
    assert sorted((r.pfile_fk, r.rf_fk, r.agent_fk) for r in spark.read.parquet(found).collect()) == [(1, 1, 5), (2, 2, 5), (3, 3, 5)]
    assert spark.read.parquet(runs).filter("success").count() == 2


def test_empty_tables(spark):
    tree = spark.createDataFrame([], "upload_fk long, item long, parent long, pfile_fk long, mode int, name string")
    assert T.nested_set(tree).count() == 0 and T.full_paths(tree).count() == 0
    names = spark.createDataFrame([], "folder long, item long, name string")
    assert N.matched_names(names, names).count() == 0


def test_numbered_trees_outlive_a_clearing(spark):
    """Tables that were cleared away are made anew."""
    from ledgerline import storage
    from ledgerline.plans import model as m

    from ..conftest import SMALL

    before = m.nested(spark, SMALL).count()
    assert m.nested(spark, SMALL) is m.nested(spark, SMALL)
    storage.clear(spark)
    assert m.nested(spark, SMALL).count() == before > 0
