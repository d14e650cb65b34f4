"""Types by content: nested rules against a slow reading of the table."""

import random
import re

import pytest
from pyspark.sql import functions as F

from ledgerline.operators import ingest as G
from ledgerline.operators import magic as M


def slow(content, rules):
    for rule in rules:
        value = rule.value
        if rule.test == "hex":
            piece = content[rule.at : rule.at + len(value) // 2].hex().upper()
            ok = len(piece) == len(value) and all(v in ("?", p) for v, p in zip(value.upper(), piece, strict=True))
        elif rule.test == "text":
            ok = content[rule.at :].startswith(value.encode())
        else:
            where = {"near": content[rule.at : rule.at + M.NEAR], "line": content[:M.NEAR].split(b"\n")[0], "holds": content}[rule.test]
            ok = re.search(b".".join(re.escape(p.encode()) for p in value.split(".")), where, re.S) is not None
        if ok:
            return slow(content, rule.below) or rule.mime
    return None


def test_types_of_made_up_contents(spark):
    rules, rnd = M.own_magic(), random.Random(3)
    flat = [r for top in rules for r in (top, *top.below, *[x for b in top.below for x in b.below])]
    rows = [b"", b"\0" * 600, b"PK\3\4", b"\x7fELF" + b"\0" * 20]
    for _ in range(400):
        body = bytearray(rnd.choice([b"", b" " * 1200, b"\0" * 700, bytes(rnd.randrange(256) for _ in range(300))]))
        for r in rnd.sample(flat, rnd.choice([1, 2, 3])):
            value = bytes.fromhex(r.value.replace("?", "5")) if r.test == "hex" else r.value.replace(".", "\0").encode() if "o.r" in r.value else r.value.encode()
            at = r.at if r.test in ("hex", "text") else rnd.choice([0, 5, 900, 1020, 1100])
            if at < 3000:
                body[len(body) :] = b"\0" * max(0, at - len(body))
                body[at : at + len(value)] = value
        rows.append(bytes(body))
    df = spark.createDataFrame([(i, bytearray(c)) for i, c in enumerate(rows)] + [(-1, None)], "i int, content binary").withColumn("value", F.lit(1))
    got = {r.i: r.mime for r in df.select("i", M.by_content(F.col("content")).alias("mime")).collect()}
    want = {i: slow(c, rules) for i, c in enumerate(rows)} | {-1: None}
    assert got == want and len(set(want.values())) > 40


def test_name_and_default(spark):
    df = spark.createDataFrame([("a.PY", b"x"), ("a.py", b"%PDF-1"), ("none", b"x"), (None, None)], "name string, content binary")
    assert [r[0] for r in df.select(G.mime_type(F.col("name"), F.col("content"))).collect()] == ["text/x-python", "application/pdf", "application/octet-stream", "application/octet-stream"]


def test_tables_that_are_none():
    head = "level;at;test;value;mime\n"
    assert M.parse_magic(head + "0;0;text;a;x\n1;0;hex;00;y\n2;0;near;b;z\n0;1;line;c;w\n")[0].below[0].below[0].mime == "z"
    for wrong in ("1;0;text;a;x", "0;0;text;a;x\n2;0;text;b;y", "0;0;other;a;x", "0;0;text;;x"):
        with pytest.raises(ValueError, match="rule"):
            M.parse_magic(head + wrong)
