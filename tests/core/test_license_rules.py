"""The license decision tree: phrases in one pass, the map to original positions, rules; against slow versions."""

import random
import re

import pytest
from pyspark.sql import functions as F

from ledgerline.operators import automaton as A
from ledgerline.operators import rule_graph as L

RULES = L.in_order(L.own_rules())
PHRASES = L.phrases_of(RULES)


def cleaned(text):
    return " " + re.sub("[^a-z0-9+]+", " ", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)).strip() + " "


def texts(seed, n):
    rnd = random.Random(seed)
    words = [w for p in PHRASES for w in p.split()]
    made = []
    for _ in range(n):
        parts = [rnd.choice([rnd.choice(PHRASES), rnd.choice(words), "é", "  ", "\n", "Ⅷ", "GPL-2.0+", "\U0001f600", "\0"]) for _ in range(rnd.randrange(40))]
        made.append(rnd.choice([" ", ", ", "é", "\n * "]).join(p.title() if rnd.random() < 0.3 else p for p in parts))
    return [*made, "", None, " ", "é", "mit license", "x" * 3000 + " MIT\n\tLicense " + "y" * 3000]


def frame(spark, rows):
    return spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")


def test_phrases_and_positions_by_looking_everywhere(spark, monkeypatch):
    rows = texts(1, 120)
    got = A.scanned(frame(spark, rows).withColumn("hits", F.lit("x")), ["doc_id", "text"], F.col("text"), PHRASES, clean=True)
    spans = A.original_spans(F.col("starts"), F.col("shifts"), F.col("hits"))
    every = 0
    for r in got.select("doc_id", "text", "hits", "clean", spans.alias("spans")).collect():
        text = r.text or ""
        clean = cleaned(text)
        assert r.clean.strip() == clean.strip()
        want = sorted((at + 1, at + 1 + len(p), i) for i, p in enumerate(PHRASES) for at in range(len(clean) - 1) if clean.startswith(f" {p} ", at))
        assert sorted((h["at"], h["to"], h["phrase"]) for h in r.hits) == want
        for h, s in zip(r.hits, r.spans, strict=True):  # cut out of the original text it is the phrase
            piece = text[s["start"] : s["end"]]
            assert cleaned(piece).strip() == PHRASES[h["phrase"]] and re.match("[A-Za-z0-9+]", piece) and re.search(r"[A-Za-z0-9+]\Z", piece)
        every += len(want)
    assert every > 300


@pytest.mark.parametrize("cells", [10, 2000])
def test_many_phrases_in_several_passes(spark, cells):
    df = frame(spark, texts(2, 30))
    one, many = (A.scanned(df, ["doc_id"], F.col("text"), PHRASES, most_cells=c).select("doc_id", "hits").orderBy("doc_id").collect() for c in (A.MOST_CELLS, cells * 39))
    assert one == many


def test_phrases_must_be_cleaned(spark):
    for wrong in (["Mit"], ["a", "a"], [""], ["a.b"]):
        with pytest.raises(ValueError, match="phrases"):
            A.scanned(frame(spark, []), ["doc_id"], F.col("text"), wrong)
    assert A.scanned(frame(spark, ["text", None]), ["doc_id"], F.col("text"), []).select("hits").collect() == [([],), ([],)]


def slow_spans(clean, parts, gap=L.GAP):
    at = lambda p: [i for i in range(len(clean)) if clean.startswith(f" {p} ", i)]
    spans = [(i, i + len(parts[0])) for i in at(parts[0])]
    for p in parts[1:]:
        spans = [(a, i + len(p)) for a, b in spans for i in at(p) if 0 <= i - b <= gap]
    return spans


def slow_findings(text, rules):
    clean, held = cleaned(text or ""), {}
    if not any(slow_spans(clean, [p]) for r in rules for s in r.says for p in s):
        return {(L.NOTHING, 0)}
    for r in rules:
        said = any(slow_spans(clean, s) for s in r.says) if r.says else True
        if said and all(n in held for n in r.needs) and not any(n in held for n in r.unless):
            held[r.name] = r
    found = {}
    for r in held.values():
        if r.license:
            found[r.license] = max(r.interest, found.get(r.license, 0))
    best = max(found.values(), default=0) >= 2
    return {(n, i) for n, i in found.items() if i >= 2 or not best} or {(L.NOTHING, 0)}


@pytest.mark.parametrize("own", [True, False])
def test_rules_by_reading_each_text(spark, own):
    rules = RULES if own else L.in_order(L.parse_rule_table(
        "rule;license;interest;says;with;unless\nc;C;2;;a&b;\na;;0;mit .. license .. version;;\nb;B;1;license;;d\nd;D;2;gnu|gpl .. version;;\ne;C;1;version;;\nf;F;1;;b;c|d"
    ))
    rows = texts(3, 150)
    got = {}
    for r in L.rule_findings(frame(spark, rows), ["doc_id"], F.col("text"), rules).collect():
        got.setdefault(r.doc_id, set()).add((r.shortname, r.interest))
        assert all(cleaned(rows[r.doc_id][s["start"] : s["end"]]).strip() for s in r.spans) and bool(r.spans) == (r.shortname != L.NOTHING)
    assert got == {i: slow_findings(t, rules) for i, t in enumerate(rows)}


def test_statements_of_well_known_licenses(spark):
    said = {
        "GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.": "GPL-2.0-or-later",
        "Licensed under the Apache License, Version 2.0 (the \"License\");": "Apache-2.0",
        "Permission is hereby granted, free of charge, to any person obtaining a copy": "MIT",
        "Redistribution and use in source and binary forms, with or without": "BSD-2-Clause",
        "GNU Lesser General Public License as published; either version 2.1": "LGPL-2.1-only",
        "// SPDX: MPL-2.0": "MPL-2.0",
        "The MIT License (MIT)": "MIT",
        "CC BY-NC-SA 4.0": "CC-BY-NC-SA-4.0",
        "smit licenses": L.NOTHING,
    }
    rows = list(said)
    got = L.rule_findings(frame(spark, rows), ["doc_id"], F.col("text")).select("doc_id", "shortname").collect()
    assert sorted((rows[r.doc_id], r.shortname) for r in got) == sorted(said.items())
    assert len({r.license for r in RULES if r.license}) >= 60


def test_rules_in_an_order():
    rule = lambda name, needs=(), unless=(): L.Rule(name, needs=list(needs), unless=list(unless))
    assert [r.name for r in L.in_order([rule("a", ["b"]), rule("b", unless=["c"]), rule("c")])] == ["c", "b", "a"]
    for wrong in ([rule("a", ["a"])], [rule("a", ["x"])], [rule("a"), rule("a")], [rule("a", ["b"]), rule("b", unless=["a"])]):
        with pytest.raises(ValueError, match="rules|cycle"):
            L.in_order(wrong)
