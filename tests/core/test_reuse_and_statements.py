"""Reuse by name, the cascade of decisions and the clean-up of statements against slow versions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerline import plans
from ledgerline.operators import decisions as D
from ledgerline.operators import fixed_patterns as fixed
from ledgerline.operators import reuse as R
from ledgerline.operators import statements as S
from ledgerline.plans import model as m

from ..conftest import SMALL


def changes(a, b):
    """Lines out and in, by the table of longest common parts."""
    row = [0] * (len(b) + 1)
    for x in a:
        before = row
        row = [0]
        for j, y in enumerate(b):
            row.append(before[j] + 1 if x == y else max(before[j + 1], row[j]))
    return len(a) + len(b) - 2 * row[-1]


def test_line_changes_by_the_whole_table():
    rnd = random.Random(1)
    for _ in range(1500):
        a = [rnd.randrange(4) for _ in range(rnd.randrange(60))]
        b = list(a)
        for _ in range(rnd.randrange(7)):
            if rnd.random() < 0.5 and b:
                b.pop(rnd.randrange(len(b)))
            else:
                b.insert(rnd.randrange(len(b) + 1), rnd.randrange(5))
        for most in (1, 2, 5):
            assert R.line_changes(np.array(a, np.int64), np.array(b, np.int64), most) == min(most, changes(a, b))


def test_reuse_by_name_over_documents(spark):
    """The registered query, by comparing every pair of namesakes line by line."""
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    cleared = {r.doc_id for r in spark.read.parquet(f"{SMALL}/labels.parquet").filter("toxic = 1").collect()}
    new = {i: ("A line.\n" * (i % 7) + t).split("\n") for i, t in docs.items()}
    want = {}
    for i in docs:
        if i not in cleared:
            fits = [j for j in docs if j // 3 == i // 3 and changes(docs[j].split("\n"), new[i]) < 5]
            if fits:
                want[i] = max(fits)
    assert {r.item: r.decision_pk for r in plans.QUERIES["reuse_by_name"](spark, SMALL).collect()} == want


def test_reuse_by_name_with_nulls_and_a_name_of_many(spark):
    items = lambda rows: spark.createDataFrame(rows, "item long, name string, pfile_fk long")
    new = items([(i, "README", 100 + i) for i in range(200)] + [(900, None, 100), (901, "x", None), (902, "same", 1)])
    old = items([(-i - 1, "README", i) for i in range(200)] + [(-900, None, 3), (-902, "same", 1)])
    contents = spark.createDataFrame([(i, "\n".join(map(str, range(3 * i)))) for i in range(100)] + [(100 + i, "\n".join(map(str, range(3 * i + 1)))) for i in range(200)] + [(i, None) for i in range(300, 310)], "pfile_fk long, text string")
    decided = spark.createDataFrame([(i, i, 5) for i in range(0, 100, 2)], "decision_pk long, pfile_fk long, decision_type int")
    got = {r.item: r.decision_pk for r in R.reused_by_name(new, old, items([]).select("item"), decided, contents).collect()}
    lines = lambda n: [str(x) for x in range(n)] or [""]
    want = {}
    for i in range(200):
        fits = [j for j in range(0, 100, 2) if j != 100 + i and changes(lines(3 * j), lines(3 * i + 1)) < 5]
        if fits:
            want[i] = max(fits)
    assert got == want


def test_cascade_as_rule_by_rule(spark):
    """The one-pass cascade gives what the rules give one by one, and each decides some item."""
    items = m.items(spark, SMALL).filter("mode & 805306368 = 0")
    matches, events = m.scans(spark, SMALL), m.order_events(spark, SMALL)
    last = m.decisions(spark, SMALL).groupBy("item").agg(F.max_by("decision_type", "decision_pk").alias("decision_type"), F.array(F.max("decision_pk") % 2).alias("licenses"))
    last = last.filter("item % 5 != 2")  # users have items of a residue each
    types = spark.createDataFrame([(0, "Other"), (1, "Permissive")], "rf_pk long, license_type string")
    conflict = spark.range(0, 3000, 44).selectExpr("id + 3 item")
    for scanners in (("keyword", "phrase", "sentence"), ("keyword", "sentence")):
        got = {r.item: r.rule for r in D.auto_decisions(items, matches, events, last, types, 1, conflicting=conflict, scanners=scanners).collect()}
        news = matches.select("item", "license").distinct().join(last.filter("decision_type != 4"), "item").filter(~F.array_contains("licenses", F.col("license"))).select("item")
        free = items.select("item").join(last, "item", "left_anti")
        with_events, own = free.join(events, "item", "left_semi"), matches.join(free.join(events, "item", "left_anti"), "item", "left_semi")
        rules = {
            "update": news, "phrase events": D.phrases_cover_all(matches.join(with_events, "item", "left_semi"), events, 1).join(with_events, "item", "left_semi"), "tag": D.tag_without_contradiction(own),
            "sidecar": D.sidecar_without_contradiction(own), "keyword in phrase": D.keyword_inside_phrase(own), "agreement": D.scanners_agree(own, scanners), "license type": D.one_license_type(own, types, "Permissive", conflict),
        }
        assert got == {r.item: r.rule for r in D.cascade(items, rules).collect()}
    assert set(got.values()) == set(rules)


def slow_clean(text):
    for old, new in [(n, " ") for n in fixed.NOISE] + [(w, fixed.FIRST_WORD) for w in fixed.FIRST_WORDS]:
        while old in text:
            text = text.replace(old, new, 1)
    return text


@pytest.mark.parametrize("seed", [1, 2])
def test_replacements_until_nothing_is_left(spark, seed):
    rnd = random.Random(seed)
    parts = [*fixed.NOISE, *fixed.FIRST_WORDS, "copyright", "Copyright", "COPYRIGHT", " ", "(", ")", "$", "?", '"', "2020 Foo", "Assembly", "App", "<", "p>"]
    rows = ["".join(rnd.choice(parts) for _ in range(rnd.randrange(12))) for _ in range(400)]
    rows += ["Copyright Copyright Copyright Copyright 2020 Foo Bar Inc", "copyright copyright copyright Copyright x", " $ $ $ $ ", "((( )))", "", "AppAppAppCopyright", "c" * 5000 + "()" * 500]
    pairs = [(n, " ") for n in fixed.NOISE] + [(w, fixed.FIRST_WORD) for w in fixed.FIRST_WORDS]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i long, t string").select("i", S.replaced(F.col("t"), pairs).alias("t")).collect()
    assert {r.i: r.t for r in got} == {i: slow_clean(t) for i, t in enumerate(rows)}


def test_repeated_first_words_in_a_statement(spark):
    texts = ["Copyright Copyright Copyright 2020 Foo Bar Inc", "Copyright Copyright Copyright Copyright 2021 Foo Bar Inc", "AssemblyAssemblyCopyright 2022 Foo Bar Inc", "Copyright ((( ))) 2023 Foo Bar Inc"]
    df = spark.createDataFrame(list(enumerate(texts)), "fk long, text string")
    left = df.select("fk", F.transform(S.judged(F.array(F.struct(F.col("text").alias("raw"), F.lit(False).alias("head")))), lambda x: x["left"])[0].alias("left")).orderBy("fk").collect()
    assert [r.left for r in left] == ["Copyright 2020 Foo Bar Inc", "Copyright 2021 Foo Bar Inc", "Copyright 2022 Foo Bar Inc", slow_clean(texts[3])]
