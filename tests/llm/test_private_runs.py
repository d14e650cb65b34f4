"""Identifiers of several words or of any length are found whole."""

import random

from ledgerline.llm import private_data as pd_
from ledgerline.llm.private_data import private_data


def test_runs_are_whole():
    whole = lambda text: [text[a:b] for a, b in pd_._runs(text)]
    assert whole("call (017) 555-7713, or") == ["(017) 555-7713"]
    assert whole("to DE89 3704 0044 0532 0130 00. Then") == ["DE89 3704 0044 0532 0130 00"]
    assert whole("to GB82 WEST 1234 5698 7654 32 now") == ["GB82 WEST 1234 5698 7654 32"]
    assert whole("(see 12 345 678) and 1 2 or 12345678") == ["12 345 678"]
    assert pd_._runs("9 " * 200_000) and pd_._instance("(017) 555-7713") == "0175557713"


def test_spaced_and_long_identifiers_are_added(spark):
    rng = random.Random(1)
    rows = [(i, f"text {rng.random()} please call me +1 555 {1000000 + i} or else") for i in range(40)]
    long = "x9" * 50 + "123"
    spots = {100: "(017) 555-7713", 101: "DE89 3704 0044 0532 0130 00", 102: long, 103: "5557713"}
    rows += [(i, f"so call me {x} or else") for i, x in spots.items()]
    out = {r.doc_id: r for r in private_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    texts = dict(rows)
    for i, x in spots.items():
        assert [texts[i][s.start : s.end] for s in out[i].spans if s.added] == [x]


def test_long_instances_are_kept_apart():
    assert pd_._hashed("a" * 64 + "b") != pd_._hashed("a" * 64 + "c")
