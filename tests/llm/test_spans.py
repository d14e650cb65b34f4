"""Personal data and secrets against the stated patterns, and what their methods add."""

import hashlib
import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerline.llm import spans as sp
from ledgerline.llm.private_data import private_data, score_patterns
from ledgerline.llm.secrets import ownership, secrets

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile("AKIA[A-Z0-9]+")
HEX = re.compile("[0-9a-f]+")


def plain_private(text):
    found = [(0, m.start(), m.end()) for m in EMAIL.finditer(text)]
    found += [(1, m.start(), m.end()) for m in IP.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))]
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    found += [(2, m.start(), m.end()) for m in CARD.finditer(text) if 16 <= len(digits(m)) <= 19 and sp.luhn(digits(m))]
    return found + [(3, m.start(), m.end()) for m in PHONE.finditer(text) if 8 <= len(digits(m)) <= 15]


def plain_secrets(text):
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if len(m[0]) >= 32]
    return [(k, a, b) for a, k, b in sorted(found)]


PARTS = st.lists(st.sampled_from(["a", "é", " ", "@", ".", "b.c", "@x.y", "1", "4111 1111 1111 1111", "+1 (2", "255.1.2.3", "999", "-", "+", ")", "token", "=", ":", '"', "AKIA", "ABCDEFGH12345678", "0a" * 16, "password: ", "api_key=", "ſecret", "\n"]), max_size=25)


@settings(max_examples=400, deadline=None)
@given(PARTS)
def test_base_spans_are_the_stated_matches(parts):
    text = "".join(parts)
    assert [x[:3] for x in sp.private_spans(text)] == plain_private(text)
    assert [x[:3] for x in sp.secret_spans(text)] == plain_secrets(text)


def test_long_runs_are_fast_and_safe():
    assert sp.private_spans("a" * 300_000 + " @ " + "9" * 300_000 + " 1." * 1000) == []
    assert sp.private_spans("9" * 5000 + ".1.1.1") == []


def contact_rows():
    rng = random.Random(1)
    rows = []
    for i in range(40):
        rows.append((i, f"text {rng.random()} please contact me at user{i}@mail.org or else. Some 12345 other {rng.random()} words"))
    rows += [(100, "so contact me at user_999(at)mail or else"), (101, "nothing to me here 555777"), (102, None), (103, ""), (100, "so contact me at user_999(at)mail or else"), (None, "contact me at 777_x_777 or")]
    return rows


def test_contexts_find_identifiers_without_a_pattern(spark):
    docs = spark.createDataFrame(contact_rows(), "doc_id long, text string").withColumn("kind", F.lit("clash"))
    out = private_data(docs).collect()
    assert len(out) == len(contact_rows())
    texts = dict(contact_rows()[:44])
    for r in out:
        added = [s for s in r.spans if s.added]
        if r.doc_id in (100, None):
            assert r.n_added == 1 == len(added) and added[0].kind == 0
        else:
            assert r.n_added == 0
            base = ",".join(f"{sp.PRIVATE_KINDS[s.kind]}:{s.start}:{s.end}" for s in r.spans)
            assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
            assert [(s.kind, s.start, s.end) for s in r.spans] == plain_private(texts[r.doc_id] or "")
    assert private_data(docs.limit(0)).count() == 0


def test_pattern_scores_follow_their_definition(spark):
    edges = [("p", f"i{j}", 0) for j in range(9)] + [("p", "new", -1), ("q", "i1", 0), ("q", "i2", 0), ("r", "new", -1), (None, "x", 0), ("s", "a", 1)]
    got = {(r.pattern, r.kind): r.confidence for r in score_patterns(spark.createDataFrame(edges, "pattern string, instance string, kind int"), rounds=2).collect()}
    first = 9 / 11
    assert set(got) == {("p", 0)} and abs(got["p", 0] - (9 + first) / 11) < 1e-9


def secret_rows():
    live, copied = "q7Xz91LmPw04TtBv", "e3b3ed3cc8548923d6"
    rows = [(i, f"password={copied}", f"owner{i % 7}") for i in range(20)]
    rows += [(50, f"token: '{live}' here", "me"), (51, f"bare {live} again and {copied}", "me"), (52, "token=aaaaaaaaaaaa", "you"), (53, None, "you"), (54, "", None), (51, f"bare {live} again and {copied}", "me"), (None, f"x {live}", None)]
    return rows


def test_owners_tell_examples_from_live_secrets(spark):
    docs = spark.createDataFrame(secret_rows(), "doc_id long, text string, source string").withColumn("value", F.lit("clash"))
    out = secrets(docs, F.col("source")).collect()
    assert len(out) == len(secret_rows())
    by = {r.doc_id: r for r in out}
    assert by[0].n_example == 1 and by[0].n_live == 0 and by[0].spans[0].n_owners == 8
    assert by[50].n_live == 1 and by[50].spans[0].n_owners == 2 and by[52].n_live == 0
    assert [(s.start, s.end, s.added) for s in by[51].spans] == [(5, 21, True)]
    assert by[53].spans == [] and by[None].n_live == 1
    assert secrets(docs.limit(0), F.col("source")).count() == 0


def test_parts_of_runs_are_found(spark):
    live = "q7Xz91LmPw04TtBv"
    rows = [(1, f"token: '{live}'", "me"), (2, f"see /x/{live}/y and auth={live} or {live}.", "me"), (3, f"x {live}{live}", "me"), (4, "z" * 100_000 + f" /{live}", "me")]
    out = {r.doc_id: r for r in secrets(spark.createDataFrame(rows, "doc_id long, text string, source string"), F.col("source")).collect()}
    assert [rows[1][1][s.start : s.end] for s in out[2].spans] == [live] * 3
    assert out[3].spans == [] and [(s.start, s.end) for s in out[4].spans] == [(100_002, 100_018)]


def test_contexts_are_whole_words():
    from ledgerline.llm.private_data import _Words

    long = "w" * 300
    text = f"start {long}1 (x@y) tail2"
    before, between = _Words(text).patterns(text.index("x@y"), text.index("x@y") + 3)
    other = _Words(text.replace("w1", "v1")).patterns(text.index("x@y"), text.index("x@y") + 3)
    assert between == "between ( )" and before.endswith(" (") and before != other[0]
    assert _Words("x@y z").patterns(0, 3) == [] and _Words("a x@y").patterns(2, 5) == []
    assert _Words("a 12 x@y B").patterns(5, 8) == ["before a 00", "between 00 b"]


def test_ownership_counts(spark):
    hits = [(1, "a", 0, "v", 4.0), (2, "a", -1, "v", 4.0), (2, "b", 1, "v", 4.0), (3, None, -1, "w", 4.0), (4, None, 2, "u", 4.0)]
    got = {r.value: (r.kind, r.n_repos, r.n_owners, r.live) for r in ownership(spark.createDataFrame(hits, "doc_id long, owner string, kind int, value string, entropy double")).collect()}
    assert got == {"v": (0, 2, 2, True), "u": (2, 1, 1, True)}
