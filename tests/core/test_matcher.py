"""The license matcher, its overlap filter and containment joins against slow independent versions."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerline.operators import phrases as P
from ledgerline.operators import tree as T

from ..conftest import SMALL


def slow_order(size=256):
    """Offsets in the order in which quarter circles pass them last."""
    seen, time, r = {}, 0, 0.0
    while r < size:
        theta = 0.0
        while theta < math.pi / 2:
            time += 1
            seen[math.floor(r * math.sin(theta)), math.floor(r * math.cos(theta))] = time
            theta += math.pi / 4 / size
        r += 0.5
    return [p for p in sorted(seen, key=seen.get) if p != (0, 0) and max(p) < size]


ORDER = slow_order()


def slow_step(text, phrase, i, j, run=3):
    for x, y in ORDER:
        if i + x < len(text) and j + y < len(phrase):
            n = min(run, len(text) - i - x, len(phrase) - j - y)
            if text[i + x : i + x + n] == phrase[j + y : j + y + n]:
                return x, y
    return None


def slow_alignment(text, phrase, i, j):
    """(matched, added, end) of a text that spells a phrase from token j on, or None."""
    matched, added, removed, end = 0, 0, j, i
    while i < len(text) and j < len(phrase):
        if text[i] == phrase[j]:
            i, j, matched, end = i + 1, j + 1, matched + 1, i + 1
            continue
        step = slow_step(text, phrase, i, j)
        if step is None:
            break
        i, j, added, removed, end = i + step[0], j + step[1], added + step[0], removed + step[1], i + step[0]
    if j < len(phrase) and len(phrase) < 256 + j:
        removed, end = removed + len(phrase) - j, max(end, i)
    return (matched, added, end) if matched + removed == len(phrase) else None


def test_offsets_are_tried_in_the_fixed_order():
    times = P.visit_times()
    assert sorted(zip(*map(list, np.nonzero(times)), strict=True), key=lambda p: times[p]) == ORDER
    rnd = random.Random(3)
    for n in (4, 30, 300):
        for _ in range(60):
            text, phrase = ([rnd.randrange(rnd.choice([3, 12])) for _ in range(rnd.randrange(1, n))] for _ in range(2))
            if text[0] != phrase[0]:  # an agreement is sought where two tokens differ
                assert P.nearest_agreement(np.array(text), np.array(phrase)) == slow_step(text, phrase, 0, 0)


def beats(a, b, includes):
    """1 if match a stands for b, -1 if b for a, 0 if neither; matches: license, full, rank, start, end."""
    holds, held = a[3] <= b[3] and a[4] >= b[4], b[3] <= a[3] and b[4] >= a[4]
    if not holds and not held:
        return 0
    if a[1] and holds:
        return 1
    if b[1] and held:
        return -1
    if a[0] != b[0]:
        if (a[0], b[0]) in includes:
            return 1
        if (b[0], a[0]) in includes:
            return -1
        if b[1] and holds:
            return 0
    return 1 if a[2] >= b[2] else -1


INCLUDES = {(3, 1)}
#: License of each side, full or not, rank, start, end; the sign for (first, second) and for (second, first).
SIGNS = [
    ((1, True, 100.0, 1, 2), (1, False, 100.0, 1, 2), 1, -1),
    ((2, True, 100.0, 1, 2), (3, True, 100.0, 1, 2), 1, 1),
    ((1, True, 100.0, 1, 2), (3, False, 100.0, 1, 3), -1, 1),
    ((1, True, 100.0, 1, 2), (3, False, 100.0, 1, 8), -1, 1),
    ((3, False, 100.0, 1, 3), (3, False, 100.0, 1, 8), 1, 1),
    ((1, True, 100.0, 1, 2), (3, False, 100.0, 4, 8), 0, 0),
    ((1, True, 100.0, 1, 2), (3, False, 90.0, 1, 8), -1, 1),
    ((3, False, 99.0, 1, 8), (1, True, 100.0, 1, 2), 1, -1),
    ((3, False, 99.0, 1, 8), (3, False, 90.0, 1, 8), 1, -1),
]
_FOUND = "pfile_fk long, rf_pk long, full boolean, rank double, start int, end int"


def survivors(spark, rows, includes):
    out = P.surviving(spark.createDataFrame(rows, _FOUND), spark.createDataFrame(sorted(includes), "big long, small long"))
    return sorted(tuple(r[c] for c in ("pfile_fk", "rf_pk", "full", "rank", "start", "end")) for r in out.collect())


def test_signs_of_pairs(spark):
    """Each pair is a file of its own. Where each stands for the other, one of them stays."""
    rows = [(i, *m) for i, pair in enumerate(SIGNS) for m in pair[:2]]
    kept = survivors(spark, rows, INCLUDES)
    for i, (a, b, ab, ba) in enumerate(SIGNS):
        assert beats(a, b, INCLUDES) == ab and beats(b, a, INCLUDES) == ba
        left = [r[1:] for r in kept if r[0] == i]
        if ab == ba == 0:
            assert left == sorted([a, b])
        elif ab > 0 and ba > 0:
            assert len(left) == 1
        else:
            assert left == [a if ab > 0 else b]


def test_survivors_by_comparing_all_pairs(spark):
    """Inclusion, ranks, full matches and equal spans at random; of equal matches the earlier start, longer span, least license."""
    rnd, rows = random.Random(5), set()
    for file in range(30):
        for _ in range(rnd.randrange(1, 25)):
            start = rnd.randrange(40)
            full = rnd.random() < 0.3
            rows.add((file, rnd.randrange(1, 6), full, 100.0 if full else float(rnd.randrange(67, 100)), start, start + rnd.randrange(1, 20)))
    spans = {}
    for r in sorted(rows, key=lambda r: (r[2], r[3])):  # one match for each license and span, the best
        spans[r[0], r[1], r[4], r[5]] = r
    includes = {(1, 2), (3, 4), (1, 5)}
    order = lambda m: (m[3], -m[4], m[0])
    want = []
    for r in spans.values():
        rivals = [x for x in spans.values() if x[0] == r[0] and x != r]
        # A tie is no win of both: it goes by the order of the matches.
        lost = any((s := beats(x[1:], r[1:], includes)) > 0 and (beats(r[1:], x[1:], includes) < 0 or order(x[1:]) < order(r[1:])) for x in rivals)
        want += [] if lost else [r]
    assert survivors(spark, list(spans.values()), includes) == sorted(want)


def test_matches_by_aligning_every_start(spark):
    """All of the small documents, and texts with planted differences, against alignments one token at a time."""
    rnd = random.Random(9)
    phrases = [(1, "A", " ".join(f"w{i % 17}" for i in range(60))), (2, "B", " ".join(f"v{i % 23}" for i in range(40))), (3, "C", "one two three"), (4, "D", " ".join(f"w{i % 17}" for i in range(20, 45)))]
    texts = [r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("text").collect()]
    for _ in range(60):
        words = rnd.choice(phrases)[2].split()
        for _ in range(rnd.randrange(8)):
            at = rnd.randrange(len(words) + 1)
            words[at : at + rnd.randrange(3)] = [f"x{rnd.randrange(5)}" for _ in range(rnd.randrange(4))]
        texts.append(" ".join(["before"] * rnd.randrange(4) + words + ["after", "it"]))
    texts += ["", None, "one two three one two three", "w0 w1"]
    wanted = {k: [t for t, _, _ in P.tokens(t)] for k, _, t in phrases}
    want = []
    for i, text in enumerate(texts):
        words = [t for t, _, _ in P.tokens(text or "")]
        for k, phrase in wanted.items():
            starts = {}
            for t in range(len(words)):
                for s in range(11):
                    if words[t : t + 3] == phrase[s : s + 3] and len(phrase) > 3 and s + 3 <= len(phrase) and t + 3 <= len(words):
                        starts.setdefault(t - s, (t, s))
                        if s < starts[t - s][1]:
                            starts[t - s] = (t, s)
                if len(phrase) <= 3 and words[t : t + len(phrase)] == phrase:
                    want.append((i, k, True, 100, t, t + len(phrase)))
            for t, s in starts.values():
                if s == 0 and words[t : t + len(phrase)] == phrase:
                    want.append((i, k, True, 100, t, t + len(phrase)))
                elif got := slow_alignment(words, phrase, t, s):
                    rank = 100.0 * got[0] / (len(phrase) + got[1])
                    if int(rank) > 66:
                        want.append((i, k, False, int(rank), t, got[2]))
    files = spark.createDataFrame(list(enumerate(texts)), "pfile_fk long, text string").filter("text is not null")
    found = P.token_matches(files.select("pfile_fk", P.token_array(F.col("text")).alias("tokens")), P.searched(spark.createDataFrame(phrases, "rf_pk long, shortname string, text string")))
    got = sorted((r.pfile_fk, r.rf_pk, r.full, int(r["rank"]), r.start, r.end) for r in found.collect())
    assert got == sorted(want) and any(not r[2] for r in want) and any(r[2] for r in want)


@pytest.mark.parametrize("n", [1, 40])
def test_held_pairs_by_comparing_all(spark, n):
    rnd = random.Random(n)
    spans = [(rnd.randrange(3), i, a := rnd.randrange(200), a + rnd.choice([-1, 0, 1, 7, 64, 150])) for i in range(3 * n)] + [(1, 998, 0, 2**40), (None, 999, 0, 5)]
    points = [(rnd.randrange(3), i, rnd.randrange(260)) for i in range(9 * n)] + [(1, 900, 2**40), (1, 901, 2**40 + 1), (1, 902, None), (None, 903, 3)]
    df = T.held_pairs(spark.createDataFrame(points, "g long, point long, at long"), spark.createDataFrame(spans, "g long, span long, lft long, rgt long"), "g")
    want = sorted((g, p, s) for g, p, at in points for h, s, a, b in spans if g is not None and g == h and at is not None and a <= at <= b)
    assert sorted(tuple(r) for r in df.collect()) == want


def test_no_row_of_the_containment_join_is_filtered(spark):
    """Rows that leave the join are the pairs: its condition is equality only, and no filter follows."""
    points = spark.range(5000).selectExpr("id % 2 g", "id point", "id at")
    spans = spark.range(0, 4000, 40).selectExpr("id % 2 g", "id span", "id lft", "id + 700 rgt")
    pairs = T.held_pairs(points, spans, "g")
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join Inner" in line]
    assert len(joins) == 1 and not re.search("[<>]=?", joins[0].split("Join Inner", 1)[1])
    assert pairs.count() == sum(1 for s in range(0, 4000, 40) for p in range(s, min(s + 701, 5000)) if p % 2 == s % 2)
