"""Queries that SQL cannot express, over the whole small tables, against slow versions in plain Python."""

import re
from collections import defaultdict

import regex

from ledgerline import plans
from ledgerline.operators import scanners as S
from ledgerline.plans import model as m

from ..conftest import SMALL


def one_letter_off(a, b):
    """Whether a distance of one letter lies between two names: one put in, taken out or exchanged."""
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    i = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    return a[i + 1 :] == b[i + 1 :] or a[i:] == b[i + 1 :] or a[i + 1 :] == b[i:]


def slow_pairs(left, right):
    """Stages of pairing (folder, item, name) of two trees; in each, of the files still alone the n-th of a key with the n-th."""
    bare = lambda name: re.sub("[0-9._-]", "", name)
    stem = lambda name: bare(re.sub(r"(?<=\.)[^.]*$", "", name))
    rest, found = [dict((i, (f, n)) for f, i, n in side) for side in (left, right)], set()

    def take(a, b, stage):
        found.add((a, b, stage))
        del rest[0][a], rest[1][b]

    for key, stage in ((str, "name"), (bare, "fuzzy"), (None, "one letter"), (stem, "stem")):
        if key:
            sides = []
            for side in rest:
                groups = defaultdict(list)
                for item in sorted(side):
                    folder, name = side[item]
                    if name is not None and key(name):
                        groups[folder, key(name)].append(item)
                sides.append(groups)
            for k in sides[0]:
                for a, b in zip(sides[0][k], sides[1].get(k, []), strict=False):
                    take(a, b, stage)
            continue
        folders = defaultdict(list)
        for item, (folder, name) in rest[1].items():
            folders[folder].append((item, bare(name or "")))
        wants = {a: {b for b, other in folders[f] if n is not None and bare(n) and other and one_letter_off(bare(n), other)} for a, (f, n) in rest[0].items()}
        while any(wants.values()):  # each asks for its least partner, each partner takes the least that asks
            asked = defaultdict(list)
            for a, partners in wants.items():
                if partners:
                    asked[min(partners)].append(a)
            taken = {min(ask): b for b, ask in asked.items()}
            for a, b in taken.items():
                take(a, b, stage)
            wants = {a: partners - set(taken.values()) for a, partners in wants.items() if a not in taken}
    return found | {(a, None, "alone") for a in rest[0]} | {(None, b, "alone") for b in rest[1]}


def test_fuzzy_name_match(spark):
    rows = m.items(spark, SMALL).filter("mode & 536870912 = 0").select("parent", "item", "name", "mode").collect()
    want = slow_pairs([(r.parent, r.item, r.name) for r in rows if r["mode"] == 0], [(r.parent, r.item, r.name) for r in rows if r["mode"] != 0])
    got = {(r.item_1, r.item_2, r.stage) for r in plans.QUERIES["fuzzy_name_match"](spark, SMALL).collect()}
    assert got == want and {s for _, _, s in want} >= {"fuzzy", "alone"}


def test_pairs_of_every_stage(spark):
    from ledgerline.operators.compare import matched_names

    left = [(1, 1, "a.c"), (1, 2, "file1.c"), (1, 3, "colour"), (1, 4, "color"), (1, 5, "notes.txt"), (1, 6, None), (2, 7, "a.c"), (1, 8, "a.c"), (1, 9, "1"), (1, 10, "abcd"), (1, 11, "abce")]
    right = [(1, 21, "a.c"), (1, 22, "file-22.c"), (1, 23, "colours"), (1, 24, "notes.md"), (1, 25, None), (3, 26, "a.c"), (1, 27, "2"), (1, 28, "abcf"), (1, 29, "abcg"), (1, 30, "colo")]
    frame = lambda rows: spark.createDataFrame(rows, "folder int, item int, name string")
    got = {(r.item_1, r.item_2, r.stage) for r in matched_names(frame(left), frame(right)).collect()}
    assert got == slow_pairs(left, right) and {s for _, _, s in got} == {"name", "fuzzy", "one letter", "stem", "alone"}


def test_contact_findings(spark):
    """The same patterns by another engine, text by text."""
    want = []
    for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect():
        for kind in ("url", "email", "author", "ecc", "ipra"):
            for hit in regex.finditer(S.PATTERNS[kind], r.text or "", flags=regex.V0 | regex.ASCII):
                content = re.sub(r"[ \t\n\x0b\f\r\x00-\x1f]{2,}", " ", hit[S.GROUPS.get(kind, 0)] or "").strip(" ")
                if content:
                    want.append((r.doc_id, kind, content))
    got = [(r.doc_id, r.type, r.content) for r in plans.QUERIES["contact_findings"](spark, SMALL).collect()]
    assert sorted(got) == sorted(want) and got
