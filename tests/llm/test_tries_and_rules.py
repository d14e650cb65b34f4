"""Conversation trie, filter audit and URL rules against brute force, and their edge cases."""

import hashlib
import random
import zlib
from collections import defaultdict
from itertools import permutations

import pytest
from pyspark.sql import functions as F
from test_pairs import WORDS

from ledgerline.llm.conversation_trie import end_digests, numbered_turns, owned, paths, rebuilt, trie
from ledgerline.llm.filter_audit import audit, judged
from ledgerline.llm.url_rules import with_rules

TURNS = "conv_id long, turn long, role string, text string"
NODE_COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute_trie(rows, family=20, taken=4):
    """The nodes of the rebuilt conversations, from the definition."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append(((turn is not None, turn or 0, sha(sha(role or "") + (text or ""))), (role or "", text or "")))
    own = {c: [x for _, x in sorted(t)] for c, t in own.items()}
    built = {}
    for c, turns in own.items():
        base = c - (abs(c) % family) * (1 if c >= 0 else -1)
        h = zlib.crc32(str(c).encode()) % taken
        built[c] = own.get(base, [])[:h] + turns[h:]
    members = defaultdict(list)
    for c in sorted(built):
        for d in range(len(built[c]) + 1):
            members[tuple(built[c][:d])].append(c)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for node in members:
        if node:
            children[node[:-1]] += 1
    for node, own_members in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += children[node] == 0
            saved[node[:d]] += (len(own_members) - 1) * len(WORDS.findall(node[-1][1])) if node else 0
    return sorted((m[0], len(n), members[n[:-1]][0] if n else None, len(m), children[n], leaves[n], saved[n], sha(",".join(str(c) for c in m if len(built[c]) == len(n)))) for n, m in members.items())


def spark_trie(df):
    convs, turns = rebuilt(numbered_turns(df))
    return sorted((tuple(r) for r in trie(convs, turns).select(*NODE_COLUMNS).collect()), key=lambda r: (r[0], r[1]))


def conversations(seed, n):
    rnd = random.Random(seed)
    texts = ["", "a", "b c", "a\tb  c\n", "x" * 5000, None, "\u00a0", "é ü"]
    rows = []
    for conv in rnd.sample(range(-60, 160), n):
        for turn in range(rnd.choice([1, 1, 2, 3, 4, 6])):
            rows.append((conv, turn if rnd.random() < 0.9 else None, rnd.choice(["user", "assistant", None, ""]), rnd.choice(texts)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_trie_by_brute_force(spark, seed):
    """Nulls, empty and long texts, repeated rows, negative ids and missing first conversations."""
    rows = conversations(seed, 110)
    rows += rows[:9] + [(None, 0, "user", "lost"), (140, None, None, None)]
    rows += [(c, 0, "user", "the same") for c in range(160, 190)] + [(c, 1, "user", f"then {c % 3}") for c in range(160, 190)]
    df = spark.createDataFrame(rows, TURNS).withColumns({"words": F.lit(1), "depth": F.lit("x"), "block": F.lit(0)}).repartition(5)
    assert spark_trie(df) == brute_trie(rows)


@pytest.fixture
def many_parts(spark):
    """Small tables are dealt over all partitions, as large ones are."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_trie_of_one_very_long_conversation(spark, many_parts):
    """Most rows belong to one conversation, and it spans several partitions."""
    rows = [(20, i, "user", f"word {i}") for i in range(600)] + [(21, i, "user", f"word {i}") for i in range(580)] + [(25, 0, "user", "word 0"), (47, 0, "a", "b")]
    assert spark_trie(spark.createDataFrame(rows, TURNS)) == brute_trie(rows)
    blocks = numbered_turns(spark.createDataFrame(rows, TURNS)).filter("conv_id = 20").select("block").distinct().count()
    assert blocks > 1


def test_trie_of_nothing_and_of_turnless_conversations(spark):
    empty = spark.createDataFrame([], TURNS)
    assert spark_trie(empty) == []
    taken = [c for c in range(1, 19) if zlib.crc32(str(c).encode()) % 4 > 0][:3]  # take their only turn from nobody
    rows = [(c, 0, "user", "gone") for c in taken]
    assert spark_trie(spark.createDataFrame(rows, TURNS)) == brute_trie(rows) == [(taken[0], 0, None, 3, 0, 1, 0, sha(",".join(map(str, taken))))]


def test_owner_is_the_smallest_member_over_all_parts(spark):
    convs, turns = rebuilt(numbered_turns(spark.createDataFrame([(c, 0, "user", "same") for c in range(0, 4000, 20)], TURNS)))
    marked = owned(paths(turns))
    assert [(r.conv_id, r.childless) for r in marked.filter("owned").collect()] == [(0, True)]
    ends = spark.createDataFrame([(1, 5, 6, c) for c in range(30_000)] + [(1, 5, 7, 3)], "depth long, key1 long, key2 long, conv_id long")
    assert {r.key2: r.ends_sha256 for r in end_digests(ends).collect()} == {6: sha(",".join(map(str, range(30_000)))), 7: sha("3")}


def brute_audit(rows, names, marks):
    out = []
    parts = sorted({r["part"] or "" for r in rows})
    removed_by = defaultdict(int)
    for order in permutations(names):
        for part in parts:
            alive = [r for r in rows if (r["part"] or "") == part]
            every = list(alive)
            for step, f in enumerate(order):
                gone = [r for r in alive if r[f]]
                alive = [r for r in alive if not r[f]]
                removed_by[part, f] += len(gone)
                unique = sum(r[f] and not any(r[x] for x in names if x != f) for r in every)
                lost = {f"{m}_lost": sum(r[m] for r in gone) for m in marks}
                out.append({"part": part, "filter_order": "".join(order), "step": step + 1, "kept": len(alive), "removed": len(gone), "redundant": sum(r[f] for r in every) - len(gone), "unique_fails": unique, **lost, "f": f})
    for r in out:
        r["shapley"] = removed_by[r["part"], r.pop("f")]
    return sorted(map(str, map(sorted, (r.items() for r in out))))


def test_audit_by_executing_every_order(spark):
    rnd = random.Random(4)
    rows = [{"part": rnd.choice(["a", "a", "a", "b", None, ""]), **{n: rnd.random() < p for n, p in zip("XYZW", (0.5, 0.3, 0.1, 0.6), strict=True)}, "good": rnd.random() < 0.5, "bad": rnd.random() < 0.2} for _ in range(400)]
    rows += [{"part": "none left", **dict.fromkeys("XYZW", True), "good": True, "bad": False}, {"part": "all left", **dict.fromkeys("XYZW", False), "good": True, "bad": False}]
    df = spark.createDataFrame(rows, "part string, X boolean, Y boolean, Z boolean, W boolean, good boolean, bad boolean")
    got = audit(df.withColumns({"state": F.lit(1), "filter": F.lit("f"), "alive": F.lit(0)}), list("XYZW"), ["good", "bad"])
    assert sorted(str(sorted(r.asDict().items())) for r in got.collect()) == brute_audit(rows, "XYZW", ["good", "bad"])
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "bad_lost", "shapley"]


def test_audit_of_nothing_and_of_wrong_filters(spark):
    empty = spark.createDataFrame([], "part string, A boolean, B boolean, good boolean")
    assert audit(empty, ["A", "B"], ["good"]).collect() == []
    for names in ([], ["A", "A"], list("ABCDEFGH"), ["AB"]):
        with pytest.raises(ValueError):
            audit(empty, names, [])


def test_verdicts_of_the_filters(spark):
    """Bounds, nulls, repeated rows and ids, a null id, and labels that repeat."""
    many = " ".join(f"w{i}" for i in range(200))
    rows = [
        (1, "s", many), (2, "s", many), (2, None, many), (None, "s", many), (3, "s", " ".join(["w"] * 200)), (4, "", None), (5, "s", ""), (6, "s", " \t\n"),
        (7, "s", "A" * 2 + "b" * 98), (8, "s", "A" * 3 + "b" * 97), (9, "s", "a|b"), (10, "s", "É" * 100), (11, "s", " ".join(f"v{i % 100}" for i in range(200))), (12, "s", "\u00a0".join(["w"] * 300)), (13, "s", "y " * 200_000),
    ]
    labels = spark.createDataFrame([(1, 0, 0), (1, 1, 0), (2, None, 1), (None, 1, 1), (99, 1, 1)], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumns({"part": F.lit("no"), "n": F.lit(1), "digest": F.lit("d"), "good": F.lit(True)})
    got = sorted(tuple(r) for r in judged(docs, labels).collect())
    want = []
    for i, source, text in rows:
        words, text = WORDS.findall(text or ""), text or ""
        same = [j for j, _, t in rows if (t or "") == text and j is not None]
        late = i is not None and bool(same) and i > min(same)
        fails = (len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * sum("A" <= c <= "Z" for c in text) > 2 * len(text), any(c in "#$%&*|" for c in text), late)
        want.append((source or "", *fails, i == 1, i == 2))
    assert got == sorted(want)


def brute_rule(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:].split("?")[0].split("#")[0]
    fits = [(len(h + p), len(h), v, h + p) for v, h, p in rules if None not in (v, h, p) for h in [h.lower()] if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3], best[2] if best else "allow"


def test_url_rules_by_brute_force(spark, many_parts):
    """Nested, equally long and repeated rules; nulls; hosts of many labels; one url on a third of all rows."""
    rnd = random.Random(7)
    rules = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"), ("block", "Example.ORG", ""), ("allow", "example.org", ""), ("allow", "a.example.org", "/"), ("block", "example.org", "/a/b"), ("block", "b.c", "/x"), ("allow", "a.b.c", "/"), ("block", None, "/"), (None, "net", "/"), ("block", "com", None), ("block", "", "")]
    rules += [(rnd.choice(["block", "allow"]), f"h{i % 9}.net", "/" + "d/" * (i % 7)) for i in range(80)]
    urls = [None, "", "no scheme", "http://", "http:///x", "http://net", "HTTP://NET/", "x://a.b.c/xy", "x://a.b.c/x#/y", "ftp://u@example.org:8/a", "http://example.org?q=/a/b", "http://xexample.org/a/b", "http://.net/en/", "http://a..net/", "a://b://c.net/", "http://e.org\n/fr/", "http://" + "a." * 60 + "net/en/", "http://example.com/de/" + "x" * 20_000]
    urls += [f"http://{rnd.choice(['', 'www.', 'a.', 'x.y.'])}{rnd.choice(['example', f'h{rnd.randrange(9)}', 'é'])}.{rnd.choice(['net', 'org', 'com'])}/{rnd.choice(['en/', 'de/', 'fr/', '', 'd/d/', 'd/d/d/d/x', 'a/b', 'a/bc?d'])}" for _ in range(600)]
    urls += ["https://www.h3.net/d/d/x"] * 300
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string").withColumns({"target": F.lit(1), "key": F.lit("k"), "rule": F.lit("old"), "path": F.lit(0)})
    got = with_rules(df, F.col("url"), spark.createDataFrame(rules, "verdict string, host string, path string"))
    assert got.columns == ["page_id", "url", "target", "key", "host", "path", "rule", "verdict"]
    found = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got.collect()}
    # Of rules with one host and path a block wins, and "block" is also the greater word, as in the brute force.
    assert found == {i: brute_rule(u, rules) for i, u in enumerate(urls)}


def test_url_rules_without_rules_or_pages(spark):
    pages = spark.createDataFrame([(1, "http://a.net/x")], "page_id long, url string")
    none = spark.createDataFrame([], "verdict string, host string, path string")
    assert [tuple(r) for r in with_rules(pages, F.col("url"), none, "block").collect()] == [(1, "http://a.net/x", "a.net", "/x", None, "block")]
    assert with_rules(pages.filter("false"), F.col("url"), none).collect() == []
