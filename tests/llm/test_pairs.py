"""Near duplicates, decontamination, line dedup and mixing against brute force, and their edge cases."""

import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from ledgerline.llm import near_dedup as nd
from ledgerline.llm import textvec as tv
from ledgerline.llm.components import components
from ledgerline.llm.decontaminate import contained_items, decontaminate, minima_for
from ledgerline.llm.line_dedup import boilerplate_lines, drop_boilerplate, host_of, html_lines, text_lines
from ledgerline.llm.mixing import with_copies, word_count

WORDS = re.compile("[^\x20\x09-\x0d]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def shingle_set(text, k):
    words = WORDS.findall(lowered(text or ""))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else {tuple(words)} - {()}


def brute_components(rows, k, percent):
    sets = {i: shingle_set(t, k) for i, t in rows}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i), root(i) == i) for i in ids}


def family(seed, size, edits, length=60):
    """Texts that each differ from one base text in a few words, so that links form chains."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(5000)}" for _ in range(length)]
    out = []
    for _ in range(size):
        own = list(base)
        for _ in range(edits):
            own[rng.randrange(length)] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(own))
    return out


def test_word_and_shingle_hashes_follow_the_definition():
    import pyarrow as pa

    texts = ["a b c d e", None, "", " \t\n", "a b c", "x", "A B C D E", "a b c d e"]
    words, firsts = next((tv.word_hashes(c, lower=True) for c in tv.chunks(pa.array(texts))))
    assert np.diff(firsts).tolist() == [5, 0, 0, 0, 2, 1, 5, 5]
    values, at = tv.distinct(*tv.shingles(words, firsts, 4))
    assert np.diff(at).tolist() == [2, 0, 0, 0, 1, 1, 2, 2]
    assert values[at[0] : at[1]].tolist() == values[at[6] : at[7]].tolist()


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(7, i) for i in range(8, 30)] + [(5, 5), (None, 1)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 100 for i in range(100, 141)} | {i: 7 for i in range(7, 30)}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_near_duplicates_match_brute_force(spark):
    rows = []
    for seed, size, edits in ((1, 25, 1), (2, 40, 2), (3, 30, 3), (4, 12, 5)):
        rows += [(None, t) for t in family(seed, size, edits)]
    rows += [(None, "same text here for all of us")] * 9 + [(None, "too short"), (None, "Too SHORT"), (None, ""), (None, None), (None, " \n ")]
    random.Random(5).shuffle(rows)
    rows = [(3 * i, t) for i, (_, t) in enumerate(rows)]
    want = brute_components(rows, 4, 80)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in nd.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=4).collect()}
    assert got == want


def test_blocks_finish_what_leaders_leave(spark, monkeypatch):
    monkeypatch.setattr(nd, "BLOCK_ROWS", 6)
    rows = list(enumerate(family(11, 60, 3) + family(12, 60, 4)))
    want = brute_components(rows, 5, 80)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in nd.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


def test_near_duplicates_of_odd_rows(spark):
    rows = [(1, "a b c d e f", 9), (1, "a b c d e f", 9), (None, "a b c d e f", 8), (4, "a b c d e f", 7), (5, "long " * 30000, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key long")
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in nd.near_duplicates(docs).collect()), key=str)
    assert got == sorted([(1, 1, True), (1, 1, True), (None, None, True), (4, 1, False), (5, 5, True)], key=str)
    assert nd.near_duplicates(docs.limit(0)).count() == 0
    assert sorted(nd.without_near_duplicates(docs).columns) == ["doc_id", "key", "text"]
    # One id, two texts: each row has the component of its own text; texts whose least ids are equal are linked.
    rows = [(3, "a b c d e f"), (7, "a b c d e f"), (7, "other words are standing in here"), (9, "other words are standing in here")]
    got = sorted((r.doc_id, r.component_id) for r in nd.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(3, 3), (7, 3), (7, 7), (9, 7)]


def test_containment_matches_brute_force(spark):
    rng = random.Random(6)
    words = lambda n: [f"w{rng.randrange(300)}" for _ in range(n)]
    items = [(i, " ".join(words(rng.choice([5, 6, 8, 20, 60, 150])))) for i in range(30)] + [(97, "one two"), (98, ""), (99, None), (None, "a b c d e f")]
    docs = []
    for i in range(40):
        text = words(400)
        for _ in range(2):
            own = items[rng.randrange(30)][1].split()
            for _ in range(rng.randrange(3)):
                own[rng.randrange(len(own))] = "edited"
            at = rng.randrange(len(text))
            text[at:at] = own
        docs.append((i, " ".join(text)))
    docs += [(50, "one two"), (51, None), (52, ""), (None, items[0][1])]
    want = {}
    for d, t in docs:
        for i, s in items:
            a, b = shingle_set(t, 5), shingle_set(s, 5)
            if d is not None and i is not None and b and 100 * len(a & b) >= 80 * len(b):
                want[d, i] = (len(a & b), len(b))
    df, it = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    twice = df.union(df.filter("doc_id < 5"))  # rows that repeat count once
    for per_block, passes in ((10**6, 4), (400, 99), (10, 4)):
        rows = contained_items(twice, it, per_block=per_block, most_passes=passes).collect()
        assert {(r.doc_id, r.item_id): (r.n_matched, r.n_item) for r in rows} == want and len(rows) == len(want)
    assert len(want) > 30
    kept = decontaminate(df.withColumn("item_id", F.lit(1)), it)
    assert {r.doc_id for r in kept.collect()} == {d for d, _ in docs} - {d for d, _ in want}
    assert contained_items(df.limit(0), it).count() == contained_items(df, it.limit(0)).count() == 0


def test_no_item_can_be_missed():
    for size in [*range(1, 200), 5000]:
        assert minima_for(size, 80) > size - -(-size * 80 // 100)


def test_lines_above_the_ratio_go(spark):
    rows = [(i, f"http://a.org/{i}", "<p>menu</p><script>menu2</script><p> own %d </p>\n\n<p>menu</p>" % i) for i in range(20)]
    rows += [(100 + i, "https://b.org", "menu\nmenu\nrare") for i in range(3)] + [(200, None, "menu"), (201, "nothing", None), (202, "http://a.org", "")]
    rows += [(300 + i, "https://c.org", "two") for i in range(2)] + [(400 + i, "https://d.org", "four" if i < 3 else "a" * 300_000) for i in range(20)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"_kept": F.lit(1), "host": F.lit("clash"), "_lines": F.lit(2), "_host": F.lit(3)})
    out = {r.page_id: r for r in drop_boilerplate(pages, html_lines(F.col("html")), host_of(F.col("url"))).collect()}
    assert out[3].clean_text == "own 3" and out[3].n_dropped == 2 and out[3].host == "a.org"
    assert out[100].clean_text == "" and out[200].clean_text == "menu"  # on 3 of 3 pages; on the only page
    assert out[300].clean_text == "two" and out[400].clean_text == "four" and out[419].clean_text == ""
    assert out[201].n_lines == 0 and out[202].clean_text == ""
    assert len(out) == len(rows)


def test_line_joins_agree(spark):
    rows = [(i, "a" if i % 3 else None, "\n".join(random.Random(i).choices(["x", "y", "z", "  ", "unique %d" % i], k=6))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    lines = text_lines(F.col("text"))
    one = drop_boilerplate(docs, lines, F.col("source")).collect()
    other = drop_boilerplate(docs, lines, F.col("source"), broadcast_lines=0).collect()
    assert sorted(one) == sorted(other)
    by = boilerplate_lines(docs.select(F.col("source").alias("host"), lines.alias("lines"))).groupBy("host").count().collect()
    assert {r.host: r["count"] for r in by} == {"a": 3, None: 3}
    oracle = Counter()
    pages = [(h, {x.strip(" ") for x in t.split("\n")} - {""}) for _, h, t in rows]
    for host in ("a", None):
        own = [p for h, p in pages if h == host]
        for line, n in Counter(x for p in own for x in p).items():
            oracle[host] += 100 * (n - 1) > 10 * (len(own) + 9)
    assert oracle == {"a": 3, None: 3}
    assert drop_boilerplate(docs.limit(0), lines, F.col("source")).count() == 0


def test_mix_meets_its_targets(spark):
    rng = random.Random(7)
    rows = [(i, " ".join("w" * rng.choice([0, 1, 5, 40, 200, 900])) if rng.random() > 0.02 else None, rng.choice(["a"] * 6 + ["b", "c", "d", None])) for i in range(1500)]
    rows += rows[:30] + [(None, "w w w", "a"), (None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("copies", F.lit(9)).withColumn("part", F.lit(1))
    run = lambda n: with_copies(docs.repartition(n), F.col("source"), word_count(F.col("text")), F.xxhash64("doc_id", "text")).collect()
    out = run(3)
    assert sorted(map(str, out)) == sorted(map(str, run(7)))
    size, taken, target = Counter(), Counter(), {}
    for r in out:
        assert r.size == len(WORDS.findall(r.text or "")) and 0 <= r.copies <= 2
        size[r.source] += r.size
        taken[r.source] += r.copies * r.size
        target[r.source] = r.target
    order = sorted((s for s in size if s is not None)) + [None]
    left, want, budget = {s: [3, 1, 2][i % 3] for i, s in enumerate(order)}, {}, 1.5 * sum(size.values())
    while left:
        level = (budget - sum(want.values())) / sum(left.values())
        full = [s for s in left if level * left[s] > 2 * size[s]]
        want |= {s: 2.0 * size[s] for s in full or left} if full else {s: level * w for s, w in left.items()}
        left = {s: w for s, w in left.items() if s in full or not full} and {s: w for s, w in left.items() if s not in want}
    for s in order:
        assert abs(target[s] - want[s]) < 1e-6 * want[s]
        assert abs(taken[s] - target[s]) <= 0.01 * target[s] + 5
    assert with_copies(docs.limit(0), F.col("source"), word_count(F.col("text")), F.xxhash64("doc_id")).count() == 0


def solved_rate(sizes, target, most=2):
    """Rates of documents of these sizes that use up a target, by halving: most / (1 + exp(-tilt * size / mean size))."""
    if target >= most * sum(sizes) * (1 - 1e-12):
        return dict.fromkeys(sizes, float(most))
    mean, low, high = sum(sizes) / len(sizes), -700.0, 700.0
    rate = lambda tilt, size: most / (1 + np.exp(-np.clip(tilt * size / mean, -700, 700)))
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if sum(s * rate(middle, s) for s in sizes) < target else (low, middle)
    return {s: rate((low + high) / 2, s) for s in set(sizes)}


def test_rates_of_a_mix_by_solving_the_dual_in_plain_python(spark):
    """The words that the longest documents of a source take, down to any size, are what their rates say; even rates would not do."""
    rnd = random.Random(6)
    sizes = {s: [rnd.choice([1, 3, 10, 40, 200]) for _ in range(n)] for s, n in (("a", 120), ("b", 400), ("c", 60), ("d", 20))}
    rows = [(i, " ".join(["w"] * n), s) for i, (s, n) in enumerate((s, n) for s, own in sizes.items() for n in own)]
    got = with_copies(spark.createDataFrame(rows, "doc_id long, text string, source string"), F.col("source"), word_count(F.col("text")), F.xxhash64("doc_id", "text")).collect()
    even_is_wrong = False
    for source, own in sizes.items():
        target = next(r.target for r in got if r.source == source)
        rates = solved_rate(own, target)
        for least in sorted(set(own), reverse=True):
            want = sum(n * rates[n] for n in own if n >= least)
            taken = sum(r.copies * r.size for r in got if r.source == source and r.size >= least)
            assert abs(taken - want) <= least / 2 + 1e-6, (source, least)
            even_is_wrong |= abs(sum(n for n in own if n >= least) * target / sum(own) - want) > 2 * least
    assert even_is_wrong


def test_mix_of_rows_that_repeat_in_full(spark):
    """1300 equal rows beside others: their source meets its target within a row, however the rows are dealt."""
    rows = [(1, "ten words " * 5, "a")] * 1300 + [(i, "w " * 7, "b") for i in range(2, 400)] + [(500, None, None)] * 3 + [(501, "x y", None)] * 5
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    runs = [with_copies(df.repartition(n), F.col("source"), word_count(F.col("text")), F.xxhash64("doc_id", "text")).collect() for n in (1, 7)]
    assert Counter(map(str, runs[0])) == Counter(map(str, runs[1])) and len(runs[0]) == len(rows)
    for source, size in (("a", 10), ("b", 7), (None, 2)):
        own = [r for r in runs[0] if r.source == source]
        assert abs(sum(r.copies * r.size for r in own) - own[0].target) <= size
        assert all(0 <= r.copies <= 2 for r in own)
