"""Language ID, quality, perplexity rules and toxicity: exact parts against brute force, models on held-out rows."""

import math
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerline.llm import language_id as li
from ledgerline.llm import perplexity as px
from ledgerline.llm import quality as ql
from ledgerline.llm import textvec as tv
from ledgerline.llm import toxicity as tx

WORDS = re.compile("[^\x20\x09-\x0d]+")
SMALL = "/root/testdata/sf0.001"
#: Syllables of four made-up languages.
SOUNDS = {"aa": "ka to mi re su".split(), "bb": "schl ung heit eur ach".split(), "cc": "oux ment eau tion que".split(), "dd": "ññ ción ado llo rro".split()}


def speech(rng, lang, n):
    return " ".join("".join(rng.choices(SOUNDS[lang], k=rng.randrange(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def spoken(spark):
    rng = random.Random(1)
    rows = []
    for i in range(400):
        lang = rng.choice(list(SOUNDS))
        rows.append((i, speech(rng, lang, rng.randrange(5, 60)), lang if rng.random() < 0.9 else None, lang))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, truth string")


WORDY = ["the thing", "où? naïve x", None, "y" * 40 + " antidisestablishmentarianism, internationalisation", "日本語の文章は空白なしで書かれますので単語はとても長くなります" * 3]


def test_forward_sums_all_segmentations(monkeypatch):
    """Whole words and all pieces, long words too: no cut."""
    monkeypatch.setattr(li, "SUMS_AT_ONCE", 60)
    pieces = li.Pieces()
    rng = np.random.default_rng(2)
    p = rng.random((len(pieces), 2)) + 1e-3
    p /= p.sum(0)
    by_hash = dict(zip(pieces.hashes.tolist(), p, strict=True))
    longest = int(pieces.lengths.max())
    assert longest > 20
    texts = next(tv.chunks(pa.array(WORDY)))
    lattices, back, doc = li._distinct_words(pieces, texts, 2)
    assert len(lattices) > 3 and {x.logs for x in lattices} == {True, False}
    got = np.concatenate([x.log_totals(x.forward(p)) for x in lattices])[back]

    def prob(span: bytes) -> np.ndarray:
        data = np.frombuffer(span, np.uint8)
        return by_hash.get(int(tv.span_hash(tv.prefix_hash(data), np.array([0]), np.array([len(span)]))[0]), np.zeros(2))

    def total(word: bytes) -> np.ndarray:
        sums = [[Fraction(1)] * 2]
        for i in range(1, len(word) + 1):
            arcs = [(j, prob(word[j:i])) for j in range(max(0, i - longest), i)]
            sums.append([sum((sums[j][c] * Fraction(float(q[c])) for j, q in arcs if q[c]), Fraction(0)) for c in range(2)])
        return [math.log(x.numerator) - math.log(x.denominator) for x in sums[-1]]

    words = [w for t in WORDY if t for w in t.encode().lower().split()]
    assert len(words) == len(got) and doc.tolist() == [0, 0, 1, 1, 1, 3, 3, 3, 4]
    for s, g in zip(words[:-1], got, strict=False):
        np.testing.assert_allclose(g, total(s), rtol=1e-9)
    assert np.isfinite(got).all()


def test_expected_counts_add_up_to_the_bytes():
    pieces = li.Pieces()
    p = np.full((len(pieces), 1), 1 / len(pieces))
    texts = next(tv.chunks(pa.array(["several words of various lengths", "more", WORDY[3], WORDY[4]])))
    lattices, back, _ = li._distinct_words(pieces, texts, 1)
    counts, at, used = np.bincount(back).astype(float)[:, None], 0, 0
    for x in lattices:
        used += (x.expected(p, counts[at : at + x.n])[:, 0] * pieces.lengths).sum()
        at += x.n
    assert abs(used - sum(len(w) for w in f"several words of various lengths more {WORDY[3]} {WORDY[4]}".encode().split())) < 1e-6


def test_every_label_is_learned(spark):
    rows = [(3 * i, f"{chr(97 + i % 26)}{chr(97 + i // 26)} " * 9, f"l{i:03d}") for i in range(300)]
    assert len(li.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True), rounds=1).languages) == 300


def test_language_is_recognised_on_held_out_rows(spoken):
    model = li.train(spoken, ~li.is_held_out(), rounds=2)
    out = li.identify(spoken.withColumn("score", F.lit("clash")), model).collect()
    held = [r for r in out if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert len(held) > 80 and np.mean([r.lang_pred == r.truth for r in held]) > 0.98
    assert all(0 <= r.score <= 1 for r in out)
    assert model.languages == ["aa", "bb", "cc", "dd"]


def test_language_of_odd_texts(spark, spoken):
    model = li.train(spoken, ~li.is_held_out(), rounds=1)
    rows = [(1, None), (2, ""), (3, "12 34 !!"), (4, "日本"), (5, "ka" * 50_000), (5, "kato"), (None, "kato")]
    got = [(r.lang_pred, r.score) for r in li.identify(spark.createDataFrame(rows, "doc_id long, text string"), model).orderBy("doc_id").collect()]
    assert [g for g in got if g[0] == "und"] == [("und", 0.0)] * 3 and len(got) == 7
    none = li.train(spoken.withColumn("lang", F.lit(None).cast("string")), ~li.is_held_out())
    assert none.languages == [] and {r.lang_pred for r in li.identify(spoken.limit(3), none).collect()} == {"und"}
    assert li.identify(spoken.limit(0), model).count() == 0
    assert li.accepted_languages(spoken).columns == spoken.columns


def test_base_rules_match_brute_force(spark):
    rng = random.Random(3)
    texts = [None, "", " ", "a b", "one two three " * 30, "x\x0by\x1cz q   $$ |", "line\nline\n\n \nline\n", "é ü # é ü # é ü #"]
    texts += ["\n".join(" ".join(rng.choices(["a", "bb", "c$", "ñandú", "D"], k=rng.randrange(0, 30))) for _ in range(5)) for _ in range(60)]
    docs = spark.createDataFrame([(i, t, rng.choice(["en", None])) for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in px.quality_rules(docs.withColumn("low", F.lit("clash"))).collect()}
    for i, t in enumerate(texts):
        t = t or ""
        words = WORDS.findall(t)
        windows = [tuple(words[j : j + 3]) for j in range(len(words) - 2)]
        counts = Counter(windows)
        covered = {j + d for j, w in enumerate(windows) if counts[w] > 1 for d in range(3)}
        lines, dup = set(), 0
        for line in t.split("\n"):
            if WORDS.search(line):
                dup += line in lines
                lines.add(line)
        want = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered))
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (len(words) < 50 or 100 * len(covered) > 50 * len(words))
        assert not (r.base_failed and r.kept)
    assert px.quality_rules(docs.limit(0)).count() == 0


def brute_kneser_ney(texts):
    """Modified Kneser-Ney by its definition, one recursion; the texts of one language."""
    k = px.ORDER
    edges = lambda t: "\x02" * (k - 1) + t + "\x03"
    counts = {k: Counter(edges(t)[i : i + k] for t in texts for i in range(len(t) + 1))}
    for j in range(k - 1, 0, -1):
        counts[j] = Counter(g[1:] for g in counts[j + 1])
    cut = {}
    for j, c in counts.items():
        times = Counter(c.values())
        n1, n2, n3, n4 = (times[i] for i in (1, 2, 3, 4))
        if n1 and n2 and n3 and n4:
            y = n1 / (n1 + 2 * n2)
            d = [min(max(x, 0), i) for i, x in ((1, 1 - 2 * y * n2 / n1), (2, 2 - 3 * y * n3 / n2), (3, 3 - 4 * y * n4 / n3))]
        else:
            d = [0.5, 1.0, 1.5]
        cut[j] = lambda n, d=d: d[min(n, 3) - 1]

    def prob(g):
        if not g:
            return 1 / len(counts[1])
        j = len(g)
        same = {x: n for x, n in counts[j].items() if x[:-1] == g[:-1]}
        total = sum(same.values())
        return (counts[j][g] - cut[j](counts[j][g]) + sum(map(cut[j], same.values())) * prob(g[1:])) / total

    return counts[k], prob


def test_kneser_ney_by_its_definition(spark):
    rng = random.Random(4)
    texts = {"en": ["".join(rng.choices("abc de.", k=60)) for _ in range(12)] + ["", "é日"], "fr": ["".join(rng.choices("xyz", k=40)) for _ in range(5)]}
    docs = spark.createDataFrame([(lang, t) for lang, own in texts.items() for t in own], "lang string, text string").repartition(3)
    model = px.train(docs).collect()
    for lang, own in texts.items():
        counts, prob = brute_kneser_ney(own)
        got = {r.run: r.p for r in model if r.lang == lang}
        assert got.keys() == counts.keys()
        for run, p in got.items():
            assert abs(p - prob(run)) < 1e-9, (lang, run)


def test_perplexity_is_the_same_broadcast_and_joined(spark):
    rng = random.Random(8)
    rows = [(i, speech(rng, rng.choice(["aa", "bb"]), rng.randrange(0, 30)), rng.choice(["aa", "bb", "cc"])) for i in range(60)]
    rows += [(7, rows[7][1], rows[7][2]), (None, "ka to", "aa"), (8, "another text", "aa"), (9, "| " * 50, "aa")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = px.train(docs).persist()
    key = lambda r: (str(r.doc_id), r.text, r.lang)
    one, other = (sorted(px.with_perplexity(docs, model, size).collect(), key=key) for size in (1 << 20, 0))
    assert len(one) == len(other) == len(rows)
    for a, b in zip(one, other, strict=True):
        assert key(a) == key(b) and abs(a.log_perplexity - b.log_perplexity) < 1e-5
    _, prob = brute_kneser_ney([t for _, t, lang in rows if lang == "aa"])
    for r in one[:40]:
        if r.lang == "aa":
            padded = "\x02" * 4 + r.text + "\x03"
            want = -sum(math.log(prob(padded[i : i + 5])) for i in range(len(r.text) + 1)) / max(1, sum(any(c.isalnum() for c in w) for w in r.text.split()))
            assert abs(r.log_perplexity - want) < 1e-3


def test_both_bands_reject(spark):
    rng = random.Random(5)
    sound = lambda: speech(rng, "aa", rng.randrange(70, 90))
    rows = [(i, sound(), "aa") for i in range(200)] + [(500 + i, speech(rng, "bb", 80), "bb") for i in range(60)]
    rows += [(900, "".join(rng.choices("qxzwvj ~^", k=600)), "aa"), (901, " ".join(rng.choices("ka to mi re su kaka toto".split(), k=75)), "aa"), (902, sound().replace(" ", "### "), "aa")]
    out = {r.doc_id: r for r in px.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert not out[900].kept and not out[900].base_failed and out[900].log_perplexity > out[900].high
    assert not out[901].kept and not out[901].base_failed and out[901].log_perplexity < out[901].low
    assert not out[902].kept and out[902].log_perplexity > out[902].high
    assert (out[1].low, out[1].high) != (out[501].low, out[501].high)
    good = [out[i].kept for i in [*range(200), *range(500, 560)] if not out[i].base_failed]
    assert len(good) > 200 and np.mean(good) > 0.97


def test_rules_of_repeated_rows_and_clashing_columns(spark):
    rows = [(1, "a b c", None, 5)] * 3 + [(None, None, "en", 6), (2, "x" * 200_000, "en", 7)]
    out = px.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, _lang int"))
    assert [r.doc_id for r in out.orderBy(F.col("doc_id").asc_nulls_last()).collect()] == [1, 1, 1, 2, None]
    assert not [r for r in out.collect() if r.kept]


def test_quality_learns_what_labels_mark(spark):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(600):
        bad = rng.random() < 0.3
        text = speech(rng, "aa", rng.randrange(20, 60))
        rows.append((i, text.upper().replace(" ", "!! ") if bad else text))
        labels.append((i, None if i % 50 == 0 else 0 if bad else 1))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, y int")
    vectors = ql.word_vectors(docs)
    assert (vectors.values == ql.word_vectors(docs.repartition(5)).values).all()
    network = ql.train(docs, marks, ~ql.is_held_out(), vectors)
    scores = {r.doc_id: r.score for r in ql.score_quality(docs.withColumn("score", F.lit(1)), network, vectors).collect()}
    held = [(scores[i], y) for i, y in labels if zlib.crc32(str(i).encode()) % 4 == 2 and y is not None]
    assert np.mean([(s >= ql.THRESHOLD) == y for s, y in held]) > 0.97
    odd = spark.createDataFrame([(1, None), (2, ""), (None, "x"), (3, "y " * 100_000)], "doc_id long, text string")
    got = ql.score_quality(odd, network, vectors).collect()
    assert len(got) == 4 and all(0 <= r.score <= 1 for r in got)
    empty = ql.train(docs, marks.limit(0), ~ql.is_held_out(), vectors)
    assert {r.score for r in ql.score_quality(docs.limit(2), empty, vectors).collect()} == {0.5}
    assert ql.score_quality(docs.limit(0), network, vectors).count() == 0


def test_chain_finds_toxic_texts_it_has_not_seen(spark):
    rng = random.Random(7)
    rows, labels = [], []
    for i in range(900):
        toxic = rng.random() < 0.2
        words = speech(rng, "aa", 40).split()
        if toxic:
            words.insert(rng.randrange(40), rng.choice(["idiot", "stupid", "loweiung", "loweischaft", "loweichen"]))
        rows.append((i, " ".join(words)))
        if i < 600:
            labels.append((i, None if i % 100 == 0 else int(toxic)))
        else:
            labels.append((i, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    known = spark.createDataFrame(labels[:600], "doc_id long, toxic int")
    chain = tx.train(docs, known.union(known.limit(50)), ["toxic"], kinds=1)
    out = {r.doc_id: r for r in tx.predict(docs.withColumn("p_toxic", F.lit("clash")), chain, ["insult", "toxic"]).collect()}
    assert np.mean([(out[i].p_toxic >= 0.5) == y for i, y in labels[600:]]) > 0.97
    odd = spark.createDataFrame([(1, None), (2, ""), (None, "idiot"), (3, "ka " * 100_000)], "doc_id long, text string")
    assert len(tx.predict(odd, chain, ["insult", "toxic"]).collect()) == 4
    none = tx.train(docs, known.limit(0), ["toxic"])
    assert tx.predict(docs.limit(2), none, ["toxic"]).count() == 2
    assert tx.predict(docs.limit(0), chain, ["insult", "toxic"]).count() == 0


def test_chain_by_its_definition():
    """Each category's model sees, for training, what models that haven't seen a row say of the categories before it."""
    rng = np.random.default_rng(3)
    n, f = 60, 9
    ids = [tuple(np.flatnonzero(rng.random(f) < 0.3)) for _ in range(n)]
    y = np.stack([np.array([2 in x for x in ids]), np.array([2 in x or 5 in x for x in ids])], 1).astype(float)
    chain = tx.Chain(np.arange(f, dtype=np.uint64), ids, y)
    x = np.zeros((n, f))
    for i, own in enumerate(ids):
        x[i, list(own)] = 1

    def fit(x, dense, y):
        """Logistic regression by Adam, on dense rows."""
        z = np.concatenate([x, dense, np.ones((len(x), 1))], 1)
        rate = (y.sum() + 0.5) / (len(y) + 1)
        theta = np.zeros(z.shape[1])
        theta[-1] = np.log(rate / (1 - rate))
        m, v, decay = np.zeros_like(theta), np.zeros_like(theta), np.full(len(theta), tx.DECAY)
        decay[-1] = 0
        for step in range(1, tx.STEPS + 1):
            grad = z.T @ (1 / (1 + np.exp(-z @ theta)) - y) / len(y) + decay * theta
            m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
            theta = theta - tx.RATE * (1 - step / (tx.STEPS + 1)) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        return lambda x, dense: 1 / (1 + np.exp(-np.concatenate([x, dense, np.ones((len(x), 1))], 1) @ theta))

    none, fold = np.zeros((n, 0)), np.arange(n) % tx.FOLDS
    first = fit(x, none, y[:, 0])
    guess = np.zeros((n, 1))
    for k in range(tx.FOLDS):
        guess[fold == k, 0] = fit(x[fold != k], none[fold != k], y[fold != k, 0])(x[fold == k], none[fold == k])
    second = fit(x, guess, y[:, 1])
    flat, rows = tx._flat(ids)
    got = chain(flat, rows, n)
    np.testing.assert_allclose(got[:, 0], first(x, none), atol=1e-6)
    np.testing.assert_allclose(got[:, 1], second(x, first(x, none)[:, None]), atol=1e-6)


def test_kinds_come_from_shared_rows():
    """Two sets of features that never share a toxic row are two kinds."""
    rng = np.random.default_rng(5)
    ids, toxic = [], []
    for i in range(200):
        bad = i % 4 == 0
        own = {10 + int(x) for x in rng.integers(0, 30, 4)}
        own |= {int(x) for x in rng.choice(4, 2, replace=False) + (0 if i % 8 else 4)} if bad else set()
        ids.append(tuple(sorted(own)))
        toxic.append(float(bad))
    kinds = tx.kinds_of(ids, np.array(toxic), 40, telling=8)
    for row, own, bad in zip(kinds, ids, toxic, strict=True):
        assert row.sum() == bad and (not bad or row.argmax() == kinds[0].argmax()) == (not bad or min(own) >= 4)
    assert not tx.kinds_of(ids, np.zeros(200), 40).any() and not tx.kinds_of([], np.zeros(0), 0).any()


def test_word_vectors_by_their_definition(spark):
    """A token's vector is the sum of the index vectors of its neighbours, two on either side, over all documents."""
    texts = ["A bb ccc dd bb", "ccc a", None, "", "one", "bb bb Bb 12,5 x"]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    known = ql.vocabulary(docs, least_share=2 / 13)  # words that occur twice or more: a, bb, ccc
    assert len(known.hashes) == 3 and list(known.hashes) == sorted(known.hashes)
    places, signs = known.index()
    assert (places[:, 0] != places[:, 1]).all() and set(signs.ravel()) == {-1.0, 1.0}
    index = np.zeros((len(known), ql.DIMENSIONS))
    for j in range(2):
        index[np.arange(len(known)), places[:, j]] += signs[:, j]
    want = np.zeros_like(index)
    for t in texts:
        *streams, _ = ql._tokens(next(tv.chunks(pa.array([t], pa.string()))), known)
        for s in streams:
            for i in range(len(s)):
                for j in range(max(0, i - 2), min(len(s), i + 3)):
                    if i != j:
                        want[s[i]] += index[s[j]]
    want /= np.maximum(1, np.linalg.norm(want, axis=1, keepdims=True))
    got = ql.word_vectors(docs, least_share=2 / 13)
    np.testing.assert_allclose(got.values, want, atol=1e-6)
    words, shapes, firsts = ql._tokens(next(tv.chunks(pa.array(texts))), known)
    assert words[0] == words[6] < 3 and words[7] >= 3 and words[1] == words[4] == words[8] < 3
    pooled = ql._pool(next(tv.chunks(pa.array(texts))), got)
    for d in range(len(texts)):
        own = [got.values[s[firsts[d] : firsts[d + 1]]].mean(0) if firsts[d + 1] > firsts[d] else np.zeros(ql.DIMENSIONS) for s in (words, shapes)]
        np.testing.assert_allclose(pooled[d], [*own[0], np.linalg.norm(own[0]), *own[1], np.linalg.norm(own[1]), np.log1p(firsts[d + 1] - firsts[d])], atol=1e-6)


def test_network_by_its_definition():
    rng = np.random.default_rng(6)
    x, y = rng.normal(size=(200, 5)), (rng.random(200) < 0.6).astype(float)
    y[x[:, 0] > 0.5] = 1
    net = ql.Network(x, y)
    z = (x - x.mean(0)) / (x.std(0) + 1e-6)
    logits = np.array([max(0, 0) + sum(max(0.0, float(row @ net.weights[0][:, h] + net.weights[1][h])) * net.weights[2][h] for h in range(ql.HIDDEN)) + net.weights[3][0] for row in z])
    np.testing.assert_allclose(net(x), 1 / (1 + np.exp(-logits / net.temperature)), atol=1e-9)
    held = np.arange(200) < ql.CALIBRATION_SHARE * 200
    loss = lambda t: np.logaddexp(0, np.where(y[held] > 0, -logits[held], logits[held]) / t).mean()
    assert loss(net.temperature) <= min(loss(t) for t in np.geomspace(0.25, 8, 61)) + 1e-12
    assert np.mean((net(x) >= 0.5) == y) > 0.75


def test_repeated_rows_and_thresholds(spark):
    """Rows that repeat keep their number and score alike; a score at the threshold counts as above it."""
    rng = random.Random(9)
    rows = [(i, speech(rng, "aa", 30) + (" idiot" if i % 3 == 0 else "")) for i in range(90)]
    docs = spark.createDataFrame(rows + rows[:40] + [(3, "another text of one id")], "doc_id long, text string").withColumn("held_out", F.lit("clash"))
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(90)] * 2, "doc_id long, toxic int")
    chain = tx.train(docs, labels, ["toxic"], kinds=2)
    out = tx.predict(docs, chain, ["a", "b", "toxic"]).collect()
    assert len(out) == 131 and len({(r.doc_id, r.text, r.p_toxic) for r in out}) == 91
    vectors = ql.word_vectors(docs)
    scored = ql.score_quality(docs, ql.train(docs, labels.withColumnRenamed("toxic", "y"), F.lit(True), vectors), vectors).collect()
    assert len(scored) == 131 and len({(r.doc_id, r.text, r.score) for r in scored}) == 91
    ties = spark.createDataFrame([(ql.THRESHOLD,), (0.69,)], "score double").select((F.col("score") >= ql.THRESHOLD).cast("int").alias("p")).collect()
    assert [r.p for r in ties] == [1, 0]


def test_predictions_follow_scores(spark):
    for query, threshold in ((ql.op2_quality_classifier, ql.THRESHOLD), (tx.op8_toxicity, tx.THRESHOLD)):
        out = query(spark, SMALL).toPandas()
        assert ((out.score >= threshold) == (out.predicted == 1)).all() and out.score.between(0, 1).all()
        remainder, of = (2, 4) if query is ql.op2_quality_classifier else (3, 5)
        assert all((zlib.crc32(str(i).encode()) % of == remainder) == h for i, h in zip(out.doc_id, out.held_out, strict=True))


@pytest.mark.parametrize("query", [li.op1_language_id, ql.op2_quality_classifier, px.op4_quality_rules, tx.op8_toxicity])
def test_queries_return_a_row_for_each_document(spark, query):
    out = query(spark, SMALL).toPandas()
    assert out["doc_id"].is_unique and len(out) == 200
