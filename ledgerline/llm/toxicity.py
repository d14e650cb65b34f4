"""Toxicity by a classifier chain.

Categories are predicted one after another by linear models over hashed words and word beginnings; each model
also sees the probabilities of the categories before it. For training those come from out-of-fold
predictions, so that a later model sees them as uncertain as they will be on new text. Where rows are labelled as
toxic only, kinds of toxicity are learned from them: features that tell toxic rows apart fall into groups by
which rows they share, and the kinds come first in the chain.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textvec as tv
from .store import broadcast_if_small, small_batches, table, written

#: The chain is fitted on at most about so many labelled rows, those of least hash.
TRAIN_ROWS = 8_000
#: Features kept: those that tell a category apart best, by chi-square, among those in so many rows.
FEATURES, LEAST_ROWS = 2048, 3
#: Beginnings of longer words, in bytes, so that inflected forms share a feature.
BEGINNINGS = (4, 5, 6, 7, 8)
FOLDS, STEPS, RATE, DECAY = 3, 200, 0.2, 1e-4
#: Probabilities from here on are predicted 1.
THRESHOLD = 0.35

#: Kinds of toxicity told apart, and from how many of the most telling features.
KINDS, TELLING = 2, 64

#: ASCII that is neither letter nor digit separates words here.
_PLAIN = tv.LOWER.copy()
_PLAIN[[b for b in range(128) if not chr(b).isalnum()]] = 32


def _features(texts: tv.Texts) -> tuple[np.ndarray, np.ndarray]:
    """Distinct feature hashes of each document, and each document's first."""
    plain = tv.Texts(_PLAIN[texts.data], texts.offsets, texts.first_row)
    starts, ends, firsts = tv.word_bounds(plain)
    prefix = tv.prefix_hash(plain.data)
    doc = np.repeat(np.arange(len(texts)), np.diff(firsts))
    values, docs = [tv.span_hash(prefix, starts, ends)], [doc]
    for n in BEGINNINGS:
        longer = ends - starts > n
        values.append(tv.span_hash(prefix, starts[longer], starts[longer] + n) + np.uint64(n))
        docs.append(doc[longer])
    value, doc = np.concatenate(values), np.concatenate(docs)
    order = np.argsort(doc, kind="stable")
    return tv.distinct(value[order], np.searchsorted(doc[order], np.arange(len(texts) + 1)))


def _feature_counter(n_categories: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = np.array(batch.column(0).to_pylist(), float).reshape(-1, n_categories)
            for texts in tv.chunks(batch.column(1)):
                values, firsts = _features(texts)
                own = np.repeat(y[texts.first_row : texts.first_row + len(texts)], np.diff(firsts), axis=0)
                found, back = np.unique(values, return_inverse=True)
                hits = [np.bincount(back, own[:, c], len(found)).astype(np.int64) for c in range(n_categories)]
                rows = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1, dtype=np.int32) * n_categories), pa.array(np.stack(hits, 1).ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(np.bincount(back, minlength=len(found))), rows], ["feature", "n", "hits"])

    return count


def _vectoriser(features: np.ndarray):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = tv.Lookup(features)
        for batch in batches:
            ids: list = []
            for texts in tv.chunks(batch.column(2)):
                values, firsts = _features(texts)
                hit, at = lookup.hits(values)
                cuts = np.searchsorted(hit, firsts)
                ids += [at[a:b].tolist() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(ids, pa.list_(pa.int32()))], ["place", "y", "ids"])

    return make


class Linear:
    """Logistic regression over present features and a few dense columns, by Adam on all rows."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, dense: np.ndarray, y: np.ndarray, n_features: int):
        self.w, self.d, self.b = np.zeros(n_features), np.zeros(dense.shape[1]), 0.0
        rate = (y.sum() + 0.5) / (len(y) + 1)
        self.b = float(np.log(rate / (1 - rate)))
        theta = np.concatenate([self.w, self.d, [self.b]])
        m, v = np.zeros_like(theta), np.zeros_like(theta)
        for step in range(1, STEPS + 1):
            self.w, self.d, self.b = theta[:n_features], theta[n_features:-1], theta[-1]
            error = (self(ids, rows, dense) - y) / max(1, len(y))
            grad = np.concatenate([np.bincount(ids, error[rows], n_features) + DECAY * self.w, dense.T @ error + DECAY * self.d, [error.sum()]])
            m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
            theta = theta - RATE * (1 - step / (STEPS + 1)) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        self.w, self.d, self.b = theta[:n_features], theta[n_features:-1], float(theta[-1])

    def __call__(self, ids: np.ndarray, rows: np.ndarray, dense: np.ndarray) -> np.ndarray:
        logit = np.bincount(rows, self.w[ids], len(dense)) + dense @ self.d + self.b
        return 1 / (1 + np.exp(-np.clip(logit, -50, 50)))


class Chain:
    """One linear model for each category, in order."""

    def __init__(self, features: np.ndarray, ids: list, y: np.ndarray):
        self.features, self.models = features, []
        flat, rows = _flat(ids)
        fold, n = np.arange(len(ids)) % FOLDS, len(features)
        before = np.zeros((len(ids), 0))
        for c in range(y.shape[1]):
            self.models.append(Linear(flat, rows, before, y[:, c], n))
            guess = np.zeros(len(ids))
            for f in range(FOLDS):  # each row's guess by a model that has not seen it
                apart, own = fold[rows] != f, fold != f
                number = np.cumsum(own) - 1
                model = Linear(flat[apart], number[rows[apart]], before[own], y[own, c], n)
                guess[~own] = model(flat, rows, before)[~own]
            before = np.concatenate([before, guess[:, None]], 1)

    def __call__(self, flat: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
        out = np.zeros((n, 0))
        for model in self.models:
            out = np.concatenate([out, model(flat, rows, out)[:, None]], 1)
        return out


def _flat(ids: list) -> tuple[np.ndarray, np.ndarray]:
    sizes = [len(x) for x in ids]
    return np.array([i for x in ids for i in x], np.int64), np.repeat(np.arange(len(ids)), sizes)


def kinds_of(ids: list, toxic: np.ndarray, n_features: int, kinds: int = KINDS, telling: int = TELLING) -> np.ndarray:
    """Rows x kinds: which kinds of toxicity the toxic rows are of, learned from their features alone.

    The features that tell toxic rows apart best are projected on the leading directions in which toxic rows differ, and
    dealt out by the direction on which they lie furthest on its positive side; a toxic row is of each
    kind of which it holds a feature. Without toxic rows there is no kind.
    """
    out = np.zeros((len(ids), kinds))
    flat, rows = _flat(ids)
    if not toxic.any() or not len(flat):
        return out
    n, hits = np.bincount(flat, minlength=n_features), np.bincount(flat, toxic[rows], n_features)
    expected = n * toxic.mean()
    strength = np.where(hits > expected, (hits - expected) ** 2 / (expected + 1), 0.0)
    best = np.sort(np.argsort(-strength, kind="stable")[:telling])
    best = best[strength[best] > 0]
    column = np.full(n_features, -1)
    column[best] = np.arange(len(best))
    x = np.zeros((len(ids), len(best)))
    held = column[flat] >= 0
    x[rows[held], column[flat[held]]] = 1
    own = x[toxic > 0]
    if not len(best):
        return out
    directions = np.linalg.svd(own - own.mean(0), full_matrices=False)[2][: max(1, kinds - 1)]
    directions = directions * np.sign(directions[np.arange(len(directions)), np.abs(directions).argmax(1)])[:, None]
    group = np.where(directions.max(0) > 0, directions.argmax(0) + 1, 0)[: len(best)] % kinds
    for k in range(kinds):
        out[:, k] = (toxic > 0) & (x[:, group == k].sum(1) > 0)
    return out


def train(docs: DataFrame, labels: DataFrame, categories: list[str], rows: int = TRAIN_ROWS, allowed: Column | None = None, kinds: int = 0) -> Chain:
    """Fits a chain. docs: doc_id, text; labels: doc_id and a 0/1 column for each category (null: 0).

    kinds: so many kinds learned from the first category's rows stand before the categories in the chain. Of the
    labels where ``allowed`` holds, one of each doc_id, about ``rows`` are used, those of least hash of the doc_id. That
    bounded sample is joined to the documents; features are counted by Spark and the best FEATURES of those
    in LEAST_ROWS rows of the sample chosen; what reaches the driver is the sample in those features.
    """
    small_batches(docs.sparkSession)
    own = labels.filter(F.col("doc_id").isNotNull() if allowed is None else F.col("doc_id").isNotNull() & allowed)
    own = own.groupBy("doc_id").agg(*[F.max(c).alias(c) for c in categories])
    total = own.count()
    sample = own.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < F.lit(1_000_000 * min(1.0, rows / max(1, total))))
    joined = docs.select("doc_id", "text").join(broadcast_if_small(sample, 2 * rows), "doc_id")
    y = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in categories])
    chosen = written(joined.select(F.xxhash64("doc_id").alias("place"), y.alias("y"), "text"), "toxicity-sample").repartition(16)
    k = len(categories)
    sums = chosen.select(*[F.sum(F.get("y", F.lit(c))).alias(f"s{c}") for c in range(k)], F.count("*").alias("n")).first()
    counted = chosen.select("y", "text").mapInArrow(_feature_counter(k), "feature long, n long, hits array<long>")
    by_feature = counted.groupBy("feature").agg(F.sum("n").alias("n"), *[F.sum(F.get("hits", F.lit(c))).alias(f"h{c}") for c in range(k)]).filter(F.col("n") >= LEAST_ROWS)
    strength = []
    for c in range(k):
        expected = F.col("n") * F.lit((sums[f"s{c}"] or 0.0) / max(1, sums["n"]))
        strength.append(F.coalesce(F.pow(F.col(f"h{c}") - expected, 2) / (expected + 1), F.lit(0.0)))
    best = by_feature.withColumn("strength", F.greatest(*strength) if k > 1 else strength[0]).orderBy(F.desc("strength"), "feature").limit(FEATURES).select("feature").toPandas()
    features = np.sort(best["feature"].to_numpy(np.int64).view(np.uint64))
    got = chosen.mapInArrow(_vectoriser(features), "place long, y array<double>, ids array<int>").toPandas()
    in_order = sorted(zip(got["place"], got["y"].map(tuple), got["ids"].map(tuple), strict=True))
    ids, y_rows = [r[2] for r in in_order], np.array([r[1] for r in in_order], float).reshape(-1, k)
    learned = kinds_of(ids, y_rows[:, 0], len(features), kinds) if kinds else np.zeros((len(ids), 0))
    return Chain(features, ids, np.concatenate([learned, y_rows], 1))


def _predictor(chain: Chain, categories: list[str], text_at: int):
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = tv.Lookup(chain.features)
        for batch in batches:
            out = []
            for texts in tv.chunks(batch.column(text_at)):
                values, firsts = _features(texts)
                hit, at = lookup.hits(values)
                out.append(chain(at, np.searchsorted(firsts, hit, side="right") - 1, len(texts)))
            p = np.concatenate(out) if out else np.zeros((0, len(categories)))
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(p[:, c]) for c in range(len(categories))]], [*batch.schema.names, *[f"p_{c}" for c in categories]])

    return predict


def predict(docs: DataFrame, chain: Chain, categories: list[str]) -> DataFrame:
    """docs (text and more) with p_<category>, the probability of each category, for every whole text.

    Null and empty texts get the probabilities of a text without features. Every row stays as often as it is
    there; columns of those names are replaced; nothing is shuffled; an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    rows = docs.drop(*[f"p_{c}" for c in categories])
    schema = T.StructType([*rows.schema.fields, *[T.StructField(f"p_{c}", T.DoubleType()) for c in categories]])
    return rows.mapInArrow(_predictor(chain, categories, rows.columns.index("text")), schema)


def is_held_out() -> Column:
    """crc32 of the doc_id as text leaves 3 modulo 5; a null doc_id does not."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 3, F.lit(False))


def op8_toxicity(spark, sf_dir: str) -> DataFrame:
    """The toxicity of every document, learned from four fifths of the labels: two learned kinds, then the labelled category."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").filter("toxic is not null")
    categories = [*(f"kind_{i + 1}" for i in range(KINDS)), "toxic"]
    chain = train(docs, labels, ["toxic"], allowed=~is_held_out(), kinds=KINDS)
    found = predict(docs, chain, categories)
    return found.select("doc_id", is_held_out().alias("held_out"), F.col("p_toxic").alias("score"), (F.col("p_toxic") >= THRESHOLD).cast("int").alias("predicted"), *[f"p_{c}" for c in categories])
