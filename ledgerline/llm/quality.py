"""Quality classifier: random-indexing word vectors pooled per document, and a calibrated two-layer network.

Every word is two tokens: its lower-cased form, and its shape with a mark if it repeats the word before (runs of
lower-case letters, upper-case letters or digits become one sign each; other signs stay). A token's index vector is sparse
and random; its word vector is the sum of its neighbours' index vectors over all documents. Words that Spark counts
often enough have a vector of their own, in an array sorted by hash; rarer ones and shapes share buckets by hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textvec as tv
from .store import broadcast_if_small, forget, small_batches, table, written

#: Words of at least this share of all words have vectors of their own: at most 100,000, in any corpus.
LEAST_SHARE = 1e-5
#: Buckets of rarer words and of shapes, and the length of a vector.
WORD_BUCKETS, SHAPE_BUCKETS, DIMENSIONS = 8192, 2048, 32
BUCKETS = WORD_BUCKETS + SHAPE_BUCKETS
#: Neighbours on either side.
WINDOW = 2
#: The network is fitted on at most about so many labelled rows, those of least hash.
TRAIN_ROWS = 12_000
#: A fifth of them only sets the temperature.
CALIBRATION_SHARE = 0.2
HIDDEN, EPOCHS, RATE, DECAY = 32, 400, 0.01, 1e-4
#: Scores from here on are predicted 1.
THRESHOLD = 0.7

_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[97:123] = _SHAPE[128:] = ord("a")
_SHAPE[65:91] = ord("A")
_SHAPE[48:58] = ord("0")
_SHAPE[[9, 10, 11, 12, 13]] = 32


class Vocabulary:
    """Hashes of the frequent words, ascending; a word's number is its place, or that of its bucket behind them."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = np.sort(hashes)

    def __len__(self) -> int:
        return len(self.hashes) + BUCKETS

    def numbers(self, words: np.ndarray) -> np.ndarray:
        at = tv.in_sorted(words, self.hashes)
        return np.where(at >= 0, at, len(self.hashes) + (words % np.uint64(WORD_BUCKETS)).astype(np.int64))

    def index(self) -> tuple[np.ndarray, np.ndarray]:
        """Two places and two signs of each number's index vector, from hashes."""
        own = np.concatenate([self.hashes, np.arange(BUCKETS, dtype=np.uint64)])
        mixed = tv.mix(tv.mix(own + np.uint64(0x9E3779B97F4A7C15)))
        first = (mixed % np.uint64(DIMENSIONS)).astype(np.int64)
        step = ((mixed >> np.uint64(8)) % np.uint64(DIMENSIONS - 1)).astype(np.int64) + 1
        signs = np.stack([(mixed >> np.uint64(40)) & np.uint64(1), (mixed >> np.uint64(41)) & np.uint64(1)], 1)
        return np.stack([first, (first + step) % DIMENSIONS], 1), signs.astype(float) * 2 - 1


def _word_counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Different words of a task with their counts, handed on whenever they are many."""
    hashes, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    out = lambda: pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(counts)], ["word", "n"])
    for batch in batches:
        for texts in tv.chunks(batch.column(0)):
            own, n = np.unique(tv.word_hashes(texts, lower=True)[0], return_counts=True)
            hashes, back = np.unique(np.concatenate([hashes, own]), return_inverse=True)
            counts = np.bincount(back, np.concatenate([counts, n]), len(hashes)).astype(np.int64)
            if len(hashes) > 1 << 20:
                yield out()
                hashes, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    yield out()


def vocabulary(docs: DataFrame, least_share: float = LEAST_SHARE) -> Vocabulary:
    """The words of at least that share of all words of the column text of docs; 1 / least_share of them at most reach the driver."""
    small_batches(docs.sparkSession)
    counts = written(docs.select("text").mapInArrow(_word_counter, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "word-counts")
    total = counts.agg(F.sum("n")).first()[0] or 0
    own = counts.filter(F.col("n") >= F.lit(least_share * total)).select("word").toPandas()
    forget(counts)
    return Vocabulary(own["word"].to_numpy(np.int64).view(np.uint64))


def _tokens(texts: tv.Texts, known: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The number of every word and of its shape, and each document's first word."""
    low = tv.Texts(tv.LOWER[texts.data], texts.offsets, texts.first_row)
    starts, ends, firsts = tv.word_bounds(low)
    words = tv.span_hash(tv.prefix_hash(low.data), starts, ends)
    shape = _SHAPE[texts.data]
    keep = np.ones(len(shape), bool)
    keep[1:] = shape[1:] != shape[:-1]
    keep[starts] = True
    upto = np.concatenate([[0], np.cumsum(keep)])
    shapes = tv.span_hash(tv.prefix_hash(shape[keep]), upto[starts], upto[ends])
    again = np.zeros(len(words), np.uint64)
    again[1:] = words[1:] == words[:-1]
    again[firsts[:-1][firsts[:-1] < len(again)]] = 0
    shapes = tv.mix(shapes * np.uint64(2) + again)
    return known.numbers(words), (shapes % np.uint64(SHAPE_BUCKETS)).astype(np.int64) + len(known.hashes) + WORD_BUCKETS, firsts


def _indexer(held):
    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = held.value
        places, signs = known.index()
        total = np.zeros(len(known) * DIMENSIONS)
        for batch in batches:
            for texts in tv.chunks(batch.column(0), 4 << 20):
                *streams, firsts = _tokens(texts, known)
                doc = np.repeat(np.arange(len(texts)), np.diff(firsts))
                for stream in streams:
                    for step in range(1, WINDOW + 1):
                        near = np.flatnonzero(doc[step:] == doc[:-step])
                        for own, other in ((stream[near], stream[near + step]), (stream[near + step], stream[near])):
                            for j in range(2):
                                total += np.bincount(own * DIMENSIONS + places[other, j], signs[other, j], len(total))
        rows = total.reshape(-1, DIMENSIONS)
        used = np.flatnonzero(rows.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), *[pa.array(rows[used, j].astype(np.int64)) for j in range(DIMENSIONS)]], ["bucket", *[f"c{j}" for j in range(DIMENSIONS)]])

    return index


class Vectors:
    """A vocabulary and the unit vectors of its numbers."""

    def __init__(self, known: Vocabulary, values: np.ndarray):
        self.known, self.values = known, values


def word_vectors(docs: DataFrame, least_share: float = LEAST_SHARE) -> Vectors:
    """Unit word vectors of all numbers of the vocabulary, from the whole column text of docs.

    Tasks add up their documents before the shuffle; DIMENSIONS sums for each number reach the driver.
    """
    known = vocabulary(docs, least_share)
    columns = [f"c{j}" for j in range(DIMENSIONS)]
    held = docs.sparkSession.sparkContext.broadcast(known)
    sums = docs.select("text").mapInArrow(_indexer(held), "bucket int, " + ", ".join(f"{c} long" for c in columns)).groupBy("bucket").agg(*[F.sum(c).alias(c) for c in columns]).toPandas()
    out = np.zeros((len(known), DIMENSIONS))
    out[sums["bucket"]] = sums[columns]
    return Vectors(known, (out / np.maximum(1, np.linalg.norm(out, axis=1, keepdims=True))).astype(np.float32))


def _pool(texts: tv.Texts, vectors: Vectors) -> np.ndarray:
    """A document's features: the mean vector of its words and of its shapes, their lengths, its word count."""
    *streams, firsts = _tokens(texts, vectors.known)
    n = np.diff(firsts)
    parts = []
    for stream in streams:
        sums = np.zeros((len(texts), DIMENSIONS))
        if len(stream):
            full = n > 0
            sums[full] = np.add.reduceat(vectors.values[stream], firsts[:-1][full], axis=0)
        mean = sums / np.maximum(1, n)[:, None]
        parts += [mean, np.linalg.norm(mean, axis=1, keepdims=True)]
    return np.concatenate([*parts, np.log1p(n)[:, None]], 1)


class Network:
    """Two layers, trained by Adam on standardised features, with a temperature for its log odds."""

    def __init__(self, x: np.ndarray, y: np.ndarray, seed: int = 33):
        rng = np.random.default_rng(seed)
        held = np.arange(len(y)) < CALIBRATION_SHARE * len(y)
        self.mean, self.scale, self.temperature = x.mean(0), x.std(0) + 1e-6, 1.0
        # With one class or none there is nothing to learn but its rate.
        self.prior = (y.sum() + 1) / (len(y) + 2)
        self.weights = None
        if len(np.unique(y[~held])) < 2:
            return
        w = [rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
        m, v = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w]
        z, t = (x[~held] - self.mean) / self.scale, y[~held]
        for epoch in range(1, EPOCHS + 1):
            hidden = np.maximum(0, z @ w[0] + w[1])
            error = (1 / (1 + np.exp(-(hidden @ w[2] + w[3]))) - t) / len(t)
            back = np.outer(error, w[2]) * (hidden > 0)
            for i, g in enumerate((z.T @ back + DECAY * w[0], back.sum(0), hidden.T @ error + DECAY * w[2], error.sum(keepdims=True))):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                w[i] = w[i] - RATE * (m[i] / (1 - 0.9**epoch)) / (np.sqrt(v[i] / (1 - 0.999**epoch)) + 1e-8)
        self.weights = w
        if held.any():
            logits, t = self._logits(x[held]), y[held]
            choices = np.geomspace(0.25, 8, 61)
            losses = [np.logaddexp(0, np.where(t > 0, -logits, logits) / c).mean() for c in choices]
            self.temperature = float(choices[int(np.argmin(losses))])

    def _logits(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) / self.scale
        return np.maximum(0, z @ self.weights[0] + self.weights[1]) @ self.weights[2] + self.weights[3]

    def __call__(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(x), self.prior)
        return 1 / (1 + np.exp(-self._logits(x) / self.temperature))


def _feature_maker(held):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors = held.value
        for batch in batches:
            x = [_pool(texts, vectors) for texts in tv.chunks(batch.column(2))]
            rows = np.concatenate(x) if x else np.zeros((0, 1))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(list(rows), pa.list_(pa.float64()))], ["place", "y", "x"])

    return make


def train(docs: DataFrame, labels: DataFrame, allowed: Column, vectors: Vectors, rows: int = TRAIN_ROWS) -> Network:
    """Fits the network. docs: doc_id, text; labels: doc_id, y (0 or 1, nulls left out).

    Of the labels where ``allowed`` holds, one of each doc_id (the greater), about ``rows`` are used, those of least hash of the doc_id; the
    sample is a bounded table, so it is broadcast to the documents and only its features reach the driver.
    """
    own = labels.filter(allowed & F.col("y").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("y").alias("y"))
    total = own.count()
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000))
    sample = own.filter(place < F.lit(1_000_000 * min(1.0, rows / max(1, total)))).select("doc_id", F.col("y").cast("double"))
    chosen = docs.select("doc_id", "text").join(broadcast_if_small(sample, 2 * rows), "doc_id").select(F.xxhash64("doc_id").alias("place"), "y", "text")
    got = chosen.mapInArrow(_feature_maker(docs.sparkSession.sparkContext.broadcast(vectors)), "place long, y double, x array<double>").toPandas().sort_values(["place", "y"], kind="stable")
    width = 2 * DIMENSIONS + 3
    x = np.stack(got["x"].to_numpy()) if len(got) else np.zeros((0, width))
    if not len(got):
        x, y = np.zeros((1, width)), np.array([0.5])
        network = Network(x, y)
        network.prior = 0.5
        return network
    order = np.lexsort((*x.T[::-1], got["y"].to_numpy(), got["place"].to_numpy()))
    return Network(x[order], got["y"].to_numpy()[order])


def _scorer(network: Network, held, text_at: int):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors = held.value
        for batch in batches:
            # Six digits: what lies behind them depends on how rows are batched.
            p = [np.round(network(_pool(texts, vectors)), 6) for texts in tv.chunks(batch.column(text_at))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(p) if p else np.zeros(0))], [*batch.schema.names, "score"])

    return score


def score_quality(docs: DataFrame, network: Network, vectors: Vectors) -> DataFrame:
    """docs (text and more) with score, the calibrated probability of label 1, for every whole text.

    Null and empty texts get the score of a document without words. Every row stays as often as it is there; a column
    named score is replaced; nothing is shuffled; an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    rows = docs.drop("score")
    schema = T.StructType([*rows.schema.fields, T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(_scorer(network, docs.sparkSession.sparkContext.broadcast(vectors), rows.columns.index("text")), schema)


def is_held_out() -> Column:
    """crc32 of the doc_id as text leaves 2 modulo 4; a null doc_id does not."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def op2_quality_classifier(spark, sf_dir: str) -> DataFrame:
    """The quality of every document, learned from three quarters of the labels."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("y"))
    vectors = word_vectors(docs)
    network = train(docs, labels, ~is_held_out(), vectors)
    scored = score_quality(docs, network, vectors)
    return scored.select("doc_id", is_held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
