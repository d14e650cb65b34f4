"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary. A word's probability in a
language is the sum over all ways to cut it into pieces, got by a forward algorithm; a text's is the product
over its words.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textvec as tv
from .store import small_batches, table, written

#: A file of public byte-level pieces for many languages: base64 and rank on each line. Read by the driver.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Sums over words of up to so many bytes are taken as they are; those of longer words as logarithms, as they'd underflow.
PLAIN_SUMS = 24
#: Numbers (positions x words x languages) that a task's tables of sums hold at once.
SUMS_AT_ONCE = 2_000_000
#: The model is fitted on at most about so many labelled rows of each language, those of least hash.
TRAIN_ROWS = 1500
#: More labels than this are taken for a mistake, and raise an error.
MOST_LABELS = 4096
#: Rounds of expectation and maximisation.
ROUNDS = 3
#: A document is accepted from this posterior on.
LEAST_SCORE = 0.5


class Pieces:
    """The pieces of the vocabulary by hash; single bytes are always among them."""

    def __init__(self, path: str = VOCABULARY):
        with open(path, "rb") as lines:
            found = {base64.b64decode(line.split()[0]).strip().lower() for line in lines if line.strip()}
        kept = {x for x in found if x and not tv.SPACE[list(x)].any()} | {bytes([b]) for b in range(256) if not tv.SPACE[b]}
        texts = sorted(kept)
        data = np.frombuffer(b"".join(texts), np.uint8)
        ends = np.cumsum([len(x) for x in texts])
        hashes = tv.span_hash(tv.prefix_hash(data), ends - np.array([len(x) for x in texts]), ends)
        order = np.argsort(hashes)
        self.hashes = hashes[order]
        self.lengths = np.array([len(x) for x in texts])[order]
        self.by_length = {int(k): tv.Lookup(self.hashes[self.lengths == k], 16) for k in np.unique(self.lengths)}
        self.of_length = {k: np.flatnonzero(self.lengths == k) for k in self.by_length}

    def __len__(self) -> int:
        return len(self.hashes)


def _words(texts: tv.Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Prefix hashes, starts and ends of all words, and the document of each."""
    low = tv.Texts(tv.LOWER[texts.data], texts.offsets, texts.first_row)
    starts, ends, firsts = tv.word_bounds(low)
    return tv.prefix_hash(low.data), starts, ends, np.repeat(np.arange(len(texts)), np.diff(firsts))


class Lattice:
    """All pieces in a set of distinct words, ordered by where they end, for the forward and backward sums.

    The words are ordered by length, the longest first.
    """

    def __init__(self, pieces: Pieces, prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        self.lengths, self.n = ends - starts, len(starts)
        self.longest = int(self.lengths.max(initial=0))
        found = []
        for k, lookup in pieces.by_length.items():
            if k > self.longest:
                break
            own = int(np.searchsorted(-self.lengths, -k, side="right"))  # words of at least k bytes
            places = self.lengths[:own] - k + 1
            word = np.repeat(np.arange(own), places)
            at = np.arange(len(word)) - np.repeat(np.cumsum(places) - places, places)
            rows, ids = lookup.hits(tv.span_hash(prefix, starts[word] + at, starts[word] + at + k))
            found.append((at[rows] + k, word[rows], np.full(len(rows), k), pieces.of_length[k][ids]))
        end, word, size, piece = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 4
        order = np.lexsort((word, end))
        self.word, self.size, self.piece = word[order], size[order], piece[order]
        #: Where the pieces begin that end at each position.
        self.steps = np.searchsorted(end[order], np.arange(self.longest + 2))
        self.logs = self.longest > PLAIN_SUMS

    def _step(self, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        arcs = slice(self.steps[i], self.steps[i + 1])
        return self.word[arcs], self.size[arcs], self.piece[arcs]

    def forward(self, p: np.ndarray) -> np.ndarray:
        """Sums over the segmentations of each prefix: [position, word, language]; logarithms if self.logs."""
        sums = np.full((self.longest + 1, self.n, p.shape[1]), -np.inf if self.logs else 0.0)
        sums[0] = 0.0 if self.logs else 1.0
        own = np.log(p) if self.logs else p
        for i in range(1, self.longest + 1):
            word, size, piece = self._step(i)
            if not len(word):
                continue
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            if self.logs:
                each = sums[i - size, word] + own[piece]
                most = np.maximum.reduceat(each, first, axis=0)
                each = np.exp(each - np.repeat(most, np.diff(np.append(first, len(word))), axis=0))
                sums[i, word[first]] = most + np.log(np.add.reduceat(each, first, axis=0))
            else:
                sums[i, word[first]] = np.add.reduceat(sums[i - size, word] * own[piece], first, axis=0)
        return sums

    def log_totals(self, sums: np.ndarray) -> np.ndarray:
        """The logarithm of the sum over all segmentations of each word."""
        out = sums[self.lengths, np.arange(self.n)]
        return out if self.logs else np.log(out)

    def expected(self, p: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Expected uses of each piece, where word i occurs counts[i] times in each language."""
        sums = self.forward(p)
        out, all_words = np.zeros_like(p), np.arange(self.n)
        if self.logs:
            with np.errstate(divide="ignore"):
                back = np.full_like(sums, -np.inf)
                back[self.lengths, all_words] = np.log(counts) - sums[self.lengths, all_words]
            own = np.log(p)
            for i in range(self.longest, 0, -1):
                word, size, piece = self._step(i)
                flow = back[i, word] + own[piece]
                np.logaddexp.at(back, (i - size, word), flow)
                np.add.at(out, piece, np.exp(sums[i - size, word] + flow))
            return out
        back = np.zeros_like(sums)
        back[self.lengths, all_words] = counts / sums[self.lengths, all_words]
        for i in range(self.longest, 0, -1):
            word, size, piece = self._step(i)
            flow = back[i, word] * p[piece]
            np.add.at(back, (i - size, word), flow)
            np.add.at(out, piece, sums[i - size, word] * flow)
        return out


class Model:
    """languages, and the probability of each piece in each: [piece, language]."""

    def __init__(self, languages: list[str], pieces: Pieces, p: np.ndarray):
        self.languages, self.pieces, self.p = languages, pieces, p


def _distinct_words(pieces: Pieces, texts: tv.Texts, languages: int) -> tuple[list[Lattice], np.ndarray, np.ndarray]:
    """Lattices of the distinct words, longest first; for each word of the texts its number in them, and its document.

    A lattice holds as many words as SUMS_AT_ONCE allows at the length of its longest.
    """
    prefix, starts, ends, doc = _words(texts)
    _, first, back = np.unique(tv.span_hash(prefix, starts, ends), return_index=True, return_inverse=True)
    order = np.argsort(starts[first] - ends[first], kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    starts, ends = starts[first[order]], ends[first[order]]
    lattices, i = [], 0
    while i < len(order):
        n = max(1, int(SUMS_AT_ONCE // ((ends[i] - starts[i] + 1) * max(1, languages))))
        if ends[i] - starts[i] > PLAIN_SUMS:  # short words don't share a lattice with long ones
            n = min(n, int(np.searchsorted(starts[i:] - ends[i:], -PLAIN_SUMS)))
        lattices.append(Lattice(pieces, prefix, starts[i : i + n], ends[i : i + n]))
        i += n
    return lattices, place[back], doc


def _expecter(held):
    def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        total = np.zeros_like(model.p)
        for batch in batches:
            langs = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for texts in tv.chunks(batch.column(1)):
                lattices, back, doc = _distinct_words(model.pieces, texts, len(model.languages))
                counts = np.zeros((sum(x.n for x in lattices), len(model.languages)))
                np.add.at(counts, (back, langs[texts.first_row + doc]), 1)
                at = 0
                for lattice in lattices:
                    total += lattice.expected(model.p, counts[at : at + lattice.n])
                    at += lattice.n
        piece, lang = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(piece), pa.array(lang), pa.array(total[piece, lang])], ["piece", "lang", "uses"])

    return expect


def train(docs: DataFrame, labelled: Column, vocabulary: str = VOCABULARY, rows: int = TRAIN_ROWS, rounds: int = ROUNDS) -> Model:
    """Fits piece probabilities by expectation-maximisation, each round one Spark aggregation.

    docs: doc_id, text, lang. Of the rows where ``labelled`` holds and lang is not null about ``rows`` of each
    language are used, those of least hash of the doc_id; all of them if there are fewer. Every label is learned.
    What reaches the driver, and is broadcast, is one number for each piece and language.
    Without labelled rows the model has no language. More than MOST_LABELS labels raise a ValueError.
    """
    small_batches(docs.sparkSession)
    pieces = Pieces(vocabulary)
    own = docs.filter(labelled & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = own.groupBy("lang").agg(F.count("*").alias("n")).limit(MOST_LABELS + 1).collect()
    if len(sizes) > MOST_LABELS:
        raise ValueError(f"more than {MOST_LABELS} labels: lang does not name languages")
    languages = sorted(x.lang for x in sizes)
    if not languages:
        return Model([], pieces, np.zeros((len(pieces), 0)))
    share = {x.lang: min(1.0, rows / x.n) for x in sizes}
    ratio = F.coalesce(*[F.when(F.col("lang") == x, F.lit(s)) for x, s in share.items()], F.lit(0.0))
    index = F.coalesce(*[F.when(F.col("lang") == x, F.lit(i)) for i, x in enumerate(languages)])
    sample = own.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < ratio * 1_000_000).select(index.cast("int").alias("lang"), "text")
    sample = written(sample, "language-sample").repartition(8 * len(languages))
    model = Model(languages, pieces, np.full((len(pieces), len(languages)), 1 / len(pieces)))
    for _ in range(rounds):
        sums = sample.mapInArrow(_expecter(docs.sparkSession.sparkContext.broadcast(model)), "piece long, lang long, uses double").groupBy("piece", "lang").agg(F.sum("uses").alias("uses")).toPandas()
        uses = np.zeros_like(model.p)
        uses[sums["piece"], sums["lang"]] = sums["uses"]
        # A hundredth of a use for each piece the language lacks, shared over the vocabulary's sizes.
        model.p = (uses + 0.01) / (uses + 0.01).sum(0)
    return model


def _has_letter(texts: tv.Texts) -> np.ndarray:
    ascii_letter = (tv.LOWER[texts.data] >= 97) & (tv.LOWER[texts.data] <= 122)
    seen = np.concatenate([[0], np.cumsum(ascii_letter)])
    out = seen[texts.offsets[1:]] > seen[texts.offsets[:-1]]
    for d in np.flatnonzero(~out):
        out[d] = any(c.isalpha() for c in texts.data[texts.offsets[d] : texts.offsets[d + 1]].tobytes().decode("utf-8", "replace"))
    return out


def _identifier(held, text_at: int):
    def identify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for batch in batches:
            preds, scores = [], []
            for texts in tv.chunks(batch.column(text_at)):
                n, n_lang = len(texts), len(model.languages)
                if not n_lang:
                    preds += ["und"] * n
                    scores += [0.0] * n
                    continue
                logs, letter = np.zeros((n, n_lang)), _has_letter(texts)
                lattices, back, doc = _distinct_words(model.pieces, texts, n_lang)
                if lattices:
                    each = np.concatenate([x.log_totals(x.forward(model.p)) for x in lattices])
                    for j in range(n_lang):
                        logs[:, j] = np.bincount(doc, each[back, j], n)
                # Words are not independent: the evidence of w words counts as that of sqrt(w).
                logs /= np.sqrt(np.maximum(1, np.bincount(doc, minlength=n)))[:, None]
                odds = np.exp(logs - logs.max(1, keepdims=True))
                best = logs.argmax(1)
                preds += [model.languages[b] if ok else "und" for b, ok in zip(best, letter, strict=True)]
                scores += np.where(letter, 1 / odds.sum(1), 0.0).tolist()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(preds, pa.string()), pa.array(scores, pa.float64())], [*batch.schema.names, "lang_pred", "score"])

    return identify


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with lang_pred (a learned label; ``und`` for texts that are null or have no letter) and score.

    score is the posterior of lang_pred among the learned languages under even priors, tempered by the number
    of words; 0 for ``und``. Whole texts are scored; ties go to the first label. Every row stays as often as
    it is there, with its columns; columns named lang_pred or score are replaced. Nothing is shuffled.
    """
    small_batches(docs.sparkSession)
    rows = docs.drop("lang_pred", "score")
    schema = T.StructType([*rows.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(_identifier(docs.sparkSession.sparkContext.broadcast(model), rows.columns.index(text_col)), schema)


def is_held_out() -> Column:
    """crc32 of the doc_id as text leaves 1 modulo 3; a null doc_id does not."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def accepted_languages(docs: DataFrame, least_score: float = LEAST_SCORE) -> DataFrame:
    """The rows whose language is recognised with a score of at least ``least_score``, with their columns.

    Learns from the lang of rows that are not held out, as op1 does. Where no row has a lang all rows stay.
    """
    model = train(docs.select("doc_id", "text", "lang"), ~is_held_out())
    if not model.languages:
        return docs
    aside = {c: "_" * (1 + max(map(len, docs.columns))) + c for c in ("lang_pred", "score") if c in docs.columns}
    found = identify(docs.withColumnsRenamed(aside), model).filter((F.col("lang_pred") != "und") & (F.col("score") >= least_score))
    return found.drop("lang_pred", "score").withColumnsRenamed({v: k for k, v in aside.items()}).select(docs.columns)


def op1_language_id(spark, sf_dir: str) -> DataFrame:
    """The language of every document, learned from two thirds of them."""
    docs = table(spark, sf_dir, "documents")
    model = train(docs.select("doc_id", "text", "lang"), ~is_held_out())
    return identify(docs.select("doc_id", "text"), model).select("doc_id", is_held_out().alias("held_out"), "lang_pred", "score")
