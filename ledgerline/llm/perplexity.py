"""Quality rules with an n-gram perplexity verdict.

Spark counts runs of five characters (code points, as they are) over all documents, language by language, and
smooths them by modified Kneser-Ney in joins. The model is kept as arrays sorted by hash, which scoring reads.
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

#: Characters in a run.
ORDER = 5
#: A document is rejected if its log perplexity lies further from the language's median than so many times the
#: distance of the median to the 10 % or 90 % quantile, whichever is on that side.
BAND = 3.0
#: A model up to this size is broadcast, as arrays; a larger one is joined, with the same result.
MODEL_BYTES = 128 << 20
#: A run that most documents hold is dealt over so many parts in that join.
PARTS = 16
#: Different runs that a task holds before it hands them on.
RUNS_AT_ONCE = 1 << 19
#: Runs in one array of the stored model.
RUNS_IN_ARRAY = 1 << 16
#: Fixed values of the base rules: fewest words, and most words in repeated windows in a hundred.
LEAST_WORDS, MOST_REPEATED = 50, 50

_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True
_SPOKEN = np.zeros(256, bool)
_SPOKEN[48:58] = _SPOKEN[65:91] = _SPOKEN[97:123] = _SPOKEN[128:] = True
#: What stands before and behind a text.
_BEFORE, _BEHIND = 2, 3
_FACTORS = tv.random_words(61, ORDER) | np.uint64(1)


def _runs(texts: tv.Texts) -> tuple[np.ndarray, np.ndarray]:
    """The code points, padded by edges, and where each run starts in them; and each document's first run (one past the last).

    ORDER - 1 edges stand before a document and one behind it, so it has one run more than characters.
    """
    points = np.frombuffer(texts.data.tobytes().decode().encode("utf-32-le"), np.uint32)
    lead = (texts.data & 0xC0) != 0x80
    upto = np.concatenate([[0], np.cumsum(lead)])[texts.offsets]  # characters before each document
    n = len(texts)
    padded = np.full(len(points) + ORDER * n, _BEFORE, np.uint32)
    doc = np.repeat(np.arange(n), np.diff(upto))
    padded[np.arange(len(points)) + (ORDER - 1) + ORDER * doc] = points
    padded[upto[1:] + ORDER * np.arange(1, n + 1) - 1] = _BEHIND
    firsts = upto + np.arange(n + 1)
    starts = np.arange(firsts[-1]) + (ORDER - 1) * np.repeat(np.arange(n), np.diff(firsts))
    return padded, starts, firsts


def _hashes(padded: np.ndarray, starts: np.ndarray, salt: np.ndarray) -> np.ndarray:
    """One hash for each run; salt: one number for each, of its language."""
    wide = padded.astype(np.uint64) + np.uint64(1)
    n = max(0, len(wide) - ORDER + 1)
    total = np.zeros(n, np.uint64)
    for j in range(ORDER):
        total += wide[j : n + j] * _FACTORS[j]
    return tv.mix(tv.mix(total[starts] + salt) + salt)


def _strings(runs: np.ndarray) -> pa.Array:
    """Rows of ORDER code points as strings."""
    data = runs.astype("<u4").tobytes().decode("utf-32-le").encode()
    sizes = (1 + (runs > 0x7F) + (runs > 0x7FF) + (runs > 0xFFFF)).sum(1)
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.StringArray.from_buffers(len(runs), pa.py_buffer(offsets.tobytes()), pa.py_buffer(data))


def _salts(langs: list[str]) -> np.ndarray:
    words, _ = zip(*[(tv.span_hash(tv.prefix_hash(d), np.array([0]), np.array([len(d)]))[0], 0) for d in (np.frombuffer(b"=" + x.encode(), np.uint8) for x in langs)]) if langs else ((), ())
    return np.array(words, np.uint64)


def _counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Different runs of a task with their counts: lang, run, hash, n."""

    def rows(held: list) -> pa.RecordBatch:
        hashes, counts, langs, runs = (np.concatenate(x) for x in zip(*held, strict=True))
        found, first, back = np.unique(hashes, return_index=True, return_inverse=True)
        n = np.bincount(back, counts, len(found)).astype(np.int64)
        held[:] = [(found, n, langs[first], runs[first])]
        return pa.RecordBatch.from_arrays([pa.array(names).take(pa.array(langs[first])), _strings(runs[first]), pa.array(found.view(np.int64)), pa.array(n)], ["lang", "run", "hash", "n"])

    held: list = []
    names: list[str] = []
    number: dict[str, int] = {}
    size = 0
    for batch in batches:
        own = batch.column(0).to_pylist()
        for x in own:
            if x not in number:
                number[x] = len(names)
                names.append(x)
        code, salts = np.array([number[x] for x in own]), _salts(names)
        for texts in tv.chunks(batch.column(1)):
            padded, starts, firsts = _runs(texts)
            lang = np.repeat(code[texts.first_row : texts.first_row + len(texts)], np.diff(firsts))
            found, first, n = np.unique(_hashes(padded, starts, salts[lang]), return_index=True, return_counts=True)
            runs = padded[starts[first][:, None] + np.arange(ORDER)]
            held.append((found, n, lang[first], runs))
            size += len(found)
            if size > RUNS_AT_ONCE:
                out = rows(held)
                size = len(held[0][0])
                if 2 * size > RUNS_AT_ONCE:
                    yield out
                    held, size = [], 0
    if held:
        yield rows(held)


def _discounted(n: str) -> Column:
    """What is taken off a count: the discount of 1, 2 or 3 and more."""
    return F.when(F.col(n) == 1, F.col("d1")).when(F.col(n) == 2, F.col("d2")).otherwise(F.col("d3"))


def _discounts(counts: DataFrame) -> DataFrame:
    """lang, d1, d2, d3 of modified Kneser-Ney, from how many runs occur once to four times; 0.5, 1 and 1.5 where one of these is 0."""
    times = counts.groupBy("lang").agg(*[F.count(F.when(F.col("n") == i, 1)).cast("double").alias(f"n{i}") for i in (1, 2, 3, 4)])
    full = (F.col("n1") > 0) & (F.col("n2") > 0) & (F.col("n3") > 0) & (F.col("n4") > 0)
    y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
    d = lambda i, other: F.when(full, F.greatest(F.lit(0.0), F.least(F.lit(float(i)), i - (i + 1) * y * F.col(f"n{i + 1}") / F.col(f"n{i}")))).otherwise(other)
    return times.select("lang", d(1, 0.5).alias("d1"), d(2, 1.0).alias("d2"), d(3, 1.5).alias("d3"))


def train(docs: DataFrame) -> DataFrame:
    """lang, run, hash, p: the probability of every run's last character after the ones before it, by modified Kneser-Ney.

    docs: lang, text (not null). All runs of all documents are counted; tasks add up theirs before the shuffle. A
    shorter run counts as often as different characters stand before it. The probability of a run is its discounted
    share in its context plus what the discounts of the context left over times the probability of the run
    without its first character; of one character, that is one over the language's different characters.
    """
    small_batches(docs.sparkSession)
    counted = docs.select("lang", "text").mapInArrow(_counter, "lang string, run string, hash long, n long")
    levels = [written(counted.groupBy("lang", "run", "hash").agg(F.sum("n").alias("n")), "runs")]
    for k in range(ORDER - 1, 0, -1):
        levels.append(written(levels[-1].groupBy("lang", F.substr("run", F.lit(2)).alias("run")).agg(F.count("*").alias("n")), f"runs-{k}"))
    below = None
    for k, counts in enumerate(reversed(levels), 1):
        rows = counts.join(broadcast_if_small(_discounts(counts)), "lang").withColumn("context", F.substr("run", F.lit(1), F.lit(k - 1)))
        contexts = rows.groupBy("lang", "context").agg(F.sum("n").alias("total"), F.sum(_discounted("n")).alias("left"), F.count("*").alias("different"))
        rows = rows.join(contexts, ["lang", "context"])
        lower = 1 / F.col("different")
        if k > 1:
            rows = rows.withColumn("rest", F.substr("run", F.lit(2))).join(below.select("lang", F.col("run").alias("rest"), F.col("p").alias("lower")), ["lang", "rest"])
            lower = F.col("lower")
        p = (F.col("n") - _discounted("n") + F.col("left") * lower) / F.col("total")
        below = rows.select("lang", "run", *(["hash"] if k == ORDER else []), p.alias("p"))
    return below


def _packer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, p = batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy().astype(np.float32)
        order = np.argsort(keys)
        yield pa.RecordBatch.from_arrays([pa.array([len(keys)], pa.int64()), pa.array([keys[order].tobytes()], pa.binary()), pa.array([np.log(p[order]).tobytes()], pa.binary())], ["n", "keys", "logs"])


def packed(model: DataFrame) -> DataFrame:
    """n, keys, logs: the model as arrays sorted by hash, RUNS_IN_ARRAY runs each at most (8-byte hashes, 4-byte log probabilities)."""
    spark = model.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", RUNS_IN_ARRAY)
    out = written(model.select("hash", "p").mapInArrow(_packer, "n long, keys binary, logs binary"), "model")
    small_batches(spark)
    return out


class SortedModel:
    """Log probabilities by hash: an array of sorted hashes, and where in it those of each beginning stand."""

    def __init__(self, arrays: list):
        keys = np.concatenate([np.frombuffer(x.keys, np.uint64) for x in arrays]) if arrays else np.zeros(0, np.uint64)
        logs = np.concatenate([np.frombuffer(x.logs, np.float32) for x in arrays]) if arrays else np.zeros(0, np.float32)
        order = np.argsort(keys, kind="stable")
        self.keys, self.logs = keys[order], logs[order]
        bits = max(8, len(keys).bit_length())
        self.shift = np.uint64(64 - bits)
        self.first = np.searchsorted(self.keys, np.arange(1 << bits, dtype=np.uint64) << self.shift).astype(np.int32)

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        """All hashes must be there."""
        at = self.first[(hashes >> self.shift).astype(np.int64)]
        left = np.flatnonzero(self.keys[at] != hashes)
        while len(left):
            at[left] += 1
            left = left[self.keys[at[left]] != hashes[left]]
        return self.logs[at]


def _chunk_runs(batch: pa.RecordBatch, text_at: int, lang_at: int) -> Iterator[tuple[tv.Texts, np.ndarray, np.ndarray]]:
    """Texts of a batch, the hashes of their runs and each document's first run."""
    langs = batch.column(lang_at).to_pylist()
    known = sorted(set(langs))
    salts = _salts(known)[[known.index(x) for x in langs]] if langs else np.zeros(0, np.uint64)
    for texts in tv.chunks(batch.column(text_at)):
        padded, starts, firsts = _runs(texts)
        yield texts, _hashes(padded, starts, np.repeat(salts[texts.first_row : texts.first_row + len(texts)], np.diff(firsts))), firsts


def _spoken(texts: tv.Texts) -> np.ndarray:
    """Words of each document that hold a letter, a digit or a character outside ASCII."""
    starts, ends, firsts = tv.word_bounds(texts)
    seen = np.concatenate([[0], np.cumsum(_SPOKEN[texts.data])])
    said = np.concatenate([[0], np.cumsum(seen[ends] > seen[starts])])
    return np.diff(said[firsts])


def _scorer(model, text_at: int, lang_at: int):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [np.zeros(0)]
            for texts, hashes, firsts in _chunk_runs(batch, text_at, lang_at):
                logs = model.value(hashes).astype(float)
                out.append(-np.add.reduceat(logs, firsts[:-1]) / np.maximum(1, _spoken(texts)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(out))], [*batch.schema.names, "log_perplexity"])

    return score


def _emitter(text_at: int, lang_at: int):
    """doc_id, row hash, words of the document, and each different run's hash and count."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts, hashes, firsts in _chunk_runs(batch, text_at, lang_at):
                said = np.maximum(1, _spoken(texts))
                for d in range(len(texts)):
                    found, n = np.unique(hashes[firsts[d] : firsts[d + 1]], return_counts=True)
                    row = texts.first_row + d
                    same = [pa.array([batch.column(i)[row].as_py()] * len(found), pa.int64()) for i in (0, 1)]
                    yield pa.RecordBatch.from_arrays([*same, pa.array(np.full(len(found), said[d])), pa.array(found.view(np.int64)), pa.array(n)], ["_id", "_row", "of", "hash", "n"])

    return emit


class _Held:
    """A broadcast model, put together once a worker."""

    def __init__(self, broadcast):
        self.broadcast = broadcast

    def value(self, hashes: np.ndarray) -> np.ndarray:
        return self.broadcast.value(hashes)


def with_perplexity(docs: DataFrame, model: DataFrame, model_bytes: int = MODEL_BYTES) -> DataFrame:
    """docs (doc_id, text, lang and more; text and lang not null) with log_perplexity: nats a word under the model of the language.

    All characters count; what is divided by are the words with a letter or digit (one at least), as signs between words
    would make a text look likelier.

    The model must have been counted over these documents, so that it knows each of their runs. Its arrays are
    broadcast if they have at most ``model_bytes``; else each document's different runs are joined to it by hash.
    """
    spark = docs.sparkSession
    small_batches(spark)
    schema = T.StructType([*docs.schema.fields, T.StructField("log_perplexity", T.DoubleType())])
    if model.count() * 12 <= model_bytes:
        held = _Held(spark.sparkContext.broadcast(SortedModel(packed(model).collect())))
        return docs.mapInArrow(_scorer(held, docs.columns.index("text"), docs.columns.index("lang")), schema)
    rows = docs.select(F.col("doc_id").cast("long").alias("_id"), F.xxhash64("lang", "text").alias("_row"), "text", "lang")
    runs = rows.dropDuplicates(["_id", "_row"]).mapInArrow(_emitter(2, 3), "_id long, _row long, of long, hash long, n long")
    logs = model.select("hash", F.log("p").cast("float").alias("log"), F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("part"))
    sums = runs.withColumn("part", F.pmod(F.col("_row"), F.lit(PARTS)).cast("int")).join(logs, ["hash", "part"]).groupBy("_id", "_row", "of").agg(F.sum(F.col("n") * F.col("log")).alias("sum"))
    out = docs.join(sums, F.col("doc_id").cast("long").eqNullSafe(F.col("_id")) & (F.xxhash64("lang", "text") == F.col("_row")))
    return out.withColumn("log_perplexity", -F.col("sum") / F.col("of")).select(*docs.columns, "log_perplexity")


def _repeated_words(words: np.ndarray) -> int:
    """Words in windows of three that occur twice or more."""
    if len(words) < 4:
        return 0
    _, ids = np.unique(words, return_inverse=True)
    windows = np.stack([ids[:-2], ids[1:-1], ids[2:]], 1).astype(np.int64)
    base = int(ids.max()) + 1
    if base < 1 << 21:
        keys = (windows[:, 0] * base + windows[:, 1]) * base + windows[:, 2]
        _, back, n = np.unique(keys, return_inverse=True, return_counts=True)
    else:
        _, back, n = np.unique(windows, axis=0, return_inverse=True, return_counts=True)
    twice = n[back.ravel()] > 1
    covered = np.zeros(len(words), bool)
    for j in range(3):
        covered[j : len(words) - 2 + j] |= twice
    return int(covered.sum())


def _duplicate_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    seen, n = set(), 0
    for line in text.split(b"\n"):
        if line.split():
            n += line in seen
            seen.add(line)
    return n


_COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _measurer(text_at: int):
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[np.ndarray] = []
            for texts in tv.chunks(batch.column(text_at)):
                hashes, firsts = tv.word_hashes(texts)
                lead = (texts.data & 0xC0) != 0x80
                sums = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[texts.offsets])  # noqa: B023, E731
                lines = [_duplicate_lines(texts.data[a:b].tobytes()) for a, b in zip(texts.offsets[:-1], texts.offsets[1:], strict=True)]
                repeats = [_repeated_words(hashes[a:b]) for a, b in zip(firsts[:-1], firsts[1:], strict=True)]
                out.append(np.stack([np.diff(firsts), sums(lead & ~tv.SPACE[texts.data]), sums(_SYMBOLS[texts.data]), lines, repeats], 1))
            whole = np.concatenate(out) if out else np.zeros((0, 5), np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(whole[:, j].astype(np.int64)) for j in range(5)]], [*batch.schema.names, *_COLUMNS])

    return measure


def quality_rules(docs: DataFrame, band: float = BAND, model_bytes: int = MODEL_BYTES) -> DataFrame:
    """docs (doc_id, lang and more, without text) with counts, perplexity and a verdict.

    Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long; see the contract of op4),
    log_perplexity (double, nats a word under the model of its language), low and high (the language's
    band), base_failed (boolean) and kept (boolean: the base rules hold and the perplexity is inside the
    band). The models and the quantiles that set the bands cover all documents; quantiles are Spark's
    approximate ones over documents that pass the base rules, and every language has a model and a band of
    its own, whatever its share; null is one language, with the empty string. The band is inclusive, so ties with
    it are kept. Null and empty texts have no word and fail. Columns of those names are replaced, text is dropped;
    rows stay as often as they are there; an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    rows = docs.drop(*_COLUMNS, "log_perplexity", "low", "high", "base_failed", "kept", "_lang")
    rows = rows.withColumn("_lang", F.col("lang")).withColumn("lang", F.coalesce("lang", F.lit(""))).withColumn("text", F.coalesce("text", F.lit("")))
    model = written(train(rows), "probabilities")
    scored = with_perplexity(rows, model, model_bytes)
    schema = T.StructType([*scored.schema.fields, *[T.StructField(c, T.LongType()) for c in _COLUMNS]])
    measured = scored.mapInArrow(_measurer(scored.columns.index("text")), schema).drop("text")
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    narrow = written(measured.withColumn("base_failed", failed), "measured")
    q = narrow.filter("not base_failed").groupBy("lang").agg(F.percentile_approx("log_perplexity", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)), 2000).alias("q"))
    low, middle, high = (F.get("q", F.lit(i)) for i in range(3))
    bands = q.select("lang", (middle - band * (middle - low)).alias("low"), (middle + band * (high - middle)).alias("high"))
    out = narrow.join(bands, "lang", "left").withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("log_perplexity").between(F.col("low"), F.col("high")), F.lit(True)))
    return out.withColumn("lang", F.col("_lang")).select(*[c for c in docs.columns if c in out.columns and c != "_lang"], *_COLUMNS, "log_perplexity", "low", "high", "base_failed", "kept")


def op4_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Base rules and perplexity verdict of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return quality_rules(docs).select("doc_id", *_COLUMNS, "base_failed", "kept", "log_perplexity")
