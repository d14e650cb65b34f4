"""Personal data by bootstrapped contextual extraction.

Base patterns give seed entities. The words around them are lexical patterns; Spark scores the graph of
patterns and instances in rounds, and patterns of high confidence mark identifiers that no base pattern knows.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spans import PRIVATE_KINDS as KINDS
from .spans import free_spots, joined, private_spans
from .store import broadcast_if_small, small_batches, table, written

#: A pattern needs the weight of so many distinct instances of a kind ...
LEAST_SUPPORT = 3
#: ... and marks unseen identifiers from this score on.
LEAST_CONFIDENCE = 0.7
#: Rounds in which patterns and instances score each other.
ROUNDS = 3
#: What may be an identifier: a word or a run of digit groups, without outer punctuation, of so many characters at
#: least, with an @ or so many digits.
CANDIDATE_CHARS, CANDIDATE_DIGITS = 6, 3

_MARK = re.compile("[0-9@]")
_DIGITS = re.compile("[0-9]")
_WORD = re.compile(r"\S+")
_LETTER = re.compile(r"[^\W\d_]")
#: Digit groups joined by a space, hyphen or dot or by brackets; and groups of four behind a country and check digits.
_RUN = re.compile(r"[0-9]+(?:(?:[)\]][\x20.-]?|[\x20.-]?[(\[]|[\x20.-])[0-9]+)+")
_ACCOUNT = re.compile(r"(?<![^\W_])[A-Z]{2}[0-9]{2}(?:[\x20-][A-Z0-9]{4})+(?:[\x20-][A-Z0-9]{1,3})?(?![^\W_])")
_PAIRS = {"(": ")", "[": "]", "{": "}", "<": ">"}
_HIT = "array<struct<kind:int,start:long,end:long,instance:string,patterns:array<string>>>"
_SCHEMA = f"doc_id long, row_hash long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, hits {_HIT}"


def _word_around(text: str, a: int, b: int, free: int) -> tuple[int, int]:
    """The bounds widened to whole words, not before ``free``."""
    while a > free and not text[a - 1].isspace():
        a -= 1
    while b < len(text) and not text[b].isspace():
        b += 1
    return a, b


def _bare(text: str, a: int, b: int) -> tuple[int, int]:
    """The bounds without outer punctuation; a bracket whose partner is inside stays."""
    while a < b and text[a] in "([{<\"'" and (text[a] not in _PAIRS or _PAIRS[text[a]] not in text[a : b - 1]):
        a += 1
    while b > a and text[b - 1] in ".,;:!?)]}>\"'":
        b -= 1
    return a, b


def _is_candidate(text: str, a: int, b: int) -> bool:
    return b - a >= CANDIDATE_CHARS and ("@" in text[a:b] or len(_DIGITS.findall(text, a, b)) >= CANDIDATE_DIGITS)


def _candidates(text: str) -> list[tuple[int, int]]:
    """Single words, ascending and disjoint."""
    found, free = [], 0
    for m in _MARK.finditer(text):
        if m.start() < free:
            continue
        a, b = _word_around(text, m.start(), m.start(), free)
        free = b
        while a < b and text[a] in "([{<\"'":
            a += 1
        while b > a and text[b - 1] in ".,;:!?)]}>\"'":
            b -= 1
        if _is_candidate(text, a, b):
            found.append((a, b))
    return found


def _runs(text: str) -> list[tuple[int, int]]:
    """Identifiers of several words, ascending and disjoint: runs of digit groups, and accounts with letters."""
    found, free = [], 0
    for m in sorted([*_RUN.finditer(text), *_ACCOUNT.finditer(text)], key=lambda m: (m.start(), -m.end())):
        if m.start() < free:
            continue
        a, b = _word_around(text, m.start(), m.end(), free)
        free = b
        a, b = _bare(text, a, b)
        if any(c.isspace() for c in text[a:b]) and _is_candidate(text, a, b):
            found.append((a, b))
    return found


def _instance(value: str) -> str:
    """What identifies a run: its digits, or all of it where it has letters."""
    return value.lower() if _LETTER.search(value) else "".join(_DIGITS.findall(value))


def _hashed(instance: str) -> str:
    return hashlib.sha256(instance.encode()).hexdigest()[:32]


def _word(word: str) -> str:
    """A word of a context: any case, digits alike; a long one by its hash."""
    word = _DIGITS.sub("0", word.lower())
    return word if len(word) <= 40 else _hashed(word)


class _Words:
    """The words of a text, whole, to find those around a span."""

    def __init__(self, text: str):
        self.text, spans = text, [m.span() for m in _WORD.finditer(text)]
        self.starts, self.ends = [a for a, _ in spans], [b for _, b in spans]

    def patterns(self, a: int, b: int) -> list[str]:
        """The two words before a span, and the word on either side of it; what touches the span counts as a word."""
        i = bisect.bisect_left(self.starts, a)
        left = [self.text[self.starts[j] : min(a, self.ends[j])] for j in range(max(0, i - 2), i)]
        j = bisect.bisect_right(self.ends, b)
        right = self.text[max(b, self.starts[j]) : self.ends[j]] if j < len(self.ends) else None
        out = []
        if len(left) == 2:
            out.append("before " + " ".join(map(_word, left)))
        if left and right:
            out.append(f"between {_word(left[-1])} {_word(right)}")
        return out


def _finder():
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {c: [] for c in ("sha", "hits", *KINDS)}
            for text in batch.column(2).to_pylist():
                text = text or ""
                base = private_spans(text)
                out["sha"].append(hashlib.sha256(joined(base, KINDS).encode()).hexdigest())
                for k, kind in enumerate(KINDS):
                    out[kind].append(sum(x[0] == k for x in base))
                hits = base + [(-1, a, b, text[a:b].lower()) for a, b in free_spots(_candidates(text), base)]
                hits += [(-1, a, b, _instance(text[a:b])) for a, b in free_spots(_runs(text), base)]
                words = _Words(text) if hits else None
                out["hits"].append([{"kind": k, "start": a, "end": b, "instance": _hashed(value), "patterns": words.patterns(a, b)} for k, a, b, value in hits])
            struct = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("instance", pa.string()), ("patterns", pa.list_(pa.string()))]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(out[k], pa.int64()) for k in KINDS], pa.array(out["sha"], pa.string()), pa.array(out["hits"], struct)], ["doc_id", "row_hash", *[f"n_{k}" for k in KINDS], "base_sha256", "hits"])

    return find


def _noisy_or(p: Column) -> Column:
    return 1 - F.exp(F.sum(F.log(1 - F.least(p, F.lit(0.999999)))))


def score_patterns(edges: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Confidence of patterns. edges: pattern, instance, kind (-1: not known), repeats allowed.

    In each round a pattern's score for a kind is the weight of its distinct instances of that kind over their
    number plus one, if that weight reaches LEAST_SUPPORT; an unknown instance's weight is the noisy-or of its
    patterns' scores. Known instances weigh 1 for their kind. Returns pattern, kind, confidence.
    """
    edges = written(edges.filter("pattern is not null and instance is not null").groupBy("pattern", "instance").agg(F.max("kind").alias("kind")), "edges")
    totals = edges.groupBy("pattern").agg(F.count("*").alias("n"))
    known = edges.filter("kind >= 0").groupBy("pattern", "kind").agg(F.count("*").cast("double").alias("weight"))
    # Patterns without any known instance can only be reached through candidates they share with others.
    unknown = edges.filter("kind < 0").select("pattern", "instance")
    weight, scores = known, None
    for i in range(rounds):
        scores = weight.join(totals, "pattern").filter(F.col("weight") >= LEAST_SUPPORT).select("pattern", "kind", (F.col("weight") / (F.col("n") + 1)).alias("confidence"))
        scores = written(scores, "patterns")
        if i + 1 < rounds:
            guessed = unknown.join(broadcast_if_small(scores), "pattern").groupBy("instance", "kind").agg(_noisy_or(F.col("confidence")).alias("w"))
            more = unknown.join(guessed, "instance").groupBy("pattern", "kind").agg(F.sum("w").alias("weight"))
            weight = known.union(more).groupBy("pattern", "kind").agg(F.sum("weight").alias("weight"))
    return scores


def private_data(docs: DataFrame, least_confidence: float = LEAST_CONFIDENCE) -> DataFrame:
    """Personal data in docs (doc_id, text).

    Returns, for every row, doc_id, n_email, n_ip, n_card, n_phone (long, base spans), base_sha256 (of the base
    spans), n_added (long) and spans: array of (kind, start, end, added), by kind as listed and then start;
    offsets are code points, ends exclusive. Base spans are those of spans.private_spans. Added spans are words
    and runs of digit groups like identifiers that overlap no base span (of a run and its words that are both
    claimed, the run) and stand in a context whose confidence for the kind is at least
    ``least_confidence``; if several contexts or kinds claim a span, the most confident wins, then the first
    kind. Null and empty texts have no span. Rows that repeat stay; rows of one id but other texts are kept
    apart. An empty table gives no rows; other columns are ignored.
    """
    small_batches(docs.sparkSession)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row_hash"), "text")
    found = written(source.mapInArrow(_finder(), _SCHEMA), "private")
    hit = found.select("doc_id", "row_hash", F.explode("hits").alias("hit")).select("doc_id", "row_hash", "hit.*").withColumn("pattern", F.explode("patterns")).drop("patterns")
    sure = score_patterns(hit.select("pattern", "instance", "kind")).filter(F.col("confidence") >= least_confidence)
    claims = hit.filter("kind < 0").drop("kind", "instance").join(broadcast_if_small(sure), "pattern")
    best = claims.groupBy("doc_id", "row_hash", "start", "end").agg(F.max(F.struct("confidence", (-F.col("kind")).alias("minus"))).alias("best"))
    added = best.groupBy(F.col("doc_id").alias("_id"), F.col("row_hash").alias("_hash")).agg(F.collect_list(F.struct((-F.col("best.minus")).alias("kind"), "start", "end", F.lit(True).alias("added"))).alias("more"))
    whole = lambda x: ~F.exists("more", lambda y: (y["start"] <= x["start"]) & (y["end"] >= x["end"]) & (y["end"] - y["start"] > x["end"] - x["start"]))
    added = added.withColumn("more", F.filter("more", whole))
    joined_rows = found.join(added, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("row_hash") == F.col("_hash")), "left")
    base = F.transform(F.filter("hits", lambda x: x["kind"] >= 0), lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"), F.lit(False).alias("added")))
    spans = F.array_sort(F.concat(base, F.coalesce(F.col("more"), F.array().cast("array<struct<kind:int,start:long,end:long,added:boolean>>"))))
    return joined_rows.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", F.coalesce(F.size("more"), F.lit(0)).cast("long").alias("n_added"), spans.alias("spans"))


def op3_private_data(spark, sf_dir: str) -> DataFrame:
    """Personal data of every document, the spans as text."""
    found = private_data(table(spark, sf_dir, "documents").select("doc_id", "text"))
    names = F.array(*map(F.lit, KINDS))
    text = F.array_join(F.transform("spans", lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")
    return found.withColumn("spans", text)
