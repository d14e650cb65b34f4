"""Secrets, judged by how widely their values are owned over the whole corpus."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spans import SECRET_KINDS as KINDS
from .spans import entropy, free_spots, joined, secret_spans
from .store import broadcast_if_small, small_batches, table, written

#: A value that so many distinct owners hold is a copied example; fewer owners make it look live.
EXAMPLE_OWNERS = 3
#: A live-looking value has at least so many bits of entropy a character.
LEAST_ENTROPY = 2.5
#: Bare words that may be a known value: of these characters, so long, with a letter and a digit.
_BARE = re.compile(r"[A-Za-z0-9+/_.=-]{8,}")
_LETTER, _DIGIT = re.compile("[A-Za-z]"), re.compile("[0-9]")
#: A value may also be a part of a run: what stands between these, without outer dots and dashes.
_PART = re.compile(r"[^/=]+")

_SCHEMA = "doc_id long, owner string, row_hash long, n_assign long, n_access long, n_hex long, base_sha256 string, hits array<struct<kind:int,start:long,end:long,value:string,entropy:double>>"


def _bare_values(text: str, a: int, b: int) -> list[tuple[int, int]]:
    """A run, and its parts, where they may be a value: so long, with a letter and a digit."""
    found = {(a, b)}
    for m in _PART.finditer(text, a, b):
        start, end = m.span()
        found.add((start, end))
        while start < end and text[start] in "._-":
            start += 1
        while end > start and text[end - 1] in "._-":
            end -= 1
        found.add((start, end))
    return sorted((x, y) for x, y in found if y - x >= 8 and _LETTER.search(text, x, y) and _DIGIT.search(text, x, y))


def _finder():
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {c: [] for c in ("sha", "hits", *KINDS)}
            for text in batch.column(3).to_pylist():
                text = text or ""
                base = secret_spans(text)
                out["sha"].append(hashlib.sha256(joined(base, KINDS).encode()).hexdigest())
                for k, kind in enumerate(KINDS):
                    out[kind].append(sum(x[0] == k for x in base))
                bare = []
                if _DIGIT.search(text):
                    runs = free_spots([m.span() for m in _BARE.finditer(text) if _DIGIT.search(m[0]) and _LETTER.search(m[0])], base)
                    bare = [spot for a, b in runs for spot in _bare_values(text, a, b)]
                hits = base + [(-1, a, b, text[a:b]) for a, b in bare]
                # Values are compared by their hash, so that the corpus-wide tables hold no secrets.
                out["hits"].append([{"kind": k, "start": a, "end": b, "value": hashlib.sha256(v.encode()).hexdigest(), "entropy": entropy(v)} for k, a, b, v in hits])
            struct = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string()), ("entropy", pa.float64())]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *[pa.array(out[k], pa.int64()) for k in KINDS], pa.array(out["sha"], pa.string()), pa.array(out["hits"], struct)], ["doc_id", "owner", "row_hash", *[f"n_{k}" for k in KINDS], "base_sha256", "hits"])

    return find


def ownership(hits: DataFrame, example_owners: int = EXAMPLE_OWNERS, least_entropy: float = LEAST_ENTROPY) -> DataFrame:
    """What the corpus says of each value. hits: doc_id, owner, kind, value, entropy.

    Returns value, kind (the first listed one it was found as), n_repos, n_owners (distinct documents and
    owners that hold it, bare or not) and live (few owners and enough entropy). Values never found by a base
    pattern are left out. Each count is pre-aggregated by value and holder, so a value in a third of all rows
    is no single group.
    """
    by_owner = hits.groupBy("value", "owner").agg(F.min(F.when(F.col("kind") >= 0, F.col("kind"))).alias("kind"), F.max("entropy").alias("entropy"))
    owners = by_owner.groupBy("value").agg(F.min("kind").alias("kind"), F.max("entropy").alias("entropy"), F.count("*").alias("n_owners")).filter("kind is not null")
    repos = hits.select("value", "doc_id").distinct().groupBy("value").agg(F.count("*").alias("n_repos"))
    live = (F.col("n_owners") < example_owners) & (F.col("entropy") >= least_entropy)
    return owners.join(repos, "value").select("value", "kind", "n_repos", "n_owners", live.alias("live"))


def secrets(docs: DataFrame, owner: Column, example_owners: int = EXAMPLE_OWNERS, least_entropy: float = LEAST_ENTROPY) -> DataFrame:
    """Secrets in docs (doc_id, text) with the corpus's verdict on each.

    owner: who is behind a row (null is an owner of its own); the doc_id stands for the repository. Returns,
    for every row, doc_id, n_assign, n_access, n_hex (long, base spans), base_sha256, n_live, n_example (long:
    spans whose value looks live, or is a widely copied example or too even to be a secret) and spans: array
    of (start, kind, end, added, live, n_repos, n_owners), by start and then kind; offsets are code points,
    ends exclusive. Base spans are those of spans.secret_spans. Added spans are bare words, or parts of them between
    slashes and equals signs without outer dots and dashes, equal to a value that looks live and that a base pattern
    found elsewhere (of one inside another the longer); they take that span's kind. Null and empty texts
    have no span; rows that repeat stay; rows of one id but other texts are kept apart; an empty table gives no
    rows; other columns are ignored.
    """
    small_batches(docs.sparkSession)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), owner.cast("string").alias("owner"), F.xxhash64("text").alias("row_hash"), "text")
    found = written(source.mapInArrow(_finder(), _SCHEMA), "secrets")
    hits = found.select("doc_id", "owner", "row_hash", F.explode("hits").alias("hit")).select("doc_id", "owner", "row_hash", "hit.*")
    known = written(ownership(hits, example_owners, least_entropy), "ownership").withColumnRenamed("kind", "known_kind")
    judged = hits.join(broadcast_if_small(known), "value").filter("kind >= 0 or live").dropDuplicates(["doc_id", "row_hash", "start", "end", "kind"])
    span = F.struct("start", F.when(F.col("kind") < 0, F.col("known_kind")).otherwise(F.col("kind")).alias("kind"), "end", (F.col("kind") < 0).alias("added"), "live", "n_repos", "n_owners")
    by_row = judged.groupBy(F.col("doc_id").alias("_id"), F.col("row_hash").alias("_hash")).agg(F.array_sort(F.collect_list(span)).alias("all"))
    inside = lambda x, y: y["added"] & (y["start"] <= x["start"]) & (y["end"] >= x["end"]) & (y["end"] - y["start"] > x["end"] - x["start"])
    by_row = by_row.select("_id", "_hash", F.filter("all", lambda x: ~x["added"] | ~F.exists("all", lambda y: inside(x, y))).alias("spans"))
    out = found.join(by_row, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("row_hash") == F.col("_hash")), "left")
    count = lambda live: F.coalesce(F.size(F.filter("spans", lambda x: x["live"] == live)), F.lit(0)).cast("long")
    spans = F.coalesce(F.col("spans"), F.array().cast("array<struct<start:long,kind:int,end:long,added:boolean,live:boolean,n_repos:long,n_owners:long>>"))
    return out.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", count(True).alias("n_live"), count(False).alias("n_example"), spans.alias("spans"))


def op10_secrets(spark, sf_dir: str) -> DataFrame:
    """Secrets of every document, owned by its source, the spans as text."""
    found = secrets(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), F.col("source"))
    names = F.array(*map(F.lit, KINDS))
    text = F.array_join(F.transform("spans", lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")
    return found.withColumn("spans", text)
