"""Benchmark decontamination: size-partitioned MinHash containment search."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .store import broadcast_if_small, small_batches, table, written

#: Shingles of test items that one pass over the documents holds in a task (8 bytes each, some three times over).
SHINGLES_PER_BLOCK = 2_000_000
#: Passes over the documents at most; more items than they hold meet the documents in joins, with the same result.
MOST_PASSES = 4

_HITS = "doc_id long, item_id long, n_matched long, n_item long, containment double"


def minima_for(size: int, percent: int) -> int:
    """Probes for items of up to ``size`` shingles: one more than may be missing, so that no item is missed."""
    return max(1, size - math.ceil(size * percent / 100) + 1)


def _item_sets(k: int):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in tv.chunks(batch.column(1)):
                values, firsts = tv.distinct(*tv.shingles(*tv.word_hashes(texts, lower=True), k))
                sets = pa.array([values[a:b].tobytes() for a, b in zip(firsts[:-1], firsts[1:], strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0)[texts.first_row : texts.first_row + len(texts)], pa.array(np.diff(firsts)), sets], ["item_id", "n_item", "shingles"])

    return make


def _probes(values: np.ndarray, percent: int) -> np.ndarray:
    """The probed minima of one item: the least values of one hash function, as many as its size class asks for."""
    n = minima_for(1 << int(len(values) - 1).bit_length(), percent)
    order = np.argsort(tv.mix(values * np.uint64(0xA24BAED4963EE407)), kind="stable")
    return values[order[:n]]


class _Index:
    """A block of items: its probed minima, and its shingles with the items that hold them."""

    def __init__(self, items: list, percent: int):
        self.ids = np.array([x.item_id for x in items], np.int64)
        self.sizes = np.array([x.n_item for x in items], np.int64)
        sets = [np.frombuffer(x.shingles, np.uint64) for x in items]
        probes = [_probes(own, percent) for own in sets]
        self.probes = np.unique(np.concatenate(probes)) if probes else np.zeros(0, np.uint64)
        flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(flat, kind="stable")
        self.flat, self.owner = flat[order], owner[order]


def _searcher(index: _Index, k: int, percent: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        probes, every = tv.Lookup(index.probes), tv.Lookup(np.unique(index.flat))
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            out: list[tuple] = []
            for texts in tv.chunks(batch.column(1)):
                values, firsts = tv.shingles(*tv.word_hashes(texts, lower=True), k)
                hit, _ = probes.hits(values)
                docs = np.unique(np.searchsorted(firsts, hit, side="right") - 1)
                for d in docs:
                    own = values[firsts[d] : firsts[d + 1]]
                    own = np.unique(own[every.hits(own)[0]])
                    left, right = np.searchsorted(index.flat, own, "left"), np.searchsorted(index.flat, own, "right")
                    owners = index.owner[np.concatenate([np.arange(a, b) for a, b in zip(left, right, strict=True)])]
                    items, matched = np.unique(owners, return_counts=True)
                    size = index.sizes[items]
                    for i, n, m in zip(items, matched, size, strict=True):
                        if 100 * int(n) >= percent * int(m):
                            out.append((int(ids[texts.first_row + d]), int(index.ids[i]), int(n), int(m), int(n) / int(m)))
            columns = list(zip(*out, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 4 + [pa.float64()], strict=True)], ["doc_id", "item_id", "n_matched", "n_item", "containment"])

    return search


def _distinct_shingles(k: int):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in tv.chunks(batch.column(2)):
                values, firsts = tv.distinct(*tv.shingles(*tv.word_hashes(texts, lower=True), k))
                rows = pa.array(texts.first_row + np.repeat(np.arange(len(texts)), np.diff(firsts)))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(values.view(np.int64))], ["doc_id", "row", "shingle"])

    return make


def _item_rows(percent: int):
    """item_id, n_item, shingle and whether it is probed, from items' sets."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                values = np.frombuffer(batch.column(2)[i].as_py(), np.uint64)
                probed = np.isin(values, _probes(values, percent))
                same = [pa.array(np.full(len(values), batch.column(j)[i].as_py())) for j in (0, 1)]
                yield pa.RecordBatch.from_arrays([*same, pa.array(values.view(np.int64)), pa.array(probed)], ["item_id", "n_item", "shingle", "probed"])

    return make


def _joined(texts: DataFrame, sets: DataFrame, words: int, percent: int) -> DataFrame:
    """Candidates by a join on probed minima, verified by a join on all shingles of the pairs."""
    source = texts.select("doc_id", F.xxhash64("text").alias("row"), "text")
    held = written(source.mapInArrow(_distinct_shingles(words), "doc_id long, row long, shingle long"), "shingles")
    rows = written(sets.mapInArrow(_item_rows(percent), "item_id long, n_item long, shingle long, probed boolean"), "item-shingles")
    pairs = held.join(rows.filter("probed").select("item_id", "shingle"), "shingle").select("doc_id", "row", "item_id").distinct()
    shared = pairs.join(held.distinct(), ["doc_id", "row"]).join(rows.drop("probed").distinct(), ["item_id", "shingle"])
    counts = shared.groupBy("doc_id", "row", "item_id", "n_item").agg(F.count("*").alias("n_matched")).filter(100 * F.col("n_matched") >= percent * F.col("n_item"))
    return counts.select("doc_id", "item_id", "n_matched", "n_item", (F.col("n_matched") / F.col("n_item")).alias("containment"))


def contained_items(docs: DataFrame, items: DataFrame, words: int = 5, percent: int = 80, per_block: int = SHINGLES_PER_BLOCK, most_passes: int = MOST_PASSES) -> DataFrame:
    """Which documents contain which test items.

    docs: doc_id, text; items: item_id, text. An item's shingles are its distinct runs of ``words`` words
    (A-Z lower-cased; a shorter text is one run, and then only a document that is that run as a whole holds
    it). A document contains an item if 100 * shared shingles >= percent * the item's shingles.

    Items are partitioned by size; the partition sets how many minima of an item are probed, always more than a
    document may lack, so no item is missed. A document that holds a probed minimum is a candidate, and candidates are
    verified by their exact shared shingles. Items are dealt into blocks of about ``per_block`` shingles by their
    number; each block is one pass over the documents, which are not shuffled. Where that would take more than
    ``most_passes``, or one item is more than a block, documents and items meet in joins instead; nothing then reaches
    the driver.

    Returns doc_id, item_id, n_matched, n_item (long), containment (double), distinct rows, one for each pair
    unless ids repeat with other texts. Null, empty and word-less texts match nothing, nor do rows with a null id.
    Empty tables give no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    source = items.select(F.col("item_id").cast("long"), "text").filter("item_id is not null")
    sets = written(source.mapInArrow(_item_sets(words), "item_id long, n_item long, shingles binary").filter("n_item > 0"), "items")
    total, largest = sets.agg(F.sum("n_item"), F.max("n_item")).first()
    blocks = max(1, math.ceil((total or 0) / per_block))
    texts = docs.select(F.col("doc_id").cast("long"), "text").filter("doc_id is not null")
    if blocks > most_passes or (largest or 0) > per_block:
        return _joined(texts, sets, words, percent).distinct()
    found = []
    for b in range(blocks):
        own = sets.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b) if blocks > 1 else sets
        found.append(texts.mapInArrow(_searcher(_Index(own.collect(), percent), words, percent), _HITS))
    return reduce(DataFrame.union, found).distinct()


def decontaminate(docs: DataFrame, items: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The documents that contain no test item, with all their columns; rows with a null doc_id stay."""
    bad = contained_items(docs, items, words, percent).select("doc_id").distinct()
    return docs.join(broadcast_if_small(written(bad, "contaminated")), "doc_id", "left_anti").select(docs.columns)


def op7_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    """All pairs of a document and a test item that it contains, on runs of five words at 0.8."""
    return contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: Words, as arrays of lower-cased strings, for DuckDB.
_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"
_SHINGLED = "CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END"

OP7_SQL = f"""
WITH d AS (SELECT doc_id, unnest({_SHINGLED}) AS s FROM (SELECT doc_id, {_WORDS} AS w FROM documents)),
     i AS (SELECT item_id, n_item, unnest(x) AS s FROM (SELECT item_id, {_SHINGLED} AS x, len(x) AS n_item FROM (SELECT item_id, {_WORDS} AS w FROM benchmark)))
SELECT doc_id, item_id, count(*) AS n_matched, n_item, count(*) / n_item::DOUBLE AS containment
FROM d JOIN i USING (s) GROUP BY doc_id, item_id, n_item HAVING 100 * count(*) >= 80 * n_item
"""
