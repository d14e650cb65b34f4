"""Near-duplicate documents: MinHash with banding, verified links, connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .components import components
from .store import broadcast_if_small, forget, small_batches, table, written

#: 32 bands of 4 minima: a pair of similarity 0.8 shares no band with a probability of 5e-8.
BANDS, ROWS = 32, 4
#: What one side of an exact comparison inside a task holds at most: bytes of shingles on average, and documents.
BLOCK_BYTES, BLOCK_ROWS = 8 << 20, 4096

_SKETCH = "id long, n_shingles long, h1 long, h2 long, bands array<long>"
_SETS = "id long, signature binary, shingles binary"


def _fixed(values: np.ndarray) -> pa.Array:
    """One binary value per row of a two-dimensional array."""
    return pa.array([row.tobytes() for row in np.ascontiguousarray(values)], pa.binary())


def _sets(texts: tv.Texts, k: int) -> tuple[np.ndarray, np.ndarray]:
    words, firsts = tv.word_hashes(texts, lower=True)
    return tv.distinct(*tv.shingles(words, firsts, k))


def _sketcher(k: int):
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in tv.chunks(batch.column(1)):
                values, firsts = _sets(texts, k)
                minima = tv.minhash(values, firsts, BANDS * ROWS).astype(np.uint64).reshape(len(texts), BANDS, ROWS)
                band = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), minima.shape[:2])
                for j in range(ROWS):
                    band = tv.mix(band * np.uint64(0x9E3779B97F4A7C15) + minima[:, :, j] + np.uint64(j + 1))
                h1 = tv.per_document(np.add, tv.mix(values), firsts, 0)
                h2 = tv.per_document(np.add, tv.mix(values ^ np.uint64(0x5851F42D4C957F2D)), firsts, 0)
                bands = pa.ListArray.from_arrays(pa.array(np.arange(0, band.size + 1, BANDS, dtype=np.int32)), pa.array(band.ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0)[texts.first_row : texts.first_row + len(texts)], pa.array(np.diff(firsts)), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), bands], ["id", "n_shingles", "h1", "h2", "bands"])

    return sketch


def _set_maker(k: int):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in tv.chunks(batch.column(1)):
                values, firsts = _sets(texts, k)
                minima = tv.minhash(values, firsts, BANDS * ROWS).astype(np.uint16)
                sets = pa.array([values[a:b].tobytes() for a, b in zip(firsts[:-1], firsts[1:], strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0)[texts.first_row : texts.first_row + len(texts)], _fixed(minima), sets], ["id", "signature", "shingles"])

    return make


def _similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Jaccard similarity of two ascending arrays against a percentage, in whole numbers."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (len(a) + len(b) - common)


def _least_agreement(percent: int) -> int:
    """Minima that a pair must share to be worth the full comparison: 6.5 deviations below what is expected."""
    p, n = percent / 100, BANDS * ROWS
    return int(n * p - 6.5 * np.sqrt(n * p * (1 - p)))


def _verifier(percent: int):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = _least_agreement(percent)
        for batch in batches:
            a, b, sa, sb, xa, xb = batch.columns
            keep = []
            for i in range(batch.num_rows):
                agree = (np.frombuffer(sa[i].as_py(), np.uint16) == np.frombuffer(sb[i].as_py(), np.uint16)).sum()
                if agree >= least and _similar(np.frombuffer(xa[i].as_py(), np.uint64), np.frombuffer(xb[i].as_py(), np.uint64), percent):
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([a.take(pa.array(keep, pa.int64())), b.take(pa.array(keep, pa.int64()))], ["u", "v"])

    return verify


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) whose signatures and then whole sets agree."""
    own = sets.select(F.col("id").alias("u"), F.col("signature").alias("su"), F.col("shingles").alias("xu"))
    other = sets.select(F.col("id").alias("v"), F.col("signature").alias("sv"), F.col("shingles").alias("xv"))
    rows = pairs.join(own, "u").join(other, "v").select("u", "v", "su", "sv", "xu", "xv")
    return rows.mapInArrow(_verifier(percent), "u long, v long")


def _block_links(percent: int):
    """Compares two blocks of a bucket across components; returns links (of components) that join them, no more than are needed."""

    def links(key: tuple, rows: pa.Table) -> pa.Table:
        least = _least_agreement(percent)
        low, high = key[1].as_py(), key[2].as_py()
        comps, block = (rows.column(c).to_numpy() for c in ("component", "block"))
        signs = np.stack([np.frombuffer(x.as_py(), np.uint16) for x in rows.column("signature")])
        sets = [np.frombuffer(x.as_py(), np.uint64) for x in rows.column("shingles")]
        parent = {c: c for c in comps.tolist()}

        def root(c):
            while parent[c] != c:
                c = parent[c]
            return c

        found = []
        right = np.flatnonzero(block == high)
        for i in np.flatnonzero(block == low):
            agree = (signs[right] == signs[i]).sum(1)
            near = agree >= least
            for j in right[near][np.argsort(-agree[near], kind="stable")]:  # the likeliest first, as one link ends the rest
                a, b = root(comps[i].item()), root(comps[j].item())
                if a != b and _similar(sets[i], sets[j], percent):
                    parent[max(a, b)] = min(a, b)
                    found.append((max(a, b), min(a, b)))
        return pa.table({"u": pa.array([x[0] for x in found], pa.int64()), "v": pa.array([x[1] for x in found], pa.int64())})

    return links


def _open_blocks(rows: DataFrame) -> DataFrame:
    """Buckets that hold several components, dealt into pairs of blocks: key, low, high, block, component, id.

    rows: key, rep, n (shingles), component. Buckets of equal members are taken once. The members of a bucket's largest component
    (main) are paired with the others only, not among themselves; a block has BLOCK_BYTES and BLOCK_ROWS at most, on average.
    """
    by_component = rows.groupBy("key", "component").agg(F.count("*").alias("n_rows"), F.sum("n").alias("n"), F.bit_xor(F.xxhash64("rep")).alias("who"))
    buckets = by_component.groupBy("key").agg(F.max(F.struct("n_rows", "component", "n")).alias("main"), F.sum("n_rows").alias("rows"), F.sum("n").alias("all"), F.bit_xor("who").alias("who"), F.count("*").alias("of")).filter("of > 1")
    buckets = buckets.groupBy("rows", "all", "who").agg(F.min_by(F.struct("key", "main"), "key").alias("first")).select("first.key", "first.main", "rows", "all")
    blocks = lambda n, count: F.greatest(F.ceil(n * 8 / BLOCK_BYTES), F.ceil(count / BLOCK_ROWS)).cast("int")
    buckets = buckets.select("key", F.col("main.component").alias("main"), blocks(F.col("main.n"), F.col("main.n_rows")).alias("mains"), blocks(F.col("all") - F.col("main.n"), F.col("rows") - F.col("main.n_rows")).alias("minors"))
    dealt = rows.join(buckets, "key").withColumn("in_main", F.col("component") == F.col("main"))
    place = F.xxhash64("rep")
    block = F.when(F.col("in_main"), F.col("minors") + F.pmod(place, F.col("mains"))).otherwise(F.pmod(place, F.col("minors"))).cast("int")
    last = F.when(F.col("in_main"), F.col("minors")).otherwise(F.col("minors") + F.col("mains")) - 1
    dealt = dealt.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), last)))
    return dealt.select("key", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "component", F.col("rep").alias("id"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """Groups of documents that are linked by near-duplicate pairs.

    A document's set holds its distinct runs of ``words`` words (A-Z lower-cased); a text of fewer words is
    one run. Two documents are linked if 100 * intersection >= percent * union.

    1. Every document gets the hash of its whole set and its band hashes; documents of equal sets collapse
       into their least id, so a group of copies of any size is one row from here on.
    2. Each band bucket proposes its least member to all others; a pair is proposed once however many bands it
       shares, checked by signature and then on the full sets. Components follow by large-star and small-star.
    3. What is left are pairs across components of a bucket that don't touch its leader. They are compared
       inside tasks, block against block, where signatures pick the pairs whose full sets are compared; no
       pairs are written, only links that join components. Those links are components' in turn.
    So every pair that shares a band is either checked or already in one component: no link between components
    is lost. A bucket of n members, m of them outside its largest component, sends each member to about
    m / BLOCK_ROWS blocks (BLOCK_BYTES for long texts), one where m is below that.

    Returns id_col, n_shingles (long, size of the set), component_id (long, the least id reachable, itself
    included), kept (boolean: it is that least id), one row for every input row. Null and empty texts and
    texts without words have n_shingles 0, their own component and are kept. Rows that repeat an id and text
    share a component; of rows of one id and several texts each has the component of its own text, and texts
    whose copies have the same least id count as linked. Rows with a null id link nothing and have a null component
    and kept true. An empty table gives no rows. Other columns are ignored.
    """
    small_batches(docs.sparkSession)
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    sketch = written(source.mapInArrow(_sketcher(words), _SKETCH), "sketch")
    full = sketch.filter("n_shingles > 0 and id is not null")
    groups = full.groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.first("n_shingles").cast("int").alias("n"), F.min_by("bands", "id").alias("bands"))
    groups = written(groups, "groups")

    banded = groups.select("rep", "n", F.explode("bands").alias("key"))
    leaders = banded.groupBy("key").agg(F.min("rep").alias("leader"), F.max("rep").alias("last")).filter("leader < last").select("key", "leader")
    buckets = written(banded.join(leaders, "key"), "buckets")
    members = buckets.select(F.col("rep").alias("id")).distinct()
    sets = written(source.join(broadcast_if_small(members), "id", "left_semi").mapInArrow(_set_maker(words), _SETS), "sets")

    pairs = buckets.filter("rep > leader").select(F.col("rep").alias("u"), F.col("leader").alias("v")).distinct()
    links = written(_verified(pairs, sets, percent), "links")
    comps = components(links)
    rows = buckets.filter("rep > leader").select("key", "rep", "n").join(comps.withColumnRenamed("node", "rep"), "rep", "left")
    rows = written(rows.withColumn("component", F.coalesce("component", "rep")), "members")
    forget(links, buckets)
    blocks = _open_blocks(rows)
    more = written(blocks.join(sets, "id").groupBy("key", "low", "high").applyInArrow(_block_links(percent), "u long, v long"), "links")
    forget(rows, sets)
    merged = components(more).select(F.col("node").alias("component"), F.col("component").alias("_to"))
    # A component of one document has no row in comps; it may be merged all the same.
    groups = groups.join(comps.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    groups = groups.join(broadcast_if_small(merged), "component", "left").withColumn("component_id", F.coalesce("_to", "component"))
    moved = groups.filter("copies > 1 or component_id < rep").select("h1", "h2", "component_id")
    out = sketch.drop("bands").join(moved, ["h1", "h2"], "left").withColumn("component_id", F.when(F.col("n_shingles") > 0, F.coalesce("component_id", "id")).otherwise(F.col("id")))
    return out.select(F.col("id").alias(id_col), "n_shingles", F.when(F.col("id").isNotNull(), F.col("component_id")).alias("component_id"), F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def op5_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents, on runs of four words at similarity 0.8."""
    return near_duplicates(table(spark, sf_dir, "documents"), words=4, percent=80)


def without_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """The document of least id of each group, with all columns of docs. Texts without words all stay."""
    gone = near_duplicates(docs, id_col, text_col, words, percent).filter("not kept").select(id_col)
    return docs.join(broadcast_if_small(written(gone, "duplicates")), id_col, "left_anti").select(docs.columns)
