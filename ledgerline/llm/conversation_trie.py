"""A prefix trie over conversations, by smallest-member ownership.

A node is a distinct sequence of first turns. It is owned by its smallest member. The smallest member of a node is
that of every deeper node on its own path, so what a conversation owns is a suffix of its path, which is known by its
first depth. Sums over a subtree are then sums over the members of its top: each member brings the words from the top
to its end, less those of the nodes that it owns, and one if the node at its end is its own and has no child.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .mixing import word_count
from .store import forget, table, written

#: A conversation takes its first turns from the first of so many, and fewer than so many of them.
FAMILY, TAKEN = 20, 4
#: Members of a node are dealt over so many parts where the smallest is sought, so a node of many members is no hot task.
PARTS = 32
#: Depth and two hashes that stand for a sequence of turns; those of the sequence one shorter.
NODE, ABOVE = ["depth", "key1", "key2"], ["up1", "up2"]
_LOW = 0xFFFFFFFF
_SUMS = ["s0", "s1", "s2", "s3"]


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, block, place (from 0), digest and words of every turn, in the order of turn (null first).

    Rows of one turn number come in the order of the hash of role and text; rows that repeat in full count each.
    Null roles and texts are empty; rows without conv_id are left out. Turns are sorted over all partitions and
    counted within a partition (block), so a conversation of very many turns is numbered by many tasks.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    digest = F.unhex(F.substring(F.sha2(F.concat(F.sha2(F.coalesce(F.col("role"), F.lit("")), 256), text), 256), 1, 32))
    rows = conversations.filter("conv_id is not null").select(F.col("conv_id").cast("long"), "turn", digest.alias("digest"), word_count(text).cast("long").alias("words"))
    narrow = written(rows, "turns")
    order = [F.col("turn").asc_nulls_first(), F.col("digest")]
    dealt = written(narrow.repartitionByRange(F.col("conv_id"), *order).withColumn("block", F.spark_partition_id()), "dealt")
    forget(narrow)
    sizes = dealt.groupBy("conv_id", "block").agg(F.count("*").alias("n"))
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("conv_id", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    ranked = dealt.withColumn("place", F.row_number().over(Window.partitionBy("conv_id", "block").orderBy(*order)))
    out = written(ranked.join(starts, ["conv_id", "block"]).select("conv_id", "block", (F.col("start") + F.col("place") - 1).alias("place"), "digest", "words"), "numbered")
    forget(dealt)
    return out


def rebuilt(turns: DataFrame, family: int = FAMILY, taken: int = TAKEN) -> tuple[DataFrame, DataFrame]:
    """Every conversation behind the first turns of the one that its family begins with.

    turns: numbered_turns(). Conversation c takes the first h turns of c - c % family (all if it has fewer, none if
    there is none), h = crc32(c) % taken, then its own turns after its first h. Returns (conv_id, length) of each
    conversation and (conv_id, length, block, depth, digest, words) of each turn, depth from 1.
    """
    sizes = written(turns.groupBy("conv_id").agg(F.count("*").alias("n")), "sizes")
    first = F.col("conv_id") - F.col("conv_id") % family
    heads = sizes.filter(first == F.col("conv_id")).select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    convs = sizes.select("conv_id", "n", first.alias("base"), (F.crc32(F.col("conv_id").cast("string").cast("binary")) % taken).alias("h")).join(heads, "base", "left")
    shared = F.least("h", F.coalesce("base_n", F.lit(0)))
    convs = convs.select("conv_id", "base", "h", shared.alias("shared"), (shared + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length"))
    lent = turns.filter((first == F.col("conv_id")) & (F.col("place") < taken - 1)).select(F.col("conv_id").alias("base"), "place", "digest", "words")
    begins = convs.join(lent, "base").filter("place < h").select("conv_id", "length", F.lit(-1).alias("block"), (F.col("place") + 1).alias("depth"), "digest", "words")
    goes_on = turns.join(convs, "conv_id").filter("place >= h").select("conv_id", "length", "block", (F.col("place") - F.col("h") + F.col("shared") + 1).alias("depth"), "digest", "words")
    return written(convs.select("conv_id", "length"), "conversations"), written(begins.unionByName(goes_on), "rebuilt")


def _key(sums: list[Column]) -> list[Column]:
    halves = [s.bitwiseAND(F.lit(_LOW)) for s in sums]
    return [F.shiftleft(halves[i], 32).bitwiseOR(halves[i + 1]) for i in (0, 2)]


def paths(turns: DataFrame) -> DataFrame:
    """The node of each turn (NODE, and ABOVE for the node above), words and words_to (those up to and with the turn).

    turns: conv_id, length, block, depth, digest, words. A node's key is a 128-bit sum over its turns of hashes of
    their depth and digest. Sums run within blocks and over the blocks' totals.
    """
    one, two = F.xxhash64("depth", "digest"), F.xxhash64("digest", "depth", F.lit(2))
    halves = [f(x) for x in (one, two) for f in (lambda x: F.shiftrightunsigned(x, 32), lambda x: x.bitwiseAND(F.lit(_LOW)))]
    rows = turns.withColumns(dict(zip(_SUMS, halves, strict=True)))
    values = [*_SUMS, "words"]
    totals = rows.groupBy("conv_id", "block").agg(*[F.sum(v).alias(f"{v}_own") for v in values])
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("conv_id", "block", *[F.coalesce(F.sum(f"{v}_own").over(before), F.lit(0)).alias(f"{v}_before") for v in values])
    within = Window.partitionBy("conv_id", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = rows.withColumns({f"{v}_to": F.sum(v).over(within) for v in values}).join(totals, ["conv_id", "block"])
    to = {v: F.col(f"{v}_to") + F.col(f"{v}_before") for v in values}
    own, above = _key([to[s] for s in _SUMS]), _key([to[s] - F.col(s) for s in _SUMS])
    return joined.select("conv_id", "length", "depth", *[c.alias(n) for c, n in zip(own + above, [*NODE[1:], *ABOVE], strict=True)], "words", to["words"].alias("words_to"))


def owned(rows: DataFrame, parts: int = PARTS) -> DataFrame:
    """paths() with owned (the conversation is the smallest member) and childless (owned, and no member goes on).

    Windows in two levels: the smallest of each part of a node's members, then the smallest of those.
    """
    part = F.pmod(F.xxhash64("conv_id"), F.lit(parts)).cast("int")
    in_part, in_node = Window.partitionBy(*NODE, "part"), Window.partitionBy(*NODE, "second")
    first = rows.withColumn("part", part).withColumns({"first": F.col("conv_id") == F.min("conv_id").over(in_part), "goes": F.max(F.col("depth") < F.col("length")).over(in_part)})
    second = first.withColumn("second", F.when(F.col("first"), F.lit(-1)).otherwise(F.col("part")))
    both = second.withColumns({"owned": F.col("first") & (F.col("conv_id") == F.min("conv_id").over(in_node)), "goes": F.max("goes").over(in_node)})
    return both.withColumn("childless", F.col("owned") & ~F.col("goes")).drop("part", "second", "first", "goes")


def _id_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of ids of one node, as text; rows come sorted by node and id."""
    for batch in batches:
        if batch.num_rows:
            keys = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)])
            at = np.flatnonzero(np.r_[True, (keys[:, 1:] != keys[:, :-1]).any(axis=0)])
            ids = batch.column(3).to_pylist()
            texts = [",".join(map(str, ids[a:b])) for a, b in zip(at, [*at[1:], len(ids)], strict=True)]
            yield pa.RecordBatch.from_arrays([*[batch.column(i).take(pa.array(at)) for i in range(4)], pa.array(texts, pa.string())], [*NODE, "first", "ids"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One SHA-256 a node over its runs, which come sorted; only the state of the current node is held."""
    node, state = None, None
    for batch in batches:
        out = []
        for *key, ids in zip(*[batch.column(i).to_pylist() for i in (0, 1, 2, 4)], strict=True):
            if key == node:
                state.update(b"," + ids.encode())
            else:
                if node:
                    out.append((*node, state.hexdigest()))
                node, state = key, hashlib.sha256(ids.encode())
        yield _digest_rows(out)
    if node:
        yield _digest_rows([(*node, state.hexdigest())])


def _digest_rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 3 + [pa.string()], strict=True)], [*NODE, "ends_sha256"])


def end_digests(ends: DataFrame) -> DataFrame:
    """NODE and ends_sha256: the hash of the conv_ids of each node, ascending, joined by commas.

    ends: NODE, conv_id. Ids are sorted over all partitions and joined where they stand, so a node of many ids is
    dealt over many tasks; only the hash itself, which has no parallel form, goes over a node's runs in one task.
    """
    kind = "depth long, key1 long, key2 long"
    dealt = ends.select(*NODE, "conv_id").repartitionByRange(*NODE, "conv_id").sortWithinPartitions(*NODE, "conv_id")
    runs = dealt.mapInArrow(_id_runs, f"{kind}, first long, ids string")
    return runs.repartition(*NODE).sortWithinPartitions(*NODE, "first").mapInArrow(_digests, f"{kind}, ends_sha256 string")


def trie(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """The nodes of the trie of conversations.

    convs: conv_id, length; turns: conv_id, length, block, depth, digest, words, as rebuilt() gives them (tables:
    both are read more than once). Returns conv_id (the smallest member), depth, parent_conv_id (null at the root),
    n_convs, n_children, n_leaves, saved_tokens (all of the subtree) and ends_sha256. A turnless conversation is a
    member of the root only. Without conversations there is no node.
    """
    marked = written(owned(paths(turns)), "marked")
    mine = F.when(F.col("owned"), F.col("words_to") - F.col("words"))
    own = marked.groupBy("conv_id").agg(F.min(F.when(F.col("owned"), F.col("depth"))).alias("from"), F.min(mine).alias("words_before"), F.max("words_to").alias("all_words"), F.max(F.col("childless").cast("long")).alias("leaf"))
    per = convs.join(own, "conv_id", "left").select(
        "conv_id", F.col("length").alias("turns"), F.coalesce("from", F.col("length") + 1).alias("from"),
        F.coalesce("words_before", "all_words", F.lit(0)).alias("words_before"), F.coalesce("leaf", F.lit(0)).alias("leaf"),
    )
    per = written(per, "owners")
    saved = F.greatest(F.col("words_before") - F.col("words_to") + F.col("words"), F.lit(0))
    child = ((F.col("depth") < F.col("length")) & (F.col("depth") + 1 >= F.col("from"))).cast("long")
    top = lambda c: F.max(F.when(F.col("owned"), c))  # noqa: E731  there is one such row
    nodes = marked.join(per, "conv_id").groupBy(*NODE).agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.sum(child).alias("n_children"), F.sum("leaf").alias("n_leaves"), F.sum(saved).alias("saved_tokens"),
        top(F.col("from") == F.col("depth")).alias("first_owned"), *[top(F.col(c)).alias(c) for c in ABOVE],
    )
    children = F.sum((F.col("from") == 1).cast("long") * (F.col("turns") > 0).cast("long"))
    none = F.lit(0).cast("long")
    root = per.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), children.alias("n_children"), F.sum("leaf").alias("n_leaves"), F.sum("words_before").alias("saved_tokens")).filter("n_convs > 0")
    root = root.withColumn("n_leaves", F.greatest("n_leaves", (F.col("n_children") == 0).cast("long"))).withColumns({**{c: none for c in (*NODE, *ABOVE)}, "first_owned": F.lit(False)})
    ends = marked.filter("depth = length").select(*NODE, "conv_id").unionByName(per.filter("turns = 0").select(*[none.alias(c) for c in NODE], "conv_id"))
    nodes = written(nodes.unionByName(root).join(end_digests(ends), NODE, "left"), "nodes")
    forget(marked, per)
    above = nodes.select((F.col("depth") + 1).alias("depth"), F.col("key1").alias("up1"), F.col("key2").alias("up2"), F.col("conv_id").alias("parent_conv_id"))
    below = nodes.filter("first_owned").join(above, ["depth", *ABOVE])
    same = nodes.filter("not first_owned").withColumn("parent_conv_id", F.when(F.col("depth") > 0, F.col("conv_id")))
    out = below.unionByName(same)
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))


def op11_conversation_trie(spark, sf_dir: str) -> DataFrame:
    """The prefix trie of all conversations, each behind the first turns of its family's first."""
    numbered = numbered_turns(table(spark, sf_dir, "conversations"))
    convs, turns = rebuilt(numbered)
    return trie(convs, turns)


#: CRC-32 of the decimal digits of ``c``, bit by bit.
_CRC = """(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(c::VARCHAR, ''), lambda x: list_transform(range(0, 8), lambda i: (ascii(x) >> i::INT) & 1)))),
      lambda a, b: CASE WHEN xor(a & 1, b) = 1 THEN xor(a >> 1, 3988292384::BIGINT) ELSE a >> 1 END))"""

OP11_SQL = rf"""
WITH t AS (SELECT conv_id, sha256(sha256(coalesce(role, '')) || coalesce(text, '')) AS s, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words,
                  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(sha256(coalesce(role, '')) || coalesce(text, ''))) AS i FROM conversations WHERE conv_id IS NOT NULL),
     n AS (SELECT conv_id AS c, count(*) AS n FROM t GROUP BY conv_id),
     h AS (SELECT c, n, c - c % {FAMILY} AS b, xor({_CRC}, 4294967295::BIGINT) % {TAKEN} AS h FROM n),
     v AS (SELECT h.c, h.n, h.b, h.h, least(h.h, coalesce(m.n, 0)) AS k FROM h LEFT JOIN n m ON m.c = h.b),
     r AS (SELECT c, i AS d, s, words FROM v JOIN t ON t.conv_id = b AND i <= h UNION ALL SELECT c, k + i - h, s, words FROM v JOIN t ON t.conv_id = c AND i > h),
     p AS (SELECT c, d, words, string_agg(s, ',') OVER (PARTITION BY c ORDER BY d) AS path FROM r UNION ALL SELECT c, 0, 0, '' FROM v),
     l AS (SELECT c, max(d) AS last FROM p GROUP BY c),
     m AS (SELECT path, d, min(c) AS conv_id, count(*) AS n_convs, max(words) AS words, string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE d = last) AS ends FROM p JOIN l USING (c) GROUP BY path, d),
     u AS (SELECT *, CASE WHEN d > 1 THEN path[:-66] WHEN d = 1 THEN '' END AS up FROM m),
     k AS (SELECT up AS path, d - 1 AS d, count(*) AS n_children FROM u WHERE d > 0 GROUP BY up, d - 1),
     w AS (SELECT u.*, coalesce(n_children, 0) AS n_children FROM u LEFT JOIN k USING (path, d)),
     s AS (SELECT path, d, sum(q.saved)::BIGINT AS saved, sum(q.leaf)::BIGINT AS leaves FROM
             (SELECT (n_convs - 1) * words AS saved, (n_children = 0)::INT AS leaf, unnest(list_transform(range(0, d + 1), lambda x: CASE WHEN x = 0 THEN '' ELSE path[:65 * x - 1] END)) AS path, unnest(range(0, d + 1)) AS d FROM w) q GROUP BY path, d)
SELECT w.conv_id, w.d::BIGINT AS depth, x.conv_id AS parent_conv_id, w.n_convs, w.n_children, leaves AS n_leaves, saved AS saved_tokens, sha256(coalesce(w.ends, '')) AS ends_sha256
FROM w JOIN s USING (path, d) LEFT JOIN w x ON x.path = w.up AND x.d = w.d - 1
"""
