"""Mixing sources to target weights by entropy balancing."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import broadcast_if_small, table, written

#: Weights of the sources in the order of their names, repeating.
WEIGHTS = (3, 1, 2)
#: Words of the mix, as a share of all words.
SHARE = 1.5
#: No document is taken more often.
MOST_COPIES = 2
#: Newton's steps end when every source is within this share of its target.
TOLERANCE = 1e-9
#: Rows of one size and source that one task ranks.
RANKED_AT_ONCE = 200_000


def word_count(text: Column) -> Column:
    """Words between spaces and tab, newline, vertical tab, form feed and carriage return; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(cells: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: int = MOST_COPIES) -> DataFrame:
    """(source, source_size, n_docs, target) from (source, size, n).

    ``share`` of all words is split by weight; no source gets over ``most`` times its words, and what it
    would get above is shared among the others by weight, again until none is above. That is one level c for
    all: target = min(most * source_size, c * weight). c rises from step to step and settles after at most
    one step a source; only sums reach the driver.
    """
    sums = cells.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"), F.sum("n").alias("n_docs"))
    ranged = written(sums.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()), "ranged-sources")
    earlier, offsets = 0, {}
    for r in sorted(ranged.groupBy("part").agg(F.count("*").alias("n")).collect()):  # one row a partition
        offsets[r.part], earlier = earlier, earlier + r.n
    before = F.create_map(*[F.lit(x) for pair in offsets.items() for x in pair])[F.col("part")] if offsets else F.lit(0)
    place = before + F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    by_source = written(ranged.withColumn("weight", weight).drop("part"), "sources")
    budget = share * (by_source.agg(F.sum("source_size")).first()[0] or 0)
    level, before = 0.0, None
    cap = most * F.col("source_size")
    while level != before:
        full = cap < F.lit(level) * F.col("weight")
        capped, open_weight = by_source.agg(F.sum(F.when(full, cap)), F.sum(F.when(~full, F.col("weight")))).first()
        before, level = level, (budget - (capped or 0)) / open_weight if open_weight else level
    return by_source.withColumn("target", F.least(cap.cast("double"), F.lit(level) * F.col("weight"))).drop("weight")


def tilts(cells: DataFrame, by_source: DataFrame, most: int = MOST_COPIES, steps: int = 60) -> DataFrame:
    """The dual variable of each source: (source, tilt), where a document of z mean sizes gets the rate
    most / (1 + exp(-tilt * z)).

    Among rates between 0 and ``most`` that meet the token constraint of the source these have the least
    relative entropy to the even rate. The convex dual is solved by Newton's method for all sources at once,
    each step one aggregation over the counts by source and size; a step that leaves the bracket known so
    far is replaced by bisection. Sources at their cap have no finite solution and a null tilt: rate ``most``.
    """
    ratio = F.col("target") / (most * F.col("source_size"))
    state = by_source.filter((F.col("source_size") > 0) & (F.col("target") > 0)).withColumn("mean", F.col("source_size") / F.col("n_docs"))
    state = state.filter(ratio < 1 - 1e-12).select("source", "source_size", "target", "mean", F.log(ratio / (1 - ratio)).alias("tilt"), F.lit(float("-inf")).alias("low"), F.lit(float("inf")).alias("high"))
    state = written(state, "tilts")
    for _ in range(steps):
        known = state.withColumnRenamed("source", "_source")
        rows = cells.filter("size > 0").join(broadcast_if_small(known), F.col("source").eqNullSafe(F.col("_source")))
        z = F.col("size") / F.col("mean")
        p = 1 / (1 + F.exp(-F.col("tilt") * z))
        words = F.col("n") * F.col("size") * most
        keys = ("_source", "source_size", "target", "mean", "tilt", "low", "high")
        sums = rows.groupBy(*keys).agg(F.sum(words * p).alias("taken"), F.sum(words * p * (1 - p) * z).alias("slope"))
        gap = F.col("taken") - F.col("target")
        low, high = F.when(gap < 0, F.col("tilt")).otherwise(F.col("low")), F.when(gap > 0, F.col("tilt")).otherwise(F.col("high"))
        newton = F.col("tilt") - gap / F.col("slope")
        bounded = (newton > F.col("low2")) & (newton < F.col("high2")) & F.col("slope").isNotNull() & (F.col("slope") > 0)
        middle = (F.when(F.col("low2") == float("-inf"), F.col("high2") - 10).otherwise(F.col("low2")) + F.when(F.col("high2") == float("inf"), F.col("low2") + 10).otherwise(F.col("high2"))) / 2
        off = F.abs(gap) / F.col("target")
        moved = sums.withColumn("off", off).withColumn("low2", low).withColumn("high2", high).withColumn("tilt", F.when(F.col("off") <= TOLERANCE, F.col("tilt")).when(bounded, newton).otherwise(middle))
        new = written(moved.select(F.col("_source").alias("source"), "source_size", "target", "mean", "tilt", F.col("low2").alias("low"), F.col("high2").alias("high"), "off"), "tilts")
        worst = new.agg(F.max("off")).first()[0]
        state = new.drop("off")
        if worst is None or worst <= TOLERANCE:
            break
    else:
        raise RuntimeError(f"the tilts did not settle in {steps} steps: off by {worst:.3g} of a target")
    return state.select("source", "tilt", "mean")


def _carry(most: int):
    """Whole copies for the sizes of one source, the longest first; what rounding leaves goes to the next."""

    def deal(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("size", ascending=False)
        left, totals = 0.0, []
        for size, n, rate in zip(rows["size"], rows["n"], rows["rate"], strict=True):
            want = round(n * rate * size + left, 4)
            copies = min(max(round(want / size), 0), most * n) if size else 0
            left = want - copies * size
            totals.append(copies)
        return rows.assign(total=totals).drop(columns="rate")

    return deal


def with_copies(docs: DataFrame, source: Column, size: Column, identity: Column, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: int = MOST_COPIES) -> DataFrame:
    """docs with columns size, source_size, target and copies (0 to ``most``).

    source: the group of a row (null is a group, the last); size: its words; identity: a hash that tells rows
    apart. Rows of one source and size have one rate. Their copies are rounded size by size, the longest
    first, and what rounding leaves is carried to the next size, so that a source misses its target by a few
    words of its shortest documents; rows of lowest identity hash get the copy more where it isn't even. One
    task at a time holds a source's counts by size, never its documents. Of rows that repeat in full as many
    get the copy more as are wanted. Reruns agree: which of equal rows these are tells nothing. Empty tables give no rows;
    sources without words have target 0 and copies 0. Other columns stay; those of the names above are
    replaced.
    """
    rows = docs.withColumn("size", size)
    narrow = written(rows.select(source.alias("source"), "size", identity.alias("h")), "sizes")
    cells = written(narrow.groupBy("source", "size").agg(F.count("*").alias("n")), "cells")
    by_source = written(targets(cells, weights, share, most), "targets")
    tilt = tilts(cells, by_source, most).withColumnRenamed("source", "_t")
    known = by_source.join(tilt, F.col("source").eqNullSafe(F.col("_t")), "left").drop("_t", "n_docs").withColumnRenamed("source", "_s")
    rated = cells.join(broadcast_if_small(written(known, "known")), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    rate = F.when(F.col("size") == 0, 0.0).when(F.col("tilt").isNull(), F.lit(float(most))).otherwise(most / (1 + F.exp(-F.col("tilt") * F.col("size") / F.col("mean"))))
    columns = "source string, size long, n long, source_size long, target double, total long"
    whole = rated.withColumn("rate", rate).select("source", "size", "n", "source_size", "target", "rate").groupBy("source").applyInPandas(_carry(most), columns)
    base = F.floor(F.col("total") / F.col("n"))
    dealt = written(whole.select("source", "size", "n", "source_size", "target", base.alias("base"), (F.col("total") - base * F.col("n")).alias("more")), "dealt")

    parts = int(dealt.agg(F.max("n")).first()[0] or 0) // RANKED_AT_ONCE + 1
    keys = ["source", "size"]
    same = lambda a, b: a["source"].eqNullSafe(b["_source"]) & (a["size"] == b["_size"])
    renamed = lambda df: df.withColumnRenamed("source", "_source").withColumnRenamed("size", "_size")
    uneven = renamed(broadcast_if_small(dealt.filter("more > 0").select(*keys, "more")))
    part = F.floor((F.col("h") / F.lit(2.0**64) + 0.5) * parts).cast("int")
    placed = narrow.join(uneven, same(narrow, uneven)).select(*keys, "more", "h", part.alias("part"))
    in_part = placed.groupBy(*keys, "part").agg(F.count("*").alias("in_part"))
    before = in_part.withColumn("before", F.sum("in_part").over(Window.partitionBy(*keys).orderBy("part")) - F.col("in_part")).withColumnRenamed("part", "_part").drop("in_part")
    before = renamed(before)
    ranked = placed.withColumn("rank", F.row_number().over(Window.partitionBy(*keys, "part").orderBy("h")))
    ranked = ranked.join(before, same(ranked, before) & (F.col("part") == F.col("_part")))
    ranked = ranked.withColumn("place", F.col("before") + F.col("rank"))
    last = renamed(ranked.filter("place = more").select(*keys, F.col("h").alias("last")))
    # Rows that repeat in full have one hash. Of those at the cut, so many get the copy more.
    at_cut = renamed(ranked.join(last, same(ranked, last) & (F.col("h") == F.col("last"))).groupBy(*keys).agg(F.first("last").alias("last"), (F.first("more") - F.min("place") + 1).alias("ties"), F.count("*").alias("equal")))
    plan = dealt.join(at_cut, same(dealt, at_cut), "left").select(F.col("source").alias("_source"), F.col("size").alias("_size"), "source_size", "target", F.col("base").alias("_base"), F.col("last").alias("_last"), F.col("ties").alias("_ties"), F.col("equal").alias("_equal"))
    plan = written(plan, "plan")
    split = not plan.filter("_ties < _equal").isEmpty()
    rows = rows.drop("source_size", "target", "copies").withColumn("_of", source).withColumn("_h", identity)
    out = rows.join(broadcast_if_small(plan), F.col("_of").eqNullSafe(F.col("_source")) & (F.col("size") == F.col("_size")))
    more = F.col("_h") <= F.col("_last")
    helpers = ["_of", "_h", "_source", "_size", "_base", "_last", "_ties", "_equal"]
    copies = lambda more: F.least(F.col("_base") + F.coalesce(more.cast("long"), F.lit(0)), F.lit(most)).cast("long")
    if not split:
        return out.withColumn("copies", copies(more)).drop(*helpers)
    tied = (F.col("_h") == F.col("_last")) & (F.col("_ties") < F.col("_equal"))
    some = written(out.filter(tied).withColumn("_part", F.spark_partition_id()), "tied-rows")
    cell = ["_source", "_size", "_part"]
    sizes = some.groupBy(*cell).agg(F.count("*").alias("_n"))
    sizes = sizes.withColumn("_before", F.sum("_n").over(Window.partitionBy("_source", "_size").orderBy("_part")) - F.col("_n"))
    sizes = sizes.select(*[F.col(c).alias(f"{c}_") for c in cell], "_before")
    number = F.row_number().over(Window.partitionBy(*cell).orderBy("_h"))
    match = F.col("_source").eqNullSafe(F.col("_source_")) & (F.col("_size") == F.col("_size_")) & (F.col("_part") == F.col("_part_"))
    some = some.withColumn("_number", number).join(sizes, match).withColumn("copies", copies(F.col("_before") + F.col("_number") <= F.col("_ties")))
    rest = out.filter(~F.coalesce(tied, F.lit(False))).withColumn("copies", copies(more)).drop(*helpers)
    return rest.unionByName(some.select(rest.columns))


def op6_mix_sources(spark, sf_dir: str) -> DataFrame:
    """How many words the mix takes of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    mixed = with_copies(docs, F.col("source"), word_count(F.col("text")), F.xxhash64("doc_id", "text"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))
