"""Connected components by alternating large-star and small-star, on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import forget, written


def _stars(pairs: DataFrame) -> DataFrame:
    """For every row (u, v): v is linked to the least of u and all its partners instead of to u."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).filter("m < u")
    # Most rows belong to a node that is its star's least already; they find no partner here.
    return pairs.join(least, "u", "left").withColumn("m", F.coalesce("m", "u"))


def large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _stars(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    linked = _stars(down)
    own = linked.filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return own.union(linked.select("u", F.col("m").alias("v"))).distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether the edges (u, v), u > v, are stars: every u has one partner, and that is nobody's u."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("n"), F.lit(0).alias("head"))
    ends = ends.union(edges.select(F.col("v").alias("node"), F.lit(0).alias("n"), F.lit(1).alias("head")))
    return ends.groupBy("node").agg(F.sum("n").alias("n"), F.max("head").alias("head")).filter("n + head > 1").isEmpty()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """The component of each linked node.

    edges: columns u, v (long), any direction, repeats and loops allowed; rows with a null are ignored. The
    edges are read twice, so they should be a table. Returns node, component (the least node reachable) for
    nodes of components of two or more. Each round rewrites the edges in the shared folder; the work ends when
    they are stars. Raises RuntimeError if ``rounds`` are not enough (the number needed grows with the
    logarithm of the nodes).
    """
    edges, before = edges.select("u", "v").filter("u != v"), None
    for _ in range(rounds):
        edges = written(small_star(large_star(edges)), "edges")
        if before is not None:
            forget(before)
        before = edges
        if _settled(edges):
            break
    else:
        raise RuntimeError("the components did not settle")
    heads = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(heads)
