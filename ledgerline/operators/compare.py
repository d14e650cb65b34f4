"""Pairing the files of folders of several trees by name, exactly or nearly."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.text import fuzzy_name
from ledgerline.storage import settled


def _pair_off(left: DataFrame, right: DataFrame, keys: list[str], stage: str) -> DataFrame:
    """Pairs the n-th row of a key on the left with the n-th on the right, in order of item: 1:1, no pair is made twice."""
    order = Window.partitionBy(*keys).orderBy("item")
    a = left.withColumn("_n", F.row_number().over(order)).select(*keys, "_n", F.col("item").alias("item_1"))
    b = right.withColumn("_n", F.row_number().over(order)).select(*keys, "_n", F.col("item").alias("item_2"))
    return a.join(b, [*keys, "_n"]).select("item_1", "item_2", F.lit(stage).alias("stage"))


def _one_letter_off(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs of names with a Levenshtein distance of 1, taken 1:1 in order of the left item, then the right.

    Candidates share the name with one letter left out (or a whole name): joins on those keys replace comparing
    all names of a folder with all others. Ties between rows that want the same partner are settled in rounds:
    each row asks for its least open partner, each partner takes the least row that asks.
    """

    def keys(df: DataFrame, n: str) -> DataFrame:
        gaps = F.transform(F.sequence(F.lit(1), F.greatest(F.length("fuzzy"), F.lit(1))), lambda i: F.concat(F.substring("fuzzy", F.lit(1), i - 1), F.substr("fuzzy", i + 1)))
        return df.select("folder", F.col("item").alias(f"item_{n}"), F.col("fuzzy").alias(f"fuzzy_{n}"), F.explode(F.array_distinct(F.concat(gaps, F.array("fuzzy")))).alias("key"))

    wide = keys(left, "1").join(keys(right, "2"), ["folder", "key"]).filter(F.levenshtein("fuzzy_1", "fuzzy_2") == 1)
    pairs = settled(wide.select("item_1", "item_2").distinct(), "near-names")
    found = []
    while True:
        asked = pairs.groupBy("item_1").agg(F.min("item_2").alias("item_2"))
        taken = settled(asked.groupBy("item_2").agg(F.min("item_1").alias("item_1")).select("item_1", "item_2"), "taken")
        if taken.isEmpty():
            break
        found.append(taken)
        pairs = settled(pairs.join(taken.select("item_1"), "item_1", "left_anti").join(taken.select("item_2"), "item_2", "left_anti").select("item_1", "item_2"), "near-names")
    return reduce(DataFrame.union, found).withColumn("stage", F.lit("one letter")) if found else pairs.withColumn("stage", F.lit("one letter"))


def matched_names(left: DataFrame, right: DataFrame) -> DataFrame:
    """item_1, item_2, stage of files(folder, item, name) of two trees.

    Stages, each on what the earlier left: the name; the name without digits, dots, dashes and underscores; that
    with a distance of one letter; that without the extension. What stays alone has a null partner and the stage
    ``alone``. Each file is in one row. Rows with a null name are alone.
    """
    prepare = lambda df: settled(df.select("folder", "item", "name", fuzzy_name(F.col("name")).alias("fuzzy"), fuzzy_name(F.col("name"), False).alias("stem")), "names")
    a, b = prepare(left), prepare(right)
    rest_a, rest_b, found = a, b, []
    steps = [("name", "name"), ("fuzzy", "fuzzy"), (None, "one letter"), ("stem", "stem")]
    for key, stage in steps:
        if key:
            usable = lambda df, k=key: df.filter(F.col(k) != "")
            pairs = settled(_pair_off(usable(rest_a), usable(rest_b), ["folder", key], stage), "pairs")
        else:
            pairs = settled(_one_letter_off(rest_a.filter("fuzzy != ''"), rest_b.filter("fuzzy != ''")), "pairs")
        found.append(pairs)
        rest_a = rest_a.join(pairs.select(F.col("item_1").alias("item")), "item", "left_anti")
        rest_b = rest_b.join(pairs.select(F.col("item_2").alias("item")), "item", "left_anti")
    kind = a.schema["item"].dataType
    found.append(rest_a.select(F.col("item").alias("item_1"), F.lit(None).cast(kind).alias("item_2"), F.lit("alone").alias("stage")))
    found.append(rest_b.select(F.lit(None).cast(kind).alias("item_1"), F.col("item").alias("item_2"), F.lit("alone").alias("stage")))
    return reduce(DataFrame.unionByName, found)


def matched_many(trees: list[DataFrame]) -> DataFrame:
    """One row for each group of matching files of several trees: item_1, item_2, ....

    Each tree is paired with the first that has a file for the row; files of later trees that match none open rows
    of their own.
    """
    rows = trees[0].select("folder", "name", F.col("item").alias("item_1"))
    for n, tree in enumerate(trees[1:], start=2):
        numbered = settled(rows.withColumn("item", F.xxhash64(*[F.coalesce(F.col(f"item_{i}").cast("string"), F.lit("")) for i in range(1, n)])), "rows")
        pairs = matched_names(numbered.select("folder", "item", "name"), tree)
        both = numbered.join(pairs.filter("item_1 is not null").select(F.col("item_1").alias("item"), F.col("item_2").alias(f"item_{n}")), "item", "left").drop("item")
        new = pairs.filter("item_1 is null").select(F.col("item_2").alias("item")).join(tree, "item").select("folder", "name", F.col("item").alias(f"item_{n}"))
        rows = settled(both.unionByName(new, allowMissingColumns=True), "rows")
    return rows.select("folder", "name", *[f"item_{i}" for i in range(1, len(trees) + 1)])


def pair_filters() -> dict[str, Column]:
    """What a comparison can hide, on pairs with hash_1, hash_2, licenses_1, licenses_2, fuzzy_1, fuzzy_2 (Q6)."""
    same_hash = F.col("hash_1").eqNullSafe(F.col("hash_2")) & F.col("hash_1").isNotNull()
    same_list = F.col("licenses_1").eqNullSafe(F.col("licenses_2")) & F.col("licenses_1").isNotNull()
    none = F.lit("No_license_found")
    return {
        "same hash": same_hash,
        "same licenses": same_list,
        "same name and licenses": same_list & F.col("fuzzy_1").eqNullSafe(F.col("fuzzy_2")),
        "no licenses": (F.coalesce("licenses_1", none) == none) & (F.coalesce("licenses_2", none) == none),
    }
