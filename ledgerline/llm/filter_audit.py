"""How filters interact: every order of applying them, executed over a trie of orders with shared states.

Orders that begin with the same filters, in whatever order, leave the same survivors. The trie is walked depth first;
a state, that is a set of filters applied, is reached once, and its survivors are those of the state before it, one
filter applied. One pass over a state's survivors counts what each next filter removes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations, permutations
from math import factorial

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .mixing import word_count
from .store import forget, table, written

#: Orders grow with the factorial, states with the power of two.
MOST_FILTERS = 7
#: Documents of one text meet the first of them in so many tasks.
COPY_PARTS = 32


def orders(names: list[str]) -> Iterator[tuple[str, int, int, str]]:
    """(filter_order, step from 1, state before the step as a sum of 2^i, filter)."""
    for order in permutations(names):
        for step, name in enumerate(order):
            yield "".join(order), step + 1, sum(1 << names.index(x) for x in order[:step]), name


def executed(docs: DataFrame, names: list[str], marks: list[str]) -> list[DataFrame]:
    """A written table for each state but the last: part, state, alive, and for each filter not yet applied
    removed_<name> and <mark>_<name>, the removed documents that carry a mark.

    docs: part, a boolean column for each filter (true: fails) and for each mark. Survivors are persisted (memory,
    then disk) while the walk is below their state, so at most one state a filter is held at a time; a lost
    executor's part is computed again from docs, which should be a table.
    """
    found: dict[int, DataFrame] = {}

    def visit(state: int, survivors: DataFrame) -> None:
        rest = [(i, n) for i, n in enumerate(names) if not state >> i & 1]
        counts = [c for _, n in rest for c in (F.count_if(F.col(n)).alias(f"removed_{n}"), *[F.count_if(F.col(n) & F.col(m)).alias(f"{m}_{n}") for m in marks])]
        found[state] = written(survivors.groupBy("part").agg(F.lit(state).alias("state"), F.count("*").alias("alive"), *counts), f"state-{state}")
        for i, n in rest:
            after = state | 1 << i
            if len(rest) > 1 and after not in found:
                kept = survivors.filter(~F.col(n)).persist(StorageLevel.MEMORY_AND_DISK)
                visit(after, kept)
                kept.unpersist()

    start = docs.persist(StorageLevel.MEMORY_AND_DISK)
    visit(0, start)
    start.unpersist()
    return list(found.values())


def audit(docs: DataFrame, names: list[str], marks: list[str]) -> DataFrame:
    """What each filter removes at each step of each order, within each part.

    docs: a table with part (string), and booleans without nulls: one for each of ``names`` (filters of one letter;
    true: the document fails it) and each of ``marks``. Returns one row for each part, filter_order and step, zeros
    included: kept, removed, redundant (fails the filter, removed before), unique_fails (fails this filter only),
    <mark>_lost (removed here, with the mark), shapley (removed by the filter at any step, summed over all orders).
    A null part is a part of its own name, the empty string. An empty table gives no rows.
    """
    if not names or len(set(names)) < len(names) or len(names) > MOST_FILTERS or any(len(n) != 1 for n in names):
        raise ValueError(f"1 to {MOST_FILTERS} filters, each with a letter of its own")
    spark = docs.sparkSession
    docs = docs.select(F.coalesce("part", F.lit("")).alias("part"), *names, *marks)
    steps = spark.createDataFrame(list(orders(names)), "filter_order string, step int, state int, filter string")
    fails = reduce(lambda a, b: a + b, [F.col(n).cast("int") for n in names])
    alone = docs.filter(fails == 1).groupBy("part").agg(*[F.count_if(F.col(n)).alias(f"unique_{n}") for n in names])
    states = executed(docs, names, marks)
    counted = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), states)
    total = states[0].select("part", *[F.col(f"removed_{n}").alias(f"fails_{n}") for n in names]).join(alone, "part", "left")
    # A part without survivors has no row at a state: the grid of edges brings its zeros.
    edges = [(s, n) for k in range(len(names)) for c in combinations(range(len(names)), k) for s in [sum(1 << i for i in c)] for i, n in enumerate(names) if i not in c]
    grid = total.withColumn("edge", F.explode(F.array(*[F.struct(F.lit(s).alias("state"), F.lit(n).alias("filter")) for s, n in edges]))).select("*", "edge.*").drop("edge")
    pick = lambda kind: F.coalesce(F.coalesce(*[F.when(F.col("filter") == n, F.col(f"{kind}_{n}")) for n in names], F.lit(0)), F.lit(0)).cast("long")
    at = grid.join(counted, ["part", "state"], "left").select(
        "part", "state", "filter", F.coalesce("alive", F.lit(0)).alias("alive"), pick("removed").alias("removed"), pick("fails").alias("fails"),
        pick("unique").alias("unique_fails"), *[pick(m).alias(f"{m}_lost") for m in marks],
    )
    at = written(at, "edges")
    forget(*states)
    # As many orders pass an edge as there are orders of the filters before it and of those after it.
    weight = F.element_at(F.array(*[F.lit(factorial(k) * factorial(len(names) - 1 - k)) for k in range(len(names))]), F.bit_count("state") + 1)
    share = at.groupBy("part", "filter").agg(F.sum(F.col("removed") * weight).alias("shapley"))
    out = at.join(share, ["part", "filter"]).join(F.broadcast(steps), ["state", "filter"])  # the orders: 600 rows for five filters
    return out.select("part", "filter_order", "step", (F.col("alive") - F.col("removed")).alias("kept"), "removed", (F.col("fails") - F.col("removed")).alias("redundant"), "unique_fails", *[f"{m}_lost" for m in marks], "shapley")


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, A to E, good and toxic of each document, in a table of the shared folder.

    docs: doc_id, source, text; labels: doc_id, quality, toxic. A document fails A with under 200 words; B if under
    half of its words are distinct; C if over 2 of 100 code points are A-Z; D with any of #$%&*|; E if a row of a
    smaller doc_id has the same text (by SHA-256). Null texts are empty. Rows of equal doc_id are documents each, and
    don't count as smaller for each other; nor does a null doc_id, which has no label either. Several labels of a
    doc_id: any that says so makes it good or toxic.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.filter(F.split("body", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    capitals = F.length("body") - F.length(F.translate("body", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    read = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), text.alias("body"))
    counted = read.select("doc_id", "part", "body", word_count(F.col("body")).alias("n"), F.size(F.array_distinct(words)).alias("kinds"), capitals.alias("capitals"))
    narrow = counted.select(
        "doc_id", "part", (F.col("n") < 200).alias("A"), (100 * F.col("kinds") < 50 * F.col("n")).alias("B"), (100 * F.col("capitals").cast("long") > 2 * F.length("body").cast("long")).alias("C"),
        F.col("body").rlike(r"[#$%&*|]").alias("D"), F.unhex(F.sha2("body", 256)).alias("digest"),
    )
    narrow = written(narrow, "judged")
    # A text that very many documents share is dealt over parts in the join.
    firsts = narrow.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).filter("n > 1").select("digest", "first", F.explode(F.sequence(F.lit(0), F.lit(COPY_PARTS - 1))).alias("copy"))
    marks = labels.groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("quality"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    dealt = narrow.withColumn("copy", F.pmod(F.xxhash64("doc_id", "part"), F.lit(COPY_PARTS)).cast("int"))
    out = dealt.join(firsts, ["digest", "copy"], "left").join(marks, "doc_id", "left")
    is_one = lambda c: F.coalesce(F.col(c) == 1, F.lit(False))
    out = written(out.select("part", *"ABCD", F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)).alias("E"), is_one("quality").alias("good"), is_one("toxic").alias("toxic")), "verdicts")
    forget(narrow)
    return out


def op12_filter_audit(spark, sf_dir: str) -> DataFrame:
    """All orders of the filters A to E over all documents, within each source."""
    docs = judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return audit(docs, list("ABCDE"), ["good", "toxic"])


OP12_SQL = r"""
WITH RECURSIVE t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS x, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
     f AS (SELECT doc_id, part, len(w) < 200 AS a, 100 * len(list_distinct(w)) < 50 * len(w) AS b, 100 * length(regexp_replace(x, '[^A-Z]', '', 'g')) > 2 * length(x) AS c,
                  regexp_matches(x, '[#$%&*|]') AS d, coalesce(doc_id > min(doc_id) OVER (PARTITION BY x), false) AS e FROM t),
     l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
     m AS (SELECT part, a::INT + 2 * b::INT + 4 * c::INT + 8 * d::INT + 16 * e::INT AS mask, count(*) AS n, count(*) FILTER (WHERE good = 1) AS good, count(*) FILTER (WHERE toxic = 1) AS toxic FROM f LEFT JOIN l USING (doc_id) GROUP BY ALL),
     o AS (SELECT '' AS filter_order, 0 AS used UNION ALL SELECT filter_order || chr(65 + i::INT), used | (1 << i::INT) FROM o, range(5) r(i) WHERE (used >> i::INT) & 1 = 0),
     s AS (SELECT filter_order, step::INT AS step, 1 << (ascii(filter_order[step]) - 65) AS bit, list_sum(list_transform(range(1, step), lambda j: 1 << (ascii(filter_order[j]) - 65))) AS seen FROM o, range(1, 6) r(step) WHERE length(filter_order) = 5),
     c AS (SELECT part, filter_order, step, bit,
                  sum(n) FILTER (WHERE mask & (bit | coalesce(seen, 0)::INT) = 0) AS kept, sum(n) FILTER (WHERE mask & bit > 0 AND mask & coalesce(seen, 0)::INT = 0) AS removed,
                  sum(n) FILTER (WHERE mask & bit > 0 AND mask & coalesce(seen, 0)::INT > 0) AS redundant, sum(n) FILTER (WHERE mask = bit) AS unique_fails,
                  sum(good) FILTER (WHERE mask & bit > 0 AND mask & coalesce(seen, 0)::INT = 0) AS good_lost, sum(toxic) FILTER (WHERE mask & bit > 0 AND mask & coalesce(seen, 0)::INT = 0) AS toxic_lost
           FROM m, s GROUP BY ALL)
SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails,
       coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost, coalesce(sum(removed) OVER (PARTITION BY part, bit), 0)::BIGINT AS shapley FROM c
"""
