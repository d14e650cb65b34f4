"""The stored phrase index by versions, and scanners called from SQL."""

import re
import uuid

import pytest
from pyspark.sql import functions as F

from ledgerline.operators import automaton as A
from ledgerline.operators import phrase_index as I
from ledgerline.operators import phrases as P
from ledgerline.operators import scanner_functions as S

PHRASES = [(1, "A", "one two three four five"), (2, "B", "two three"), (3, "C", "alpha beta gamma delta"), (4, "Void", "never searched at all"), (5, "D", "six")]
TEXTS = ["zero one two three four five six", "alpha beta gamma", "two three two three", "", None, "six alpha beta gamma delta six"]


@pytest.fixture
def table(spark):
    name = f"index_{uuid.uuid4().hex}"
    yield name
    spark.sql(f"DROP TABLE IF EXISTS {name}")


def phrases(spark, *keys):
    return spark.createDataFrame([p for p in PHRASES if p[0] in keys], "rf_pk long, shortname string, text string")


def files(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "pfile_fk long, text string").filter("text is not null").select("pfile_fk", P.token_array(F.col("text")).alias("tokens"))


def rows(df):
    return sorted(tuple(r) for r in df.select("pfile_fk", "rf_pk", "t", "s").collect())


def test_versions(spark, table):
    seen = spark.createDataFrame([], "pfile_fk long, version int")
    assert I.index_version(spark, table) == 0 and rows(I.new_candidates(files(spark), seen, table)) == []
    assert I.extend_index(spark, table, phrases(spark, 1, 2, 4), 4) == 1
    assert I.extend_index(spark, table, phrases(spark, 1, 2, 4), 4) == 1  # nothing new
    every = lambda *keys: rows(P.candidates(files(spark), P.searched(phrases(spark, *keys))))
    assert rows(I.new_candidates(files(spark), seen, table, 4)) == every(1, 2)
    seen = I.marked_scanned(files(spark).filter("pfile_fk < 3"), 1)
    assert rows(I.new_candidates(files(spark), seen, table, 4)) == [r for r in every(1, 2) if r[0] >= 3]
    assert I.extend_index(spark, table, phrases(spark, 2, 3, 5), 4) == 2
    assert rows(I.new_candidates(files(spark), seen, table, 4)) == sorted(set(every(3, 5)) | {r for r in every(1, 2) if r[0] >= 3})
    seen = seen.unionByName(I.marked_scanned(files(spark), 2))
    assert rows(I.new_candidates(files(spark), seen, table, 4)) == []
    assert spark.table(table).filter("rf_pk = 4").count() == 0 and spark.table(table).filter("version = 1").select("rf_pk").distinct().count() == 2


def test_the_index_is_not_shuffled(spark, table):
    """Only texts move: the stored side of the join is read by its buckets."""
    I.extend_index(spark, table, phrases(spark, 1, 2, 3, 5), 4)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = I.new_candidates(files(spark), spark.createDataFrame([], "pfile_fk long, version int"), table, 4)
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Bucketed: true" in plan and sum("hashpartitioning(n" in line for line in plan.splitlines()) == 1
        assert rows(df) == rows(P.candidates(files(spark), P.searched(phrases(spark, 1, 2, 3, 5))))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_scanners_from_sql(spark):
    S.register_scanners(spark)
    texts = ["The MIT-License, é 1999 and mit license 2001.", "", None, "a1999b"]
    spark.createDataFrame(list(enumerate(texts)), "k int, text string").createOrReplaceTempView("_texts")
    found = spark.sql(r"SELECT k, f.* FROM _texts, LATERAL scan_pattern(text, '(?P<century>19|20)(\\d\\d)', 'year', 2) f")
    assert found.columns == ["k", "type", "content", "start", "end", "century"]
    want = [(k, "year", m[2], m.start(2), m.end(2), m[1]) for k, t in enumerate(texts) for m in re.finditer(r"(19|20)(\d\d)", t or "")]
    assert sorted(map(tuple, found.collect())) == sorted(want)
    hits = sorted(map(tuple, spark.sql("SELECT k, f.* FROM _texts, LATERAL scan_phrases(text, 'mit license|license|1999') f").collect()))
    df = A.scanned(spark.table("_texts"), ["k"], F.col("text"), ["1999", "license", "mit license"])
    spans = A.original_spans(F.col("starts"), F.col("shifts"), F.col("hits"))
    same = sorted((r.k, ["1999", "license", "mit license"][h["phrase"]], s["start"], s["end"]) for r in df.select("k", "hits", spans.alias("s")).collect() for h, s in zip(r.hits, r.s, strict=True))
    assert hits == same and len(hits) == 5


@pytest.mark.parametrize("call", ["scan_pattern(text, text)", "scan_pattern(text, '(?P<start>a)')", "scan_phrases(text, 'Not Clean')", "scan_phrases(text, 'a||b')"])
def test_wrong_arguments_are_told_when_a_query_is_analysed(spark, call):
    S.register_scanners(spark)
    spark.createDataFrame([("a",)], "text string").createOrReplaceTempView("_texts")
    with pytest.raises(Exception, match="constant|named|cleaned"):
        spark.sql(f"SELECT f.* FROM _texts, LATERAL {call} f").schema
