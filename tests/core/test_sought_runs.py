"""Runs that no phrase has are dropped where texts are read; with too many phrases for that the rows are the same."""

from pyspark.sql import functions as F

from ledgerline.operators import phrases as P


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_only_sought_runs_are_exploded(spark, monkeypatch):
    files = spark.createDataFrame([(1, "x a b c d e y"), (2, "a b c"), (3, "q r s t u v w x y z"), (4, None), (5, "")], "pfile_fk long, text string")
    split = files.select("pfile_fk", P.token_array(F.col("text")).alias("tokens"))
    phrases = spark.createDataFrame([(7, "A b C d e"), (8, "q r"), (9, "z")], "rf_pk long, text string")
    index = P.germs(phrases.select("rf_pk", P.token_array(F.col("text")).alias("tokens")))
    lengths, wanted = P.sought(index)
    assert lengths == (1, 2, 3) and len(wanted) == 5
    assert P._heads(split, "pfile_fk", "tokens", lengths, wanted).count() == 6  # of 49 runs
    catalogue = phrases.select("rf_pk", P.token_array(F.col("text")).alias("tokens"))
    as_hits = phrases.withColumnRenamed("rf_pk", "phrase_pk")
    few = rows(P.candidates(split, catalogue)), rows(P.phrase_hits(files, as_hits))
    monkeypatch.setattr(P, "MOST_SOUGHT", 1)
    assert P.sought(index) == ((1, 2, 3), None)
    assert few == (rows(P.candidates(split, catalogue)), rows(P.phrase_hits(files, as_hits)))
    assert few[1] == [(1, 7), (3, 8), (3, 9)]
    assert rows(P.phrase_hits(files, as_hits.limit(0))) == []
