"""A stored index of phrases that grows by versions, and scans that go on from the version a file has seen."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .phrases import RUN, _heads, germs, searched, sought

#: Buckets of the stored table: texts are dealt likewise, so the index itself never moves.
BUCKETS = 32


def index_version(spark: SparkSession, table: str) -> int:
    """The newest version of a stored index, 0 if there is none."""
    if not spark.catalog.tableExists(table):
        return 0
    return spark.table(table).agg(F.max("version")).first()[0] or 0


def extend_index(spark: SparkSession, table: str, phrases: DataFrame, buckets: int = BUCKETS) -> int:
    """Adds those of phrases(rf_pk, shortname, text) to a stored index that are not in it; returns the newest version.

    Entries are written once, with the version that brought them, in files bucketed and sorted by their run. Phrases
    that are never searched get none. If nothing is new the version stays. One writer at a time.
    """
    before = index_version(spark, table)
    own = germs(searched(phrases).withColumn("rf_pk", F.col("rf_pk").cast("long")))
    if before:
        own = own.join(spark.table(table).select("rf_pk").distinct(), "rf_pk", "left_anti")
    new = own.select("rf_pk", F.col("n").cast("int").alias("n"), "run", F.col("s").cast("int").alias("s"), F.lit(before + 1).alias("version"))
    if before and new.isEmpty():
        return before
    new.repartition(buckets, "n", "run").write.bucketBy(buckets, "n", "run").sortBy("n", "run").mode("append").saveAsTable(table)
    return before + 1


def new_candidates(files: DataFrame, seen: DataFrame, table: str, buckets: int = BUCKETS) -> DataFrame:
    """pfile_fk, rf_pk, t, s: candidates (see phrases.candidates) of entries that a file has not been scanned with.

    files: pfile_fk, tokens; seen: pfile_fk, version (the newest version a file was scanned with; files without one
    meet the whole index). Files that have seen the newest version are not even split into runs. Runs of texts are
    dealt by the buckets of the index, which is read where it lies.
    """
    spark = files.sparkSession
    newest = index_version(spark, table)
    last = seen.groupBy("pfile_fk").agg(F.max("version").alias("seen"))
    due = files.join(last, "pfile_fk", "left").withColumn("seen", F.coalesce("seen", F.lit(0))).filter(F.col("seen") < newest)
    if not newest:
        return files.select("pfile_fk", F.lit(None).cast("long").alias("rf_pk"), F.lit(0).alias("t"), F.lit(0).alias("s")).limit(0)
    index = spark.table(table)
    lengths, wanted = sought(index)
    heads = _heads(due.withColumn("_key", F.struct("pfile_fk", "seen")), "_key", "tokens", lengths or (RUN,), wanted).select("_key", "n", "t", "run")
    joined = heads.repartition(buckets, "n", "run").join(index, ["n", "run"]).filter(F.col("version") > F.col("_key.seen"))
    return joined.select("_key.pfile_fk", "rf_pk", "t", "s")


def marked_scanned(files: DataFrame, version: int) -> DataFrame:
    """Rows for ``seen`` after a scan: pfile_fk, version."""
    return files.select("pfile_fk", F.lit(version).alias("version"))
