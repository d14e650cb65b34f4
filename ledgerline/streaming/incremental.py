"""Scanning only what is new: batch, and as a stream of arriving files."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def to_scan(contents: DataFrame, findings: DataFrame, agent: int) -> DataFrame:
    """Contents without a row of this version of a scanner (W1); rows for "nothing found" count as scanned."""
    return contents.join(findings.filter(F.col("agent_fk") == agent).select("pfile_fk"), "pfile_fk", "left_anti")


def uploads_to_scan(uploads: DataFrame, runs: DataFrame, agent: int) -> DataFrame:
    """Uploads without a successful run of this version."""
    return uploads.join(runs.filter((F.col("agent_fk") == agent) & F.col("success")).select("upload_fk"), "upload_fk", "left_anti")


def scan_stream(arriving: DataFrame, scan: Callable[[DataFrame], DataFrame], agent: int, findings_path: str, runs_path: str, checkpoint: str, upload: int = 0) -> StreamingQuery:
    """Scans a stream of files(pfile_fk, text) into a Parquet table of findings, each content once.

    Every micro-batch is held against the table by content, so copies that arrive later and files that arrive again
    are not scanned again. Each batch writes a folder of its own, overwritten if the batch is tried again after a
    failure, and one row of the run table (W2).
    """

    def batch(rows: DataFrame, number: int) -> None:
        spark, began = rows.sparkSession, dt.datetime.now(dt.UTC).replace(tzinfo=None)
        known = _read(spark, findings_path, "pfile_fk long, agent_fk int, batch long")
        new = rows.dropDuplicates(["pfile_fk"])
        if known is not None:
            new = to_scan(new, known.filter(F.col("batch") != number), agent)
        scan(new).withColumn("agent_fk", F.lit(agent)).write.mode("overwrite").parquet(f"{findings_path}/batch={number}")
        run = [(upload, agent, began, dt.datetime.now(dt.UTC).replace(tzinfo=None), True)]
        spark.createDataFrame(run, "upload_fk long, agent_fk int, began timestamp, ended timestamp, success boolean").write.mode("overwrite").parquet(f"{runs_path}/batch={number}")

    return arriving.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    """The table so far, or None before the first batch."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        return None
    return spark.read.schema(schema).parquet(path)


def started_run(runs: DataFrame, upload: int, agent: int, run_pk: int) -> DataFrame:
    """The run table with a row for a run that has begun."""
    row = runs.sparkSession.createDataFrame([(run_pk, upload, agent, False)], "run_pk long, upload_fk long, agent_fk int, success boolean")
    return runs.unionByName(row, allowMissingColumns=True)


def ended_run(runs: DataFrame, run_pk: int, success: bool = True) -> DataFrame:
    """The run table with a run's result."""
    return runs.withColumn("success", F.when(F.col("run_pk") == run_pk, F.lit(success)).otherwise(F.col("success")))
