"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows are handed to Python in batches of at most so many rows and about so many bytes, which bounds the
#: memory of a worker and of the JVM's Arrow buffers (a longer row is a batch of its own).
ROWS_PER_BATCH, BYTES_PER_BATCH = 1000, 4 << 20

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; where it is unset (local tests), a folder of our own."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found
    app, master = spark.sparkContext.applicationId, spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="ledgerline-")
    return _own[app]


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of df, written as Parquet in the shared folder and read again.

    This cuts the lineage: a lost executor costs only the tasks that read the files. The files stay until
    forget() or clear() removes them, as checkpoint files of a cluster do.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/ledgerline/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def forget(*tables: DataFrame) -> None:
    """Deletes written() tables that nothing reads any more: all that was made of them has been written in turn."""
    for df in tables:
        _delete(df.sparkSession, df._written_to)


def clear(spark: SparkSession) -> None:
    """Deletes all written() tables of this application, when its results have been used."""
    _delete(spark, f"{shared_dir(spark)}/ledgerline/{spark.sparkContext.applicationId}")


def small_batches(spark: SparkSession) -> None:
    """Bounds the rows and bytes of an Arrow batch, so that long texts don't fill a worker's memory."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BYTES_PER_BATCH)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ROWS_PER_BATCH)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of a data folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


#: Rows of a few numbers each that may be broadcast (about 50 MB); beyond them joins shuffle.
BROADCAST_ROWS = 1_000_000


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df, which must be cheap to count and narrow, with a broadcast hint if it has at most ``rows`` rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
