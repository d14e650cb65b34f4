"""Intermediate tables of iterative operators, in a folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_local: dict[str, str] = {}


def _one_machine(spark: SparkSession) -> bool:
    """Whether driver and executors are one process, which may use a folder of the machine."""
    master = spark.sparkContext.master
    return master == "local" or master.startswith("local[")


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; a folder of this run where it is unset, as in tests."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not _one_machine(spark):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        app = spark.sparkContext.applicationId
        if app not in _local:
            _local[app] = tempfile.mkdtemp(prefix="ledgerline-")
            atexit.register(shutil.rmtree, _local[app], ignore_errors=True)
        found = _local[app]
    return found


def clear(spark: SparkSession) -> None:
    """Deletes the intermediate tables of this application, when its results have been used."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/core/{spark.sparkContext.applicationId}")
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def settled(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet and read again: cuts the lineage, and survives the loss of executors."""
    path = f"{shared_folder(df.sparkSession)}/core/{df.sparkSession.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._settled_at = path
    return out


def still_there(df: DataFrame) -> bool:
    """Whether the files of a settled() table have not been cleared."""
    folder = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._settled_at)
    return folder.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).exists(folder)


#: Rows of a few short values each that are few enough to be broadcast.
FEW_ROWS = 10_000


def broadcast_if_few(df: DataFrame, rows: int = FEW_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most ``rows`` rows: a join on a key of few values would else make one task a value."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
