"""Shared storage that the session names."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Takes spark.checkpoint.dir; a temporary folder only where the session names none and its master is local, as in tests."""
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        found = spark.conf.get("spark.checkpoint.dir", None)
        if not found:
            if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            found = tempfile.mkdtemp(prefix="countloom-")
            atexit.register(shutil.rmtree, found, True)
        spark.sparkContext.setCheckpointDir(found)


def cut(df: DataFrame) -> DataFrame:
    """df computed once into the shared checkpoint folder: what is built on it does not repeat its plan."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def removed(spark: SparkSession, path: str) -> None:
    try:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # noqa: BLE001  at the end the session may have ended first
        pass


def written(df: DataFrame, by: str | None = None) -> DataFrame:
    """df as a table in the shared folder, read back; with `by`, in a folder for each of its values, so that a filter reads one.

    For long iterations: a checkpoint keeps the sizes that the optimiser guessed, and those of joins multiply from round to
    round, while a table has the size of its files.  dropped() removes it, at the latest the end of the driver.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext._jsc.sc().getCheckpointDir().get()
    path = f"{base.rstrip('/')}/countloom/table-{uuid.uuid4().hex}"
    atexit.register(removed, spark, path)
    writer = df.write.option("compression", "snappy")
    (writer.partitionBy(by) if by else writer).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Removes what written() wrote, once everything that reads it is written itself."""
    for df in tables:
        removed(df.sparkSession, df._written_at)
