"""Manifests of runs and outputs, completion by hash, and the synthetic fixture."""

from __future__ import annotations

import hashlib
import json
import platform

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def config_hash(config: dict) -> str:
    return hashlib.sha256(json.dumps(config, sort_keys=True, default=str).encode()).hexdigest()


def output_manifest(spark: SparkSession, root: str) -> DataFrame:
    """path, bytes and sha256 of every file below root; the files are read by the executors."""
    read = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return read.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def write_run(df: DataFrame, path: str, config: dict, command: str = "") -> None:
    """df as Parquet at path/data, then its marker at path/done: a run without a marker, or with another hash, counts as not done."""
    spark = df.sparkSession
    df.write.mode("overwrite").parquet(f"{path}/data")
    row = (config_hash(config), json.dumps(config, sort_keys=True, default=str), command, spark.version, platform.python_version(), spark.read.parquet(f"{path}/data").count())
    spark.createDataFrame([row], "config_hash string, config string, command string, spark string, python string, rows long").coalesce(1).write.mode("overwrite").parquet(f"{path}/done")


def resumed(spark: SparkSession, path: str, config: dict) -> DataFrame | None:
    """The table of a run that ended with this very config and still has all its rows, else None."""
    marker = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/done/_SUCCESS")
    if not marker.getFileSystem(spark._jsc.hadoopConfiguration()).exists(marker):
        return None
    done = spark.read.parquet(f"{path}/done").first()
    if done is None or done["config_hash"] != config_hash(config):
        return None
    data = spark.read.parquet(f"{path}/data")
    return data if data.count() == done["rows"] else None


def fixture(spark: SparkSession, cells: int, genes: int, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(counts, cells) of made data: four clusters by place, gamma baselines with a block of raised genes each, lognormal libraries, Poisson counts, every 17th cell labelled."""
    rng = np.random.default_rng(seed)
    base = rng.gamma(1.2, 0.8, genes)
    library = rng.lognormal(0.0, 0.35, cells)
    raised = np.ones((4, genes))
    for c in range(4):
        raised[c, c * genes // 4 : (c + 1) * genes // 4 : 2] = 3.0
    x = rng.poisson(base * raised[np.arange(cells) % 4] * library[:, None])
    rows = [(f"cell_{i:05d}", f"gene_{j:05d}", float(x[i, j])) for i, j in zip(*np.nonzero(x))]
    meta = [(f"cell_{i:05d}", f"cluster_{i % 4}", int(i % 17 == 0)) for i in range(cells)]
    return spark.createDataFrame(rows, "cell string, gene string, count double"), spark.createDataFrame(meta, "cell string, cluster string, label int")
