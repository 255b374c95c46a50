"""The ledger of runs: rows appended and finished, and estimates from what has run before."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# States of a run that count as done.
DONE = ("SUCCESS", "COMPLETED", "PASS")


def appended(path: str, rows: DataFrame) -> None:
    """Rows added to the ledger at path: Spark's commit protocol makes them visible all at once or not at all."""
    rows.write.mode("append").parquet(path)


def finished(ledger: DataFrame, ended: DataFrame, keys: list[str]) -> DataFrame:
    """ended (keys, end_time, status) as rows of the ledger: the start of each comes from its last open row; a run that never began is an error."""
    w = W.partitionBy(*keys).orderBy(F.desc("start_time"))
    begun = ledger.filter("end_time IS NULL").withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r", "end_time", "status", "elapsed_seconds")
    joined = ended.join(begun, keys, "left")
    if not joined.filter("start_time IS NULL").isEmpty():
        raise ValueError("a run ended that never began")
    return joined.withColumn("elapsed_seconds", F.unix_micros("end_time") / 1e6 - F.unix_micros("start_time") / 1e6).select(*ledger.columns)


def estimates(tasks: DataFrame, runs: DataFrame, order: list[str], last: int = 20, least: int = 2) -> DataFrame:
    """Per task (stage, method, cells): median seconds of the last runs that are like it, on what they rest, and how many.

    Runs count that are done, not read from a cache and took some time.  Of the last `last` of the stage and method those of half to
    twice the size come first, then all of them, then the last of the stage; each needs `least` runs.
    """
    good = runs.filter(F.upper("status").isin(*DONE) & ~F.coalesce("cached", F.lit(False)) & (F.col("elapsed") > 0))
    recent = [F.desc(c) for c in order]
    own = good.withColumn("_p", F.row_number().over(W.partitionBy("stage", "method").orderBy(*recent))).filter(F.col("_p") <= last)
    stage = good.withColumn("_p", F.row_number().over(W.partitionBy("stage").orderBy(*recent))).filter(F.col("_p") <= last)
    near = F.col("_c").between(0.5 * F.col("cells"), 2 * F.col("cells"))
    by_method = tasks.join(own.select("stage", "method", F.col("cells").alias("_c"), "elapsed"), ["stage", "method"]).groupBy("stage", "method", "cells").agg(
        F.expr("percentile(elapsed, 0.5)").alias("m"), F.count("*").alias("n"), F.percentile(F.when(near, F.col("elapsed")), 0.5).alias("mn"), F.count_if(near).alias("nn"))
    by_stage = stage.groupBy("stage").agg(F.expr("percentile(elapsed, 0.5)").alias("ms"), F.count("*").alias("ns"))
    joined = tasks.join(by_method, ["stage", "method", "cells"], "left").join(by_stage, "stage", "left")
    first, second, third = (F.coalesce(c, F.lit(0)) >= least for c in ("nn", "n", "ns"))
    pick = lambda a, b, c, z: F.when(first, a).when(second, b).when(third, c).otherwise(z)
    return joined.select(
        "stage", "method", pick(F.col("mn"), F.col("m"), F.col("ms"), F.lit(None)).alias("seconds"), pick(F.lit("similar_size"), F.lit("same_method"), F.lit("stage"), F.lit("insufficient_history")).alias("basis"),
        pick(F.col("nn"), F.col("n"), F.col("ns"), F.coalesce("ns", F.lit(0))).alias("observations"))
