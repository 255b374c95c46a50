"""Structured Streaming: calls for arriving entities with a fixed threshold, and a run ledger by windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_ledger(events: DataFrame, time: str = "ts", late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Per window and status: rows, mean and largest value.  The watermark bounds the state that is held."""
    return events.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), "event_type").agg(
        F.count("*").alias("n"), F.avg("value").alias("mean"), F.max("value").alias("most")).select(F.col("w.start").alias("start"), "event_type", "n", "mean", "most")


def scored_stream(counts: DataFrame, model, path: str, checkpoint: str):
    """Writes predictions of every micro-batch of complete cells (cell, gene, count); the model is frozen, so batches do not influence each other.

    model: a fitted detector, or the folder of a saved one, from which a restarted stream goes on.
    """
    if isinstance(model, str):
        from countloom.plans.detector import Detector

        model = Detector.load(counts.sparkSession, model)

    def one(batch: DataFrame, number: int) -> None:
        model.predict(batch).withColumn("batch", F.lit(number)).write.mode("append").parquet(path)

    return counts.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
