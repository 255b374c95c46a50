"""Real streams: windows with a watermark, and a frozen model over arriving cells."""

import datetime

from pyspark.sql import functions as F

from countloom.streaming import scoring

EVENTS = "ts timestamp, event_type string, value double"


def test_windows_close_behind_the_watermark(spark, tmp_path):
    at = lambda h, m: datetime.datetime(2024, 1, 1, h, m)
    source = str(tmp_path / "in")
    # one file a batch; the first event of the last comes two batches after the watermark has closed its window
    for rows in ([(at(0, 5), "a", 1.0), (at(0, 50), "a", 3.0), (at(0, 20), "b", 7.0)], [(at(3, 0), "a", 5.0)], [(at(5, 0), "a", 6.0)], [(at(0, 30), "a", 99.0), (at(9, 0), "c", 0.0)]):
        spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(source)
    query = scoring.windowed_ledger(stream).writeStream.outputMode("append").format("memory").queryName("ledger").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert query.exception() is None
    got = {(r["start"].hour, r["event_type"]): (r["n"], r["mean"], r["most"]) for r in spark.table("ledger").collect()}
    assert got[0, "b"] == (1, 7.0, 7.0) and got[0, "a"] == (2, 2.0, 3.0) and (9, "c") not in got


class Totals:
    """A frozen model: a cell's total and whether it is above a threshold."""

    def predict(self, counts):
        return counts.groupBy("cell").agg(F.sum("count").alias("total")).withColumn("called", F.col("total") > 5)


def test_batches_are_scored_on_their_own(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "cell string, gene string, count double"
    for rows in ([("a", "g", 4.0), ("a", "h", 3.0), ("b", "g", 1.0)], [("c", "g", 9.0)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    query = scoring.scored_stream(stream, Totals(), out, str(tmp_path / "c"))
    query.awaitTermination(120)
    rows = spark.read.parquet(out).collect()
    assert {(r["cell"], r["total"], r["called"]) for r in rows} == {("a", 7.0, True), ("b", 1.0, False), ("c", 9.0, True)} and {r["batch"] for r in rows} == {0, 1}
