"""Ranks, empirical distribution functions, tails and thresholds.

Whole-table ranks go through counts of distinct values: values are aggregated, the running sum is over their counts only,
and rows get their rank back by a join on the value, so no task sorts all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from countloom.functions.running import numbered, running_sums
from countloom.functions.scalars import clip, finite


def value_counts(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Per distinct value: rows with it, rows up to it, all rows, distinct values."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_c"))
    whole = counts.groupBy(*by).agg(F.sum("_c").alias("_n"), F.count("*").alias("_distinct"))
    summed = running_sums(counts, value, {"_upto": "_c"}, by)
    return summed.join(whole, by) if by else summed.crossJoin(F.broadcast(whole))  # one row


def percentile_rank(df: DataFrame, value: str, out: str, by: list[str] | None = None, constant: float = 0.5) -> DataFrame:
    """Average rank over n; missing and non-finite values take the median first; a constant column ranks to `constant`."""
    by = by or []
    kept = df
    df = df.withColumn("_x", finite(F.col(value)))
    middle = df.groupBy(*by).agg(F.expr("percentile(_x, 0.5)").alias("_m"))
    filled = (df.join(middle, by, "left") if by else df.crossJoin(F.broadcast(middle))).withColumn("_v", F.coalesce("_x", "_m", F.lit(0.0)))
    counts = value_counts(filled, "_v", by).select(
        *by, "_v", F.when(F.col("_distinct") == 1, F.lit(constant)).otherwise((F.col("_upto") - (F.col("_c") - 1) / 2) / F.col("_n")).alias(out))
    return filled.join(counts, [*by, "_v"], "left").select(*(c for c in kept.columns if c != out), out)


def empirical(df: DataFrame, value: str, out: str) -> DataFrame:
    """Average percentile of known values; missing ones 0.5; NULL throughout if all are missing."""
    counts = value_counts(df, value, []).select(value, ((F.col("_upto") - (F.col("_c") - 1) / 2) / F.col("_n")).alias("_r"))
    known = df.agg(F.max(F.col(value).isNotNull()).alias("_k"))
    joined = df.join(counts, value, "left").crossJoin(F.broadcast(known))  # one row
    return joined.withColumn(out, F.when(F.col("_k"), F.coalesce("_r", F.lit(0.5)))).drop("_r", "_k")


def tail(rank: Column, start: float = 0.5) -> Column:
    return clip((rank - start) / (1 - start), 0.0, 1.0)


def reference_ecdf(df: DataFrame, value: str, reference: DataFrame, ref_value: str, out: str) -> DataFrame:
    """Share of reference values up to each value.  Values of both sides are merged; the running sum is over distinct values."""
    ref = reference.filter(F.col(ref_value).isNotNull()).groupBy(F.col(ref_value).alias("_v")).agg(F.count("*").alias("_c"))
    own = df.select(F.col(value).alias("_v")).distinct().withColumn("_c", F.lit(0).cast("long"))
    both = ref.unionByName(own).groupBy("_v").agg(F.sum("_c").alias("_c"))
    whole = ref.agg(F.sum("_c").alias("_n"))
    ranks = running_sums(both.filter("_v IS NOT NULL"), "_v", {"_upto": "_c"}, []).crossJoin(F.broadcast(whole))  # one row
    ranks = ranks.select("_v", (F.col("_upto") / F.col("_n")).alias(out))
    return df.join(ranks, df[value] == ranks["_v"], "left").drop("_v")


def top_rank(df: DataFrame, score: str, key: str, out: str, by: list[str] | None = None) -> DataFrame:
    return numbered(df, score, key, out, by or [])


def coarse_bin(df: DataFrame, value: str, key: str, out: str, by: list[str] | None = None, bins: int = 5) -> DataFrame:
    """Position of the value, ties by key, cut into bins; -1 for missing values."""
    by = by or []
    known = F.col(value).isNotNull()
    whole = df.groupBy(*by).agg(F.count(value).alias("_n"))
    rows = numbered(df, value, key, "_place", by, descending=False)
    rows = rows.join(whole, by) if by else rows.crossJoin(F.broadcast(whole))  # one row
    place = F.col("_place") / F.col("_n")
    return rows.withColumn(out, F.when(known, F.least(F.floor(place * bins), F.lit(bins - 1))).otherwise(-1).cast("int")).drop("_place", "_n")


def expected_rate_threshold(df: DataFrame, score: str, rate: float) -> DataFrame:
    """One row: the value at place floor((n - 1) * (1 - rate)) of the rising finite scores, found over counts of values.

    Without any finite score the query fails, as there is nothing to cut.
    """
    if not 0 < rate < 1:
        raise ValueError("rate lies between 0 and 1")
    known = df.select(finite(F.col(score)).alias(score)).filter(F.col(score).isNotNull())
    counts = value_counts(known, score, []).drop("_n")
    total = known.agg(F.count("*").alias("_n")).select(F.when(F.col("_n") > 0, F.col("_n")).otherwise(F.raise_error("no finite scores to cut").cast("long")).alias("_n"))
    place = F.floor((F.col("_n") - 1) * F.lit(1.0 - rate)) + 1
    return total.join(counts, (F.col("_upto") >= place) & (F.col("_upto") - F.col("_c") < place), "left").select(F.col(score).alias("threshold"))  # total is one row


def auto_threshold(df: DataFrame, score: str) -> DataFrame:
    """median + 3 * 1.4826 * MAD, or the 0.95 quantile where that reaches the largest score; cut to 0 to 1; 1 without scores."""
    known = df.select(finite(F.col(score)).alias("_s")).filter("_s IS NOT NULL")
    first = known.agg(F.expr("percentile(_s, array(0.5, 0.95))").alias("_q"), F.max("_s").alias("_high"))
    second = known.crossJoin(F.broadcast(first)).agg(  # one row
        F.expr("percentile(abs(_s - _q[0]), 0.5)").alias("mad"), F.first("_q").alias("_q"), F.first("_high").alias("_high"))
    raw = F.col("_q")[0] + 3 * 1.4826 * F.col("mad")
    return second.select(F.coalesce(clip(F.when(raw >= F.col("_high"), F.col("_q")[1]).otherwise(raw), 0.0, 1.0), F.lit(1.0)).alias("threshold"))
