"""Running sums and row numbers over a whole table, range by range.

A window without partition sorts all rows in one task.  Here values are cut into ranges at approximate quantiles, which one
aggregation finds; rows are numbered or summed inside their range, and each range adds what lies before it.  Equal values
share a range, so results are exact whatever the cuts.
"""

from __future__ import annotations

from math import inf, isfinite

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Ranges that values are cut into, at most.
RANGES = 64


def known(value: str) -> Column:
    """value, or NULL where it is no finite number."""
    # NaN counts as above all numbers; names the value twice only, as filters repeat its whole expression
    return F.when(F.abs(F.col(value).cast("double")) < float("inf"), F.col(value))


def ranged(df: DataFrame, value: str) -> DataFrame:
    """df with _b: the number of cuts below the value; missing values have -1.  Finding the cuts is a job of its own, of RANGES numbers."""
    shares = [i / RANGES for i in range(1, RANGES)]
    row = df.select(F.percentile_approx(F.col(value).cast("double"), shares, 1000).alias("q")).first()
    cuts = sorted({c + 0.0 for c in row["q"] or [] if isfinite(c)})
    if not cuts:
        return df.withColumn("_b", F.when(F.col(value).isNull(), -1).otherwise(0))
    # a binary search that names the value once: a sum of comparisons repeats its whole expression for every cut and is too long to be compiled
    search = Bucketizer(splits=[-inf, *cuts, inf], inputCol="_at", outputCol="_b", handleInvalid="keep")
    found = search.transform(df.withColumn("_at", F.col(value).cast("double") + 0.0)).drop("_at")  # -0.0 becomes 0.0
    return found.withColumn("_b", F.when(F.col(value).isNull(), -1).otherwise(F.col("_b").cast("int")))


def _joined(df: DataFrame, offsets: DataFrame, by: list[str]) -> DataFrame:
    # without groups there are as many rows as ranges
    return df.join(offsets if by else F.broadcast(offsets), [*by, "_b"])


def running_sums(df: DataFrame, value: str, sums: dict[str, str], by: list[str], descending: bool = False) -> DataFrame:
    """df with, for every name of sums, the sum of its column over all rows up to this one in the order of value, per group; values are distinct in a group."""
    rows = ranged(df, value)
    order = (lambda c: F.desc(c)) if descending else (lambda c: F.asc(c))
    inside = W.partitionBy(*by, "_b").orderBy(order(value)).rowsBetween(W.unboundedPreceding, 0)
    before = W.partitionBy(*by).orderBy(order("_b")).rowsBetween(W.unboundedPreceding, -1)
    totals = rows.groupBy(*by, "_b").agg(*(F.sum(c).alias(f"_t_{n}") for n, c in sums.items()))
    offsets = totals.select(*by, "_b", *(F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in sums))
    out = _joined(rows.withColumns({n: F.sum(c).over(inside) for n, c in sums.items()}), offsets, by)
    return out.withColumns({n: F.col(n) + F.col(f"_o_{n}") for n in sums}).drop("_b", *(f"_o_{n}" for n in sums))


def numbered(df: DataFrame, value: str, key: str | Column, out: str, by: list[str], descending: bool = True) -> DataFrame:
    """df with out: 1, 2, ... in the order of value (falling, or rising), ties by key, missing and non-finite values last, per group."""
    rows = ranged(df.withColumn("_known", known(value)), "_known")
    place = F.when(F.col("_b") < 0, 1 << 20).otherwise(-F.col("_b") if descending else F.col("_b"))
    rows = rows.withColumn("_b", place)
    inside = W.partitionBy(*by, "_b").orderBy(F.desc_nulls_last("_known") if descending else F.asc_nulls_last("_known"), key)
    before = W.partitionBy(*by).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    offsets = rows.groupBy(*by, "_b").agg(F.count("*").alias("_t")).select(*by, "_b", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_o"))
    return _joined(rows.withColumn(out, F.row_number().over(inside)), offsets, by).withColumn(out, (F.col(out) + F.col("_o")).cast("int")).select(*(c for c in df.columns if c != out), out)
