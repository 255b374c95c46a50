"""Median-based location and scale, whole or by group, with the fallbacks of each variant."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAD, TINY = 1.4826, 1e-12


def statistics(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Per group: n, med, mad (unscaled), q25, q75, std (ddof 0).  Two aggregations; only group rows are joined."""
    v = F.col(value)
    first = df.groupBy(*by).agg(
        F.count(v).alias("n"), F.expr(f"percentile({value}, 0.5)").alias("med"),
        F.expr(f"percentile({value}, 0.25)").alias("q25"), F.expr(f"percentile({value}, 0.75)").alias("q75"), F.stddev_pop(v).alias("std"))
    joined = df.join(first, by) if by else df.crossJoin(F.broadcast(first))  # one row
    second = joined.withColumn("_d", F.abs(v - F.col("med"))).groupBy(*by).agg(F.expr("percentile(_d, 0.5)").alias("mad"))
    return first.join(second, by) if by else first.crossJoin(F.broadcast(second))


def scale_of(variant: str):
    """Column of the scale from statistics().  r1: IQR before deviation; r2-r5: deviation; 1 at last."""
    mad, std = MAD * F.col("mad"), F.col("std")
    last = F.when(std > TINY, std).otherwise(1.0)
    if variant == "r1":
        iqr = (F.col("q75") - F.col("q25")) / 1.349
        return F.when(mad > TINY, mad).when(F.col("q75") > F.col("q25"), iqr).otherwise(last)
    if variant == "r2":
        return F.when(mad > TINY, mad).otherwise(last)
    return F.when(F.col("mad") > 0, mad).when(std > 0, std).otherwise(1.0)


def robust_z(df: DataFrame, value: str, by: list[str], out: str, variant: str = "r1") -> DataFrame:
    stats = statistics(df, value, by).select(*by, F.col("med").alias("_med"), scale_of(variant).alias("_scale"))
    joined = df.join(stats, by, "left") if by else df.crossJoin(F.broadcast(stats))
    return joined.withColumn(out, (F.col(value) - F.col("_med")) / F.col("_scale")).drop("_med", "_scale")


def z_with_fallback(df: DataFrame, value: str, by: list[str], out: str, variant: str = "r2", reference: DataFrame | None = None) -> DataFrame:
    """z against the reference's group, or against the whole reference for groups it does not have."""
    ref = df if reference is None else reference
    group = statistics(ref, value, by).select(*by, F.col("med").alias("_gm"), scale_of(variant).alias("_gs"))
    whole = statistics(ref, value, []).select(F.col("med").alias("_wm"), scale_of(variant).alias("_ws"))
    joined = df.join(group, by, "left").crossJoin(F.broadcast(whole))  # one row
    return joined.withColumn(out, (F.col(value) - F.coalesce("_gm", "_wm")) / F.coalesce("_gs", "_ws")).drop("_gm", "_gs", "_wm", "_ws")


def z_by_chain(df: DataFrame, value: str, chain: list[list[str]], names: list[str], out: str, level: str, reference: DataFrame, variant: str = "r1") -> DataFrame:
    """z against the first group of the chain that the reference has, the whole reference at last, and which it was (names: one for each and for the whole)."""
    joined = df
    for at, by in enumerate(chain):
        joined = joined.join(statistics(reference, value, by).select(*by, F.col("med").alias(f"_m{at}"), scale_of(variant).alias(f"_s{at}")), by, "left")
    whole = statistics(reference, value, []).select(F.col("med").alias("_m"), scale_of(variant).alias("_s"))
    joined = joined.crossJoin(F.broadcast(whole))  # one row
    known = [f"_m{at}" for at in range(len(chain))]
    which = F.coalesce(*(F.when(F.col(c).isNotNull(), n) for c, n in zip(known, names)), F.lit(names[-1]))
    scales = [F.col(f"_s{at}") for at in range(len(chain))]
    return joined.withColumns({out: (F.col(value) - F.coalesce(*known, "_m")) / F.coalesce(*scales, F.col("_s")), level: which}).select(*df.columns, out, level)
