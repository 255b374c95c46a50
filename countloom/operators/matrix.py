"""Sparse counts as rows (cell, gene, count), count > 0: totals, normalising, gene statistics, filters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from countloom.functions.scalars import clip, safe_divide


def cell_totals(counts: DataFrame) -> DataFrame:
    return counts.groupBy("cell").agg(F.sum("count").alias("n_count"), F.count_if(F.col("count") > 0).alias("n_feature"))


def gene_totals(counts: DataFrame) -> DataFrame:
    return counts.groupBy("gene").agg(F.sum("count").alias("total"), F.count_if(F.col("count") > 0).alias("n_cells"))


def log_normalised(counts: DataFrame, target: float = 1e4) -> DataFrame:
    """log1p(count * target / total of the cell); the totals are aggregated on the key that the join uses."""
    totals = counts.groupBy("cell").agg(F.sum("count").alias("_t"))
    return counts.join(totals, "cell").select("cell", "gene", F.log1p(safe_divide(F.col("count") * target, F.col("_t"))).alias("value"))


def prefix_fraction(counts: DataFrame, prefixes: list[str], out: str) -> DataFrame:
    hit = F.lit(False)
    for p in prefixes:
        hit = hit | F.col("gene").startswith(p)
    sums = counts.groupBy("cell").agg(F.sum(F.when(hit, F.col("count")).otherwise(0.0)).alias("_h"), F.sum("count").alias("_t"))
    return sums.select("cell", safe_divide(F.col("_h"), F.col("_t")).alias(out))


def gene_moments(values: DataFrame, n_cells: DataFrame) -> DataFrame:
    """Mean and variance over all cells, zeros included; n_cells: one row, column n."""
    sums = values.groupBy("gene").agg(F.sum("value").alias("_s"), F.sum(F.col("value") ** 2).alias("_q")).crossJoin(F.broadcast(n_cells))
    mean = F.col("_s") / F.col("n")
    return sums.select("gene", mean.alias("mean"), F.greatest(F.col("_q") / F.col("n") - mean * mean, F.lit(0.0)).alias("variance"))


def stable_gene_score(counts: DataFrame, cells: DataFrame, top: int = 100) -> DataFrame:
    """log1p of a cell's counts over the `top` expressed genes of smallest coefficient of variation, ties by gene; 0 for cells without any.  cells: cell."""
    n_cells = cells.agg(F.count("*").alias("n"))
    moments = gene_moments(counts.withColumnRenamed("count", "value"), n_cells).filter("mean > 0")
    chosen = moments.withColumn("cv", F.sqrt("variance") / F.col("mean")).orderBy("cv", "gene").limit(top).select("gene")
    sums = counts.join(F.broadcast(chosen), "gene", "left_semi").groupBy("cell").agg(F.sum("count").alias("_s"))  # `top` genes at most
    return cells.select("cell").join(sums, "cell", "left").select("cell", F.log1p(F.coalesce("_s", F.lit(0.0))).alias("stable"))


def marker_dosage(counts: DataFrame, cells: DataFrame, top: int = 25) -> DataFrame:
    """log1p sum of a cell's counts over its cluster's markers; 0 for cells without any.

    Markers are the genes whose mean normalised value (log_normalised) in the cluster exceeds the whole mean most, ties by gene.
    """
    values = log_normalised(counts).join(cells.select("cell", "cluster"), "cell")
    sizes = cells.groupBy("cluster").agg(F.count("*").alias("_nc"))
    n = cells.agg(F.count("*").alias("_n"))
    # sums by cluster and gene give those by gene
    sums = values.groupBy("cluster", "gene").agg(F.sum("value").alias("_s"))
    whole = sums.groupBy("gene").agg(F.sum("_s").alias("_g")).crossJoin(F.broadcast(n)).select("gene", (F.col("_g") / F.col("_n")).alias("_gm"))
    per = sums.join(sizes, "cluster").join(whole, "gene")
    ranked = per.withColumn("_d", F.round(F.col("_s") / F.col("_nc") - F.col("_gm"), 9))
    ranked = ranked.withColumn("_r", F.row_number().over(W.partitionBy("cluster").orderBy(F.desc("_d"), "gene"))).filter(F.col("_r") <= top)
    found = counts.join(cells.select("cell", "cluster"), "cell").join(ranked.select("cluster", "gene"), ["cluster", "gene"], "left_semi")
    sums = found.groupBy("cell").agg(F.sum("count").alias("_m"))
    return cells.select("cell").join(sums, "cell", "left").select("cell", F.log1p(F.coalesce("_m", F.lit(0.0))).alias("marker_dosage"))


def low_quality(totals: DataFrame, n_genes: DataFrame, min_counts: float = 500, max_mito: float = 0.3, min_genes: float = 200) -> DataFrame:
    """totals: cell, n_count, n_feature, mito.  The largest of three clipped shortfalls, and whether the cell passes."""
    least = F.least(F.lit(float(min_genes)), F.greatest(F.lit(1.0), F.ceil(0.1 * F.col("n")).cast("double")))
    joined = totals.crossJoin(F.broadcast(n_genes)).withColumn("_least", least)
    short = lambda value, bound: clip(1 - safe_divide(value, bound, 1.0), 0.0, 1.0)
    over = clip(safe_divide(F.col("mito") - max_mito, F.lit(1.0 - max_mito)), 0.0, 1.0)
    return joined.select(
        "cell", F.greatest(short(F.col("n_count"), F.lit(float(min_counts))), short(F.col("n_feature"), F.col("_least")), over).alias("low_quality"),
        ((F.col("n_count") >= min_counts) & (F.col("n_feature") >= F.col("_least")) & (F.col("mito") <= max_mito)).alias("passes"))


def passing_or_all(scored: DataFrame, least: int = 2) -> DataFrame:
    """Rows that pass; all rows if fewer than `least` do (one row that passes alone is enough)."""
    enough = scored.agg(F.count_if("passes").alias("_p"), F.count("*").alias("_n"))
    few = F.col("_p") < F.least(F.lit(least), F.col("_n"))
    return scored.crossJoin(F.broadcast(enough)).filter(few | F.col("passes")).drop("_p", "_n")


def non_zero(counts: DataFrame) -> DataFrame:
    """Without cells and genes whose sum is not a positive finite number."""
    good = counts.filter(F.col("count").isNotNull() & ~F.isnan("count") & (F.abs("count") != float("inf")))
    keep = lambda k: good.groupBy(k).agg(F.sum("count").alias("_s")).filter("_s > 0").select(k)
    return good.join(keep("cell"), "cell", "left_semi").join(keep("gene"), "gene", "left_semi")


def high_count_mask(cells: DataFrame, value: str = "log_count", q: float = 0.9) -> DataFrame:
    """Cells at or above their cluster's linear quantile."""
    bound = cells.groupBy("cluster").agg(F.expr(f"percentile({value}, {q})").alias("_b"))
    return cells.join(bound, "cluster").withColumn("high", F.col(value) >= F.col("_b")).drop("_b")


def aligned(counts: DataFrame, genes: DataFrame) -> DataFrame:
    """Counts over the reference's genes only; raises if a reference gene is missing."""
    missing = genes.join(counts.select("gene").distinct(), "gene", "left_anti").limit(1).count()
    if missing:
        raise ValueError("genes of the reference are missing")
    return counts.join(genes, "gene", "left_semi")


def require_valid(counts: DataFrame, cells: DataFrame, min_cells: int = 20, min_genes: int = 10, fractional: float = 0.05) -> None:
    """Raises unless ids are unique, counts finite, not negative and nearly whole, and the table is large enough."""
    c = counts.agg(
        F.count_distinct("gene").alias("genes"), F.count_if(F.col("count").isNull() | F.isnan("count") | (F.abs("count") == float("inf"))).alias("bad"),
        F.count_if(F.col("count") < 0).alias("negative"), F.avg((F.abs(F.col("count") - F.rint("count")) > 1e-6).cast("double")).alias("fraction")).first()
    n = cells.agg(F.count("*").alias("n"), F.count_distinct("cell").alias("d")).first()
    for failed, why in (
        (n["n"] != n["d"], "cell ids repeat"), (n["n"] < min_cells, f"fewer than {min_cells} cells"), (c["genes"] < min_genes, f"fewer than {min_genes} genes"),
        (c["bad"], "counts are missing or not finite"), (c["negative"], "counts are negative"), ((c["fraction"] or 0) > fractional, "counts are not whole numbers")):
        if failed:
            raise ValueError(why)


def optional_filter(totals: DataFrame, n_genes: DataFrame, min_counts: float | None = None, min_genes: float | None = None, max_mito: float | None = None) -> DataFrame:
    """totals without the cells that miss a given bound (passing_or_all); all of them where no bound is given."""
    if min_counts is None and min_genes is None and max_mito is None:
        return totals
    scored = totals.join(low_quality(totals, n_genes, 1 if min_counts is None else min_counts, 1.0 if max_mito is None else max_mito, 1 if min_genes is None else min_genes), "cell")
    return passing_or_all(scored).select(*totals.columns)
