"""Operating points of several methods at once: fixed budget and matched recalls, with every rate at each point."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from countloom.functions.scalars import CLASSES, finite

# The budget and the recalls of the points.
BUDGET = 0.2
OVERALL = (0.5, 0.7, 0.8, 0.9)
HOMOTYPIC = (0.5, 0.7, 0.8)
#: Point whose false rate is the primary metric.
PRIMARY = ("matched_homotypic_recall", 0.5)


def _points(spark) -> DataFrame:
    rows = [("fixed_candidate_fraction", None)]
    rows += [("matched_overall_recall", r) for r in OVERALL] + [("matched_homotypic_recall", r) for r in HOMOTYPIC]
    return spark.createDataFrame(rows, "type string, target double")


def ranked(scores: DataFrame) -> DataFrame:
    """scores (method, cell, score, label, high) with rank (score falling, missing last, then cell) and running counts of each kind."""
    rows = scores.withColumn("score", finite(F.col("score"))).withColumn("high", F.coalesce("high", F.lit(False)))
    order = W.partitionBy("method").orderBy(F.desc_nulls_last("score"), "cell")
    running = order.rowsBetween(W.unboundedPreceding, 0)
    kinds = {"hom": F.col("label") == CLASSES[2], "het": F.col("label") == CLASSES[3], "rna": F.col("high")}
    return rows.withColumn("rank", F.row_number().over(order)).withColumns({f"up_{k}": F.count_if(F.coalesce(c, F.lit(False))).over(running) for k, c in kinds.items()})


def operating_table(scores: DataFrame) -> DataFrame:
    """One row per method and point; NOT_AVAILABLE without finite scores, without the rows to recall, or without high-count singlets.

    The prefix of a point is the shortest that holds ceil(recall * positives) of them, or rint(BUDGET * rows) rows.
    """
    rows = ranked(scores)
    totals = rows.groupBy("method").agg(
        F.count("*").alias("n_cells"), F.max("up_hom").alias("n_hom"), F.max("up_het").alias("n_het"), F.max("up_rna").alias("n_high"), F.count("score").alias("known"))
    grid = totals.crossJoin(F.broadcast(_points(scores.sparkSession)))  # eight points
    wanted = F.when(F.col("type") == "matched_overall_recall", F.ceil(F.col("target") * (F.col("n_hom") + F.col("n_het")) - 1e-12)).when(
        F.col("type") == "matched_homotypic_recall", F.ceil(F.col("target") * F.col("n_hom") - 1e-12)).otherwise(F.rint(BUDGET * F.col("n_cells")))
    grid = grid.withColumn("wanted", F.when(F.col("known") > 0, wanted.cast("long")))
    reached = F.when(F.col("type") == "matched_overall_recall", F.col("up_hom") + F.col("up_het")).when(F.col("type") == "matched_homotypic_recall", F.col("up_hom")).otherwise(F.col("rank"))
    # the row that brings the count to what is wanted is the last of the prefix
    own = F.when(F.col("type") == "matched_overall_recall", F.col("label").isin(*CLASSES[2:])).when(F.col("type") == "matched_homotypic_recall", F.col("label") == CLASSES[2]).otherwise(True)
    ends = rows.join(F.broadcast(grid.select("method", "type", "target", "wanted")), "method").filter((reached == F.col("wanted")) & own)
    ends = ends.select("method", "type", F.coalesce("target", F.lit(-1.0)).alias("_t"), "rank", "score", "up_hom", "up_het", "up_rna")
    joined = grid.withColumn("_t", F.coalesce("target", F.lit(-1.0))).join(ends, ["method", "type", "_t"], "left")
    selected = F.coalesce("rank", F.lit(0))
    share = lambda a, b: F.when(b > 0, F.coalesce(a, F.lit(0)) / b)
    both, n_true = F.col("up_hom") + F.col("up_het"), F.col("n_hom") + F.col("n_het")
    missing = F.when(F.col("known") == 0, "no finite scores").when((F.col("type") == "matched_overall_recall") & (n_true == 0), "no doublets").when(
        (F.col("type") == "matched_homotypic_recall") & (F.col("n_hom") == 0), "no homotypic doublets").when(F.col("n_high") == 0, "no high-count singlets").otherwise("")
    return joined.select(
        "method", "type", "target", selected.cast("long").alias("selected"), share(selected, F.col("n_cells")).alias("fraction"),
        F.when(F.col("rank").isNotNull(), F.coalesce("score", F.lit(float("-inf")))).alias("threshold"), F.when(selected > 0, both / selected).alias("precision"),
        share(both, n_true).alias("overall_recall"), share(F.col("up_hom"), F.col("n_hom")).alias("homotypic_recall"), share(F.col("up_het"), F.col("n_het")).alias("heterotypic_recall"),
        share(F.col("up_rna"), F.col("n_high")).alias("fpr"), "n_cells", n_true.alias("n_true"), "n_hom", "n_het", "n_high", F.coalesce("up_rna", F.lit(0)).alias("n_selected_high"),
        F.when(missing == "", "SUCCESS").otherwise("NOT_AVAILABLE").alias("status"), missing.alias("message"))


def metric_bundle(scores: DataFrame) -> DataFrame:
    """Per method: the primary false rate (half of the homotypic recalled), those of the other points and of the budget of true doublets."""
    table = operating_table(scores)
    primary = (F.col("type") == PRIMARY[0]) & (F.col("target") == PRIMARY[1])
    at = lambda c, kind, target=None: F.max(F.when((F.col("type") == kind) & (F.lit(True) if target is None else F.col("target") == target), F.col(c)))
    points = table.groupBy("method").agg(
        F.max(F.when(primary, F.col("fpr"))).alias("fpr"), F.max(F.when(primary, F.col("status"))).alias("status"), F.max(F.when(primary, F.col("message"))).alias("reason"),
        at("fpr", "matched_homotypic_recall", 0.7).alias("fpr_70"), at("fpr", "matched_homotypic_recall", 0.8).alias("fpr_80"), at("fpr", "fixed_candidate_fraction").alias("fpr_fixed"),
        F.max(F.when(primary, F.col("homotypic_recall"))).alias("recall"), F.max(F.when(primary, F.col("fraction"))).alias("fraction"), F.max(F.when(primary, F.col("selected"))).alias("selected"))
    rows = ranked(scores)
    totals = rows.groupBy("method").agg((F.max("up_hom") + F.max("up_het")).alias("budget"), F.max("up_rna").alias("_h"), F.count("score").alias("_k"))
    last = rows.join(F.broadcast(totals), "method").filter("rank = budget AND _k > 0").select("method", "up_rna")
    history = totals.join(last, "method", "left").select("method", "budget", F.when((F.col("_h") > 0) & (F.col("budget") > 0), F.col("up_rna") / F.col("_h")).alias("fpr_budget"))
    return points.join(history, "method")


def true_budget(scores: DataFrame) -> DataFrame:
    """Per method: the rows of largest score, as many as there are doublets, their threshold and false rate; missing scores last, ties by cell."""
    rows = ranked(scores)
    totals = rows.groupBy("method").agg((F.max("up_hom") + F.max("up_het")).alias("_n"), F.max("up_rna").alias("_h"), F.count("*").alias("_m"))
    last = rows.join(F.broadcast(totals), "method").filter("rank = _n").select("method", "score", "up_rna")  # one row a method
    joined = totals.join(last, "method", "left")
    fine = (F.col("_h") > 0) & (F.col("_n") > 0)
    return joined.select(
        "method", F.col("score").alias("threshold"), F.col("_n").alias("selected"), (F.col("_n") / F.col("_m")).alias("fraction"), F.col("_h").alias("n_high"), F.coalesce("up_rna", F.lit(0)).alias("n_selected_high"),
        F.when(fine, F.col("up_rna") / F.col("_h")).alias("fpr"), F.when(fine, "AVAILABLE").otherwise("NOT_AVAILABLE").alias("status"))
