"""Queries of the domain audit, of pairs within libraries and of residuals on covariates."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from countloom.functions import robust
from countloom.operators import domain, refinement, residuals, sampling
from countloom.plans.registry import query
from countloom.plans.storage import ensure_checkpoint_dir
from countloom.sources import tables as t


def selection(spark, sf):
    """Every purchased part of every customer as an edge; customers of a segment are the capacity of its cluster."""
    cells = t.customer_cells(spark, sf)
    parts = t.table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("gene"), "p_brand")
    e = t.purchase_counts(spark, sf).join(cells.select("cell", "cluster"), "cell").join(parts, "gene")
    edges = e.select(
        F.concat_ws("-", "cell", "gene").alias("edge"), F.concat(F.lit("c"), "cell").alias("parent_1"), F.concat(F.lit("p"), "gene").alias("parent_2"),
        domain.cluster_pair(F.col("cluster"), F.col("p_brand")).alias("pair"), "cluster")
    return domain.parent_unique_edges(edges, cells.groupBy("cluster").agg(F.count("*").alias("capacity")))


def matched(spark, sf):
    """Selected edges and customers paired by their place in each cluster: component, cell, experimental, parent_1, parent_2, pair."""
    place = lambda key: F.row_number().over(W.partitionBy("cluster").orderBy(key)).alias("_i")
    a = selection(spark, sf).filter("selected").select("cluster", "edge", "parent_1", "parent_2", "pair", place("edge"))
    both = a.join(t.customer_cells(spark, sf).select("cluster", "cell", place("cell")), ["cluster", "_i"])
    none = F.lit(None).cast("string")
    semi = both.select(F.col("edge").alias("component"), F.substring_index("edge", "-", 1).alias("cell"), F.lit(0).alias("experimental"), "parent_1", "parent_2", "pair")
    return semi.union(both.select("edge", "cell", F.lit(1), none, none, none))


@query("d20_parent_unique_edges")
def d20(spark, sf):
    return selection(spark, sf)


@query("j18_parent_block_folds")
def j18(spark, sf):
    ensure_checkpoint_dir(spark)
    return domain.parent_block_folds(matched(spark, sf).checkpoint())


@query("j17_domain_classifier")
def j17(spark, sf):
    ensure_checkpoint_dir(spark)
    rows = matched(spark, sf).checkpoint()
    with_folds = rows.join(domain.parent_block_folds(rows), "component").join(t.demo_scores(spark, sf).select("cell", "s1", "s2", "s3"), "cell")
    with_folds = with_folds.select("component", "cell", "experimental", "fold", "s1", "s2", "s3").checkpoint()
    return domain.domain_probabilities(with_folds, ["s1", "s2", "s3"], "experimental", "fold").select("component", "cell", "experimental", "fold", "p")


@query("i4_library_pairs")
def i4(spark, sf):
    return sampling.library_pairs(t.customer_cells(spark, sf), 1000, 7, 0.5)


@query("j16_regression_residual")
def j16(spark, sf):
    z = robust.robust_z(t.customer_base(spark, sf), "log_count", ["cluster", "library"], "count_z")
    money = t.table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("cell"), (F.col("c_acctbal") / 1000).alias("balance"))
    rows = z.join(money, "cell").withColumn("share", F.col("n_feature") / F.col("n_count"))
    return residuals.regression_residual(rows, "cell", "log_count", ["balance", "share"], ["cluster", "library"], "count_z")


def scored(spark, sf):
    s = t.demo_scores(spark, sf)
    return s.select(
        "cell", (F.col("s1") / 2).alias("homotypic_doublet"), (F.col("s2") / 2).alias("heterotypic_doublet"), (1 - F.col("s1") / 2 - F.col("s2") / 2).alias("clean"),
        F.col("s3").alias("homotypic_similarity"), F.col("s2").alias("heterotypic_similarity"), (1 - F.col("s1")).alias("distance_to_cluster_centroid"),
        F.col("s1").alias("homotypic_candidate_score"), F.col("s3").alias("biological_program_coherence_score"))


@query("c17_refined_scores")
def c17(spark, sf):
    return refinement.refined(scored(spark, sf), "cell")


@query("c17_refined_scores_legacy")
def c17_legacy(spark, sf):
    return refinement.refined(scored(spark, sf), "cell", legacy=True)
