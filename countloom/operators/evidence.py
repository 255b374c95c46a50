"""Evidence that an entity is a mixture within its own group: gates on residuals, balance of modules, programs, and the final score."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from countloom.functions.ranks import percentile_rank
from countloom.functions.scalars import centred_sigmoid, clip
from countloom.plans.storage import cut

# Centre, scale and weight of each residual's gate.
GATES = {"count_z": (1.5, 0.6, 0.35), "gene_z": (1.25, 0.6, 0.2), "stable_z": (1.25, 0.6, 0.25), "marker_z": (1.25, 0.6, 0.2)}

OUTPUTS = ("centroid_inlier", "neighbour_consistency", "inlier", "dosage_outlier", "uniform_dosage", "program", "candidate", "final", "mixture", "rank_mean", "rank_spread")


def homotypic_evidence(df: DataFrame) -> DataFrame:
    """df: the residuals of GATES, distance_z, consistency, hom, het, count_rank.  Adds the scores of each step.

    Residuals below zero count as zero.  A dosage that all residuals share is even; one module that stands out alone looks like
    a program of the cell instead, and likeness to mixtures of two groups speaks against the score.
    """
    out = df
    for r in GATES:
        out = out.withColumn(f"_{r}", F.greatest(F.coalesce(F.col(r), F.lit(0.0)), F.lit(0.0)))
        # a rank reads its input several times: the plan is cut after each
        out = cut(percentile_rank(out, f"_{r}", f"_r_{r}")).withColumn(f"_g_{r}", centred_sigmoid(F.col(f"_{r}"), GATES[r][0], GATES[r][1]))
    out = out.withColumn("_margin", F.greatest(F.col("het") - F.col("hom"), F.lit(0.0)))
    for name in ("hom", "het", "_margin"):
        out = cut(percentile_rank(out, name, f"_rank_{name}"))
    ranks, gates = [F.col(f"_r_{r}") for r in GATES], [F.col(f"_g_{r}") for r in GATES]
    mean = reduce(lambda a, b: a + b, ranks) / len(ranks)
    spread = F.sqrt(reduce(lambda a, b: a + b, [(r - F.col("_mean")) ** 2 for r in ranks]) / len(ranks))
    out = out.withColumn("_mean", mean).withColumns({"_spread": F.greatest(*ranks) - F.least(*ranks), "_balance": clip(1 - 2.5 * spread, 0.0, 1.0)})
    out = out.withColumns({
        "dosage_outlier": clip(reduce(lambda a, b: a + b, [GATES[r][2] * F.col(f"_g_{r}") for r in GATES]), 0.0, 1.0),
        "uniform_dosage": F.sqrt(clip(F.least(*gates) * F.col("_balance"), 0.0, 1.0)),
        "centroid_inlier": centred_sigmoid(-F.col("distance_z"), -1.25, 0.75), "neighbour_consistency": clip(F.col("consistency"), 0.0, 1.0),
    }).withColumn("inlier", F.sqrt(clip(F.col("centroid_inlier") * (0.25 + 0.75 * F.col("neighbour_consistency")), 0.0, 1.0)))
    imbalance = clip(0.65 * F.col("_spread") + 0.35 * (1 - F.col("_balance")), 0.0, 1.0)
    program = clip(F.greatest(F.greatest(*ranks), F.greatest(*gates)) * imbalance * centred_sigmoid(F.col("dosage_outlier"), 0.45, 0.2), 0.0, 1.0)
    coherent = clip(F.col("count_rank") * F.col("inlier") * (1 - F.col("uniform_dosage")) * (1 - 0.65 * F.col("dosage_outlier")), 0.0, 1.0)
    out = out.withColumns({
        "program": F.greatest(program, coherent),
        "mixture": clip(0.55 * F.col("_rank_het") + 0.35 * F.col("_rank__margin") + 0.1 * (1 - F.col("inlier")), 0.0, 1.0),
    })
    sensitive = clip(0.55 * F.col("dosage_outlier") + 0.25 * F.col("_rank_hom") + 0.2 * F.col("inlier"), 0.0, 1.0)
    out = out.withColumn("candidate", F.sqrt(clip(sensitive * (0.1 + 0.9 * F.col("dosage_outlier")) * (0.35 + 0.65 * F.col("inlier")), 0.0, 1.0)))
    final = F.col("candidate") * (0.35 + 0.65 * F.col("uniform_dosage")) * (1 - 0.55 * F.col("program")) * (1 - 0.35 * F.col("mixture"))
    return out.withColumn("final", clip(final, 0.0, 1.0)).withColumnsRenamed({"_mean": "rank_mean", "_spread": "rank_spread"}).select(*df.columns, *OUTPUTS)


def propensity(df: DataFrame, score: str, rate: float = 0.06) -> DataFrame:
    """Per (library, cluster): abundance, propensity q (mean 1 by abundance) and the share of homotypic mixtures expected.

    High cells are those at or above the library's 0.9 quantile, or its maximum with fewer than ten cells.
    """
    bound = df.groupBy("library").agg(F.when(F.count("*") >= 10, F.expr(f"percentile({score}, 0.9)")).otherwise(F.max(score)).alias("_b"), F.count("*").alias("_n"))
    per = df.join(bound, "library").groupBy("library", "cluster").agg(
        (F.count("*") / F.first("_n")).alias("abundance"), F.avg((F.col(score) >= F.col("_b")).cast("double")).alias("_rate"))
    per = per.withColumn("_q", (F.col("_rate") + 1e-3) / (F.col("abundance") + 1e-6))
    mean = per.groupBy("library").agg(F.sum(F.col("_q") * F.col("abundance")).alias("_m"))
    per = per.join(mean, "library").withColumn("propensity", F.when(F.col("_m") > 0, F.col("_q") / F.col("_m")).otherwise(1.0))
    per = per.withColumn("_w", (F.col("abundance") * F.col("propensity")) ** 2)
    total = per.groupBy("library").agg(F.sum("_w").alias("_t"))
    return per.join(total, "library").select("library", "cluster", "abundance", "propensity", F.when(F.col("_t") > 0, rate * F.col("_w") / F.col("_t")).otherwise(0.0).alias("expected_share"))


def reliable_negatives(df: DataFrame, signs: list[str], quantile: float = 0.3) -> DataFrame:
    """df with risk (mean of the signs' ranks) and clean (risk at or below its quantile)."""
    out = df
    for s in signs:
        out = cut(percentile_rank(out, s, f"_r_{s}", constant=0.0))
    risk = reduce(lambda a, b: a + b, [F.col(f"_r_{s}") for s in signs]) / len(signs)
    out = out.withColumn("risk", F.round(risk, 12))
    bound = out.agg(F.expr(f"percentile(risk, {quantile})").alias("_b"))
    return out.crossJoin(F.broadcast(bound)).withColumn("clean", F.col("risk") <= F.col("_b")).drop("_b", *(f"_r_{s}" for s in signs))  # one row
