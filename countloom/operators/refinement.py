"""Refinement of class probabilities by soft gates over whole-table ranks, the current rule and the older one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from countloom.functions import ranks
from countloom.functions.scalars import centred_sigmoid, clip, finite, union
from countloom.plans.storage import cut

CLASSES = ("clean", "heterotypic_doublet", "homotypic_doublet", "low_quality")
#: Feature -> value where the column is missing.
FEATURES = {
    "homotypic_similarity": 0.0, "heterotypic_similarity": 0.0, "distance_to_cluster_centroid": 0.0, "homotypic_final_score": 0.0, "homotypic_candidate_score": 0.0,
    "dosage_outlier_score": 0.0, "uniform_dosage_inflation_score": 0.5, "biological_program_coherence_score": 0.0, "identity_inlier_score": 0.0, "population_propensity_prior": 1.0,
    "homotypic_heterotypic_mixture_penalty": 0.0, "dosage_residual": 0.0, "cluster_count_robust_z": 0.0, "cluster_gene_robust_z": 0.0, "cluster_stable_dosage_robust_z": 0.0}
_VARY = ("identity_inlier_score", "homotypic_final_score", "dosage_outlier_score", "homotypic_candidate_score", "homotypic_heterotypic_mixture_penalty", "population_propensity_prior")


# Weights of the two rules, in the order of what they weigh.
WEIGHTS = {
    "gate": (0.55, 0.25, 0.20), "mixture": (0.45, 0.20, 0.20, 0.10, 0.05), "support": (0.65, 0.20, 0.15), "homotypic": (0.72, 0.15, 0.08, 0.05),
    "older evidence": (0.45, 0.30, 0.25), "older mixture": (0.65, 0.15, 0.15, 0.05), "older mixture with penalty": (0.55, 0.45), "older shown": (0.62, 0.18, 0.12, 0.08), "older homotypic": (0.20, 0.80)}
# Start, slope and ends of the ramps.
RAMPS = {
    "kept": (1, -0.40, 0.6, 1.0), "biology": (1, -0.45, 0.55, 1.0), "level": (0.25, 0.75, 0.25, 1.0), "prior": (0.85, 0.15, 0.85, 1.0), "identity": (0.35, 0.65, 0.0, 1.0), "inlier": (0.30, 0.70, 0.0, 1.0),
    "older level": (0.35, 0.65, 0.35, 1.0), "older prior": (0.75, 0.25, 0.75, 1.0), "older gate": (0.10, 0.90, 0.0, 1.0)}
# Slope and power of the falling factors of the older rule.
FALLS = {"mixture": (1, 3), "penalty": (1, 2), "biology": (0.75, 2), "last": (0.85, 2)}
# Middle of the sigmoid of each robust score of the older rule, and their common width.
MIDDLES, WIDTH = {"cluster_count_robust_z": 1.0, "cluster_gene_robust_z": 0.75, "cluster_stable_dosage_robust_z": 0.75, "dosage_residual": 1.0}, 0.75


def blend(name: str, *parts):
    """Weighted sum of the parts, between 0 and 1."""
    return unit(sum((w * x for w, x in zip(WEIGHTS[name], parts, strict=True)), F.lit(0.0)))


def ramp(name: str, x):
    first, slope, low, high = RAMPS[name]
    return clip(first + slope * x, low, high)


def fall(name: str, x):
    slope, power = FALLS[name]
    return F.pow(1 - slope * x, F.lit(float(power)))


def unit(x):
    return clip(x, 0.0, 1.0)


def least(a, b):
    return F.when(a.isNotNull() & b.isNotNull(), F.least(a, b))


def refined(rows: DataFrame, key: str, legacy: bool = False, penalize: bool = True, prior: bool = True) -> DataFrame:
    """key and the four classes.  rows: key, probabilities by class and features; what is missing takes its default."""
    columns = set(rows.columns)
    number = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    df = rows.select(
        key, *(F.coalesce(finite(F.col(c).cast("double")), F.lit(0.0)).alias(f"p_{c}") if c in columns else F.lit(0.0).alias(f"p_{c}") for c in CLASSES),
        *((number(c) if c in columns else F.lit(v)).alias(c) for c, v in FEATURES.items()))
    hom_raw, het_raw = F.col("homotypic_similarity"), F.col("heterotypic_similarity")
    df = df.withColumns({
        "_a": finite(hom_raw), "_b": finite(het_raw), "_c": finite(F.col("distance_to_cluster_centroid")),
        "_d": finite(F.when(hom_raw.isNotNull() & het_raw.isNotNull(), F.greatest(het_raw - hom_raw, F.lit(0.0)))), "_e": finite(F.col("population_propensity_prior"))})
    clipped = {c: F.col(c) if c == "population_propensity_prior" or legacy else unit(F.col(c)) for c in _VARY}
    vary = df.agg(F.min("_c").alias("low"), F.max("_c").alias("high"), *(F.coalesce(F.min(x) < F.max(x), F.lit(False)).alias(c) for c, x in clipped.items())).first()
    for c in "abcde":
        df = cut(ranks.percentile_rank(df, f"_{c}", f"r{c}"))  # a rank reads its input several times
    constant = vary["low"] is None or vary["low"] == vary["high"]
    hom, het, off, margin = F.col("ra"), F.col("rb"), F.col("rc"), F.col("rd")
    centred = F.lit(0.5) if constant else 1 - off
    p = {c: F.col(f"p_{c}") for c in CLASSES}
    q = {c: unit(x) for c, x in p.items()}
    f = {c: unit(F.col(c)) for c in FEATURES}
    inlier = f["identity_inlier_score"] if vary["identity_inlier_score"] else centred
    candidate, outlier, program = f["homotypic_candidate_score"], f["dosage_outlier_score"], f["biological_program_coherence_score"]
    uniform, mixed = f["uniform_dosage_inflation_score"], f["homotypic_heterotypic_mixture_penalty"]
    gate = blend("gate", het, off, margin)
    use_prior = prior and vary["population_propensity_prior"]
    favour = ramp("older prior" if legacy else "prior", F.col("re")) if use_prior else F.lit(1.0)
    het_score = unit(q["heterotypic_doublet"] * ramp("identity", gate))
    if not legacy:
        mixture = blend("mixture", het_score, het, margin, off, mixed)
        factor = (ramp("kept", mixture * mixture) if penalize else F.lit(1.0)), ramp("biology", program), favour
        spare = unit(candidate * ramp("level", uniform) * factor[1] * ramp("inlier", inlier))
        module = f["homotypic_final_score"] if vary["homotypic_final_score"] else spare
        support = blend("support", q["homotypic_doublet"], q["heterotypic_doublet"], outlier)
        hom_score = blend("homotypic", module, spare, candidate, support)
        for x in factor:
            hom_score = hom_score * x
        low, hom_score = q["low_quality"], unit(hom_score)
        out = {"clean": unit((1 - union(het_score, hom_score)) * (1 - low)), "heterotypic_doublet": het_score, "homotypic_doublet": hom_score, "low_quality": low}
        return df.select(key, *(F.coalesce(x, F.lit(0.0)).alias(c) for c, x in out.items()))
    bent = {c: centred_sigmoid(F.when(F.col(c).isNotNull(), F.greatest(F.col(c), F.lit(0.0))), m, WIDTH) for c, m in MIDDLES.items()}
    counts, genes, stable, rest = bent.values()
    if not vary["dosage_outlier_score"]:
        outlier = blend("older evidence", least(counts, genes), F.sqrt(unit(genes * stable)), rest)
    agreed = unit(outlier * hom * inlier)
    if not vary["homotypic_candidate_score"]:
        candidate = unit(F.sqrt(agreed))
    mixture = blend("older mixture", q["heterotypic_doublet"], het, margin, off)
    if vary["homotypic_heterotypic_mixture_penalty"]:
        mixture = blend("older mixture with penalty", mixture, mixed)
    before = p["homotypic_doublet"] + p["heterotypic_doublet"]
    biology = ramp("older level", uniform) * fall("biology", program)
    module = unit(candidate * biology * (fall("penalty", mixture) if penalize else F.lit(1.0)) * favour)
    shown = blend("older shown", module, unit(outlier * biology), q["homotypic_doublet"], unit(before))
    gated = q["homotypic_doublet"] * ramp("older gate", F.pow(agreed, F.lit(1.0 / 3.0))) * fall("mixture", mixture)
    hom_score = blend("older homotypic", gated, shown)
    if penalize:
        hom_score = least(hom_score, F.when(module.isNotNull(), F.greatest(unit(before), module)) * fall("last", mixture))
    df = df.select(key, "p_clean", "p_low_quality", before.alias("_before"), unit(hom_score).alias("homotypic_doublet"), het_score.alias("heterotypic_doublet"))
    after = F.col("homotypic_doublet") + F.col("heterotypic_doublet")
    freed = F.when(after.isNotNull(), F.greatest(F.col("_before") - after, F.lit(0.0)))
    df = df.withColumns({"clean": unit(F.col("p_clean") + freed), "low_quality": F.col("p_low_quality")})
    total = sum((F.coalesce(F.col(c), F.lit(0.0)) for c in CLASSES), F.lit(0.0))
    return df.withColumn("_t", F.when(total == 0, 1.0).otherwise(total)).select(key, *((F.col(c) / F.col("_t")).alias(c) for c in CLASSES))
