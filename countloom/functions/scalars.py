"""Row-local expressions over columns: safe division, squashing, evidence fusion, calls and labels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

CLASSES = ("clean", "high_RNA_singlet", "homotypic_doublet", "heterotypic_doublet")

# Fixed values of label parsing.
POSITIVE = ("1", "true", "t", "yes", "y", "doublet", "doublets", "multiplet", "multiplets")
NEGATIVE = ("0", "false", "f", "no", "n", "singlet", "singlets", "cell", "cells")


def finite(x: Column) -> Column:
    """NaN and infinities become NULL, so that aggregates skip them."""
    return F.when(F.abs(x) < float("inf"), x)  # NaN counts as above all numbers


def safe_divide(a: Column, b: Column, fill: float = 0.0) -> Column:
    return F.when(b != 0, a / b).otherwise(F.lit(fill))


def clip(x: Column, low: float, high: float) -> Column:
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def sigmoid(x: Column, bound: float = 40.0) -> Column:
    return 1 / (1 + F.exp(-clip(x, -bound, bound)))


def centred_sigmoid(x: Column, centre: float, scale: float) -> Column:
    return sigmoid((x - centre) / scale, 60.0)


def union(*scores: Column) -> Column:
    """Noisy-or: the chance that at least one of independent signs holds."""
    return 1 - reduce(lambda a, b: a * b, [1 - clip(s, 0.0, 1.0) for s in scores])


def complexity_balance(n_feature: Column, n_count: Column) -> Column:
    return F.log1p(n_feature) - 0.5 * F.log1p(n_count)


def dosage(count_z: Column, feature_z: Column) -> Column:
    return sigmoid(0.75 * count_z + 0.25 * feature_z)


def identity(distance_z: Column, purity: Column) -> Column:
    return clip(0.55 * sigmoid(distance_z) + 0.45 * (1 - purity), 0.0, 1.0)


def dosage_residual(count_z: Column, gene_z: Column, stable_z: Column) -> Column:
    return 0.5 * count_z + 0.3 * gene_z + 0.2 * stable_z


def overall(hom: Column, het: Column) -> Column:
    return clip(hom + het, 0.0, 1.0)


def call(score: Column, threshold) -> Column:
    """NULL without a threshold."""
    return F.lit(None).cast("boolean") if threshold is None else score >= threshold


def called_subtype(called: Column, hom: Column, het: Column) -> Column:
    """'' when not called; a tie is homotypic."""
    return F.when(F.coalesce(called, F.lit(False)), F.when(hom >= het, CLASSES[2]).otherwise(CLASSES[3])).otherwise("")


def subtype_confidence(called: Column, hom: Column, het: Column) -> Column:
    total = hom + het
    return F.when(F.coalesce(called, F.lit(False)), F.when(total > 0, F.greatest(hom, het) / total).otherwise(0.5))


def candidate_class(candidate: Column, hom: Column, het: Column, upper: float = 0.6, lower: float = 0.4) -> Column:
    q = F.when(hom + het > 0, hom / (hom + het)).otherwise(0.5)
    return F.when(~candidate, "not_candidate").when(q >= upper, "homotypic_like").when(q <= lower, "heterotypic_like").otherwise("subtype_ambiguous")


def known_or_zero(x: Column) -> Column:
    return F.coalesce(finite(x), F.lit(0.0))


def five_way_label(low_quality: Column, hom: Column, het: Column, cut: float = 0.9, doubt: float = 0.6) -> Column:
    """Missing and non-finite scores count as 0; the two subtype scores are cut to 0 to 1."""
    low_quality, hom, het = known_or_zero(low_quality), clip(known_or_zero(hom), 0.0, 1.0), clip(known_or_zero(het), 0.0, 1.0)
    return (
        F.when(low_quality >= cut, "low_quality")
        .when((het >= cut) & (het > hom), "heterotypic_doublet")
        .when((hom >= cut) & (hom >= het), "homotypic_doublet")
        .when((hom >= doubt) | (het >= doubt) | (union(hom, het) >= doubt), "uncertain")
        .otherwise("clean")
    )


def gated_fusion(identity_rank: Column, dose_rank: Column, gate: float = 0.95, inlier: float = 0.75) -> dict[str, Column]:
    """Identity ranks raised by how far the dose rank is above its gate; both are ranks from 0 to 1."""
    rescue = clip((dose_rank - gate) / (1 - gate), 0.0, 1.0)
    raised = lambda w, by: clip(identity_rank + w * (1 - identity_rank) * by, 0.0, 1.0)
    return {
        "gated_025": raised(0.25, rescue),
        "gated_050": raised(0.5, rescue),
        "gated_max": clip(F.greatest(identity_rank, 0.5 * rescue), 0.0, 1.0),
        "gated_inlier": raised(0.5, F.when(identity_rank > inlier, 0.0).otherwise(rescue)),
    }


def informativeness(q25: Column, q50: Column, q75: Column, q95: Column, distinct: Column, correlation: Column) -> Column:
    """How useful the upper tail of a score is: its height over the quartile range and that range, less what the counts explain; 0 for a constant."""
    iqr = F.greatest(q75 - q25, F.lit(1e-8))
    tail, spread = clip(((q95 - q50) / iqr - 1) / 3, 0.0, 1.0), clip(iqr / 0.25, 0.0, 1.0)
    penalty = F.coalesce(clip(1 - 0.35 * F.abs(finite(correlation)), 0.45, 1.0), F.lit(1.0))
    return F.when(F.coalesce(distinct, F.lit(0)) <= 1, 0.0).otherwise(clip((0.65 * tail + 0.35 * spread) * penalty, 0.0, 1.0))


def neighbour_identity(enrichment: Column, weighted: Column, distance: Column) -> Column:
    zero = F.lit(0.0)
    return 0.45 * F.greatest(zero, enrichment) + 0.35 * F.greatest(zero, weighted) + 0.2 / (1 + distance)


def sample_weight(label: Column) -> Column:
    return F.when(label == "high_RNA_singlet", 2.0).otherwise(1.0)


def separation(auroc: Column) -> Column:
    return (
        F.when(auroc.isNull() | F.isnan(auroc), "not available").when(auroc <= 0.55, "little detectable separation").when(auroc <= 0.65, "weak separation").when(auroc <= 0.75, "moderate separation").otherwise("substantial separation")
    )


def binary_label(x: Column) -> Column:
    value = F.lower(F.trim(x.cast("string")))
    number = F.expr("1.0") * F.when(value.rlike(r"^[0-9]+([.][0-9]+)?$"), value.cast("double"))
    return F.when(value.isin(*POSITIVE) | (number == 1), 1).when(value.isin(*NEGATIVE) | (number == 0), 0)


def canonical_pair(a: Column, b: Column) -> tuple[Column, Column]:
    a, b = a.cast("string"), b.cast("string")
    return F.least(a, b), F.greatest(a, b)


def one_hot(x: Column, levels: list[str], prefix: str) -> dict[str, Column]:
    """A column for every fixed level; what is unseen goes to __unknown__."""
    out = {f"{prefix}_{v}": F.when(x == v, 1.0).otherwise(0.0) for v in levels}
    out[f"{prefix}___unknown__"] = F.when(x.isin(*levels), 0.0).otherwise(1.0)
    return out


def draw(seed: int, salt: str, key: Column) -> Column:
    """Order key of deterministic sampling: does not depend on partitions or row order."""
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), F.lit(salt), key.cast("string")), 256)


def half_even(x: Column) -> Column:
    return F.rint(x)


def capped_ratio(a: Column, b: Column, cap: float = 20.0) -> Column:
    """a / b up to cap; 1 where either is not above 0."""
    return F.when((b > 0) & (a > 0), F.least(a / b, F.lit(cap))).otherwise(1.0)
