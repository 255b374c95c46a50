"""Contracts of runs, pools, features and exported tables: each check is a row with a status."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from countloom.functions.scalars import finite
from countloom.operators.governance import DENIED, source_groups

# Candidate features of the model matrix, in its order.
CANDIDATES = (
    "scrublet_score", "handcrafted_homotypic_score", "handcrafted_identity_mixture_score", "handcrafted_combined_score", "handcrafted_sensitive_score",
    "handcrafted_dosage_raw_score", "handcrafted_dosage_reference_ecdf", "handcrafted_dosage_reference_tail", "hybrid_overall_score", "hybrid_homotypic_score",
    "hybrid_heterotypic_score", "nCount", "log_nCount", "cluster_nCount_z", "library_complexity_balance", "handcrafted_homotypic_reference_score",
    "handcrafted_artificial_doublet_neighbor_score", "handcrafted_homotypic_reference_ecdf", "handcrafted_artificial_doublet_neighbor_ecdf", "handcrafted_homotypic_reference_tail",
    "handcrafted_artificial_doublet_neighbor_tail", "handcrafted_combined_raw_score", "handcrafted_combined_reference_ecdf", "handcrafted_combined_reference_tail",
    "handcrafted_artificial_doublet_compatible_score", "dosage_outlier_score", "identity_inlier_score", "uniform_dosage_inflation_score", "biological_program_coherence_score",
    "handcrafted_homotypic_candidate_score", "handcrafted_homotypic_dosage_score", "module_residual_rank_mean", "module_residual_rank_spread", "cluster_count_robust_z",
    "cluster_gene_robust_z", "cluster_stable_dosage_robust_z", "cluster_marker_dosage_robust_z", "dosage_residual", "cluster_abundance", "cluster_level_expected_homotypic_burden",
    "benchmark_cluster_frequency",
)
# Features that the protocol allows, in its order.
ALLOWED = (
    "handcrafted_homotypic_score", "handcrafted_identity_mixture_score", "handcrafted_combined_score", "handcrafted_sensitive_score", "handcrafted_dosage_raw_score", "nCount", "log_nCount",
    "library_complexity_balance", "cluster_nCount_z", "handcrafted_homotypic_reference_score", "handcrafted_artificial_doublet_neighbor_score", "handcrafted_combined_raw_score",
    "handcrafted_artificial_doublet_compatible_score", "dosage_outlier_score", "identity_inlier_score", "uniform_dosage_inflation_score", "biological_program_coherence_score",
    "handcrafted_homotypic_candidate_score", "handcrafted_homotypic_dosage_score", "cluster_count_robust_z", "cluster_gene_robust_z", "cluster_stable_dosage_robust_z",
    "cluster_marker_dosage_robust_z", "dosage_residual",
)
# Source groups of raw measurements.
RAW_GROUPS = {
    "raw:ncount": ("dosage", "row_local"), "raw:nfeature": ("dosage", "row_local"), "raw:benchmark_cluster": ("cluster_relative",), "raw:dosage_module": ("cluster_relative", "dosage"),
    "raw:identity_module": ("cluster_relative", "identity_mixture"), "raw:scrublet": ("identity_mixture", "scrublet_derived"),
}
# What features are made from, as far as the row-local and pre-model ones go.
NEEDS = {
    "nCount": ("raw:ncount",), "log_nCount": ("nCount",), "library_complexity_balance": ("raw:nfeature", "raw:ncount"), "scrublet_score": ("raw:scrublet",),
    "handcrafted_homotypic_score": ("raw:dosage_module",), "handcrafted_identity_mixture_score": ("raw:identity_module",), "handcrafted_combined_score": ("raw:dosage_module", "raw:scrublet"),
    "handcrafted_sensitive_score": ("raw:dosage_module", "raw:scrublet"), "handcrafted_dosage_raw_score": ("raw:dosage_module",), "handcrafted_dosage_reference_ecdf": ("handcrafted_dosage_raw_score",),
    "handcrafted_dosage_reference_tail": ("handcrafted_dosage_raw_score",), "hybrid_overall_score": ("scrublet_score", "handcrafted_homotypic_score"), "hybrid_homotypic_score": ("handcrafted_homotypic_score",),
    "hybrid_heterotypic_score": ("scrublet_score", "handcrafted_identity_mixture_score"), "cluster_nCount_z": ("log_nCount", "raw:benchmark_cluster"),
    "handcrafted_homotypic_reference_score": ("handcrafted_homotypic_score",), "handcrafted_artificial_doublet_neighbor_score": ("raw:scrublet",),
    "handcrafted_homotypic_reference_ecdf": ("handcrafted_homotypic_reference_score",), "handcrafted_artificial_doublet_neighbor_ecdf": ("handcrafted_artificial_doublet_neighbor_score",),
    "handcrafted_homotypic_reference_tail": ("handcrafted_homotypic_reference_score",), "handcrafted_artificial_doublet_neighbor_tail": ("handcrafted_artificial_doublet_neighbor_score",),
    "handcrafted_combined_raw_score": ("handcrafted_combined_score",),
}
# Tokens and names that the older numeric filter refuses.
OLD_DENIED = ("benchmark", "true", "label", "doublet_type", "simulated", "expected", "y_true", "is_")
OLD_EXACT = ("artificial_neighbor_fraction", "nearest_heterotypic_doublet_distance", "nearest_homotypic_doublet_distance", "heterotypic_similarity", "homotypic_similarity")


def check(name: str, failed: Column) -> Column:
    return F.struct(F.lit(name).alias("check"), failed.cast("long").alias("failed"))


def as_checks(one: DataFrame, *checks: Column) -> DataFrame:
    """check, failed, status of a table of one row."""
    return one.select(F.inline(F.array(*checks))).withColumn("status", F.when(F.col("failed") == 0, "PASS").otherwise("FAIL"))


def feature_matrix(spark: SparkSession) -> DataFrame:
    """place, feature, denied (holds a refused token), allowed (in the protocol's list), included (in the public matrix)."""
    rows = spark.createDataFrame([(p, f) for p, f in enumerate(CANDIDATES)], "place long, feature string")
    denied = reduce(lambda a, b: a | b, [F.lower("feature").contains(t) for t in DENIED])
    return rows.select("place", "feature", denied.alias("denied"), F.col("feature").isin(*ALLOWED).alias("allowed"), (~denied).alias("included"))


def provenance(spark: SparkSession) -> DataFrame:
    """feature, sources (raw measurements it descends from), groups (theirs, sorted and joined), composite."""
    edges = spark.createDataFrame([(f, n) for f, needs in NEEDS.items() for n in needs], "feature string, needs string")
    raw = spark.createDataFrame([(r, g) for r, groups in RAW_GROUPS.items() for g in groups], "source string, grp string")
    reached = source_groups(edges).join(F.broadcast(raw), "source")  # a fixed list
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ";")
    direct = edges.groupBy("feature").agg(F.max((~F.col("needs").startswith("raw:")).cast("int")).alias("_d"), F.count("*").alias("_n"))
    return reached.groupBy("feature").agg(joined("source").alias("sources"), joined("grp").alias("groups")).join(direct, "feature").select(
        "feature", "sources", "groups", ((F.col("_d") == 1) | (F.col("_n") > 1)).alias("composite"))


def feature_audit(spark: SparkSession, features: list[str]) -> DataFrame:
    """feature, reasons against it, status: refused tokens, not allowed, without provenance."""
    rows = spark.createDataFrame([(f,) for f in features], "feature string")
    tokens = F.filter(F.array(*(F.lit(t) for t in DENIED)), lambda t: F.contains(F.lower("feature"), t))
    other = F.array_compact(F.array(F.when(~F.col("feature").isin(*ALLOWED), "not allowed"), F.when(~F.col("feature").isin(*CANDIDATES), "no provenance")))
    reasons = F.concat(tokens, other)
    return rows.select("feature", F.array_join(reasons, "; ").alias("reasons"), F.when(F.size(reasons) == 0, "PASS").otherwise("FAIL").alias("status"))


def old_safe_columns(columns: list[str]) -> list[str]:
    """Columns that the older filter takes."""
    return [c for c in columns if c.lower() not in OLD_EXACT and not any(t in c.lower() for t in OLD_DENIED)]


def old_safe_features(df: DataFrame, key: str) -> DataFrame:
    """key and the numeric columns that the older filter takes: gaps and non-finite values take the median, 0 without any; a constant column where none is left."""
    numeric = [c for c, k in df.dtypes if k in ("double", "float", "int", "bigint", "smallint", "tinyint") and c != key]
    chosen = old_safe_columns(numeric)
    if not chosen:
        return df.select(key, F.lit(1.0).alias("constant_feature"))
    clean = df.select(key, *(finite(F.col(c).cast("double")).alias(c) for c in chosen))
    middles = clean.agg(*(F.expr(f"percentile(`{c}`, 0.5)").alias(f"_{c}") for c in chosen))
    return clean.crossJoin(F.broadcast(middles)).select(key, *(F.coalesce(c, f"_{c}", F.lit(0.0)).alias(c) for c in chosen))  # one row


def schema_audit(counts: DataFrame, cells: DataFrame, genes: DataFrame) -> DataFrame:
    """Ids unique, counts of known cells and genes only, finite and not negative.  counts: cell, gene, count; cells: cell; genes: gene."""
    c = counts.agg(
        F.count_if(F.col("count").isNull() | F.isnan("count") | (F.abs("count") == float("inf"))).alias("bad"), F.count_if(F.col("count") < 0).alias("below"))
    ids = cells.agg((F.count("*") - F.count_distinct("cell")).alias("cells")).crossJoin(F.broadcast(genes.agg((F.count("*") - F.count_distinct("gene")).alias("genes"))))
    loose = counts.select("cell").distinct().join(cells, "cell", "left_anti").agg(F.count("*").alias("no_cell")).crossJoin(
        F.broadcast(counts.select("gene").distinct().join(genes, "gene", "left_anti").agg(F.count("*").alias("no_gene"))))
    one = c.crossJoin(F.broadcast(ids)).crossJoin(F.broadcast(loose))  # tables of one row
    return as_checks(
        one, check("unique_cells", F.col("cells")), check("unique_genes", F.col("genes")), check("cells_known", F.col("no_cell")), check("genes_known", F.col("no_gene")), check("finite_counts", F.col("bad")),
        check("counts_not_negative", F.col("below")))


def pool_composition(pools: DataFrame, labels: DataFrame, key: str, pool: str, label: str) -> DataFrame:
    """Per pool: ids, positives, unlabelled, and PASS where no positive is in it."""
    joined = pools.join(labels.select(key, F.col(label).alias("_l")), key, "left")
    out = joined.groupBy(pool).agg(F.count_distinct(key).alias("ids"), F.count_if(F.col("_l") == 1).alias("positives"), F.count_if(F.col("_l").isNull()).alias("unlabelled"))
    return out.withColumn("status", F.when(F.col("positives") == 0, "PASS").otherwise("FAIL"))


def audit_contract(audits: DataFrame) -> DataFrame:
    """dataset, status, reason of primary audits, by precedence.  audits: dataset, is_primary, status, auroc, auprc, overlap, balance, provenance."""
    primary = audits.filter("is_primary").groupBy("dataset").agg(F.count("*").alias("n"), *(F.first(c).alias(c) for c in ("status", "auroc", "auprc", "overlap", "balance", "provenance")))
    rows = audits.select("dataset").distinct().join(primary, "dataset", "left")
    status = F.upper("status")
    reason = (
        F.when(F.coalesce("n", F.lit(0)) != 1, "not exactly one primary row").when(~F.coalesce(status.isin("PASS", "SUCCESS", "COMPLETED"), F.lit(False)), F.concat(F.lit("status is "), F.coalesce(status, F.lit("missing"))))
        .when(finite(F.col("auroc")).isNull() | finite(F.col("auprc")).isNull(), "areas are not finite").when(F.coalesce(F.col("overlap"), F.lit(1)) != 0, "parents overlap across folds")
        .when(F.coalesce("balance", F.lit("")) != "PASS", "folds are not balanced").when(F.coalesce("provenance", F.lit("")) != "PASS", "provenance is not clean").otherwise(""))
    known = F.when(F.col("n") == 1, F.when(status.isin("PASS", "SUCCESS", "COMPLETED"), "CONTRACT_ERROR").when(status.isin("INSUFFICIENT_PARENT_DISJOINT_DATA", "SKIPPED_INSUFFICIENT_DATA"), "SKIPPED_INSUFFICIENT_DATA").otherwise(status))
    return rows.select("dataset", F.when(reason == "", "COMPLETED").otherwise(F.coalesce(known, F.lit("CONTRACT_ERROR"))).alias("state"), reason.alias("reason"))


# States of an audit, and words of messages that tell why one failed.
DONE = ("PASS", "SUCCESS", "COMPLETED")
TOO_FEW = ("INSUFFICIENT_PARENT_DISJOINT_DATA", "SKIPPED_INSUFFICIENT_DATA")
KNOWN_FAILURES = (*TOO_FEW, "INPUT_ERROR", "PROVENANCE_ERROR", "CONTRACT_ERROR", "ANALYSIS_ERROR", "FAILED")


def audit_state(source: Column, status: Column, message: Column) -> Column:
    """The state of an audit from its own status, that of its source and the message, in this order of precedence."""
    source, status, text = F.upper(F.trim(source)), F.upper(F.trim(status)), F.lower(message)
    holds = lambda *words: reduce(lambda a, b: a | b, [text.contains(w) for w in words])
    return (
        F.when(status.isin(*DONE), "COMPLETED").when(status.isin(*TOO_FEW), "SKIPPED_INSUFFICIENT_DATA").when(status.isin(*KNOWN_FAILURES), status)
        .when((source == TOO_FEW[0]) | holds("insufficient parent-unique", "additional labeled singlets", "no parent cluster"), TOO_FEW[0])
        .when(holds("provenance", "transformer", "reference pool"), "PROVENANCE_ERROR").when(source.isin("INPUT_ERROR", "FAILED") & holds("input", "missing", "not found", "read"), "INPUT_ERROR")
        .when((source != "") & ~source.isin(*DONE, *KNOWN_FAILURES), "CONTRACT_ERROR").otherwise("ANALYSIS_ERROR"))


def shared_coordinates(coordinates: DataFrame, scores: DataFrame, key: str, panels: list[str]) -> DataFrame:
    """Per panel: cells, an order-free hash of ids and coordinates, and whether scores have the same ids."""
    hashed = coordinates.select(key, F.xxhash64(key).alias("_i"), F.xxhash64(*coordinates.columns).alias("_c"))
    total = hashed.agg(F.count("*").alias("cells"), F.bit_xor("_i").alias("id_hash"), F.bit_xor("_c").alias("coordinate_hash"))
    apart = coordinates.select(key).join(scores.select(key), key, "left_anti").union(scores.select(key).join(coordinates.select(key), key, "left_anti")).agg(F.count("*").alias("apart"))
    every = coordinates.sparkSession.createDataFrame([(p,) for p in panels], "panel string")
    return every.crossJoin(F.broadcast(total.crossJoin(F.broadcast(apart)))).withColumn("status", F.when(F.col("apart") == 0, "PASS").otherwise("FAIL"))


def keyed_update(table: DataFrame, updates: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """table with columns replaced where updates has the key; raises if a key of updates repeats or updates none or several rows."""
    hits = updates.select(*keys).join(table.select(*keys, F.lit(1).alias("_h")), keys, "left").groupBy(*keys).agg(F.count("_h").alias("n"), F.count("*").alias("m"))
    if not hits.filter("n <> 1 OR m <> 1").isEmpty():
        raise ValueError("every update must replace exactly one row")
    new = updates.select(*keys, *(F.col(c).alias(f"_{c}") for c in columns), F.lit(True).alias("_u"))
    joined = table.join(new, keys, "left")
    return joined.select(*(F.when(F.col("_u"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in columns else c for c in table.columns))


def positional_alignment(left: DataFrame, right: DataFrame, order: str, key: str) -> DataFrame:
    """One row: rows of both sides by position, and positions where the keys differ or one side has none."""
    at = lambda df, name: df.select(F.row_number().over(W.orderBy(order)).alias("_p"), F.col(key).alias(name))
    both = at(left, "_x").join(at(right, "_y"), "_p", "full")
    return both.agg(F.count("_x").alias("left_rows"), F.count("_y").alias("right_rows"), F.count_if(~F.col("_x").eqNullSafe(F.col("_y"))).alias("mismatches"))


def first_alias(df: DataFrame, aliases: list[str]) -> Column:
    """The first of the columns that df has; an error without any."""
    found = next((a for a in aliases if a in df.columns), None)
    if found is None:
        raise ValueError(f"none of {', '.join(aliases)} is there")
    return F.col(found)


def domain_masks(df: DataFrame, split: str) -> DataFrame:
    """df with experimental, heterotypic and in_split, read from whichever of the known columns is there."""
    text = lambda c: F.lower(F.trim(c.cast("string")))
    experimental = text(first_alias(df, ["experimental_singlet_doublet_label", "experimental_doublet_label", "experimental_label"]))
    subtype = text(first_alias(df, ["synthetic_subtype", "doublet_subtype", "model_class_label", "true_label"]))
    return df.withColumns({
        "experimental": F.coalesce(experimental.isin("1", "1.0", "doublet", "doublets", "experimental_doublet", "experimentally_detectable_doublet"), F.lit(False)),
        "heterotypic": F.coalesce(subtype.isin("heterotypic", "heterotypic_doublet"), F.lit(False)),
        "in_split": F.coalesce(text(F.col("split")).isin(split, f"semi_real_{split}"), F.lit(False))})


def export_checks(real: DataFrame, parents: DataFrame, key: str, features: list[str]) -> DataFrame:
    """Of an export: ids unique and not synthetic, one split, features finite, every pair with both parents, which are two."""
    bad = reduce(lambda a, b: a | b, [finite(F.col(c).cast("double")).isNull() for c in features])
    one = real.agg(
        (F.count("*") - F.count_distinct(key)).alias("a"), F.count_if(F.col(key).startswith("synthetic")).alias("b"), F.greatest(F.count_distinct("split") - 1, F.lit(0)).alias("c"), F.count_if(bad).alias("d"))
    two = parents.agg(F.count_if(F.col("parent_1").isNull() | F.col("parent_2").isNull()).alias("e"), F.count_if(F.col("parent_1") == F.col("parent_2")).alias("f"))
    names = ("unique_ids", "no_synthetic_ids", "one_split", "finite_features", "parents_complete", "parents_differ")
    return as_checks(one.crossJoin(F.broadcast(two)), *(check(n, F.col(c)) for n, c in zip(names, "abcdef")))


def method_rows(scores: DataFrame, methods: list[str], allowed: list[str]) -> DataFrame:
    """method, rows, status of every method asked for; one that is not allowed is an error."""
    unknown = [m for m in methods if m not in allowed]
    if unknown:
        raise ValueError(f"unsupported method {unknown[0]}")
    every = scores.sparkSession.createDataFrame([(m,) for m in methods], "method string")
    found = scores.groupBy("method").agg(F.count("*").alias("n"), F.count("score").alias("k"))
    return every.join(found, "method", "left").select(
        "method", F.coalesce("n", F.lit(0)).alias("rows"), F.when(F.col("n").isNull(), "skipped").when(F.col("k") == 0, "failed").otherwise("success").alias("status"))


def resolved(value: str | list[str] | None, known: dict[str, str], default: str = "all") -> list[str]:
    """Names behind tokens: comma lists in any case, `all` alone, each once; unknown tokens are an error."""
    items = [] if value is None else [value] if isinstance(value, str) else list(value)
    tokens = [x.strip().lower() for item in items for x in item.split(",") if x.strip()] or [default]
    if "all" in tokens:
        if len(tokens) > 1:
            raise ValueError("all stands alone")
        return list(known.values())
    if any(x not in known for x in tokens):
        raise ValueError(f"unknown among {', '.join(tokens)}; known are all, {', '.join(known)}")
    return list(dict.fromkeys(known[x] for x in tokens))


# How pairs are summed and whether parents stay in the reference.
VARIANTS = {
    "raw_sum_parents_retained": ("raw_sum", "retained"), "raw_sum_parents_removed": ("raw_sum", "removed"), "downsampled_parents_retained": ("downsampled", "retained"),
    "downsampled_parents_removed": ("downsampled", "removed"),
}


def construction(variant: str = "raw_sum_parents_removed", counts: str | None = None, parents: str | None = None) -> tuple[str, str, str]:
    """(variant, counts, parents) of a named variant with either part replaced."""
    if variant not in VARIANTS:
        raise ValueError(f"unknown variant {variant}")
    counts, parents = counts or VARIANTS[variant][0], parents or VARIANTS[variant][1]
    name = f"{counts}_parents_{parents}"
    if name not in VARIANTS:
        raise ValueError(f"unknown variant {name}")
    return name, counts, parents


def scaled_sizes(sizes: dict[str, int], factor: float, historical: bool = False) -> dict[str, int]:
    """Sizes of a protocol times factor, at least 1: those of training only, or (historical) all."""
    if factor <= 0:
        raise ValueError("the factor must be positive")
    return {k: max(1, round(v * factor)) if historical or k.startswith("n_train") else v for k, v in sizes.items()}


def completion(expected: DataFrame, found: DataFrame) -> DataFrame:
    """stage, rows, state of every expected stage: MISSING without a table, INCOMPLETE below its least number of rows, else COMPLETE; and UNEXPECTED stages.

    expected: stage, least.  found: stage, rows.
    """
    both = expected.join(found, "stage", "full")
    state = F.when(F.col("least").isNull(), "UNEXPECTED").when(F.col("rows").isNull(), "MISSING").when(F.col("rows") < F.col("least"), "INCOMPLETE").otherwise("COMPLETE")
    return both.select("stage", F.coalesce("rows", F.lit(0)).alias("rows"), state.alias("state"))


def domain_frame(real: DataFrame, made: DataFrame, totals: DataFrame, features: list[str]) -> DataFrame:
    """Rows of both domains with their features, technical covariates and the group that keeps parents together in cross-validation.

    real and made: cell, features, and log_count, log_feature or not; made also parent_1.  Covariates that a side lacks come from totals
    (cell, n_count, n_feature).  A real cell is its own group, a made one goes with its first parent.
    """
    covariates = {"log_count": F.log1p("n_count"), "log_feature": F.log1p("n_feature")}

    def side(df: DataFrame, domain: str, group) -> DataFrame:
        joined = df.join(totals.select("cell", "n_count", "n_feature"), "cell", "left")
        filled = {c: F.coalesce(F.col(c), e) if c in df.columns else e for c, e in covariates.items()}
        return joined.select("cell", F.lit(domain).alias("domain"), *(finite(F.col(f).cast("double")).alias(f) for f in features), *(e.alias(c) for c, e in filled.items()), group.alias("grp"))

    return side(real, "experimental_doublet", F.col("cell")).unionByName(side(made, "semireal_heterotypic_doublet", F.col("parent_1")))


# What every metric is computed on, as data.
METRICS = (
    ("auroc", "doublets", "all others", "all test rows", "none"),
    ("overall_auprc", "doublets", "all others", "all test rows", "none"),
    ("homotypic_auprc", "homotypic doublets", "all others", "without heterotypic doublets", "none"),
    ("heterotypic_auprc", "heterotypic doublets", "all others", "without homotypic doublets", "none"),
    ("macro_subtype_auprc", "mean of both subtypes", "as in each", "as in each", "none"),
    ("homotypic_vs_high_auprc", "homotypic doublets", "high-count singlets", "these two", "none"),
    ("fpr", "high-count singlets selected", "those left", "shortest prefix with half of the homotypic doublets", "matched recall"),
    ("fpr_fixed", "high-count singlets selected", "those left", "a fifth of all rows", "rint(0.2 * rows)"),
    ("fpr_budget", "high-count singlets selected", "those left", "as many rows as doublets", "doublets"),
    ("precision_at_k", "doublets selected", "others selected", "as many rows as doublets", "doublets"),
    ("recall_at_k", "doublets selected", "doublets left", "as many rows as doublets", "doublets"),
)


def metric_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(METRICS), "metric string, positive string, negative string, subset string, budget string")


def method_status(scores: DataFrame) -> DataFrame:
    """Per method: its most frequent status (ties to the first by name) and its longest run time.  scores: method, status, runtime."""
    counts = scores.filter("status IS NOT NULL").groupBy("method", "status").agg(F.count("*").alias("_n"))
    common = counts.groupBy("method").agg(F.min_by("status", F.struct(-F.col("_n"), F.col("status"))).alias("status"))
    return scores.groupBy("method").agg(F.max(finite(F.col("runtime").cast("double"))).alias("runtime"), F.count("*").alias("rows")).join(common, "method", "left")


def centroid_distances(centroids: DataFrame) -> DataFrame:
    """group, nearest, distance: the nearest other centroid of every group, ties to the smaller group.  centroids: group, p, mean; groups are few."""
    other = centroids.select(F.col("group").alias("nearest"), "p", F.col("mean").alias("_m"))
    pairs = centroids.join(other, "p").filter(F.col("group") != F.col("nearest")).groupBy("group", "nearest").agg(F.sqrt(F.sum((F.col("mean") - F.col("_m")) ** 2)).alias("distance"))
    return pairs.groupBy("group").agg(F.min(F.struct(F.round("distance", 9).alias("d"), "nearest", "distance")).alias("x")).select("group", "x.nearest", "x.distance")


def plan_checks(pairs: DataFrame, splits: list[str], subtypes: list[str]) -> DataFrame:
    """Contract of a pair plan (synthetic, split, subtype, parent_1, parent_2): gaps, repeated ids, unknown splits and subtypes, equal parents, repeated pairs, and parents of several splits."""
    a, b = F.col("parent_1").cast("string"), F.col("parent_2").cast("string")
    rows = pairs.select("synthetic", "split", "subtype", a.alias("a"), b.alias("b"), F.least(a, b).alias("x"), F.greatest(a, b).alias("y"))
    gaps = reduce(lambda p, q: p | q, [F.col(c).isNull() for c in ("synthetic", "split", "subtype", "a", "b")])
    one = rows.agg(
        F.count_if(gaps).alias("c0"), (F.count("*") - F.count_distinct("synthetic")).alias("c1"), F.count_if(~F.col("split").isin(*splits)).alias("c2"), F.count_if(~F.col("subtype").isin(*subtypes)).alias("c3"), F.count_if(F.col("a") == F.col("b")).alias("c4"))
    twice = rows.groupBy("split", "x", "y").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("c5"))
    across = rows.select("split", "a").union(rows.select("split", "b")).groupBy("a").agg(F.count_distinct("split").alias("n")).agg(F.count_if(F.col("n") > 1).alias("c6"))
    names = ("complete", "unique_ids", "known_splits", "known_subtypes", "two_parents", "no_repeated_pair", "no_parent_across_splits")
    return as_checks(one.crossJoin(F.broadcast(twice)).crossJoin(F.broadcast(across)), *(check(n, F.col(f"c{k}")) for k, n in enumerate(names)))


def parent_removal(pairs: DataFrame, reference: DataFrame) -> DataFrame:
    """Per split: pairs, distinct parents, those still in the reference, and PASS where there is none.  reference: cell."""
    parents = pairs.select("split", F.explode(F.array("parent_1", "parent_2")).alias("cell"))
    marked = parents.distinct().join(reference.select("cell", F.lit(1).alias("_r")), "cell", "left")
    held = marked.groupBy("split").agg(F.count("*").alias("parents"), F.count("_r").alias("in_reference"))
    joined = pairs.groupBy("split").agg(F.count("*").alias("pairs")).join(held, "split")
    return joined.withColumn("status", F.when(F.col("in_reference") == 0, "PASS").otherwise("FAIL"))


def single_valued(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, values, status: provenance columns hold one value and no gap."""
    one = df.agg(*(F.count_distinct(c).alias(f"n{k}") for k, c in enumerate(columns)), *(F.count_if(F.col(c).isNull()).alias(f"z{k}") for k, c in enumerate(columns)))
    rows = F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"n{k}").alias("values"), F.when((F.col(f"n{k}") == 1) & (F.col(f"z{k}") == 0), "PASS").otherwise("FAIL").alias("status")) for k, c in enumerate(columns)))
    return one.select(F.inline(rows))
