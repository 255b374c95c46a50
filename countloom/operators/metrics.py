"""Evaluation of rankings: areas, top-K, operating points, paired summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from countloom.functions.running import known, numbered, running_sums


def _sums(df: DataFrame, score: str, label: str, by: list[str]) -> DataFrame:
    """Positives and rows by score; rows without a finite score count as none, but keep their group."""
    there = F.col(score).isNotNull()
    return df.withColumn(score, known(score)).groupBy(*by, score).agg(
        F.coalesce(F.sum(F.when(there, F.col(label).cast("double"))), F.lit(0.0)).alias("_p"), F.count(F.when(there, 1)).cast("double").alias("_c"))


def auroc(df: DataFrame, score: str, label: str, by: list[str] | None = None) -> DataFrame:
    """Mann-Whitney with ties averaged, over finite scores; NULL with one class.  Sums run over distinct scores, range by range."""
    by = by or []
    s = _sums(df, score, label, by).withColumn("_n", F.col("_c") - F.col("_p"))
    s = running_sums(s, score, {"_below": "_n"}, by).withColumn("_below", F.col("_below") - F.col("_n"))
    out = s.groupBy(*by).agg(
        F.sum(F.col("_p") * (F.col("_below") + F.col("_n") / 2)).alias("_u"), F.sum("_p").alias("_P"), F.sum("_n").alias("_N"))
    return out.select(*by, F.when((F.col("_P") > 0) & (F.col("_N") > 0), F.col("_u") / (F.col("_P") * F.col("_N"))).alias("auroc"))


def average_precision(df: DataFrame, score: str, label: str, by: list[str] | None = None) -> DataFrame:
    """Step sum over distinct thresholds, over finite scores; NULL with one class."""
    by = by or []
    s = running_sums(_sums(df, score, label, by), score, {"_tp": "_p", "_k": "_c"}, by, descending=True)
    out = s.groupBy(*by).agg(F.sum(F.when(F.col("_k") > 0, F.col("_p") * F.col("_tp") / F.col("_k"))).alias("_a"), F.sum("_p").alias("_P"), F.sum("_c").alias("_N"))
    return out.select(*by, F.when((F.col("_P") > 0) & (F.col("_N") > F.col("_P")), F.col("_a") / F.col("_P")).alias("auprc"))


def _with_total(df: DataFrame, column: str, by: list[str]) -> DataFrame:
    """df with _k: the column's sum in each group."""
    total = df.groupBy(*by).agg(F.sum(column).alias("_k"))
    return df.join(total, by) if by else df.crossJoin(F.broadcast(total))  # one row


def top_k(df: DataFrame, score: str, key: str, label: str, by: list[str] | None = None) -> DataFrame:
    """Precision and recall of the K best rows, K being the number of positives; ties by key."""
    by = by or []
    ranked = _with_total(numbered(df, score, key, "_r", by), label, by)
    out = ranked.groupBy(*by).agg(F.max("_k").alias("k"), F.sum(F.when(F.col("_r") <= F.col("_k"), F.col(label)).otherwise(0)).alias("hits"))
    return out.withColumns({"precision": F.when(F.col("k") > 0, F.col("hits") / F.col("k")), "recall": F.when(F.col("k") > 0, F.col("hits") / F.col("k"))})


def fpr_at_budget(df: DataFrame, score: str, key: str, positive: str, hard: str, by: list[str] | None = None) -> DataFrame:
    """Share of the hard negatives among the K best rows, K being the number of positives."""
    by = by or []
    ranked = _with_total(numbered(df, score, key, "_r", by), positive, by)
    return ranked.groupBy(*by).agg(
        F.max("_k").alias("budget"), F.sum(F.when(F.col("_r") <= F.col("_k"), F.col(hard)).otherwise(0)).alias("false_hits"),
        F.sum(hard).alias("hard")).withColumn("fpr", F.when(F.col("hard") > 0, F.col("false_hits") / F.col("hard")))


def operating_points(df: DataFrame, score: str, key: str, positive: str, hard: str, recalls=(0.5, 0.7, 0.8, 0.9)) -> DataFrame:
    """For every recall: the shortest prefix that reaches it, its threshold (NULL where rows without a finite score are needed, which come last), precision, recall and false rate among hard negatives."""
    sums = df.agg(F.sum(positive).alias("_P"), F.sum(hard).alias("_H"))
    rows = running_sums(numbered(df.withColumn(score, known(score)), score, key, "_r", []), "_r", {"_tp": positive, "_fp": hard}, []).crossJoin(F.broadcast(sums))  # one row
    wanted = F.explode(F.array(*(F.lit(float(r)) for r in recalls)))
    spread = rows.withColumn("target", wanted).filter(F.col("_tp") >= F.ceil(F.col("target") * F.col("_P") - 1e-12))
    best = spread.groupBy("target").agg(F.min(F.struct("_r", score, "_tp", "_fp", "_P", "_H")).alias("m"))
    return best.select(
        "target", F.col("m._r").cast("long").alias("selected"), F.col(f"m.{score}").alias("threshold"), (F.col("m._tp") / F.col("m._r")).alias("precision"),
        F.when(F.col("m._P") > 0, F.col("m._tp") / F.col("m._P")).alias("recall"), F.when(F.col("m._H") > 0, F.col("m._fp") / F.col("m._H")).alias("hard_fpr"))


def rate_budget(df: DataFrame, score: str, key: str, rate: float) -> DataFrame:
    """The round(rate * n) best rows, halves to even."""
    ranked = numbered(df, score, key, "rank", []).crossJoin(F.broadcast(df.agg(F.count("*").alias("_n"))))  # one row
    return ranked.withColumn("selected", F.col("rank") <= F.rint(F.lit(rate) * F.col("_n"))).drop("_n")


def cliffs_delta(df: DataFrame, score: str, label: str) -> DataFrame:
    return auroc(df, score, label).select((2 * F.col("auroc") - 1).alias("cliffs_delta"))


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    from countloom.functions.ranks import percentile_rank

    ranked = percentile_rank(percentile_rank(df, a, "_ra"), b, "_rb")
    return ranked.agg(F.corr("_ra", "_rb").alias("spearman"))


def feature_statistics(df: DataFrame, features: list[str], group: str, case: str, control: str, covariate: str) -> DataFrame:
    """Per feature and group: n, median, quartiles and rank correlation with the covariate; per feature the case's standardised effect, Cliff's delta and AUROC against the control.

    Missing values are left out.  The effect is the difference of medians over the standard deviation of both groups together.
    """
    long = df.unpivot([group, covariate], features, "feature", "v").filter("v IS NOT NULL")
    spread = F.expr("percentile(v, array(0.25, 0.5, 0.75))")
    stats = long.groupBy("feature", group).agg(F.count("*").alias("n"), spread.alias("_q"))
    pair = long.filter(F.col(group).isin(case, control)).withColumn("_y", (F.col(group) == case).cast("int"))
    scale = pair.groupBy("feature").agg(F.stddev_samp("v").alias("_s"))
    middle = lambda g, name: stats.filter(F.col(group) == g).select("feature", F.col("_q")[1].alias(name))
    effect = scale.join(middle(case, "_a"), "feature", "left").join(middle(control, "_b"), "feature", "left").select("feature", F.when(F.col("_s") > 0, (F.col("_a") - F.col("_b")) / F.col("_s")).alias("effect"))
    area = auroc(pair, "v", "_y", ["feature"])
    place = lambda c: (F.rank().over(W.partitionBy("feature", group).orderBy(c)) + (F.count("*").over(W.partitionBy("feature", group, c)) - 1) / 2)
    agreed = long.filter(F.col(covariate).isNotNull()).select("feature", group, place("v").alias("_rv"), place(covariate).alias("_rn")).groupBy("feature", group).agg(F.corr("_rv", "_rn").alias("spearman"))
    out = stats.join(effect, "feature", "left").join(area, "feature", "left").join(agreed, ["feature", group], "left")
    return out.select("feature", group, "n", F.col("_q")[1].alias("median"), F.col("_q")[0].alias("q25"), F.col("_q")[2].alias("q75"), "effect", (2 * F.col("auroc") - 1).alias("cliffs_delta"), "auroc", "spearman")


def permutation_summary(null: DataFrame, observed: DataFrame) -> DataFrame:
    """null: metric, value.  observed: metric, observed, direction (higher or lower is better).  Per metric the null's shape, the empirical p and what it supports."""
    v, o, higher = F.col("value"), F.col("observed"), F.col("direction") == "higher"
    joined = null.join(F.broadcast(observed), "metric")  # one row a metric
    out = joined.groupBy("metric", "direction", "observed").agg(
        F.count("value").alias("n"), F.avg("value").alias("null_mean"), F.stddev_samp("value").alias("_s"), F.expr("percentile(value, array(0.025, 0.5, 0.975))").alias("_q"),
        F.count_if(F.when(higher, v >= o).otherwise(v <= o)).alias("_tail"), F.count_if(v <= o).alias("_up"))
    p = (1 + F.col("_tail")) / (1.0 + F.col("n"))
    side = F.when(higher, o > F.col("null_mean")).otherwise(o < F.col("null_mean"))
    return out.select(
        "metric", "direction", "observed", "n", "null_mean", F.when(F.col("n") == 1, 0.0).otherwise(F.col("_s")).alias("null_std"), F.col("_q")[1].alias("null_median"), F.col("_q")[0].alias("null_025"), F.col("_q")[2].alias("null_975"),
        p.alias("p"), (100.0 * F.col("_up") / F.col("n")).alias("percentile"), F.when(F.col("n") < 20, "INCONCLUSIVE").when(side & (p <= 0.05), "SUPPORTED").otherwise("NOT_SUPPORTED").alias("evidence"))


def fold_metrics(predictions: DataFrame, fold: str, score: str, label: str, cut: float = 0.5) -> DataFrame:
    """Per fold and pooled (fold -1): AUROC, average precision, prevalence, balanced accuracy and Matthews' correlation at the cut."""
    both = predictions.select(F.explode(F.array(F.col(fold), F.lit(-1).cast(predictions.schema[fold].dataType))).alias(fold), score, label)
    hit, true = F.col(score) >= cut, F.col(label) == 1
    counts = both.groupBy(fold).agg(*(F.count_if(c).cast("double").alias(n) for n, c in (("tp", hit & true), ("fp", hit & ~true), ("fn", ~hit & true), ("tn", ~hit & ~true))))
    tp, fp, fn, tn = (F.col(n) for n in ("tp", "fp", "fn", "tn"))
    product = (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)
    joined = counts.join(auroc(both, score, label, [fold]), fold).join(average_precision(both, score, label, [fold]), fold)
    return joined.select(
        fold, "auroc", "auprc", ((tp + fn) / (tp + fp + fn + tn)).alias("prevalence"), F.when((tp + fn > 0) & (tn + fp > 0), (tp / (tp + fn) + tn / (tn + fp)) / 2).alias("balanced_accuracy"),
        F.when(product > 0, (tp * tn - fp * fn) / F.sqrt(product)).otherwise(0.0).alias("mcc"))


def fold_summary(folds: DataFrame, fold: str, apart: float = 0.1) -> DataFrame:
    """One row over the folds of fold_metrics; average precision is not averaged where prevalences lie more than `apart` apart."""
    own, pooled = F.col(fold) >= 0, F.col(fold) == -1
    within = lambda f, c: f(F.when(own, F.col(c)))
    alike = within(F.max, "prevalence") - within(F.min, "prevalence") <= apart
    return folds.agg(
        F.count_if(own).alias("folds"), within(F.avg, "auroc").alias("auroc_mean"), within(F.stddev_pop, "auroc").alias("auroc_std"), F.when(alike, within(F.avg, "auprc")).alias("auprc_mean"),
        F.when(alike, within(F.stddev_pop, "auprc")).alias("auprc_std"), F.max(F.when(pooled, F.col("auroc"))).alias("pooled_auroc"), F.max(F.when(pooled, F.col("auprc"))).alias("pooled_auprc"))
