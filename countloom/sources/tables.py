"""The driver's tables seen as sparse counts: customers by parts, documents by tokens, and small score tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def purchase_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cell = customer, gene = part, count = quantity bought.  One join on the order key, one aggregation."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.groupBy(F.col("o_custkey").cast("string").alias("cell"), F.col("l_partkey").cast("string").alias("gene")).agg(F.sum("l_quantity").alias("count"))


def customer_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cell, cluster (market segment), library (region)."""
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    c = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return c.select(F.col("c_custkey").cast("string").alias("cell"), F.col("c_mktsegment").alias("cluster"), F.col("r_name").alias("library"))


def token_counts(spark: SparkSession, sf_dir: str, dealt: bool = False) -> DataFrame:
    """cell = document, gene = token [a-z]+, count = occurrences.

    With dealt, texts are dealt by document before they are split, so that what is grouped by document later is in place; they are shorter than their counts.
    """
    tokens = F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), 1))
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("cell"), "text")
    texts = texts.repartition("cell") if dealt else texts
    return texts.select("cell", tokens.alias("gene")).groupBy("cell", "gene").agg(F.count("*").cast("double").alias("count"))


def document_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("cell"), F.col("lang").alias("cluster"), F.col("source").alias("library"))


def customer_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    from countloom.operators.matrix import cell_totals

    totals = cell_totals(purchase_counts(spark, sf_dir))
    return totals.join(customer_cells(spark, sf_dir), "cell").withColumns({"log_count": F.log1p("n_count"), "log_feature": F.log1p("n_feature")})


def demo_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores with many ties and three kinds of rows, from the customers' keys and balances."""
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        k.cast("string").alias("cell"), F.col("c_mktsegment").alias("cluster"), k.alias("key"),
        ((k * 37) % 101 / 100.0).alias("s1"), ((k * 53) % 97 / 96.0).alias("s2"), ((k * 11) % 89 / 88.0).alias("s3"),
        F.when(k * 7 % 5 == 0, 1).otherwise(0).alias("positive"), F.when(k * 7 % 5 == 1, 1).otherwise(0).alias("hard"),
        F.when(k * 7 % 5 == 0, F.when(k % 2 == 0, "homotypic_doublet").otherwise("heterotypic_doublet")).when(k * 7 % 5 == 1, "high_RNA_singlet").otherwise("clean").alias("label"))


def rounded(x: Column, places: int) -> Column:
    """x to so many places, halves of the product in doubles away from zero, as DuckDB does (products below 2^52); Spark's own round goes by the shortest decimal text of x."""
    unit = F.lit(float(10**places))
    return F.signum(x) * F.floor(F.abs(x * unit) + 0.5) / unit


def rough_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores as they come: balances and spending of customers, beyond 0 to 1 on both sides, some missing, some not a number."""
    k = F.col("c_custkey")
    spent = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sum("o_totalprice").alias("spent"))
    return table(spark, sf_dir, "customer").join(spent, "c_custkey", "left").select(
        k.cast("string").alias("cell"), F.col("c_mktsegment").alias("cluster"), k.alias("key"),
        F.when(k % 13 != 0, rounded(F.col("c_acctbal") / 8000, 3)).alias("a"),
        F.when(k % 19 == 0, float("nan")).when(k % 23 != 0, rounded((k * 53 % 97) / 80.0 - 0.1, 4)).alias("b"),
        rounded(1 - F.col("c_acctbal") / 9000, 3).alias("c"), rounded(F.col("spent"), 2).alias("spent"),
        F.when(k * 7 % 5 == 0, F.when(k % 2 == 0, "homotypic_doublet").otherwise("heterotypic_doublet")).when(k * 7 % 5 == 1, "high_RNA_singlet").otherwise("clean").alias("label"))


def rough_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rough_scores with what rankings need: positive and hard; b is missing on some rows and not a number on others."""
    label = F.col("label")
    return rough_scores(spark, sf_dir).withColumns({"positive": label.endswith("_doublet").cast("int"), "hard": (label == "high_RNA_singlet").cast("int")})


def method_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rough_scores by method: a, b, c, and one method without any score."""
    s = rough_scores(spark, sf_dir).withColumn("none", F.lit(None).cast("double"))
    long = s.unpivot(["cell", "cluster", "key", "label"], ["a", "b", "c", "none"], "method", "score")
    return long.withColumn("high", F.col("label") == "high_RNA_singlet")
