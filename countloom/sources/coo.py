"""Readers and writers of sparse counts, label parsing, key discovery and external scores."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from countloom.functions.scalars import binary_label

# Columns that are looked at first for labels.
LABEL_COLUMNS = ("doublet", "is_doublet", "doublet_label", "label", "labels", "true_label", "ground_truth", "classification")


def read_matrix_market(spark: SparkSession, matrix: str, barcodes: str, features: str | None) -> DataFrame:
    """cell, gene, count of a coordinate file; which side holds the cells follows from the number of barcodes.

    The first line that is no comment holds the sizes and is left out by its place.  Gene names that are missing or of
    another number become gene_0, gene_1, and so on; a matrix whose sides both differ from the barcodes is an error.
    """
    lines = spark.read.text(matrix).withColumn("_n", F.monotonically_increasing_id()).withColumn("value", F.trim("value")).filter(~F.col("value").startswith("%") & (F.col("value") != ""))
    parts = F.split("value", r"\s+")
    size = lines.agg(F.min(F.struct("_n", "value")).alias("s")).first()["s"]
    if size is None:
        raise ValueError("the matrix is empty")
    high, wide, *_ = (int(float(x)) for x in size["value"].split())
    cells = name_file(spark, barcodes, False)
    n_cells = cells.count()
    if n_cells not in (high, wide):
        raise ValueError("names and matrix differ in size")
    by_row = n_cells == high
    n_genes = wide if by_row else high
    genes = name_file(spark, features, True) if features else None
    if genes is None or genes.count() != n_genes:
        genes = spark.range(1, n_genes + 1).select(F.col("id").alias("place"), F.concat(F.lit("gene_"), (F.col("id") - 1).cast("string")).alias("name"))
    i, j = parts[0].cast("long"), parts[1].cast("long")
    rows = lines.filter(F.col("_n") > size["_n"]).select((i if by_row else j).alias("_c"), (j if by_row else i).alias("_g"), parts[2].cast("double").alias("count"))
    # an entry may come in parts, which add up
    placed = rows.groupBy("_c", "_g").agg(F.sum("count").alias("count")).filter("count > 0")
    return placed.join(cells.select(F.col("place").alias("_c"), F.col("name").alias("cell")), "_c").join(genes.select(F.col("place").alias("_g"), F.col("name").alias("gene")), "_g").select("cell", "gene", "count")


def name_file(spark: SparkSession, path: str, second: bool) -> DataFrame:
    """place (from 1) and unique name; the second column where the file is of genes and has one."""
    lines = spark.read.text(path, wholetext=False)
    rows = lines.rdd.zipWithIndex().map(lambda x: (x[1] + 1, x[0][0])).toDF("place long, line string")
    parts = F.split("line", "\t")
    name = F.when(F.lit(second) & (F.size(parts) > 1), parts[1]).otherwise(parts[0])
    return unique_names(rows.select("place", name.alias("raw")), "raw", "place").select("place", "name")


def unique_names(df: DataFrame, name: str, order: str) -> DataFrame:
    """The first keeps its name, the n-th gets _n-1."""
    r = F.row_number().over(W.partitionBy(name).orderBy(order))
    return df.withColumn("_r", r).withColumn("name", F.when(F.col("_r") == 1, F.col(name)).otherwise(F.concat(F.col(name), F.lit("_"), (F.col("_r") - 1).cast("string")))).drop("_r")


def read_wide(spark: SparkSession, path: str, sep: str = ",", key: str | None = None, labels: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(counts, labels) of a table with one row a cell and one column a gene."""
    df = spark.read.csv(path, header=True, sep=sep)
    key = key or df.columns[0]
    labels = labels or label_column([c for c in df.columns if c != key])
    genes = [c for c in df.columns if c not in (key, labels)]
    long = df.unpivot([key], genes, "gene", "count").select(F.col(key).alias("cell"), "gene", F.col("count").try_cast("double").alias("count")).filter("count > 0")
    found = df.select(F.col(key).alias("cell"), F.col(labels).alias("raw")) if labels else df.select(F.col(key).alias("cell"), F.lit(None).cast("string").alias("raw"))
    return long, parse_labels(found, "raw", "label")


def label_column(columns: list[str]) -> str | None:
    lower = {c.lower(): c for c in columns}
    for name in LABEL_COLUMNS:
        if name in lower:
            return lower[name]
    return next((c for c in columns if any(t in c.lower() for t in ("doublet", "label", "class"))), None)


def parse_labels(df: DataFrame, raw: str, out: str) -> DataFrame:
    """0 or 1, or NULL throughout unless every row parses and both classes occur."""
    parsed = df.withColumn("_l", binary_label(F.col(raw)))
    good = parsed.agg((F.count_if(F.col("_l").isNull()) == 0).alias("all"), (F.count_distinct("_l") == 2).alias("both")).select((F.col("all") & F.col("both")).alias("_ok"))
    return parsed.crossJoin(F.broadcast(good)).withColumn(out, F.when(F.col("_ok"), F.col("_l"))).drop("_l", "_ok")


def key_overlap(df: DataFrame, columns: list[str], ids: DataFrame) -> DataFrame:
    """k, n: distinct values of each column that are among ids (id)."""
    out = None
    for c in columns:
        one = df.select(F.col(c).alias("id")).distinct().join(ids, "id", "left_semi").agg(F.count("*").alias("n")).select(F.lit(c).alias("k"), "n")
        out = one if out is None else out.union(one)
    return out


def join_key(df: DataFrame, columns: list[str], ids: DataFrame, share: float = 0.5) -> str | None:
    """The first column that holds at least this share of the ids."""
    total = ids.distinct().count()
    found = {r["k"]: r["n"] for r in key_overlap(df, columns, ids).collect()}
    return next((c for c in columns if total and found[c] >= share * total), None)


def aligned_scores(scores: DataFrame, cells: DataFrame, order: str) -> DataFrame:
    """One row for every cell and method: the first score by `order`, NULL where there is none."""
    first = scores.groupBy("cell", "method").agg(F.min_by("score", order).alias("score"))
    methods = scores.select("method").distinct()
    # methods are few names; the grid has one row for each cell and method
    grid = cells.crossJoin(methods)
    return grid.join(first, ["cell", "method"], "left")


def cache_key(**parts) -> str:
    return hashlib.sha1(json.dumps(parts, sort_keys=True, default=str).encode()).hexdigest()


def write_results(cells: DataFrame, scores: DataFrame, path: str, form: str = "parquet") -> None:
    """Cells with their result columns, left-aligned by id."""
    renamed = {"overall": "doublet_score", "predicted_doublet": "doublet_prediction", "predicted_subtype": "doublet_subtype"}
    out = cells.join(scores.withColumnsRenamed({k: v for k, v in renamed.items() if k in scores.columns}), "cell", "left")
    out.write.mode("overwrite").format(form).save(path)


def read_all(spark: SparkSession, root: str, name: str) -> DataFrame:
    """All tables of one name below a folder, with their file, columns matched by name."""
    return spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", name).option("header", True).csv(root).withColumn("source_file", F.input_file_name())


def aligned_labels(labels: DataFrame, columns: list[str], label: str, cells: DataFrame) -> DataFrame:
    """cells (cell, place) with label, by the first column that holds at least half of them, else by place where both are as many; else an error.

    labels: the columns, label and place.
    """
    key = join_key(labels, columns, cells.select(F.col("cell").alias("id")))
    if key is not None:
        found = labels.groupBy(F.col(key).cast("string").alias("cell")).agg(F.min_by(label, "place").alias(label))
        return cells.join(found, "cell", "left").select("cell", label)
    if labels.count() != cells.count():
        raise ValueError("labels match neither by id nor in number")
    return cells.join(labels.select("place", label), "place", "left").select("cell", label)


def load_scores(cached: DataFrame | None, cells: DataFrame) -> tuple[DataFrame | None, str]:
    """(scores, "") of a cache that holds a finite score for every cell once and nothing else, or (None, why it is refused)."""
    if cached is None:
        return None, "not there"
    both = cells.select("cell", F.lit(1).alias("_w")).join(cached.select("cell", "score", F.lit(1).alias("_c")), "cell", "full")
    bad = F.isnan("score") | F.col("score").isNull() | (F.abs("score") == float("inf"))
    one = both.agg(F.count_if(F.col("_c").isNull()).alias("missing"), F.count_if(F.col("_w").isNull()).alias("unknown"), F.count_if(F.col("_c").isNotNull() & bad).alias("bad"), (F.count("*") - F.count_distinct("cell")).alias("twice")).first()
    for name, why in (("missing", "cells are missing"), ("unknown", "cells are unknown"), ("bad", "scores are not finite"), ("twice", "cells repeat")):
        if one[name]:
            return None, why
    return cached, ""
