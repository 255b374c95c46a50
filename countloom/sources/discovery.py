"""Finding data sets below a folder, and loading them: what fails becomes a row with its reason.

Folders are listed through Spark's file systems, so a path may be in any store that Spark reads.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from countloom.sources import coo

# Names of the files of a data set, in the order in which they are looked for.
MATRIX = ("counts.mtx", "matrix.mtx", "counts.mtx.gz", "matrix.mtx.gz")
GENES = ("genes.tsv", "features.tsv", "genes.txt", "features.txt", "genes.tsv.gz", "features.tsv.gz")
BARCODES = ("barcodes.tsv", "barcodes.txt", "cells.tsv", "cells.txt", "barcodes.tsv.gz")
LABELS = ("labels.tsv", "label.tsv", "doublet_labels.tsv", "metadata.tsv", "labels.csv", "metadata.csv")
# Tables with these names belong to a data set and are none themselves; folders that are not searched.
SIDECARS = ("barcodes", "genes", "features", "labels", "label", "metadata", "matrix", "counts")
SKIPPED = ("converted", "cache")


@dataclass
class Loaded:
    dataset: str
    form: str
    status: str
    message: str
    counts: DataFrame | None = None
    labels: DataFrame | None = None


def files(spark: SparkSession, root: str) -> list[str]:
    """Paths of all files below root, in order, without hidden ones and those below skipped folders."""
    jvm = spark._jvm
    top = jvm.org.apache.hadoop.fs.Path(root)
    system = top.getFileSystem(spark._jsc.hadoopConfiguration())
    base = system.makeQualified(top).toString().rstrip("/")
    found, each = [], system.listFiles(top, True)
    while each.hasNext():
        path = each.next().getPath().toString()
        parts = path[len(base) + 1 :].split("/")
        if not any(p.startswith(".") for p in parts) and not any(p.lower() in SKIPPED for p in parts[:-1]):
            found.append(path)
    return sorted(found, key=str.lower)


def discovered(spark: SparkSession, root: str) -> list[tuple[str, str, str]]:
    """(data set, form, path): folders with a matrix file, and tables that are not part of one."""
    out = {}
    for path in files(spark, root):
        folder, name = path.rsplit("/", 1)
        stem, _, suffix = name.partition(".")
        if name in MATRIX:
            out[folder] = (folder.rsplit("/", 1)[1], "directory", folder)
        elif suffix.lower() in ("csv", "tsv", "rds", "h5ad") and stem.lower() not in SIDECARS:
            out[path] = (stem, suffix.lower(), path)
    return sorted(out.values(), key=lambda x: x[2].lower())


def _first(held: set[str], names: tuple[str, ...]) -> str | None:
    return next((n for n in names if n in held), None)


def manifest(spark: SparkSession, root: str) -> DataFrame:
    """dataset, path, form, matrix, labels, status, reason of everything below root; one name at two places is an error."""
    rows, seen = [], {}
    for name, form, path in discovered(spark, root):
        if seen.setdefault(name, path) != path:
            raise ValueError(f"{name} stands for {seen[name]} and {path}")
        matrix, labels, missing = path, "embedded", []
        if form == "directory":
            held = {f.rsplit("/", 1)[1] for f in files(spark, path)}
            parts = {kind: _first(held, names) for kind, names in (("matrix", MATRIX), ("genes", GENES), ("barcodes", BARCODES), ("labels", LABELS))}
            matrix, labels = parts["matrix"] or "", parts["labels"] or ""
            missing = [kind for kind, found in parts.items() if found is None]
        rows.append((name, path, form, matrix, labels, "invalid" if missing else "valid", "missing " + ", ".join(missing) if missing else ""))
    return spark.createDataFrame(rows, "dataset string, path string, form string, matrix string, labels string, status string, reason string")


def load(spark: SparkSession, name: str, form: str, path: str) -> Loaded:
    """A data set's counts and labels, or why there are none: skipped where its form or files do not serve, failed on any error."""
    try:
        if form in ("csv", "tsv"):
            counts, labels = coo.read_wide(spark, path, "," if form == "csv" else "\t")
            return Loaded(name, form, "success", "", counts, labels)
        if form != "directory":
            return Loaded(name, form, "skipped", f"no reader for {form}")
        held = {f.rsplit("/", 1)[1] for f in files(spark, path)}
        matrix, genes, barcodes, labels = (_first(held, names) for names in (MATRIX, GENES, BARCODES, LABELS))
        if not (matrix and barcodes and labels):
            return Loaded(name, form, "skipped", "matrix, barcodes or labels are missing")
        at = lambda f: f"{path}/{f}"
        counts = coo.read_matrix_market(spark, at(matrix), at(barcodes), at(genes) if genes else None)
        cells = coo.name_file(spark, at(barcodes), False).select(F.col("name").alias("cell"), "place")
        table = spark.read.csv(at(labels), header=True, sep="," if labels.endswith(".csv") else "\t")
        column = coo.label_column(table.columns)
        if column is None:
            return Loaded(name, form, "skipped", "no label column")
        keys = [c for c in table.columns if c != column]
        numbered = table.rdd.zipWithIndex().map(lambda x: (*x[0], x[1] + 1)).toDF(", ".join(f"`{c}` string" for c in table.columns) + ", place long")
        found = coo.parse_labels(coo.aligned_labels(numbered, keys, column, cells), column, "label").select("cell", "label")
        if found.filter("label IS NOT NULL").isEmpty():
            return Loaded(name, form, "skipped", "labels do not parse")
        return Loaded(name, form, "success", "", counts, found)
    except Exception as error:  # noqa: BLE001  a data set that cannot be read is a row of the report
        return Loaded(name, form, "failed", str(error).splitlines()[0][:300])


def status_rows(spark: SparkSession, loaded: list[Loaded]) -> DataFrame:
    return spark.createDataFrame([(x.dataset, x.form, x.status, x.message) for x in loaded], "dataset string, form string, status string, message string")
