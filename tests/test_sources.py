"""Readers, discovery, caches, manifests and the ledger on small files."""

import datetime
import gzip

import pytest
from pyspark.sql import functions as F

from countloom.operators import ledger
from countloom.sources import coo, discovery, manifests


def put(folder, name, text):
    folder.mkdir(parents=True, exist_ok=True)
    data = text.encode()
    (folder / name).write_bytes(gzip.compress(data) if name.endswith(".gz") else data)


def matrix(rows, shape):
    return "%%MatrixMarket matrix coordinate integer general\n%note\n" + f"{shape[0]} {shape[1]} {len(rows)}\n" + "".join(f"{i} {j} {v}\n" for i, j, v in rows)


@pytest.fixture
def tree(tmp_path):
    # genes by cells; the last entry equals the size line
    put(tmp_path / "one", "matrix.mtx.gz", matrix([(1, 1, 5), (2, 3, 1), (2, 2, 4), (4, 3, 4)], (4, 3)))
    put(tmp_path / "one", "barcodes.tsv", "A\nB\nC\n")
    put(tmp_path / "one", "features.tsv", "id1\tg\nid2\tg\nid3\th\nid4\ti\n")
    put(tmp_path / "one", "labels.tsv", "barcode\tdoublet\nC\tyes\nA\tno\nB\tno\n")
    # cells by genes, too few gene names, labels by place
    put(tmp_path / "deep" / "two", "counts.mtx", matrix([(1, 1, 2), (2, 3, 7)], (2, 3)))
    put(tmp_path / "deep" / "two", "cells.txt", "X\nY\n")
    put(tmp_path / "deep" / "two", "genes.txt", "only\n")
    put(tmp_path / "deep" / "two", "metadata.csv", "row,label\n10,doublet\n20,singlet\n")
    put(tmp_path / "broken", "matrix.mtx", matrix([(1, 1, 2)], (5, 5)))
    put(tmp_path / "broken", "barcodes.tsv", "X\nY\n")
    put(tmp_path / "broken", "labels.tsv", "barcode\tlabel\nX\t1\nY\t0\n")
    put(tmp_path / "bare", "matrix.mtx", matrix([(1, 1, 2)], (1, 1)))
    put(tmp_path, "wide.csv", "cell,g1,g2,is_doublet\na,1,0,1\nb,2,3,0\n")
    put(tmp_path, "old.rds", "x")
    put(tmp_path / "cache", "hidden.csv", "a,b\n1,2\n")
    put(tmp_path, ".secret.csv", "a,b\n1,2\n")
    return tmp_path


def test_discovery_and_manifest(spark, tree):
    found = {(n, f) for n, f, _ in discovery.discovered(spark, str(tree))}
    assert found == {("one", "directory"), ("two", "directory"), ("broken", "directory"), ("bare", "directory"), ("wide", "csv"), ("old", "rds")}
    rows = {r["dataset"]: r for r in discovery.manifest(spark, str(tree)).collect()}
    assert rows["one"]["status"] == rows["wide"]["status"] == "valid" and rows["bare"]["reason"] == "missing genes, barcodes, labels"
    put(tree / "again" / "one", "matrix.mtx", matrix([(1, 1, 2)], (1, 1)))
    with pytest.raises(ValueError):
        discovery.manifest(spark, str(tree))


def test_loading_gives_counts_or_a_reason(spark, tree):
    loaded = {x.dataset: x for x in (discovery.load(spark, *d) for d in discovery.discovered(spark, str(tree)))}
    get = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert get(loaded["one"].counts) == [("A", "g", 5.0), ("B", "g_1", 4.0), ("C", "g_1", 1.0), ("C", "i", 4.0)]
    assert get(loaded["one"].labels) == [("A", 0), ("B", 0), ("C", 1)]
    assert get(loaded["two"].counts) == [("X", "gene_0", 2.0), ("Y", "gene_2", 7.0)]
    assert get(loaded["two"].labels) == [("X", 1), ("Y", 0)]
    assert get(loaded["wide"].counts) == [("a", "g1", 1.0), ("b", "g1", 2.0), ("b", "g2", 3.0)]
    status = {r["dataset"]: (r["status"], r["message"]) for r in discovery.status_rows(spark, list(loaded.values())).collect()}
    assert status["broken"] == ("failed", "names and matrix differ in size") and status["bare"][0] == status["old"][0] == "skipped" and status["one"] == ("success", "")


def test_label_columns_in_the_preferred_order():
    assert coo.label_column(["x", "Label", "doublet"]) == "doublet" and coo.label_column(["cell_class", "y"]) == "cell_class" and coo.label_column(["x"]) is None


def test_all_tables_of_one_name(spark, tmp_path):
    put(tmp_path / "a", "m.csv", "x,y\n1,2\n")
    put(tmp_path / "b" / "c", "m.csv", "x,y\n3,4\n")
    rows = coo.read_all(spark, str(tmp_path), "m.csv").collect()
    assert sorted((r["x"], r["y"], r["source_file"].rsplit("/", 2)[1]) for r in rows) == [("1", "2", "a"), ("3", "4", "c")]


def test_cached_scores_are_refused_unless_complete(spark):
    cells = spark.createDataFrame([("a",), ("b",)], "cell string")
    cache = lambda *rows: spark.createDataFrame(list(rows), "cell string, score double")
    assert coo.load_scores(cache(("a", 0.1), ("b", 0.2)), cells)[1] == ""
    for rows, why in (((("a", 0.1),), "cells are missing"), ((("a", 0.1), ("b", 0.2), ("c", 1.0)), "cells are unknown"), ((("a", 0.1), ("b", float("nan"))), "scores are not finite"), ((("a", 0.1), ("a", 0.1), ("b", 0.2)), "cells repeat")):
        assert coo.load_scores(cache(*rows), cells) == (None, why)
    assert coo.load_scores(None, cells) == (None, "not there")
    assert coo.cache_key(a=1, b="x") == coo.cache_key(b="x", a=1) != coo.cache_key(a=2, b="x")


def test_results_keep_every_cell(spark, tmp_path):
    cells = spark.createDataFrame([("a", 1), ("b", 2)], "cell string, n int")
    scores = spark.createDataFrame([("a", 0.7, True, "homotypic_doublet")], "cell string, overall double, predicted_doublet boolean, predicted_subtype string")
    coo.write_results(cells, scores, str(tmp_path / "r"))
    rows = {r["cell"]: r for r in spark.read.parquet(str(tmp_path / "r")).collect()}
    assert rows["a"]["doublet_score"] == 0.7 and rows["a"]["doublet_prediction"] and rows["b"]["doublet_score"] is None


def test_a_run_resumes_only_with_its_own_config(spark, tmp_path):
    df, path = spark.range(7), str(tmp_path / "run")
    assert manifests.resumed(spark, path, {"a": 1}) is None
    manifests.write_run(df, path, {"a": 1}, "run it")
    assert manifests.resumed(spark, path, {"a": 1}).count() == 7 and manifests.resumed(spark, path, {"a": 2}) is None
    files = manifests.output_manifest(spark, f"{path}/data").collect()
    assert files and all(len(r["sha256"]) == 64 and r["bytes"] > 0 for r in files)
    spark.range(3).write.mode("overwrite").parquet(f"{path}/data")
    assert manifests.resumed(spark, path, {"a": 1}) is None


def test_fixture_is_the_same_again(spark):
    counts, cells = manifests.fixture(spark, 40, 20, 5)
    again, _ = manifests.fixture(spark, 40, 20, 5)
    assert counts.exceptAll(again).isEmpty() and cells.filter("label = 1").count() == 3 and cells.select("cluster").distinct().count() == 4


def test_ledger_rows_are_appended_and_finished(spark, tmp_path):
    at = lambda m: datetime.datetime(2024, 1, 1, 0, m)
    schema = "stage string, dataset string, start_time timestamp, end_time timestamp, status string, elapsed_seconds double"
    path = str(tmp_path / "ledger")
    ledger.appended(path, spark.createDataFrame([("s", "d", at(0), None, "RUNNING", None), ("s", "d", at(5), None, "RUNNING", None)], schema))
    ended = spark.createDataFrame([("s", "d", at(7), "SUCCESS")], "stage string, dataset string, end_time timestamp, status string")
    rows = ledger.finished(spark.read.parquet(path), ended, ["stage", "dataset"])
    assert [(r["elapsed_seconds"], r["status"]) for r in rows.collect()] == [(120.0, "SUCCESS")]
    ledger.appended(path, rows)
    assert spark.read.parquet(path).filter(F.col("end_time").isNotNull()).count() == 1
    with pytest.raises(ValueError):
        ledger.finished(spark.read.parquet(path), ended.withColumn("stage", F.lit("other")), ["stage", "dataset"])
