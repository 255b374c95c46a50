"""Bundles: whole versions only, torn ones refused with their reason, provenance as rows."""

import shutil
from pathlib import Path

import pytest

from countloom.sources import bundles


def tables(spark, n=20):
    real = spark.createDataFrame([(f"r{i}", "fully_real", "p1", float(i)) for i in range(n)], "cell string, split string, reference_pool string, a double")
    made = spark.createDataFrame([(f"m{i}", "test", "p1", None if i == 3 else float(-i)) for i in range(n)], "cell string, split string, reference_pool string, a double")
    parents = spark.createDataFrame([(f"m{i}", f"a{i}", f"b{i}") for i in range(n)], "cell string, parent_1 string, parent_2 string")
    return real, made, parents


def test_versions_come_whole(spark, tmp_path):
    path = str(tmp_path / "b")
    with pytest.raises(bundles.BundleError, match="no whole version"):
        bundles.load_bundle(spark, path)
    assert bundles.export_audit(spark, path, *tables(spark), {"run": "x"}) == 1
    assert bundles.export_audit(spark, path, *tables(spark, 5)) == 2
    new, old = bundles.load_bundle(spark, path), bundles.load_bundle(spark, path, 1)
    assert (new.version, new.tables["made"].count(), old.tables["made"].count(), old.about) == (2, 5, 20, {"run": "x"})
    assert sorted(map(tuple, old.tables["made"].collect()), key=repr) == sorted(map(tuple, tables(spark)[1].collect()), key=repr)
    with pytest.raises(bundles.BundleError, match="no version 7"):
        bundles.load_bundle(spark, path, 7)


def test_torn_writes_are_refused_or_unseen(spark, tmp_path):
    path = tmp_path / "b"
    bundles.export_audit(spark, str(path), *tables(spark))
    bundles.export_audit(spark, str(path), *tables(spark, 6))
    (path / "manifests/00000002/_SUCCESS").unlink()  # the manifest was not finished: the version does not exist
    assert bundles.load_bundle(spark, str(path)).version == 1
    shutil.copytree(path, tmp_path / "c")
    first = Path(bundles.load_bundle(spark, str(path)).tables["made"].inputFiles()[0].removeprefix("file://")).parent
    for f in first.glob("part-*"):
        f.unlink()
    with pytest.raises(bundles.BundleError, match="made (has 0 rows|cannot be read)"):
        bundles.load_bundle(spark, str(path))
    shutil.rmtree(first)
    with pytest.raises(bundles.BundleError, match="made cannot be read"):
        bundles.load_bundle(spark, str(path))


def test_changed_rows_are_refused(spark, tmp_path):
    path = str(tmp_path / "b")
    bundles.export_audit(spark, path, *tables(spark))
    df = bundles.load_bundle(spark, path).tables["fully_real"]
    place = df.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    changed = spark.createDataFrame([("q" if r["cell"] == "r3" else r["cell"], *list(r)[1:]) for r in df.collect()], df.schema)
    changed.write.mode("overwrite").parquet(place)
    with pytest.raises(bundles.BundleError, match="fully_real has another checksum"):
        bundles.load_bundle(spark, path)
    assert bundles.load_bundle(spark, path, verify=False).tables["fully_real"].count() == 20


def test_checksum_needs_no_order(spark):
    df = tables(spark)[1]
    assert bundles.checksum(df) == bundles.checksum(df.repartition(7)) != bundles.checksum(df.union(df.limit(1)))
    assert bundles.checksum(df.limit(0)) == (0, "0")


def test_provenance_checks(spark, tmp_path):
    real, made, parents = tables(spark)
    state = lambda r, m, p: {x["check"]: x["failures"] for x in bundles.provenance_checks(bundles.Bundle(1, {"fully_real": r, "made": m, "parents": p}, {})).collect()}
    clean = state(real, made, parents)
    assert len(clean) == 10 and set(clean.values()) == {0}
    bad_real = real.union(spark.createDataFrame([("m1", " TEST ", "p2", 0.0), ("r1", None, None, 0.0), ("a4", "Fully_Real", "p1", 0.0)], real.schema)).withColumn("synthetic_subtype", bundles.F.when(bundles.F.col("cell") == "r2", "x"))
    bad_made = made.union(spark.createDataFrame([("m50", "train", "p1", 0.0), ("m51", None, "p1", 0.0)], made.schema))
    bad_parents = parents.union(spark.createDataFrame([("m51", "z", "z"), ("m52", None, "y")], parents.schema))
    assert state(bad_real, bad_made, bad_parents) == {
        "real rows are of no made split": 1, "real rows bear no made label": 1, "no id is both real and made": 1, "made rows are of a held-out split": 2, "real ids are single": 1,
        "made ids are single": 0, "made rows have parents": 1, "parents are two different cells": 2, "parents are not among the real rows": 1, "one reference_pool for all rows": 3}
    with pytest.raises(bundles.BundleError, match="no table parents"):
        bundles.provenance_checks(bundles.Bundle(1, {"fully_real": real, "made": made}, {}))
