"""Bundles: several tables as one version.  A manifest with checksums is written last, and readers see whole versions only."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

#: The label of fully real rows and the splits whose rows are made.
REAL, SPLITS = "fully_real", ("test", "validation")


class BundleError(ValueError):
    """Why a bundle is not taken."""


@dataclass
class Bundle:
    version: int
    tables: dict[str, DataFrame]
    about: dict


def checksum(df: DataFrame) -> tuple[int, str]:
    """(rows, sum of the hashes of all rows): the same in any order and partitioning."""
    h = F.xxhash64(*(F.to_json(c) if kind.startswith(("map", "variant")) else F.col(c) for c, kind in df.dtypes)).cast("decimal(20,0)")
    row = df.agg(F.count("*").alias("n"), F.coalesce(F.sum(h.cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).alias("s")).first()
    return int(row["n"]), str(row["s"])


def write_bundle(spark: SparkSession, path: str, tables: dict[str, DataFrame], about: dict | None = None) -> int:
    """Writes the tables, reads them back for their checksums, and then the manifest of the next version, whose number is returned.

    Older versions stay.  Two writers of one version end with an error for the later one, as a manifest is never overwritten.
    """
    place = f"{path}/data/{uuid.uuid4().hex}"
    listed = {}
    for name, df in tables.items():
        df.write.parquet(f"{place}/{name}")
        back = spark.read.schema(df.schema).parquet(f"{place}/{name}")
        n, total = checksum(back)
        listed[name] = {"path": f"{place}/{name}", "rows": n, "checksum": total, "schema": df.schema.json()}
    version = max(versions(spark, path), default=0) + 1
    text = json.dumps({"version": version, "about": about or {}, "tables": listed})
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("error").text(f"{path}/manifests/{version:08d}")
    return version


def versions(spark: SparkSession, path: str) -> list[int]:
    """Versions whose manifest is whole: its folder has the mark that Spark writes last."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/manifests")
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(hadoop):
        return []
    folders = [s.getPath() for s in fs.listStatus(hadoop)]
    return sorted(int(p.getName()) for p in folders if p.getName().isdigit() and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def load_bundle(spark: SparkSession, path: str, version: int | None = None, verify: bool = True) -> Bundle:
    """The latest version, or the one asked for; every table must have the rows and the checksum of its manifest."""
    known = versions(spark, path)
    if not known:
        raise BundleError("no whole version")
    version = known[-1] if version is None else version
    if version not in known:
        raise BundleError(f"no version {version}")
    from pyspark.sql.types import StructType

    manifest = json.loads(spark.read.text(f"{path}/manifests/{version:08d}", wholetext=True).first()["value"])
    tables = {}
    for name, entry in manifest["tables"].items():
        try:
            df = spark.read.schema(StructType.fromJson(json.loads(entry["schema"]))).parquet(entry["path"])
            if verify:
                n, total = checksum(df)
                if n != entry["rows"]:
                    raise BundleError(f"{name} has {n} rows instead of {entry['rows']}")
                if total != entry["checksum"]:
                    raise BundleError(f"{name} has another checksum")
        except AnalysisException as e:
            raise BundleError(f"{name} cannot be read: {str(e).splitlines()[0]}") from e
        tables[name] = df
    return Bundle(version, tables, manifest["about"])


def export_audit(spark: SparkSession, path: str, real: DataFrame, made: DataFrame, parents: DataFrame, about: dict | None = None) -> int:
    """The inputs of a domain audit as one bundle: real and made rows with features and provenance, and the parents of made rows."""
    return write_bundle(spark, path, {"fully_real": real, "made": made, "parents": parents}, about)


def provenance_checks(bundle: Bundle, key: str = "cell") -> DataFrame:
    """check, failures, passed: one row a check of an audit's bundle.  Missing tables are an error, missing optional columns pass."""
    for name in ("fully_real", "made", "parents"):
        if name not in bundle.tables:
            raise BundleError(f"no table {name}")
    real, made, parents = (bundle.tables[n] for n in ("fully_real", "made", "parents"))
    text = lambda c: F.lower(F.trim(F.col(c).cast("string")))
    count = lambda df, name: df.agg(F.count("*").alias("failures")).withColumn("check", F.lit(name))

    def repeated(df, name):
        return count(df.groupBy(key).count().filter((F.col("count") > 1) | F.col(key).isNull()), name)

    none = real.limit(0)
    labels = [c for c in ("model_class_label", "synthetic_subtype") if c in real.columns]
    both = lambda c: real.select(F.col(c).cast("string").alias("v")).unionByName(made.select(F.col(c).cast("string").alias("v"))).groupBy("v").count()
    shared = [c for c in ("reference_pool", "transformer") if c in real.columns and c in made.columns]
    out = [
        count(real.filter(F.col("split").isNotNull() & (text("split") != REAL)) if "split" in real.columns else none, "real rows are of no made split"),
        count(real.filter(F.coalesce(*(F.col(c).cast("string") for c in labels)).isNotNull()) if labels else none, "real rows bear no made label"),
        count(real.join(made.select(key), key, "left_semi"), "no id is both real and made"),
        count(made.filter(~text("split").isin(*SPLITS) | F.col("split").isNull()), "made rows are of a held-out split"),
        repeated(real, "real ids are single"), repeated(made, "made ids are single"),
        count(made.join(parents.select(key), key, "left_anti"), "made rows have parents"),
        count(parents.filter(F.col("parent_1").isNull() | F.col("parent_2").isNull() | (F.col("parent_1") == F.col("parent_2"))), "parents are two different cells"),
        count(real.join(parents.select(F.explode(F.array("parent_1", "parent_2")).alias(key)), key, "left_semi"), "parents are not among the real rows"),
        *(count(both(c).filter(F.col("v").isNull()).select("v").unionByName(both(c).select("v").orderBy(F.asc_nulls_first("v")).offset(1)), f"one {c} for all rows") for c in shared),
    ]
    rows = out[0]
    for r in out[1:]:
        rows = rows.unionByName(r)
    return rows.select("check", "failures", (F.col("failures") == 0).alias("passed"))
