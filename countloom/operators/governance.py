"""Feature governance: allow and deny lists, source groups of derived features, ablation."""

from __future__ import annotations

import fnmatch

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from countloom.plans.storage import cut

# Tokens that a feature's name must not hold.
DENIED = ("benchmark", "true", "label", "doublet_type", "simulated", "expected", "y_true", "is_", "scrublet", "hybrid", "external")


def safe_columns(columns: list[str], denied=DENIED) -> list[str]:
    return [c for c in columns if not any(t in c.lower() for t in denied)]


def allowed(columns: list[str], patterns: list[str]) -> list[str]:
    """Columns that a pattern allows, in the order of the patterns and each once; a pattern that matches none is an error."""
    found: dict[str, None] = {}
    for p in patterns:
        hits = [c for c in columns if fnmatch.fnmatchcase(c, p)]
        if not hits:
            raise ValueError(f"no column matches {p}")
        found.update(dict.fromkeys(hits))
    return list(found)


def source_groups(edges: DataFrame) -> DataFrame:
    """feature, source: all features that each depends on, directly or through others.  edges: feature, needs.  A cycle is an error.

    Every round doubles the length of the ways that are known, so rounds grow with the logarithm of the longest.
    """
    direct = edges.select("feature", F.col("needs").alias("source")).distinct()
    out = direct
    held = out.count()
    while True:
        step = out.join(out.select(F.col("feature").alias("source"), F.col("source").alias("_n")), "source").select("feature", F.col("_n").alias("source"))
        after = cut(out.union(step).distinct())
        if not after.filter("feature = source").isEmpty():
            raise ValueError("features depend on each other in a cycle")
        now = after.count()
        if now == held:
            return after
        out, held = after, now


def ablated(columns: list[str], groups: dict[str, list[str]], without: str) -> list[str]:
    """Columns without those that descend from a group; `none` keeps all."""
    if without == "none":
        return list(columns)
    known = {g for found in groups.values() for g in found}
    if without not in known:
        raise ValueError(f"unknown group {without}")
    return [c for c in columns if without not in groups.get(c, [])]


def renamed(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Old names replaced by new ones; both present with different values is an error."""
    for old, new in names.items():
        if old in df.columns and new in df.columns:
            if not df.filter(~F.col(old).eqNullSafe(F.col(new))).isEmpty():
                raise ValueError(f"{old} and {new} differ")
            df = df.drop(old)
        elif old in df.columns:
            df = df.withColumnRenamed(old, new)
    return df
