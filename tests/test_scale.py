"""Steps that larger tables once broke: long chains, halves of roundings, many cuts, units of counts, cells of few features."""

from __future__ import annotations

import hashlib
import random

import numpy as np

from countloom import catalog
from countloom.functions.running import numbered, ranged
from countloom.operators import matching, sampling
from countloom.sources.tables import rounded
from pyspark.sql import functions as F


def test_components_of_a_long_chain_settle(spark):
    ids = list(range(300))
    random.Random(1).shuffle(ids)
    edges = spark.createDataFrame([*zip(ids, ids[1:]), (500, 500)], "a long, b long")
    got = {r["node"]: r["component"] for r in matching.connected_components(edges).collect()}
    assert got == {**{i: 0 for i in range(300)}, 500: 500}


def test_halves_round_by_the_product_in_doubles(spark):
    rows = [(1 - b / 9000,) for b in (4.5, 13.5, 22.5, 1215.0, 4999.5, 9994.5, 7213.5)]
    got = [r["r"] for r in spark.createDataFrame(rows, "x double").select(rounded(F.col("x"), 3).alias("r")).collect()]
    away = lambda y: np.sign(y) * np.floor(abs(y) + 0.5)
    assert got == [away(x * 1000) / 1000 for (x,) in rows]
    # the product reaches a half that the decimal text stays below
    assert spark.createDataFrame([(1.005,), (0.285,)], "x double").select(rounded(F.col("x"), 2).alias("r")).collect()[1]["r"] == away(0.285 * 100) / 100


def test_ranges_name_their_value_once(spark):
    df = spark.range(1000).withColumn("v", F.when(F.col("id") % 7 != 0, F.col("id") % 97 / 3.0))
    plan = ranged(df, "v")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("% 97") <= 4
    got = [r["id"] for r in numbered(df, "v", "id", "n", []).orderBy("n").collect()]
    assert got == sorted(range(1000), key=lambda i: (i % 7 == 0, -(i % 97) if i % 7 else 0, i))


def test_units_are_counted_as_their_hashes_say(spark):
    rows = [(f"c{i}", f"g{j}", float(i * j) + 0.5) for i in range(4) for j in range(9)]
    counts = spark.createDataFrame(rows, "cell string, gene string, count double")
    draw = lambda *x: int(hashlib.sha256(":".join(map(str, (0, *x))).encode()).hexdigest()[:12], 16) / 16**12
    want = {(c, g): sum(draw("unit", c, g, u) < 0.6 + 0.4 * draw("fraction", c) for u in range(1, int(n) + 1)) for c, g, n in rows}
    out = sampling.thinned(counts)
    assert {(r["cell"], r["gene"]): r["count"] for r in out.collect()} == {k: v for k, v in want.items() if v}
    # no function is called for every element of an array, which is never compiled
    assert "lambda" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_downsampling_draws_for_many_cells_of_a_batch(spark):
    rows = [(f"c{i}", f"g{j}", float((i * j) % 5)) for i in range(40) for j in range(9)]
    counts = spark.createDataFrame(rows, "cell string, gene string, count double")
    targets = spark.createDataFrame([(f"c{i}", 5 + i % 4) for i in range(39)], "cell string, target long")
    want = {}
    for i in range(39):
        own = sorted((g, int(n)) for c, g, n in rows if c == f"c{i}" and n >= 1)
        c = np.array([n for _, n in own])
        if len(c):
            rng = np.random.default_rng(int.from_bytes(hashlib.sha256(f"0:c{i}".encode()).digest()[:8], "big"))
            drawn = rng.multinomial(min(5 + i % 4, int(c.sum())), c / c.sum())
            want.update({(f"c{i}", g): float(n) for (g, _), n in zip(own, drawn) if n})
    out = sampling.downsampled(counts, targets)
    assert {(r["cell"], r["gene"]): r["count"] for r in out.collect()} == want
    assert "FlatMapGroups" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_loadings_stay_a_table(spark):
    # two genes of one direction: a rank below the components asked for gives zeros
    from countloom.operators.reference import loadings_table

    values = spark.createDataFrame([(f"c{i}", g, v * (i + 1.0)) for i in range(6) for g, v in (("a", 3.0), ("b", 4.0))], "cell string, gene string, value double")
    got = {r["gene"]: r["b"] for r in loadings_table(values, 2).collect()}
    assert np.allclose(got["a"], [0.6, 0.0]) and np.allclose(got["b"], [0.8, 0.0])


def test_ordered_pairs_are_counted_with_their_canonical_pair(spark):
    from countloom.operators.audits import pair_duplicates

    ends = [("1", "2"), ("2", "1"), ("2", "1"), ("3", "3"), ("3", None), (None, "3"), (None, None), (None, None), ("1", "2")]
    rows = [(a, b, "ab"[i % 2], f"k{i // 3}", i % 2) for i, (a, b) in enumerate(ends)]
    out = pair_duplicates(spark.createDataFrame(rows, "a string, b string, s string, k string, f int"), "a", "b", "s", "k", "f")
    got = out.first()
    assert got["ordered_repeats"] == len(ends) - len(set(ends)) and got["row_repeats"] == len(rows) - len({(r[3], *r[:3], r[4]) for r in rows})
    assert got["id_repeats"] == 6 and got["profile_repeats"] == 7
    assert "Expand" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_profiles_of_documents_need_one_shuffle_by_document(spark):
    rows = catalog.queries()["e37_duplicate_profiles"](spark, "/root/testdata/sf0.001")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(") == 2  # by document, then by profile
    assert rows.count() > 0
