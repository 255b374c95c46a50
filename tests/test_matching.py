"""Matching in two stages, the balanced logistic model and ablation against plain versions."""

import math
import random

import pytest

from countloom.operators import governance, matching
from countloom.operators.logistic import BalancedLogistic


def test_second_stage_takes_the_nearest_free_control(spark):
    rng = random.Random(3)
    rows = [(f"{side}{i:02d}", rng.choice("AB"), rng.randrange(3), round(rng.random(), 2), round(rng.random() * 9, 2)) for side, n in (("a", 20), ("z", 30)) for i in range(n)]
    df = spark.createDataFrame(rows, "cell string, cluster string, b int, x double, y double")
    got = {r["cell"]: (r["control"], r["stage"]) for r in matching.match_with_fallback(df.filter("cell < 'b'"), df.filter("cell > 'b'"), ["cluster", "b"], ["x", "y"]).collect()}
    std = [math.sqrt(sum((r[k] - sum(q[k] for q in rows) / 50) ** 2 for r in rows) / 50) for k in (3, 4)]
    wanted, used = {}, set()
    strata = {(r[1], r[2]) for r in rows}
    for s in strata:
        for a, z in zip(sorted(r[0] for r in rows if r[0] < "b" and (r[1], r[2]) == s), sorted(r[0] for r in rows if r[0] > "b" and (r[1], r[2]) == s)):
            wanted[a] = (z, 1)
            used.add(z)
    for a in sorted(r for r in rows if r[0] < "b" and r[0] not in wanted):
        free = [z for z in rows if z[0] > "b" and z[1] == a[1] and z[0] not in used]
        if free:
            z = min(free, key=lambda z: (round(abs(z[3] / std[0] - a[3] / std[0]) + abs(z[4] / std[1] - a[4] / std[1]), 12), z[0]))
            wanted[a[0]] = (z[0], 2)
            used.add(z[0])
    assert got == wanted


def test_balanced_logistic_orders_and_fills_gaps(spark):
    rng = random.Random(5)
    rows = [(i, rng.gauss(2.0 if i % 5 == 0 else 0.0, 1.0), None if i % 7 == 0 else rng.gauss(0, 1), int(i % 5 == 0)) for i in range(400)]
    df = spark.createDataFrame(rows, "i int, a double, b double, y int")
    model = BalancedLogistic(["a", "b"]).fit(df, "y")
    got = {r["i"]: r["chance"] for r in model.predict(df).collect()}
    pos, neg = [got[i] for i in got if i % 5 == 0], [got[i] for i in got if i % 5]
    assert sum(p > n for p in pos for n in neg) / (len(pos) * len(neg)) > 0.85
    # classes weigh the same, so the mean chance is about one half in each half of the weight
    assert abs(sum(pos) / len(pos) / 2 + sum(neg) / len(neg) / 2 - 0.5) < 0.02
    with pytest.raises(ValueError):
        BalancedLogistic(["a"]).fit(df.filter("y = 1"), "y")


def test_ablation_leaves_no_descendant():
    groups = {"a": ["dosage"], "b": ["identity"], "c": ["dosage", "identity"]}
    assert governance.ablated(["a", "b", "c"], groups, "dosage") == ["b"] and governance.ablated(["a", "x"], groups, "none") == ["a", "x"]
    with pytest.raises(ValueError):
        governance.ablated(["a"], groups, "unheard")
