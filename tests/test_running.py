"""Range-wise sums and numbers against plain loops, with ties, gaps and groups."""

import random

import pytest

from countloom.functions import running


@pytest.mark.parametrize("ranges", [3, 64])
def test_numbers_and_sums_equal_plain_loops(spark, monkeypatch, ranges):
    monkeypatch.setattr(running, "RANGES", ranges)
    rng = random.Random(ranges)
    rows = [(f"k{i:03d}", rng.choice("AB"), None if i % 17 == 0 else rng.choice([0.5, 0.5, rng.random(), -1.0]), rng.randrange(3)) for i in range(300)]
    df = spark.createDataFrame(rows, "key string, g string, v double, w int")
    for by in ([], ["g"]):
        for falling in (True, False):
            got = {r["key"]: r["n"] for r in running.numbered(df, "v", "key", "n", by, falling).collect()}
            for g in ("AB" if not by else ["A", "B"]) if by else [None]:
                own = [r for r in rows if g is None or r[1] == g]
                order = sorted(own, key=lambda r: (r[2] is None, 0 if r[2] is None else -r[2] if falling else r[2], r[0]))
                assert [got[r[0]] for r in order] == list(range(1, len(own) + 1))
    sums = {}
    for _, g, v, w in rows:
        if v is not None:
            sums[g, v] = sums.get((g, v), 0) + w
    df = spark.createDataFrame([(g, v, w) for (g, v), w in sums.items()], "g string, v double, w long")
    for falling in (True, False):
        for r in running.running_sums(df, "v", {"s": "w"}, ["g"], falling).collect():
            assert r["s"] == sum(w for (g, v), w in sums.items() if g == r["g"] and (v >= r["v"] if falling else v <= r["v"]))


def test_of_nothing(spark):
    df = spark.createDataFrame([], "key string, v double, w long")
    assert running.numbered(df, "v", "key", "n", []).count() == running.running_sums(df, "v", {"s": "w"}, []).count() == 0
