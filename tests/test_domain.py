"""Parent-unique edges, block folds, the domain classifier, pairs within libraries, residuals on covariates, refined scores."""

import numpy as np
import pytest

from countloom import catalog
from countloom.operators import domain, refinement, residuals, sampling

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["c17_refined_scores", "c17_refined_scores_legacy", "d20_parent_unique_edges", "i4_library_pairs", "j16_regression_residual", "j17_domain_classifier", "j18_parent_block_folds"])
def test_registered(name, spark):
    assert catalog.queries()[name](spark, SF).count() > 0


def test_edges_take_turns(spark):
    rows = [("e1", "a", "b", "x|y", "k"), ("e2", "a", "c", "x|y", "k"), ("e3", "b", "d", "x|z", "k"), ("e4", "e", "f", "x|z", "k"), ("e5", "g", "h", "x|z", "k"), ("e6", "m", "n", "x|y", "none")]
    edges = spark.createDataFrame(rows, "edge string, parent_1 string, parent_2 string, pair string, cluster string")
    got = {r["edge"]: (r["round"], r["reason"].split("_")[1], r["selected"]) for r in domain.parent_unique_edges(edges, spark.createDataFrame([("k", 2)], "cluster string, capacity long")).collect()}
    assert got == {"e1": (1, "parent", True), "e3": (1, "parent", False), "e2": (2, "parent", False), "e4": (2, "parent", True), "e6": (3, "no", False), "e5": (3, "no", False)}
    with pytest.raises(ValueError):
        domain.parent_unique_edges(edges.withColumn("parent_2", edges["parent_1"]), spark.createDataFrame([("k", 2)], "cluster string, capacity long"))


@pytest.mark.parametrize("stretch", [25, 1000])
def test_edges_in_stretches_are_those_in_turn(spark, monkeypatch, stretch):
    """Against a plain loop, with clusters that run full and parents that are missing; no task reads more than about a stretch."""
    monkeypatch.setattr(domain, "STRETCH", stretch, raising=False)
    rng = np.random.default_rng(5)
    name = lambda kind, n: None if n == 0 else f"{kind}{n}"
    rows = [(f"e{i:03}", name("a", int(rng.integers(60))), name("b" if i % 9 else "a", int(rng.integers(60, 120)) * int(rng.random() < 0.98)), f"{rng.integers(7)}|x", f"k{rng.integers(4)}") for i in range(300)]
    room = {"k0": 3, "k1": 40, "k2": 9}
    edges = spark.createDataFrame(rows, "edge string, parent_1 string, parent_2 string, pair string, cluster string")
    got = domain.parent_unique_edges(edges, spark.createDataFrame(list(room.items()), "cluster string, capacity long"))
    place, turns = {}, []
    for edge, a, b, pair, cluster in sorted(rows, key=lambda r: (r[3], r[1] is not None, r[1] or "", r[2] is not None, r[2] or "", r[0])):
        place[pair] = place.get(pair, 0) + 1
        turns.append((place[pair], pair, edge, a, b, cluster))
    used, taken, wanted = set(), {}, {}
    for turn, _, edge, a, b, cluster in sorted(turns, key=lambda r: r[:2]):
        if a in used or b in used:
            wanted[edge] = (turn, "excluded_parent_reuse", False)
        elif taken.get(cluster, 0) >= room.get(cluster, 0):
            wanted[edge] = (turn, "excluded_no_experimental_cluster_capacity", False)
        else:
            used.update((a, b))
            taken[cluster] = taken.get(cluster, 0) + 1
            wanted[edge] = (turn, "selected_parent_unique", True)
    assert len({w[1] for w in wanted.values()}) == 3
    assert {r["edge"]: (r["round"], r["reason"], r["selected"]) for r in got.collect()} == wanted and got.count() == 300
    # the tables behind it are of several parts, not of one task that read all edges
    assert len({f for f in got.inputFiles() if "stretch=" in f}) >= 300 // (2 * stretch) + 1


def test_edges_by_offers_are_those_in_turn(spark, monkeypatch):
    """More than a stretch of edges between two kinds of parents, with room in every cluster, are taken all at once, not stretch by stretch."""
    rng = np.random.default_rng(8)
    rows = [(f"e{i:03}", f"a{rng.integers(40)}", f"b{rng.integers(50)}", f"{rng.integers(5)}|x", f"k{rng.integers(3)}") for i in range(400)]
    edges = spark.createDataFrame(rows, "edge string, parent_1 string, parent_2 string, pair string, cluster string")
    room = spark.createDataFrame([("k0", 40), ("k1", 40), ("k2", 40)], "cluster string, capacity long")
    in_turn = domain.parent_unique_edges(edges, room)
    monkeypatch.setattr(domain, "STRETCH", 25)
    by_offers = domain.parent_unique_edges(edges, room)
    assert in_turn.filter("selected").count() > 30
    assert sorted(map(tuple, by_offers.select(in_turn.columns).collect())) == sorted(map(tuple, in_turn.collect()))
    assert not any("stretch=" in f for f in by_offers.inputFiles())


def pairs(spark, n):
    rows = [r for i in range(n) for r in ((f"b{i:03}", 1, None, None, None), (f"b{i:03}", 0, f"p{i}", f"q{i}", "x|y" if i % 3 else "x|z"))]
    return spark.createDataFrame(rows, "component string, experimental int, parent_1 string, parent_2 string, pair string")


@pytest.mark.parametrize("n, folds", [(30, 2), (59, 2), (60, 3)])
def test_block_folds(spark, n, folds):
    got = {r["component"]: r["fold"] for r in domain.parent_block_folds(pairs(spark, n)).collect()}
    sizes = [list(got.values()).count(k + 1) for k in range(folds)]
    assert len(got) == n and sum(sizes) == n and all(0.5 <= s * folds / n <= 1.5 for s in sizes)


@pytest.mark.parametrize("seed", range(4))
def test_blocks_go_where_the_whole_imbalance_is_least(seed):
    """Against the imbalance of all folds, taken anew for every choice."""
    rng = np.random.default_rng(seed)
    names, size, kinds = [f"b{i:02d}" for i in range(40)], rng.integers(1, 6, 40).tolist(), rng.choice(["x|y", "x|z", "y|z"], 40).tolist()
    got = domain.dealt_blocks(names, size, kinds, 3)
    rows = sorted(zip(names, size, kinds, got), key=lambda r: (-r[1], r[0]))
    even, folds, held = sum(size) / 3, [0, 0, 0], {}
    for place, (_, m, kind, fold) in enumerate(rows):
        def whole(f):
            x = [n + m * (k == f) for k, n in enumerate(folds)]
            due = kinds.count(kind) / 3
            own = 0.25 * ((held.get((f, kind), 0) + m - due) / max(due, 1)) ** 2
            return sum(((2 * n - 2 * even) / (2 * even)) ** 2 + 4 * ((n - even) / even) ** 2 for n in x) + own

        assert fold == (place if place < 3 else min(range(3), key=lambda f: (round(whole(f), 9), f))) + 1
        folds[fold - 1] += m
        held[fold - 1, kind] = held.get((fold - 1, kind), 0) + m
    with pytest.raises(ValueError):
        domain.dealt_blocks(["a"], [3], ["x"], 2)
    with pytest.raises(ValueError):
        domain.dealt_blocks(["a", "b", "c"], [30, 1, 1], ["x"] * 3, 3)


def test_block_folds_refuse(spark):
    with pytest.raises(ValueError):
        domain.parent_block_folds(pairs(spark, 29))
    twice = pairs(spark, 40).replace("p1", "p0", "parent_1")
    with pytest.raises(ValueError):
        domain.parent_block_folds(twice)


def test_domain_classifier(spark):
    rng = np.random.default_rng(0)
    rows = [(i, int(y), i % 3, float(rng.normal() + y) if i % 10 else None, float(rng.normal())) for i, y in enumerate(rng.integers(0, 2, 300))]
    df = spark.createDataFrame(rows, "id long, y int, fold int, a double, b double")
    got = {r["id"]: r["p"] for r in domain.domain_probabilities(df, ["a", "b"], "y", "fold").collect()}
    train = [r for r in rows if r[2] != 0]
    middle = np.median([r[3] for r in train if r[3] is not None])
    x = lambda part: np.array([[middle if r[3] is None else r[3], r[4]] for r in part])
    m, s, y = x(train).mean(0), x(train).std(0), np.array([r[1] for r in train])
    a, w = np.column_stack([(x(train) - m) / s, np.ones(len(train))]), np.zeros(3)
    for _ in range(20000):
        w = w - 0.005 * (a.T @ (1 / (1 + np.exp(-a @ w)) - y) + w * [1, 1, 0])
    test = [r for r in rows if r[2] == 0]
    wanted = 1 / (1 + np.exp(-np.column_stack([(x(test) - m) / s, np.ones(len(test))]) @ w))
    assert len(got) == 300 and np.allclose([got[r[0]] for r in test], wanted, atol=1e-6)


def test_library_pairs(spark):
    rows = [(f"{lib}{c}{k}", c, lib) for lib, c, n in (("L", "a", 30), ("L", "b", 10), ("M", "a", 10)) for k in range(n)]
    cells = spark.createDataFrame(rows, "cell string, cluster string, library string")
    got = sampling.library_pairs(cells, 2000, 1, 0.5).collect()
    again = sampling.library_pairs(cells.repartition(5), 2000, 1, 0.5).collect()
    assert sorted(got) == sorted(again) and len(got) == 2000
    where = {c: (k, lib) for c, k, lib in rows}
    for r in got:
        (a, x), (b, y) = where[r["parent_1"]], where[r["parent_2"]]
        assert x == y == r["library"] and (a == b) == (r["subtype"] == "homotypic")
    assert abs(sum(r["library"] == "M" for r in got) / 2000 - 0.2) < 0.03
    large = [r for r in got if r["library"] == "L"]
    assert abs(sum(r["subtype"] == "homotypic" for r in large) / len(large) - 0.5) < 0.05
    same = [where[r["parent_1"]][0] for r in large if r["subtype"] == "homotypic"]
    assert abs(same.count("a") / len(same) - 0.75) < 0.05


def test_huber_ignores_outliers():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 2))
    y = x @ [2.0, -1.0] + 3 + 0.1 * rng.normal(size=200)
    y[:10] += 50
    assert np.allclose(residuals.huber(x, y), [2, -1, 3], atol=0.05)


def test_residual_of_small_groups(spark):
    rows = [(f"s{i}", "small", float(i), float(i), 0.25) for i in range(7)] + [(f"l{i}", "large", 2.0 * i + (9 if i == 5 else 0.1 * (i % 3)), float(i), 0.0) for i in range(30)]
    df = spark.createDataFrame(rows, "cell string, g string, v double, x double, z double")
    got = {r["cell"]: r["residual"] for r in residuals.regression_residual(df, "cell", "v", ["x"], ["g"], "z").collect()}
    assert all(got[f"s{i}"] == 0.25 for i in range(7)) and got["l5"] > 20 and abs(np.median([got[f"l{i}"] for i in range(30)])) < 1e-9


def test_refined_scores_of_constant_features(spark):
    df = spark.createDataFrame([("a", 0.2, 0.6), ("b", 0.2, 0.6)], "cell string, homotypic_doublet double, heterotypic_doublet double")
    het = 0.6 * (0.35 + 0.65 * 0.5)
    mixture = 0.45 * het + 0.25
    hom = 0.05 * (0.65 * 0.2 + 0.2 * 0.6) * (1 - 0.4 * mixture**2)
    got = refinement.refined(df, "cell").first()
    assert np.allclose([got["heterotypic_doublet"], got["homotypic_doublet"], got["clean"]], [het, hom, (1 - het) * (1 - hom)])
    old = refinement.refined(df, "cell", legacy=True).first()
    assert np.isclose(sum(old[c] for c in refinement.CLASSES), 1) and old["heterotypic_doublet"] > old["homotypic_doublet"]
