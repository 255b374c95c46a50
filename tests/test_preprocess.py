"""Variable genes and the centred decomposition against numpy."""

import numpy as np
import pytest

from countloom.operators.preprocess import Decomposition

KINDS = "cell string, gene string, count double"


def table(spark, x):
    rows = [(f"c{i:03d}", f"g{j:03d}", float(v)) for i, r in enumerate(x) for j, v in enumerate(r) if v]
    return spark.createDataFrame(rows, KINDS)


def made(n=90, genes=40, seed=1):
    rng = np.random.default_rng(seed)
    kinds = rng.gamma(0.5, 2.0, (3, genes))
    x = rng.poisson(kinds[rng.integers(0, 3, n)] * rng.uniform(2, 5, (n, 1)))
    x[:, 7] = x[:, 8]  # equal variances, up to what totals do to both
    x[:, 20] = 0
    x[x.sum(1) == 0, 0] = 1
    return x


def plain(x, n_genes, axes, centred):
    v = np.log1p(x / x.sum(1, keepdims=True) * 1e4)
    names = np.array([f"g{j:03d}" for j in range(x.shape[1])])
    seen = x.sum(0) > 0
    order = sorted(np.flatnonzero(seen), key=lambda j: (-round(v[:, j].var(), 12), names[j]))[:n_genes]
    m, s = v[:, order].mean(0), v[:, order].std(0)
    z = (v[:, order] - (m if centred else 0)) / np.where(s > 0, s, 1)
    k = min(axes, len(x) - 1, len(order) - 1)
    _, d, vt = np.linalg.svd(z, full_matrices=False)
    vt = vt[:k]
    vt = vt * np.sign(vt[np.arange(k), np.abs(vt).argmax(1)])[:, None]
    return [names[j] for j in order], vt, d[:k] ** 2 / len(x), z @ vt.T


@pytest.mark.parametrize("centred", [True, False])
def test_equals_numpy(spark, centred):
    x = made()
    fitted = Decomposition.fit(table(spark, x), 25, 3, centred)
    genes, components, power, scores = plain(x, 25, 3, centred)
    assert fitted.genes == genes
    assert np.allclose(fitted.shares, power, rtol=1e-6)
    assert np.allclose(np.abs(np.sum(fitted.components * components, axis=1)), 1, atol=1e-5)
    got = np.array([r["vector"] for r in sorted(fitted.transform(table(spark, x)).collect(), key=lambda r: r["cell"])])
    assert np.allclose(got, scores, atol=2e-3 * np.abs(scores).max())


def test_frozen_padded_and_saved(spark, tmp_path):
    x = made()
    fitted = Decomposition.fit(table(spark, x[:60]), 12, 30)
    assert fitted.components.shape == (11, 12)
    new = table(spark, x[60:])
    rows = lambda df: {r["cell"]: r["vector"] for r in df.collect()}
    all_at_once = rows(fitted.transform(new))
    assert all(len(v) == 30 and v[11:] == [0.0] * 19 for v in all_at_once.values())
    same = lambda got: got.keys() == all_at_once.keys() and all(np.allclose(got[c], all_at_once[c], atol=1e-12) for c in got)
    assert same(rows(fitted.transform(new.repartition(7))))
    assert rows(fitted.transform(new.filter("cell = 'c003'")))["c003"] == pytest.approx(all_at_once["c003"], abs=1e-12)
    fitted.save(str(tmp_path / "d"), spark)
    assert same(rows(Decomposition.load(spark, str(tmp_path / "d")).transform(new)))
    again = Decomposition.fit(table(spark, x[:60]).repartition(5), 12, 30)
    assert np.allclose(again.components, fitted.components, atol=1e-8)


def test_small_and_strange(spark):
    one = Decomposition.fit(spark.createDataFrame([("a", "g", 3.0)], KINDS), 10, 4)
    assert [r["vector"] for r in one.transform(spark.createDataFrame([("b", "g", 1.0), ("c", "other", 2.0)], KINDS)).collect()] == [[0.0] * 4] * 2
    none = Decomposition.fit(spark.createDataFrame([], KINDS), 10, 4)
    assert none.genes == [] and none.transform(spark.createDataFrame([("b", "g", 1.0)], KINDS)).collect()[0]["vector"] == [0.0] * 4
    x = made(30, 24)
    fitted = Decomposition.fit(table(spark, x), 5, 2)
    strange = fitted.transform(spark.createDataFrame([("z", "unknown", 9.0)], KINDS)).collect()[0]["vector"]
    assert np.allclose(strange, -(np.array(fitted.mean) / fitted.scale) @ fitted.components.T)
