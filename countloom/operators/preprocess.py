"""Variable genes and a decomposition of their scaled values: centred without ever being dense, padded with zeros, frozen."""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from countloom.operators import matrix
from countloom.operators.network import _summed
from countloom.plans.storage import dropped, written

#: Steps of the subspace iteration, and axes beyond the wanted ones that it carries.
STEPS, SPARE = 8, 10


def variable_genes(values: DataFrame, n_cells: int, n: int) -> DataFrame:
    """gene, mean, variance of the n genes of largest variance over all cells, zeros included; ties by name.  values: cell, gene, value."""
    sums = values.groupBy("gene").agg(F.sum("value").alias("_s"), F.sum(F.col("value") * F.col("value")).alias("_q"))
    mean = F.col("_s") / n_cells
    out = sums.select("gene", mean.alias("mean"), F.round(F.greatest(F.lit(0.0), F.col("_q") / n_cells - mean * mean), 12).alias("variance"))
    return out.orderBy(F.desc("variance"), "gene").limit(n)


def packed(values: DataFrame, cells: DataFrame, genes: list[str]) -> DataFrame:
    """cell, places, vals of every cell, in the order of the chosen genes, of which a row holds as many at most."""
    spark = values.sparkSession
    places = spark.createDataFrame([(g, p) for p, g in enumerate(genes)], "gene string, place int")
    rows = values.join(F.broadcast(places), "gene").groupBy("cell").agg(F.sort_array(F.collect_list(F.struct("place", "value"))).alias("_v"))  # as many rows as genes chosen
    both = cells.join(rows, "cell", "left")
    part = lambda f, kind: F.coalesce(F.transform("_v", lambda x: x[f]), F.array().cast(kind))
    return both.select("cell", part("place", "array<int>").alias("places"), part("value", "array<double>").alias("vals"))


def _scores(places, vals, weight: np.ndarray, offset: np.ndarray) -> np.ndarray:
    """Rows times weight (genes by axes), less the offset that centring takes from every row."""
    n = np.array([len(p) for p in places])
    out = np.zeros((len(n), weight.shape[1]))
    if n.sum():
        row = np.repeat(np.arange(len(n)), n)
        np.add.at(out, row, weight[np.concatenate(places)] * np.concatenate(vals)[:, None])
    return out - offset


@dataclass
class Decomposition:
    """State of a fitted decomposition: transform() uses nothing else."""

    genes: list[str]
    mean: list[float]
    scale: list[float]
    components: np.ndarray
    axes: int
    centred: bool
    shares: list[float]

    @classmethod
    def fit(cls, counts: DataFrame, n_genes: int = 2000, axes: int = 50, centred: bool = True, seed: int = 0) -> Decomposition:
        """counts: cell, gene, count.  Values are log-normalised, divided by their deviation and, if wanted, centred by a rank-one
        correction in each product.  With fewer cells or genes than two there are no axes but zeros.  Signs: the largest loading is positive.

        A step of the iteration is one job without a shuffle: tasks sum products of n_genes by axes + SPARE numbers.
        """
        values = matrix.log_normalised(counts.select("cell", "gene", "count"))
        cells = counts.select("cell").distinct()
        n = cells.count()
        top = variable_genes(values, max(n, 1), n_genes).collect()  # n_genes rows
        genes, mean = [r["gene"] for r in top], np.array([r["mean"] for r in top])
        scale = np.sqrt(np.array([r["variance"] for r in top]))
        scale = np.where(scale > 0, scale, 1.0)
        k = min(axes, n - 1, len(genes) - 1)
        out = cls(genes, mean.tolist(), scale.tolist(), np.zeros((max(k, 0), len(genes))), axes, centred, [])
        if k < 1:
            return out
        rows = written(packed(values, cells, genes))
        basis, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(genes), min(k + SPARE, len(genes)))))
        for step in range(STEPS + 1):
            weight = basis / scale[:, None]
            offset = mean @ weight if centred else np.zeros(basis.shape[1])
            shape = weight.shape

            def part(batches, weight=weight, offset=offset, shape=shape):
                import pandas as pd

                back, gram = np.zeros(shape), np.zeros((shape[1], shape[1]))
                total = np.zeros(shape[1])
                for pdf in batches:
                    places, vals = pdf["places"].tolist(), pdf["vals"].tolist()
                    y = _scores(places, vals, weight, offset)
                    total += y.sum(axis=0)
                    gram += y.T @ y
                    size = np.array([len(p) for p in places])
                    if size.sum():
                        np.add.at(back, np.concatenate(places), np.concatenate(vals)[:, None] * np.repeat(y, size, axis=0))
                yield pd.DataFrame({"loss": [0.0], "g": [np.concatenate([back.ravel(), gram.ravel(), total]).tobytes()]})

            size = shape[0] * shape[1] + shape[1] ** 2 + shape[1]
            _, sums = _summed(rows.select("places", "vals").mapInPandas(part, "loss double, g binary"), size)
            back, gram, total = sums[: shape[0] * shape[1]].reshape(shape), sums[shape[0] * shape[1] : -shape[1]].reshape(shape[1], shape[1]), sums[-shape[1] :]
            if step == STEPS:
                break
            image = back / scale[:, None] - (np.outer(mean / scale, total) if centred else 0)
            basis, _ = np.linalg.qr(image)
        power, turn = np.linalg.eigh(gram)
        order = np.argsort(-power)[:k]
        found = (basis @ turn[:, order]).T
        signs = np.sign(found[np.arange(k), np.abs(found).argmax(axis=1)])
        out.components = found * np.where(signs == 0, 1, signs)[:, None]
        out.shares = (np.maximum(power[order], 0) / max(n, 1)).tolist()
        dropped(rows)
        return out

    def transform(self, counts: DataFrame) -> DataFrame:
        """cell, vector of `axes` numbers: a cell's place depends on its own counts only; genes unknown to the fit count in totals alone."""
        values = matrix.log_normalised(counts.select("cell", "gene", "count"))
        weight = self.components.T / np.array(self.scale)[:, None] if len(self.genes) else np.zeros((0, len(self.components)))
        offset = np.array(self.mean) @ weight if self.centred and len(self.genes) else np.zeros(weight.shape[1])
        axes = self.axes

        def place(batches):
            import pandas as pd

            for pdf in batches:
                if len(pdf):
                    y = np.nan_to_num(_scores(pdf["places"].tolist(), pdf["vals"].tolist(), weight, offset), posinf=0.0, neginf=0.0)
                    wide = np.zeros((len(pdf), axes))
                    wide[:, : y.shape[1]] = y
                    yield pd.DataFrame({"cell": pdf["cell"], "vector": list(wide)})

        return packed(values, counts.select("cell").distinct(), self.genes).mapInPandas(place, "cell string, vector array<double>")

    def save(self, path: str, spark: SparkSession) -> None:
        state = {**self.__dict__, "components": self.components.tolist()}
        spark.createDataFrame([(json.dumps(state),)], "value string").coalesce(1).write.mode("overwrite").text(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Decomposition:
        state = json.loads(spark.read.text(path, wholetext=True).first()["value"])
        return cls(**{**state, "components": np.array(state["components"], float).reshape(-1, len(state["genes"]))})
