"""The older linear model: medians for gaps, standardised features, classes of equal weight."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from countloom.functions.scalars import finite


class BalancedLogistic:
    """Logistic regression whose rows weigh n / (2 * rows of their class).  The model is a few numbers: medians, means, scales and coefficients."""

    def __init__(self, features: list[str], regularisation: float = 1.0, rounds: int = 1000):
        self.features, self.regularisation, self.rounds = features, regularisation, rounds
        self.state: list[tuple[float, float, float, float]] = []
        self.intercept = 0.0

    def _filled(self, df: DataFrame, medians: list[float]) -> DataFrame:
        return df.withColumns({f"_x{n}": F.coalesce(finite(F.col(f).cast("double")), F.lit(m)) for n, (f, m) in enumerate(zip(self.features, medians))})

    def fit(self, df: DataFrame, label: str) -> BalancedLogistic:
        from pyspark.ml.classification import LogisticRegression
        from pyspark.ml.feature import VectorAssembler

        names = [f"_x{n}" for n in range(len(self.features))]
        clean = df.select(label, *(finite(F.col(f).cast("double")).alias(f) for f in self.features))
        row = clean.agg(*(F.expr(f"percentile(`{f}`, 0.5)").alias(f) for f in self.features)).first()
        medians = [float(row[f]) if row[f] is not None else 0.0 for f in self.features]
        filled = self._filled(clean, medians)
        stats = filled.agg(*(F.avg(n).alias(f"m{n}") for n in names), *(F.stddev_pop(n).alias(f"s{n}") for n in names), F.count("*").alias("n"), F.sum(label).alias("p")).first()
        means, scales = [stats[f"m{n}"] for n in names], [stats[f"s{n}"] or 1.0 for n in names]
        total, positive = stats["n"], stats["p"]
        if not 0 < positive < total:
            raise ValueError("both classes must occur")
        weight = F.when(F.col(label) == 1, total / (2.0 * positive)).otherwise(total / (2.0 * (total - positive)))
        scaled = filled.select(F.col(label).cast("double").alias("y"), weight.alias("w"), *(((F.col(n) - m) / s).alias(n) for n, m, s in zip(names, means, scales)))
        data = VectorAssembler(inputCols=names, outputCol="x").transform(scaled)
        # the penalty is on the sum of squares over the rows' total weight
        model = LogisticRegression(featuresCol="x", labelCol="y", weightCol="w", standardization=False, regParam=1.0 / (self.regularisation * total), maxIter=self.rounds, tol=1e-9).fit(data)
        self.state = list(zip(medians, means, scales, model.coefficients.toArray().tolist()))
        self.intercept = float(model.intercept)
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        """df with chance: one expression over its columns."""
        value = F.lit(self.intercept)
        for n, (_, mean, scale, weight) in enumerate(self.state):
            value = value + (F.col(f"_x{n}") - mean) / scale * weight
        return self._filled(df, [m for m, *_ in self.state]).withColumn("chance", 1 / (1 + F.exp(-value))).select(*df.columns, "chance")
