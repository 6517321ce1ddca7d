"""Logistic regression by a stated number of Newton steps, each one aggregate: the normal equations are summed where the rows are."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Logistic:
    """An intercept and a coefficient a feature; the log likelihood before the last step, and how far that step went."""

    features: tuple[str, ...]
    intercept: float
    coefficients: tuple[float, ...]
    log_likelihood: float
    last_move: float

    def score(self, df: DataFrame, output: str = "risk_score") -> DataFrame:
        """``df`` with the probability of the class 1; null where a feature is."""
        return df.withColumn(output, _probability([self.intercept, *self.coefficients], self.features))


def _linear(beta: Sequence[float], features: Sequence[str]) -> Column:
    out = F.lit(float(beta[0]))
    for b, c in zip(beta[1:], features, strict=True):
        out = out + F.lit(float(b)) * F.col(f"`{c}`").cast("double")
    return out


def _probability(beta: Sequence[float], features: Sequence[str]) -> Column:
    return 1 / (1 + F.exp(-_linear(beta, features)))


def fit(df: DataFrame, features: Sequence[str], target: str, steps: int = 8, ridge: float = 0.0, weight: str | None = None) -> Logistic:
    """The model after ``steps`` Newton steps from zero.

    A step sums the gradient and the upper half of the Hessian over all rows in one aggregate without an exchange of rows:
    what is shuffled, and what the driver gets, are (p + 1)(p + 4) / 2 numbers for p features. Rows with a null among
    features, target or weight are left out. ``ridge`` adds half its multiple of the squared coefficients, intercept
    aside; a singular step, as in separated classes without ridge, is an error.
    """
    x = [F.lit(1.0), *[F.col(f"`{c}`").cast("double") for c in features]]
    y, w = F.col(f"`{target}`").cast("double"), F.col(f"`{weight}`").cast("double") if weight else F.lit(1.0)
    names = [f"x{i}" for i in range(len(x))]
    rows = df.select(*[c.alias(n) for n, c in zip(names, x, strict=True)], y.alias("y"), w.alias("w")).dropna()
    beta, k = np.zeros(len(x)), len(x)
    upper = [(i, j) for i in range(k) for j in range(i, k)]
    value = move = 0.0
    for _ in range(steps):
        z = sum((F.lit(float(b)) * F.col(n) for b, n in zip(beta, names, strict=True)), F.lit(0.0))
        at = rows.select("*", z.alias("z"), (1 / (1 + F.exp(-z))).alias("p")).withColumn("v", F.col("w") * F.col("p") * (1 - F.col("p")))
        gradient = [F.sum(F.col("w") * (F.col("y") - F.col("p")) * F.col(n)) for n in names]
        hessian = [F.sum(F.col("v") * F.col(names[i]) * F.col(names[j])) for i, j in upper]
        likely = F.sum(F.col("w") * (F.col("y") * F.col("z") - F.when(F.col("z") > 0, F.col("z") + F.log1p(F.exp(-F.col("z")))).otherwise(F.log1p(F.exp("z")))))
        found = at.agg(F.array(*gradient).alias("g"), F.array(*hessian).alias("h"), likely.alias("l")).first()
        if found["l"] is None:
            raise ValueError("there are no rows without nulls")
        penalty = ridge * np.array([0.0, *[1.0] * (k - 1)])
        h = np.zeros((k, k))
        for (i, j), s in zip(upper, found["h"], strict=True):
            h[i, j] = h[j, i] = s
        step = np.linalg.solve(h + np.diag(penalty), np.array(found["g"]) - penalty * beta)
        beta, value, move = beta + step, found["l"], float(np.abs(step).max())
    return Logistic(tuple(features), float(beta[0]), tuple(map(float, beta[1:])), value, move)
