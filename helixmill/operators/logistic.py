"""Penalised logistic regression by Newton steps whose sums Spark takes; one fit per group, all groups in each pass."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def probability(weights: dict[str, np.ndarray], group: str, features: list[str]) -> Column:
    """The model's probability for each row of its group; null for a group without a model."""
    score = F.lit(None).cast("double")
    for name, w in weights.items():
        line = F.lit(float(w[0]))
        for x, f in zip(w[1:], features):
            line = line + F.lit(float(x)) * F.col(f)
        score = F.when(F.col(group) == name, line).otherwise(score)
    return 1 / (1 + F.exp(-score))


def fit(df: DataFrame, group: str, features: list[str], label: str, penalty: float = 1.0, rounds: int = 8) -> dict[str, np.ndarray]:
    """Intercept and coefficients per group; the intercept counts as a feature of constant 1 and is penalised too.

    ``df`` is read once a round and should be written or cached; groups are few (splits of a library), rows may be many. A
    group of one class only still has a finite fit, thanks to the penalty.
    """
    names = ["_one", *features]
    rows = df.select(group, F.lit(1.0).alias("_one"), *[F.col(f).cast("double").alias(f) for f in features], F.col(label).cast("double").alias("_y"))
    k = len(names)
    weights = {r[group]: np.zeros(k) for r in rows.select(group).distinct().collect()}  # one row a group
    for _ in range(rounds):
        p = probability(weights, group, features)
        near = rows.withColumn("_p", p).withColumn("_v", F.col("_p") * (1 - F.col("_p")))
        sums = [F.sum((F.col("_p") - F.col("_y")) * F.col(a)).alias(f"g{i}") for i, a in enumerate(names)]
        sums += [F.sum(F.col("_v") * F.col(a) * F.col(names[j])).alias(f"h{i}_{j}") for i, a in enumerate(names) for j in range(i, k)]
        for r in near.groupBy(group).agg(*sums).collect():  # one row a group
            w = weights[r[group]]
            gradient = np.array([r[f"g{i}"] for i in range(k)]) + penalty * w
            curve = np.array([[r[f"h{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)]) + penalty * np.eye(k)
            weights[r[group]] = w - np.linalg.solve(curve, gradient)
    return weights
