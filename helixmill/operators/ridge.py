"""Standardised ridge regression from one pass of sums per group; the driver solves matrices of features times features."""

from __future__ import annotations

from itertools import combinations_with_replacement

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ALPHAS = tuple(10.0**k for k in range(-4, 5))


def moments(df: DataFrame, group: list[str], features: list[str], outcome: str) -> DataFrame:
    """Counts, sums and products of each group: all that a ridge fit needs, mergeable over groups by addition."""
    cols = {"one": F.lit(1.0)} | {c: F.col(c).cast("double") for c in [*features, outcome]}
    sums = [F.sum(cols[a] * cols[b]).alias(f"{a}*{b}") for a, b in combinations_with_replacement(cols, 2)]
    return df.groupBy(*group).agg(*sums)


def gram(row: dict, features: list[str], outcome: str) -> np.ndarray:
    names = ["one", *features, outcome]
    out = np.zeros((len(names), len(names)))
    for (i, a), (j, b) in combinations_with_replacement(enumerate(names), 2):
        out[i, j] = out[j, i] = row[f"{a}*{b}"]
    return out


def solve(g: np.ndarray, alpha: float) -> tuple[float, np.ndarray]:
    """(intercept, raw coefficients) of the ridge fit on population-standardised features; constant features count 0."""
    n = g[0, 0]
    mean, cov = g[0, 1:-1] / n, g[1:-1, 1:-1] - np.outer(g[0, 1:-1], g[0, 1:-1]) / n
    sd = np.sqrt(np.maximum(np.diag(cov), 0) / n)
    sd[sd == 0] = 1
    xy = (g[1:-1, -1] - g[0, 1:-1] * g[0, -1] / n) / sd
    beta = np.linalg.solve(cov / np.outer(sd, sd) + alpha * np.eye(len(sd)), xy) / sd
    return float(g[0, -1] / n - beta @ mean), beta


def squared_error(g: np.ndarray, intercept: float, beta: np.ndarray) -> float:
    """Sum of squared errors on the rows behind ``g``."""
    w = np.r_[-intercept, -beta, 1.0]
    return float(w @ g @ w)


def best_alpha(folds: list[np.ndarray], alphas: tuple[float, ...] = ALPHAS) -> float:
    """The first of the penalties with the least mean squared error over held-out folds."""
    total = sum(folds)
    scores = []
    for a in alphas:
        scores.append(np.mean([squared_error(f, *solve(total - f, a)) / f[0, 0] for f in folds]))
    return alphas[int(np.argmin(scores))]
