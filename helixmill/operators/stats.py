"""Rank statistics, two-sample distances and resampling, on running totals rather than whole-group windows."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from hashlib import sha256
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixmill.operators.positions import average_ranks, running_totals
from helixmill.sources import spread

GROUPS_AT_ONCE = 64


def spearman(df: DataFrame, group: list[str], x: str, y: str) -> DataFrame:
    """(group..., n, spearman): correlation of average ranks; null where a side is constant."""
    ranked = average_ranks(average_ranks(df.select(*group, x, y), group, x, "_rx"), group, y, "_ry")
    varied = (F.stddev_pop("_rx") > 0) & (F.stddev_pop("_ry") > 0)
    return ranked.groupBy(*group).agg(F.count("*").alias("n"), F.round(F.when(varied, F.corr("_rx", "_ry")), 6).alias("spearman"))


def auc(df: DataFrame, group: list[str], score: str, label: str) -> DataFrame:
    """(group..., positives, auc) from the rank sum of positives; null where a class is empty."""
    ranked = average_ranks(df.select(*group, score, label), group, score, "_r")
    p, n = F.count_if(F.col(label) == 1), F.count_if(F.col(label) == 0)
    area = F.try_divide(F.sum(F.when(F.col(label) == 1, F.col("_r"))) - p * (p + 1) / 2, p * n)
    return ranked.groupBy(*group).agg(p.alias("positives"), F.round(area, 6).alias("auc"))


def average_precision(df: DataFrame, group: list[str], score: str, label: str) -> DataFrame:
    """(group..., average_precision): precision over recall steps, scores descending, tied scores taken as one step."""
    steps = df.groupBy(*group, (-F.col(score)).alias("_s")).agg(F.sum(F.col(label).cast("long")).alias("_p"), F.count("*").alias("_n"))
    run = running_totals(steps, group, ["_s"], {"_tp": F.col("_p"), "_all": F.col("_n")})
    return run.groupBy(*group).agg(F.round(F.try_divide(F.sum(F.col("_p") * F.col("_tp") / F.col("_all")), F.sum("_p")), 6).alias("average_precision"))


def weighted_ranks(df: DataFrame, group: list[str], value: str, weight: str, name: str) -> DataFrame:
    """``df`` with the mid-rank of ``value`` where each row counts ``weight`` times."""
    ties = df.groupBy(*group, value).agg(F.sum(weight).alias("_w"))
    run = running_totals(ties, group, [value], {"_upto": F.col("_w")})
    return df.join(run.select(*group, value, (F.col("_upto") - F.col("_w") + (F.col("_w") + 1) / 2).alias(name)), [*group, value])


def two_sample(df: DataFrame, group: list[str], value: str, side: str) -> DataFrame:
    """(group..., ks, wasserstein) between the rows with ``side`` 0 and 1; null where a side is empty."""
    counts = df.groupBy(*group, value).agg(F.count_if(F.col(side) == 0).alias("_a"), F.count_if(F.col(side) == 1).alias("_b"))
    run = running_totals(counts, group, [value], {"_fa": F.col("_a"), "_fb": F.col("_b"), "_at": F.lit(1).cast("long")})
    sizes = counts.groupBy(*group).agg(F.sum("_a").alias("_na"), F.sum("_b").alias("_nb"))
    after = run.select(*group, (F.col("_at") - 1).alias("_at"), F.col(value).alias("_next"))
    both = run.join(after, [*group, "_at"], "left").join(sizes, group).where("_na > 0 and _nb > 0")
    gap = F.abs(F.col("_fa") / F.col("_na") - F.col("_fb") / F.col("_nb"))
    return both.groupBy(*group).agg(F.round(F.max(gap), 6).alias("ks"), F.round(F.coalesce(F.sum(gap * (F.col("_next") - F.col(value))), F.lit(0.0)), 9).alias("wasserstein"))


def ks_p(ks: Column, n: Column, m: Column) -> Column:
    """Asymptotic two-sided p of a two-sample Kolmogorov-Smirnov distance: 100 terms of the series, 1 where it does not settle."""
    t = ks * F.sqrt(n * m / (n + m))
    term = lambda k: F.when(k % 2 == 1, 1.0).otherwise(-1.0) * F.exp(-2 * k * k * t * t)
    total = F.aggregate(F.sequence(F.lit(1), F.lit(100)), F.lit(0.0), lambda a, k: a + term(k))
    return F.when(t < 0.2, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), 2 * total)))


def draw(seed: str, replicate: Column, index: Column, n: Column) -> Column:
    """A place in [0, n) from the SHA-256 of seed, replicate and index: the same in any engine and partitioning."""
    text = F.concat(F.lit(seed + "|"), replicate.cast("string"), F.lit("|"), index.cast("string"))
    return F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("long") % n


def poisson_weights(bits: np.ndarray) -> np.ndarray:
    """Poisson(1) counts, from 0 to 8, of 16-bit uniform numbers: how often a row stands in a bootstrap resample."""
    below = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(8)])
    return np.searchsorted(np.floor(below * 65536), bits, side="right")


def digests(seed: str, key: str, blocks: int) -> bytes:
    return b"".join(sha256(f"{seed}|{block}|{key}".encode()).digest() for block in range(blocks))


def _summed(df: DataFrame, group: str, columns: list[str], names: list[str], replicates: int, of_row: Callable[[tuple], np.ndarray]) -> DataFrame:
    """(group, replicate, names...): sums over rows of ``of_row`` (names x replicates), added up inside tasks before the shuffle.

    A task holds the sums of at most ``GROUPS_AT_ONCE`` groups at a time.
    """

    def rows_of(sums: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for name, total in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * replicates), pa.array(np.arange(replicates, dtype=np.int32)), *(pa.array(t) for t in total)], [group, "replicate", *names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for name, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if name not in sums:
                    if len(sums) >= GROUPS_AT_ONCE:
                        yield from rows_of(sums)
                        sums = {}
                    sums[name] = np.zeros((len(names), replicates))
                sums[name] += of_row(tuple(row))
        yield from rows_of(sums)

    parts = spread(df.select(group, *columns)).mapInArrow(run, f"{group} string, replicate int, " + ", ".join(f"{n} double" for n in names))
    return parts.groupBy(group, "replicate").agg(*[F.sum(n).alias(n) for n in names])


def bootstrap_means(df: DataFrame, group: str, key: str, value: str, replicates: int, seed: str) -> DataFrame:
    """(group, replicate, mean) of Poisson resamples: each row counts by a hash of seed, replicate and its ``key`` (unique in the table).

    One SHA-256 serves 16 replicates. A replicate that draws no row has a null mean.
    """

    def of_row(row: tuple) -> np.ndarray:
        weights = poisson_weights(np.frombuffer(digests(seed, row[0], -(-replicates // 16)), ">u2")[:replicates])
        return np.stack([weights, weights * row[1]])

    sums = _summed(df.withColumn(key, F.col(key).cast("string")), group, [key, value], ["w", "s"], replicates, of_row)
    return sums.select(group, "replicate", F.try_divide(F.col("s"), F.col("w")).alias("mean"))


def bootstrap_sums(df: DataFrame, group: str, key: str, values: list[str], replicates: int, seed: str) -> DataFrame:
    """(group, replicate, values...): the sums of several values under the same Poisson weights, so that their differences are paired."""

    def of_row(row: tuple) -> np.ndarray:
        weights = poisson_weights(np.frombuffer(digests(seed, row[0], -(-replicates // 16)), ">u2")[:replicates])
        return np.outer(row[1:], weights)

    rows = df.select(group, F.col(key).cast("string").alias("_key"), *[F.col(v).cast("double").alias(v) for v in values])
    return _summed(rows, group, ["_key", *values], values, replicates, of_row)


def random_choices(df: DataFrame, group: str, key: str, outcomes: str, replicates: int, seed: str) -> DataFrame:
    """(group, replicate, mean): the mean over rows of one of the four ``outcomes`` of each, drawn by a hash; one SHA-256 serves 64 replicates."""

    def of_row(row: tuple) -> np.ndarray:
        raw = np.frombuffer(digests(seed, row[0], -(-replicates // 64)), np.uint8)
        slots = np.stack([raw >> 4 & 3, raw & 3], axis=1).ravel()[:replicates]
        return np.stack([np.ones(replicates), np.array(row[1])[slots]])

    sums = _summed(df.withColumn(key, F.col(key).cast("string")), group, [key, outcomes], ["n", "s"], replicates, of_row)
    return sums.select(group, "replicate", (F.col("s") / F.col("n")).alias("mean"))


def bca(estimate: float, replicates: list[float], jackknife_skew: float, level: float = 0.95) -> tuple[float, float]:
    """Bias-corrected accelerated interval from bootstrap means (a bounded list, one a replicate) and the acceleration."""
    normal, b = NormalDist(), sorted(replicates)
    share = (sum(x < estimate for x in b) + 0.5 * sum(x == estimate for x in b)) / len(b)
    z0 = normal.inv_cdf(min(max(share, 0.5 / len(b)), 1 - 0.5 / len(b)))
    out = []
    for p in ((1 - level) / 2, (1 + level) / 2):
        z = z0 + normal.inv_cdf(p)
        at = normal.cdf(z0 + z / (1 - jackknife_skew * z)) * (len(b) - 1)
        low = min(int(at), len(b) - 2)
        out.append(b[low] + (at - low) * (b[low + 1] - b[low]))
    return out[0], out[1]


