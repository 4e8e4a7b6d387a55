"""Two-stage resampling: a ridge model is refitted on each resample of its source, and each resample of the target's fibers is tried under it.

A task adds up all replicates' moments of its rows, Spark adds up the tasks' moments, and the fits are solved where those sums lie,
a row a group and replicate. Fibers and models then meet in salted groups of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixmill.operators import ridge
from helixmill.operators.stats import digests, poisson_weights
from helixmill.sources import spread

#: Rows whose replicates are added up at once, and fibers tried together under all models of a source.
ROWS, FIBERS = 512, 4096


def _weights(seed: str, names: list, replicates: int) -> np.ndarray:
    """Poisson(1) counts, names x replicates, from hashes of seed, block and name; one SHA-256 serves 16."""
    raw = b"".join(digests(seed, str(n), -(-replicates // 16)) for n in names)
    return poisson_weights(np.frombuffer(raw, ">u2").reshape(len(names), -1)[:, :replicates]).astype(float)


def refits(df: DataFrame, group: str, fold: str, key: str, features: list[str], outcome: str, replicates: int, seed: str) -> DataFrame:
    """(group, replicate, alpha, b_feature...): the ridge model of each Poisson resample of each group's rows.

    The penalty is chosen in each replicate over the folds given. ``key`` is unique in the table. A replicate of which fewer than two
    folds have rows has no model.
    """
    names = ["one", *features, outcome]
    at = list(combinations_with_replacement(range(len(names)), 2))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups, folds, keys = (batch.column(i).to_pylist() for i in range(3))
            x = np.column_stack([np.ones(len(batch)), *(c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns[3:])])
            products = np.stack([x[:, i] * x[:, j] for i, j in at], axis=1)
            places: dict[tuple, list[int]] = {}
            for i, g in enumerate(zip(groups, folds)):
                places.setdefault(g, []).append(i)
            for (g, f), rows in places.items():
                total = np.zeros((replicates, len(at)))
                for start in range(0, len(rows), ROWS):
                    part = rows[start : start + ROWS]
                    total += _weights(seed, [keys[i] for i in part], replicates).T @ products[part]
                columns = [pa.array([g] * replicates), pa.array([f] * replicates, pa.int32()), pa.array(np.arange(replicates, dtype=np.int32)), *(pa.array(t) for t in total.T)]
                yield pa.RecordBatch.from_arrays(columns, [group, "fold", "replicate", *(f"s{k}" for k in range(len(at)))])

    head = f"{group} string, fold int, replicate int, " + ", ".join(f"s{k} double" for k in range(len(at)))
    rows = df.select(group, fold, key, *[F.col(c).cast("double").alias(c) for c in (*features, outcome)])
    added = spread(rows).mapInArrow(sums, head).groupBy(group, "fold", "replicate").agg(F.array(*[F.sum(f"s{k}") for k in range(len(at))]).alias("s"))
    folded = added.where("s[0] > 0").groupBy(group, "replicate").agg(F.transform(F.array_sort(F.collect_list(F.struct("fold", "s"))), lambda z: z["s"]).alias("folds"))  # one entry a fold

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(3 + len(features))]
            for g, r, folds in zip(*(c.to_pylist() for c in batch.columns)):
                if len(folds) < 2:
                    continue
                grams = np.zeros((len(folds), len(names), len(names)))
                for k, (i, j) in enumerate(at):
                    grams[:, i, j] = grams[:, j, i] = [s[k] for s in folds]
                alpha = ridge.best_alpha(list(grams))
                for column, v in zip(out, (g, r, alpha, *ridge.solve(grams.sum(axis=0), alpha)[1])):
                    column.append(v)
            types = [pa.string(), pa.int32(), *[pa.float64()] * (1 + len(features))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], [group, "replicate", "alpha", *(f"b_{f}" for f in features)])

    return spread(folded).mapInArrow(fit, f"{group} string, replicate int, alpha double, " + ", ".join(f"b_{f} double" for f in features))


def replicate_gains(fibers: DataFrame, models: DataFrame, source: str, group: str, key: str, features: list[str], outcome: str, replicates: int, seed: str) -> DataFrame:
    """(source, group, replicate, gain): the weighted mean gain of the choices that each replicate's model makes in resampled fibers.

    ``fibers``: one row a fiber, ``outcome`` and every feature an array over its members in order; a choice is the member whose
    predicted score, as a whole-number key, is highest, the first on ties. Fibers are salted into groups of about ``FIBERS``.
    """
    salts = max(1, -(-fibers.count() // FIBERS))
    salted = fibers.withColumn("salt", F.pmod(F.xxhash64(key), F.lit(salts)).cast("int"))
    copied = models.join(fibers.select(source, group).distinct(), source).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    betas, theirs = [f"b_{f}" for f in features], ["_source", "_group", "_salt"]
    copied = copied.select(F.col(source).alias("_source"), F.col(group).alias("_group"), F.col("salt").alias("_salt"), "replicate", *betas)

    def tried(left: pa.Table, right: pa.Table) -> pa.Table:
        schema = pa.schema([(source, pa.string()), (group, pa.string()), ("replicate", pa.int32()), ("w", pa.float64()), ("s", pa.float64())])
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        x = np.stack([np.array(left.column(f).to_pylist(), float) for f in features], axis=2)  # fibers, members, features
        y = np.array(left.column(outcome).to_pylist(), float)
        gain = y - y.mean(axis=1, keepdims=True)
        weights = _weights(seed, left.column(key).to_pylist(), replicates)
        at, beta = right.column("replicate").to_numpy(), np.stack([right.column(b).to_numpy() for b in betas])
        w, s = weights.sum(axis=0)[at], np.zeros(len(at))
        for k, r in enumerate(at):
            best = np.rint(x @ beta[:, k] * 1e12).argmax(axis=1)
            s[k] = weights[:, r] @ gain[np.arange(len(gain)), best]
        one = lambda c: pa.array([left.column(c)[0].as_py()] * len(at))
        return pa.table([one(source), one(group), pa.array(at, pa.int32()), pa.array(w), pa.array(s)], schema=schema)

    by = [source, group, "salt"]
    parts = salted.groupBy(*by).cogroup(copied.groupBy(*theirs)).applyInArrow(tried, f"{source} string, {group} string, replicate int, w double, s double")
    return parts.groupBy(source, group, "replicate").agg(F.try_divide(F.sum("s"), F.sum("w")).alias("gain"))
