"""Problem 5: percentiles per group with a bounded rank error, from randomised compactors that merge level by level.

A sketch is a hierarchy of levels; a value on level ``h`` stands for ``2 ** h`` values. A level over its capacity is sorted,
every other value, from a random start, moves one level up, and the rest is dropped. Capacities shrink geometrically below the
highest level. Two sketches merge by joining their levels and compacting again, so sketches of days, files or tasks give that
of the whole. With the first capacity of 1,000 the rank of an answered percentile is off by at most ``ERROR`` of the values of its
group with high probability; groups of fewer values than the capacity are exact. The smallest and largest are kept exactly.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixmill.sources import materialise, table

CAPACITY, SHRINK, ERROR = 1000, 2 / 3, 0.01
QUANTILES = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)
METRICS = ("own_model_gain_q25", "own_model_gain_median", "own_model_gain_q75")
SALTS = 16
SKETCH = "n long, least double, most double, levels array<array<double>>"


def compact(levels: list[np.ndarray], rng: np.random.Generator) -> list[np.ndarray]:
    """Compact from below until every level fits its capacity."""
    h = 0
    while h < len(levels):
        room = max(8, math.ceil(CAPACITY * SHRINK ** (len(levels) - 1 - h)))
        if len(levels[h]) > room:
            v = np.sort(levels[h])
            odd = v[-1:] if len(v) % 2 else v[:0]
            if h + 1 == len(levels):
                levels.append(np.zeros(0))
            levels[h + 1] = np.concatenate([levels[h + 1], v[: len(v) - len(odd)][rng.integers(2) :: 2]])
            levels[h] = odd
        h += 1
    return levels


def merge(sketches: list[list[np.ndarray]], rng: np.random.Generator) -> list[np.ndarray]:
    height = max((len(s) for s in sketches), default=0)
    return compact([np.concatenate([s[h] for s in sketches if h < len(s)]) for h in range(height)], rng)


def answer(levels: list[np.ndarray], n: int, least: float, most: float, q: float) -> float:
    """The value of rank ``ceil(q * n)``, within the error."""
    if q <= 0 or q >= 1 or n == 1:
        return least if q <= 0 or n == 1 else most
    v = np.concatenate(levels)
    w = np.repeat(1 << np.arange(len(levels)), [len(x) for x in levels])
    order = np.argsort(v, kind="stable")
    reached = np.cumsum(w[order])
    place = np.searchsorted(reached, q * reached[-1], "left")
    return float(min(max(v[order][min(place, len(v) - 1)], least), most))


def _lists(levels: list[list[np.ndarray]]) -> pa.Array:
    inner = pa.ListArray.from_arrays(
        np.r_[0, np.cumsum([len(x) for s in levels for x in s])].astype(np.int32), pa.array(np.concatenate([np.zeros(0), *(x for s in levels for x in s)]))
    )
    return pa.ListArray.from_arrays(np.r_[0, np.cumsum([len(s) for s in levels])].astype(np.int32), inner)


def partial_sketches(values: DataFrame, keys: list[str], value: str, seed: int = 5) -> DataFrame:
    """One sketch for each group that a task met, of ``values`` (keys..., value double)."""
    head = values.select(*keys).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        rng = np.random.default_rng([seed, TaskContext.get().partitionId()])
        held: dict[tuple, list] = {}
        for batch in batches:
            t = pa.Table.from_batches([batch])
            for r in t.group_by(keys, use_threads=False).aggregate([(value, "list")]).to_batches():
                rows = zip(*(r.column(k).to_pylist() for k in keys), r.column(f"{value}_list"))
                for *key, v in rows:
                    v = v.values.to_numpy(zero_copy_only=False)
                    s = held.setdefault(tuple(key), [0, math.inf, -math.inf, [np.zeros(0)]])
                    s[0], s[1], s[2] = s[0] + len(v), min(s[1], v.min()), max(s[2], v.max())
                    s[3][0] = np.concatenate([s[3][0], v])
                    s[3] = compact(s[3], rng)
            if len(held) > 10_000:
                yield out(held)
                held = {}
        if held:
            yield out(held)

    kinds = [f.dataType for f in head]

    def out(held: dict[tuple, list]) -> pa.RecordBatch:
        from pyspark.sql.pandas.types import to_arrow_type

        cols = [pa.array([k[i] for k in held], to_arrow_type(kinds[i])) for i in range(len(keys))]
        n, least, most, levels = zip(*held.values())
        return pa.RecordBatch.from_arrays([*cols, pa.array(n, pa.int64()), pa.array(least, pa.float64()), pa.array(most, pa.float64()), _lists(list(levels))], [*keys, "n", "least", "most", "levels"])

    names = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in head)
    return values.select(*keys, value).mapInArrow(run, f"{names}, {SKETCH}")


def merged(sketches: DataFrame, keys: list[str], seed: int = 6) -> DataFrame:
    """One sketch per group of ``keys``, merged in two steps so that no task gathers all partial sketches of a large group."""
    head = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in sketches.select(*keys).schema)

    def join(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        rows = [[np.asarray(x, float) for x in s] for s in t.column("levels").to_pylist()]
        rng = np.random.default_rng([seed, t.num_rows, int(np.sum(t.column("n").to_numpy()))])
        first = t.slice(0, 1).select([c for c in t.column_names if c in ("salt", *keys)])
        for name, x in (
            ("n", pa.array([int(t.column("n").to_numpy().sum())])),
            ("least", pa.array([float(t.column("least").to_numpy().min())])),
            ("most", pa.array([float(t.column("most").to_numpy().max())])),
            ("levels", _lists([merge(rows, rng)])),
        ):
            first = first.append_column(name, x)
        return first

    salted = sketches.select(*keys, F.pmod(F.xxhash64("n", "least", "most"), F.lit(SALTS)).cast("int").alias("salt"), "n", "least", "most", "levels")
    some = salted.groupBy(*keys, "salt").applyInArrow(join, f"{head}, salt int, {SKETCH}")
    return some.drop("salt").groupBy(*keys).applyInArrow(join, f"{head}, {SKETCH}")


def percentiles(sketches: DataFrame, keys: list[str], quantiles: tuple[float, ...] = QUANTILES) -> DataFrame:
    """(keys..., n, quantile, value) answered from sketches, one per group."""
    head = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in sketches.select(*keys).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, q, v = [], [], []
            for i, row in enumerate(batch.select(["n", "least", "most", "levels"]).to_pylist()):
                levels = [np.asarray(x, float) for x in row["levels"]]
                for p in quantiles:
                    at.append(i)
                    q.append(p)
                    v.append(answer(levels, row["n"], row["least"], row["most"], p))
            groups = batch.select([*keys, "n"]).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*groups.columns, pa.array(q, pa.float64()), pa.array(v, pa.float64())], [*keys, "n", "quantile", "value"])

    return sketches.mapInArrow(run, f"{head}, n long, quantile double, value double")


def finite_values(spark: SparkSession, data_dir: str) -> DataFrame:
    """(selector_bits, metric, day, value): the finite values of each result once, negative zero as zero; null bits are a group."""
    t = table(spark, data_dir, "generated_fiber_results")
    once = t.where("result_id is not null").select("result_id", "selector_bits", F.to_date("computed_at").alias("day"), *METRICS).distinct()
    long = once.unpivot(["result_id", "selector_bits", "day"], list(METRICS), "metric", "value")
    v = F.col("value")
    return long.where(v.isNotNull() & ~F.isnan(v) & (F.abs(v) != math.inf)).select("selector_bits", "metric", "day", (v + F.lit(0.0)).alias("value"))


def daily_sketches(spark: SparkSession, data_dir: str) -> DataFrame:
    keys = ["selector_bits", "metric", "day"]
    return merged(partial_sketches(finite_values(spark, data_dir), keys, "value"), keys)


def p5_percentiles(spark: SparkSession, data_dir: str) -> DataFrame:
    """Percentiles per selector_bits and metric, from sketches of the tasks."""
    keys = ["selector_bits", "metric"]
    return percentiles(merged(partial_sketches(finite_values(spark, data_dir), keys, "value"), keys), keys)


def p5_combined(spark: SparkSession, data_dir: str) -> DataFrame:
    """The same from the sketches of separate days, combined."""
    keys = ["selector_bits", "metric"]
    return percentiles(merged(daily_sketches(spark, data_dir), keys), keys)


def p5_within(spark: SparkSession, data_dir: str) -> DataFrame:
    """For each combined percentile, whether its true rank is within the stated error of the wanted one."""
    keys = ["selector_bits", "metric"]
    answers = materialise(p5_combined(spark, data_dir), "p5-answers").withColumn("bits", F.coalesce("selector_bits", F.lit(-1)))
    packed = answers.groupBy("bits", "metric").agg(F.sort_array(F.collect_list(F.struct("quantile", "value", "n"))).alias("p"))  # one entry per quantile
    values = finite_values(spark, data_dir).withColumn("bits", F.coalesce("selector_bits", F.lit(-1))).join(packed, ["bits", "metric"])
    sums = []
    for i in range(len(QUANTILES)):
        sums += [F.count_if(F.col("value") < F.col("p")[i]["value"]).alias(f"b{i}"), F.count_if(F.col("value") <= F.col("p")[i]["value"]).alias(f"u{i}")]
    ranks = values.groupBy(*keys).agg(F.count("*").alias("n"), *sums)
    rows = F.array(*[F.struct(F.lit(q).alias("quantile"), F.col(f"b{i}").alias("below"), F.col(f"u{i}").alias("upto")) for i, q in enumerate(QUANTILES)])
    long = ranks.select(*keys, "n", F.explode(rows).alias("r"))
    wanted, slack = F.col("r.quantile") * F.col("n"), F.col("n") * ERROR + 1
    return long.select(*keys, "n", F.col("r.quantile").alias("quantile"), ((F.col("r.below") <= wanted + slack) & (F.col("r.upto") >= wanted - slack)).alias("within"))


P5_WITHIN_SQL = f"""
WITH once AS (SELECT DISTINCT result_id, selector_bits, {", ".join(METRICS)} FROM generated_fiber_results WHERE result_id IS NOT NULL),
long AS ({" UNION ALL ".join(f"SELECT selector_bits, '{m}' AS metric, {m} AS value FROM once" for m in METRICS)})
SELECT selector_bits, metric, n, quantile, TRUE AS within FROM (SELECT selector_bits, metric, count(*) AS n FROM long WHERE isfinite(value) GROUP BY 1, 2),
  (SELECT CAST(unnest([{", ".join(map(str, QUANTILES))}]) AS DOUBLE) AS quantile)
"""
