"""Problems 4 and 5: cutoffs and percentiles."""

import math

import numpy as np
import pytest

from helixmill.llm import compactors, cutoffs


def _cut(rows):
    groups = {}
    for s, q, v in rows:
        groups.setdefault((s, q), []).append(v)
    out = {}
    for (s, q), v in groups.items():
        if q > 0:
            k = min(len(v), -(-q * len(v) // 10000))
            out[s, q] = (len(v), k, sorted(v, reverse=True)[k - 1])
    return out


@pytest.mark.parametrize("seed", range(3))
def test_cutoffs_match_sorting(spark, seed):
    rng = np.random.default_rng(seed)
    rows = []
    for s, n in (("big", 6000), ("ties", 2000), ("one", 1), ("few", 7), ("wide", 900)):
        for q in (1000, 2500, 5000, 9999, 10000, 12000, 0):
            v = rng.integers(0, 5, n).astype(float) if s == "ties" else rng.standard_cauchy(n) * 1e6 if s == "wide" else rng.normal(size=n)
            rows += [(s, q, float(x)) for x in v]
    df = spark.createDataFrame(rows, "source string, part int, score double").repartition(9)
    got = {(r["source"], r["part"]): (r["n"], r["k"], r["cutoff"]) for r in cutoffs.cutoffs(df).collect()}
    assert got == _cut(rows)


def test_cutoffs_of_nothing(spark):
    assert cutoffs.cutoffs(spark.createDataFrame([], "source string, part int, score double")).count() == 0


def test_dirty_rows_of_the_table(spark, tmp_path):
    cols = "row_id long, pool_or_direction string, retention_fraction double, standardized_gain_vs_pool double, achieved_retention_fraction double, source string"
    nan, inf = float("nan"), float("inf")
    rows = [(1, " GCall", 0.25, 1.0, 0.2), (1, " GCall", 0.25, 1.0, 0.2), (2, "gcall", 0.2500000001, 1.0, nan), (3, "GCALL ", 0.25, 0.5, None), (4, "GCall", 0.25, nan, 0.1), (5, "GCall", 0.25, inf, 0.1)]
    rows += [(6, None, 0.25, 2.0, 0.1), (7, "GCall", None, 2.0, 0.1), (8, "GCall", 0.25, None, 0.1), (9, "GCall", 0.25, -1.0, 0.1), (None, "GCall", 0.25, 9.0, 0.1), (10, " ", 0.25, 9.0, 0.1)]
    spark.createDataFrame([(*r, "clash") for r in rows], cols).write.parquet(f"{tmp_path}/paper2_assay_calibrated_selection_figure_source_data.parquet")
    assert sorted(r["row_id"] for r in cutoffs.p4_found(spark, str(tmp_path)).collect()) == [1, 2]


def _sketch(spark, df, keys):
    return compactors.merged(compactors.partial_sketches(df, keys, "value"), keys)


def test_percentiles_are_within_the_bound_and_days_combine(spark):
    rng = np.random.default_rng(4)
    data = {"a": rng.normal(size=60_000), "b": rng.integers(0, 3, 30_000).astype(float), "c": rng.pareto(0.5, 20_000), "tiny": np.array([3.0, 1.0, 2.0])}
    rows = [(g, int(i % 6), float(v)) for g, x in data.items() for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "g string, day int, value double").repartition(8)
    whole = compactors.percentiles(_sketch(spark, df, ["g"]), ["g"]).collect()
    days = compactors.percentiles(compactors.merged(_sketch(spark, df, ["g", "day"]), ["g"]), ["g"]).collect()
    for r in [*whole, *days]:
        x = np.sort(data[r["g"]])
        low, high = np.searchsorted(x, r["value"], "left"), np.searchsorted(x, r["value"], "right")
        assert r["n"] == len(x)
        assert low - compactors.ERROR * len(x) - 1 <= r["quantile"] * len(x) <= high + compactors.ERROR * len(x) + 1
    assert next(r["value"] for r in whole if r["g"] == "tiny" and r["quantile"] == 0.5) == 2.0


def test_sketch_of_nothing_and_null_groups(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), (2, 5.0)], "g int, value double")
    got = {(r["g"], r["quantile"]): r["value"] for r in compactors.percentiles(_sketch(spark, df, ["g"]), ["g"]).collect()}
    assert got[None, 0.5] == 1.0 and got[2, 0.99] == 5.0
    assert _sketch(spark, df.where("false"), ["g"]).count() == 0


def test_levels_keep_their_weight():
    rng = np.random.default_rng(1)
    levels = compactors.compact([rng.normal(size=50_000)], rng)
    assert sum(len(v) << h for h, v in enumerate(levels)) == 50_000
    assert sum(len(v) for v in levels) < 4 * compactors.CAPACITY
    assert math.isclose(compactors.answer(levels, 50_000, -9, 9, 0.5), 0, abs_tol=0.05)
