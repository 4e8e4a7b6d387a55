"""Problem 4: for each source and fraction, the score cutoff that keeps the fraction, by multi-sequence selection.

The scores are cut into sorted arrays of bounded length, one per source, fraction and batch of rows, and written once. Every
round, each array offers a few of its scores within its source's open range as pivots; Spark condenses them to some per source;
each array finds their ranks by binary search, and Spark adds the ranks up. The pivots on either side of the wanted rank are
the next range; where the wanted rank falls on a pivot, that is the cutoff. The driver holds one range per source and fraction.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixmill.functions.names import name_key
from helixmill.sources import materialise, table

PIVOTS = 32
_PIVOT = "source string, part int, score double"


def sorted_runs(rows: DataFrame) -> DataFrame:
    """(source, part, scores ascending) of rows (source string, part int, score double), one per group and batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch]).sort_by([("source", "ascending"), ("part", "ascending"), ("score", "ascending")]).combine_chunks()
            source, part = t.column(0).combine_chunks().dictionary_encode(), t.column(1).to_numpy()
            code = source.indices.to_numpy(zero_copy_only=False)
            at = np.flatnonzero(np.r_[True, (code[1:] != code[:-1]) | (part[1:] != part[:-1])])
            lists = pa.ListArray.from_arrays(pa.array(np.r_[at, len(code)].astype(np.int32)), t.column(2).combine_chunks())
            yield pa.RecordBatch.from_arrays([source.dictionary.take(source.indices.take(pa.array(at))), pa.array(part[at], pa.int32()), lists], ["source", "part", "scores"])

    return rows.select("source", "part", "score").mapInArrow(run, "source string, part int, scores array<double>")


def _pivots(runs: DataFrame, ranges: dict) -> dict:
    """Some scores inside each open range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for source, part, scores in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if (source, part) in ranges:
                    low, high = ranges[source, part]
                    v = scores.values.to_numpy()
                    a, b = np.searchsorted(v, low, "right"), np.searchsorted(v, high, "left")
                    if a < b:
                        take = np.unique(np.linspace(a, b - 1, min(PIVOTS, b - a)).astype(int))
                        out += [(source, part, float(x)) for x in v[take]]
            cols = list(zip(*out)) if out else [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int32(), pa.float64()))], ["source", "part", "score"])

    shares = F.array(*[F.lit(i / PIVOTS) for i in range(PIVOTS + 1)])
    condensed = runs.mapInArrow(run, _PIVOT).groupBy("source", "part").agg(F.percentile_approx("score", shares, 1000).alias("p"))
    return {(r["source"], r["part"]): np.unique(r["p"]) for r in condensed.collect()}  # one row per source and fraction


def _ranks(runs: DataFrame, pivots: dict) -> dict:
    """For each pivot, the number of scores above it and the number not below it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[tuple, np.ndarray] = {}
            for source, part, scores in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if (source, part) in pivots:
                    v, p = scores.values.to_numpy(), pivots[source, part]
                    here = np.stack([len(v) - np.searchsorted(v, p, "right"), len(v) - np.searchsorted(v, p, "left")])
                    out[source, part] = out.get((source, part), 0) + here
            rows = [(s, q, i, int(n[0, i]), int(n[1, i])) for (s, q), n in out.items() for i in range(n.shape[1])]
            cols = list(zip(*rows)) if rows else [[], [], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64()))], ["source", "part", "i", "above", "least"])

    sums = runs.mapInArrow(run, "source string, part int, i int, above long, least long").groupBy("source", "part", "i").agg(F.sum("above").alias("above"), F.sum("least").alias("least"))
    out: dict[tuple, dict] = {}
    for r in sums.collect():  # at most PIVOTS + 1 rows per source and fraction
        out.setdefault((r["source"], r["part"]), {})[r["i"]] = (r["above"], r["least"])
    return out


def cutoffs(rows: DataFrame) -> DataFrame:
    """(source, part, n, k, cutoff) of rows (source, part in ten-thousandths, score finite), ``k = ceil(part * n / 10000)``.

    The cutoff is the k-th highest score, ties counted one by one. Groups with a part of 0 or less have none and are left out;
    a part of over 10000 keeps all. An empty table gives an empty result.
    """
    spark = rows.sparkSession
    runs = materialise(sorted_runs(rows), "p4-runs")
    sizes = runs.where("part > 0").groupBy("source", "part").agg(F.sum(F.size("scores")).alias("n")).collect()  # one row per source and fraction
    wanted = {(r["source"], r["part"]): (r["n"], min(r["n"], -(-r["part"] * r["n"] // 10000))) for r in sizes}
    ranges = dict.fromkeys(wanted, (-math.inf, math.inf))
    found: dict[tuple, float] = {}
    while ranges:
        pivots = _pivots(runs, ranges)
        for group, ranks in _ranks(runs, pivots).items():
            k, (low, high) = wanted[group][1], ranges[group]
            for i, p in enumerate(pivots[group]):
                above, least = ranks[i]
                if above < k <= least:
                    found[group] = float(p)
                elif above >= k:
                    low = max(low, p)
                else:
                    high = min(high, p)
            if group in found:
                del ranges[group]
            else:
                ranges[group] = (low, high)
    return spark.createDataFrame([(s, q, n, k, found[s, q]) for (s, q), (n, k) in wanted.items()], "source string, part int, n long, k long, cutoff double")


def scored_rows(spark: SparkSession, data_dir: str) -> DataFrame:
    """Distinct rows with a source, a fraction and a finite score; the fraction in ten-thousandths."""
    score, fraction = F.col("standardized_gain_vs_pool"), F.col("retention_fraction")
    return (
        table(spark, data_dir, "paper2_assay_calibrated_selection_figure_source_data")
        .where(F.col("row_id").isNotNull() & fraction.isNotNull() & ~F.isnan(fraction) & score.isNotNull() & ~F.isnan(score) & (F.abs(score) != math.inf))
        .select("row_id", name_key("pool_or_direction").alias("source"), F.round(fraction * 10000).cast("int").alias("part"), score.alias("score"), "achieved_retention_fraction")
        .where("source is not null")
        .distinct()
    )


def p4_found(spark: SparkSession, data_dir: str) -> DataFrame:
    rows = materialise(scored_rows(spark, data_dir).drop("achieved_retention_fraction"), "p4-rows")
    return rows.join(cutoffs(rows), ["source", "part"]).where("score >= cutoff").select("row_id")


def p4_cutoffs(spark: SparkSession, data_dir: str) -> DataFrame:
    """Cutoff, number and share kept of each source and fraction, beside the mean achieved fraction that the table states."""
    rows = materialise(scored_rows(spark, data_dir), "p4-rows")
    kept = rows.join(cutoffs(rows), ["source", "part"]).groupBy("source", "part", "n", "k", "cutoff")
    stated = F.avg(F.when(~F.isnan("achieved_retention_fraction"), F.col("achieved_retention_fraction")))
    return kept.agg(F.count_if(F.col("score") >= F.col("cutoff")).alias("kept"), F.round(stated, 6).alias("stated_fraction")).withColumn("reached_fraction", F.round(F.col("kept") / F.col("n"), 6))


_ROWS_SQL = """
WITH r AS (
  SELECT DISTINCT row_id, lower(trim(pool_or_direction)) AS source, CAST(round(retention_fraction * 10000) AS INTEGER) AS part, standardized_gain_vs_pool AS score, achieved_retention_fraction AS stated
  FROM paper2_assay_calibrated_selection_figure_source_data
  WHERE row_id IS NOT NULL AND trim(pool_or_direction) <> '' AND retention_fraction IS NOT NULL AND NOT isnan(retention_fraction) AND isfinite(standardized_gain_vs_pool)),
c AS (SELECT *, row_number() OVER (PARTITION BY source, part ORDER BY score DESC) AS place, count(*) OVER (PARTITION BY source, part) AS n FROM r WHERE part > 0),
k AS (SELECT source, part, n, least(n, (part * n + 9999) // 10000) AS k, score AS cutoff FROM c WHERE place = least(n, (part * n + 9999) // 10000))
"""
P4_FOUND_SQL = _ROWS_SQL + "SELECT row_id FROM r JOIN k USING (source, part) WHERE score >= cutoff"
P4_CUTOFFS_SQL = (
    _ROWS_SQL
    + """SELECT source, part, n, k, cutoff, count(*) FILTER (score >= cutoff) AS kept, round(avg(stated) FILTER (NOT isnan(stated)), 6) AS stated_fraction,
  round(count(*) FILTER (score >= cutoff) / n, 6) AS reached_fraction FROM r JOIN k USING (source, part) GROUP BY source, part, n, k, cutoff"""
)
