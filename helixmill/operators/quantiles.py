"""Exact quantiles within groups, without a task that holds a whole group's values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixmill.operators.positions import running_totals


def with_quantiles(summary: DataFrame, rows: DataFrame, group: list[str], value: str, at: dict[str, float], digits: int | None = None) -> DataFrame:
    """``summary``, one row a group, with a column per entry of ``at``: that quantile of ``value`` over ``rows``, linearly interpolated.

    Equal values are counted first; the counts' running totals place each quantile. Null values do not count, null group keys are
    a group of their own, and a group without values has null quantiles. Values must not be NaN.
    """
    key = F.struct(*group)
    counts = rows.where(F.col(value).isNotNull()).groupBy(key.alias("_g"), F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_c"))
    run = running_totals(counts, ["_g"], ["_v"], {"_upto": F.col("_c")})
    placed = run.join(run.groupBy("_g").agg(F.max("_upto").alias("_all")), "_g")

    def quantile(p: float) -> Column:
        place = F.lit(p) * (F.col("_all") - 1)
        low, high = F.min(F.when(F.col("_upto") > F.floor(place), F.col("_v"))), F.min(F.when(F.col("_upto") > F.ceil(place), F.col("_v")))
        share = F.max(place - F.floor(place))
        out = F.when((share == 0) | (low == high), low).otherwise(low + share * (high - low))
        return out if digits is None else F.round(out, digits)

    found = placed.groupBy("_g").agg(*[quantile(p).alias(name) for name, p in at.items()])
    return summary.withColumn("_g", key).join(found, "_g", "left").drop("_g")
