"""Running totals, positions and ranks within groups, without a task that holds a whole group.

A window over a group sorts it in one task; with a third of all rows in one group that is the bottleneck. Here the rows are
range-partitioned by group and order, summed within each partition's part of a group, and shifted by the totals of the parts
before. Only those part totals, one per partition and group, go through a window over the group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixmill.sources import materialise


def running_totals(df: DataFrame, group: list[str], order: list[str], weights: dict[str, Column]) -> DataFrame:
    """``df`` with a column per entry of ``weights``: the weight's sum from the group's first row to this one, this one included.

    Ascending by ``order``, which should be total within a group; group columns must not be null. Rows are kept, ties included.
    """
    names = list(weights)
    w = Window.partitionBy("_part", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    placed = df.withColumns({f"_w_{n}": x for n, x in weights.items()}).repartitionByRange(*group, *order).withColumn("_part", F.spark_partition_id())
    parts = materialise(placed.withColumns({n: F.sum(f"_w_{n}").over(w) for n in names}), "running")
    totals = parts.groupBy("_part", *group).agg(*[F.sum(f"_w_{n}").alias(f"_t_{n}") for n in names])
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = totals.select("_part", *group, *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_s_{n}") for n in names])
    return parts.join(shifts, ["_part", *group]).select(*df.columns, *[(F.col(n) + F.col(f"_s_{n}")).alias(n) for n in names])


def positions(df: DataFrame, group: list[str], order: list[str], name: str = "base_rank") -> DataFrame:
    """``df`` with each row's place, from 0, in its group."""
    out = running_totals(df, group, order, {name: F.lit(1).cast("long")})
    return out.withColumn(name, F.col(name) - 1)


def average_ranks(df: DataFrame, group: list[str], value: str, name: str) -> DataFrame:
    """``df`` with the rank of ``value`` in its group, from 1; ties share the mean of their ranks. Values must not be null."""
    ties = df.groupBy(*group, value).agg(F.count("*").alias("_n"))
    ranked = running_totals(ties, group, [value], {"_upto": F.col("_n")})
    return df.join(ranked.select(*group, value, (F.col("_upto") - (F.col("_n") - 1) / 2).alias(name)), [*group, value])
