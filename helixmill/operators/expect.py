"""Integrity checks of a table in one aggregate, before it is used."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class ExpectationError(ValueError):
    """A table does not have the shape that a step relies on."""


def expect(df: DataFrame, keys: list[str] = (), not_null: list[str] = (), rows: int | None = None, at_least: int | None = None) -> DataFrame:
    """``df`` itself if its keys are unique and its columns filled as stated; an error that names the first failure if not.

    One job with a single aggregate row; unique keys are counted after a hash aggregate by key, never collected.
    """
    grouped = df.groupBy(*keys).agg(F.count("*").alias("_n"), *[F.count_if(F.col(c).isNull()).alias(f"_null_{c}") for c in not_null])
    row = grouped.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"), F.coalesce(F.max("_n"), F.lit(0)).alias("most"), *[F.coalesce(F.sum(f"_null_{c}"), F.lit(0)).alias(c) for c in not_null]).first()
    if keys and row["most"] > 1:
        raise ExpectationError(f"{row['most']} rows share one key of {list(keys)}")
    for c in not_null:
        if row[c]:
            raise ExpectationError(f"{row[c]} nulls in {c}")
    if rows is not None and row["rows"] != rows:
        raise ExpectationError(f"{row['rows']} rows, not {rows}")
    if at_least is not None and row["rows"] < at_least:
        raise ExpectationError(f"{row['rows']} rows, under {at_least}")
    return df
