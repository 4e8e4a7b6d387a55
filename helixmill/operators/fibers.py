"""Fiber selection: blocks of consecutive candidates of a locked codebook, one choice each, and what the choices gain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixmill.functions.sequence import score_key
from helixmill.operators.positions import positions


def codebook(df: DataFrame, group: list[str], digest: str, namespace: str, tie: str) -> DataFrame:
    """Candidates in the order of the namespaced hash of their digest, outcome-blind: adds ``lock`` and ``base_rank`` from 0."""
    locked = df.withColumn("lock", F.sha2(F.concat(F.lit(namespace + "|"), F.col(digest)), 256))
    return positions(locked, group, ["lock", digest, tie])


def fibers(df: DataFrame, width: int) -> DataFrame:
    """Adds ``fiber`` and ``choice``; the last fiber of a group, if it is short of ``width``, is dropped by ``whole_fibers``."""
    return df.withColumn("fiber", F.floor(F.col("base_rank") / width).cast("long")).withColumn("choice", (F.col("base_rank") % width).cast("int"))


def whole_fibers(df: DataFrame, group: list[str], width: int) -> DataFrame:
    w = Window.partitionBy(*group, "fiber")
    return df.withColumn("_n", F.count("*").over(w)).where(F.col("_n") == width).drop("_n")


def ranked_choices(df: DataFrame, group: list[str], score: str, lowest: bool = False) -> DataFrame:
    """Adds the score's whole-number ``key`` and ``place`` in the fiber: best first, the smaller choice index on ties."""
    keyed = df.withColumn("key", score_key(score))
    order = F.col("key").asc() if lowest else F.col("key").desc()
    return keyed.withColumn("place", F.row_number().over(Window.partitionBy(*group, "fiber").orderBy(order, F.col("choice").asc())))


def chosen(df: DataFrame, group: list[str], score: str, lowest: bool = False) -> DataFrame:
    return ranked_choices(df, group, score, lowest).where("place = 1").drop("place")


def first_passing(df: DataFrame, group: list[str], passes: Column) -> DataFrame:
    """One row per fiber with the first choice that passes, null where none does."""
    return df.groupBy(*group, "fiber").agg(F.min(F.when(passes, F.col("choice"))).alias("choice"), F.count("*").alias("width"))


def gains(df: DataFrame, group: list[str], score: str, outcome: str) -> DataFrame:
    """The chosen candidate of each fiber with its outcome less the fiber's mean, and the fiber's variances."""
    w = Window.partitionBy(*group, "fiber")
    wide = df.withColumns({"fiber_mean": F.avg(outcome).over(w), "outcome_variance": F.var_pop(outcome).over(w), "score_variance": F.var_pop(score).over(w)})
    return chosen(wide, group, score).withColumn("gain", F.col(outcome) - F.col("fiber_mean"))


def margins(df: DataFrame, group: list[str], score: str) -> DataFrame:
    """Per fiber, the best score less the runner-up's; infinite for a fiber of one."""
    top = ranked_choices(df, group, score).where("place <= 2")
    best, next_ = F.max(F.when(F.col("place") == 1, F.col(score))), F.max(F.when(F.col("place") == 2, F.col(score)))
    return top.groupBy(*group, "fiber").agg(F.coalesce(best - next_, F.lit(float("inf"))).alias("margin"), F.max(F.when(F.col("place") == 1, F.col("key"))).alias("key"))
