"""Writers of result tables with reproducible text, and manifests of files with their hashes."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _general(numbers: pd.Series, digits: int) -> pd.Series:
    return numbers.map(lambda x: f"%.{digits}g" % x, na_action="ignore").where(numbers.notna(), None)


def general(col: Column, digits: int) -> Column:
    """A number as ``%.<digits>g`` writes it, without trailing zeros; null and NaN are null."""

    def text(numbers: pd.Series) -> pd.Series:
        return _general(numbers, digits)

    return F.pandas_udf(text, T.StringType())(col.cast("double"))


def write_text_table(df: DataFrame, path: str, digits: int = 12, sep: str = "\t") -> None:
    """Write ``df`` as text with a header; doubles with ``digits`` significant digits. An empty table is refused."""
    if df.isEmpty():
        raise ValueError("refusing to write an empty table")
    doubles = {f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    df.select(*[general(F.col(c), digits).alias(c) if c in doubles else F.col(c) for c in df.columns]).write.csv(path, sep=sep, header=True, mode="error")


def write_json(rows: dict, path: str, spark: SparkSession) -> None:
    """A small driver-side record as one line of JSON with sorted keys."""
    spark.createDataFrame([(json.dumps(rows, sort_keys=True),)], "value string").coalesce(1).write.text(path)


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """(path, bytes, sha256) of every file under ``folder``, hashed by Spark; hidden and empty files and the manifest itself stay out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    name = F.regexp_replace("path", "^file:/*", "/")
    return files.select(name.alias("path"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"), git_blob(F.col("content"), F.col("length")).alias("git_blob")).where(
        ~name.rlike(r"(^|/)(MANIFEST|_SUCCESS|\.)[^/]*$")
    )


def git_blob(content: Column, length: Column) -> Column:
    """SHA-1 of the content under its length header, as version control names it."""
    head = F.concat(F.encode(F.concat(F.lit("blob "), length.cast("string")), "UTF-8"), F.unhex(F.lit("00")))
    return F.sha1(F.concat(head, content))


def verify_manifest(spark: SparkSession, expected: DataFrame, folder: str) -> DataFrame:
    """(path, problem) of files that are missing, unexpected, or of another size or hash than ``expected``; empty if all is well."""
    there = manifest(spark, folder).select("path", F.col("bytes").alias("b"), F.col("sha256").alias("s"))
    both = expected.select("path", "bytes", "sha256").join(there, "path", "full")
    problem = (
        F.when(F.col("b").isNull(), "missing").when(F.col("bytes").isNull(), "unexpected").when(F.col("b") != F.col("bytes"), "size").when(F.col("s") != F.col("sha256"), "hash")
    )
    return both.select("path", problem.alias("problem")).where("problem is not null")
