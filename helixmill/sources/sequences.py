"""Readers of sequence files: FASTA, id and sequence lists, alignment statistics, all-string tables, and feature caches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixmill.operators.expect import ExpectationError


def read_fasta(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """(id, seq) of a FASTA file: the id is the first word after ``>``, lines are joined and in upper case.

    Records are split by Spark at ``>``, so a file is read in parallel. With ``strict``, letters other than A, C, G and T are an
    error when the row is read; without it they stay.
    """
    blocks = spark.read.text(path, lineSep=">").where(F.length(F.trim("value")) > 0)
    head = F.regexp_extract("value", r"^[^\r\n]*", 0)
    seq = F.upper(F.regexp_replace(F.expr("substr(value, length(regexp_extract(value, '^[^\\\\r\\\\n]*', 0)) + 1)"), r"\s", ""))
    rows = blocks.select(F.regexp_extract(head, r"^\s*(\S+)", 1).alias("id"), seq.alias("seq"))
    if not strict:
        return rows
    good = (F.col("id") != "") & (F.translate("seq", "ACGT", "") == "")
    return rows.select("id", F.when(good, F.col("seq")).otherwise(F.raise_error(F.concat(F.lit("no id or a letter other than ACGT in record "), F.col("id")))).alias("seq"))


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """(id, seq) of lines ``id seq`` split at commas or blanks; a bare sequence is named ``seq`` and its place, from 0."""
    lines = spark.read.text(path).select(F.col("_metadata.file_block_start").alias("_block"), F.trim("value").alias("value"))
    lines = lines.where("value <> '' and not startswith(value, '#')").withColumn("_order", F.monotonically_increasing_id())
    parts = F.split(F.regexp_replace("value", ",", "\t"), r"\s+")
    named = lines.select("_block", "_order", F.when(F.size(parts) > 1, parts[0]).alias("id"), F.upper(F.when(F.size(parts) > 1, parts[1]).otherwise(parts[0])).alias("seq"))
    bare = named.where("id is null")
    if bare.isEmpty():
        return named.select("id", "seq")
    from helixmill.operators.positions import positions

    placed = positions(named.withColumn("_all", F.lit(0)), ["_all"], ["_block", "_order"], "_place")
    return placed.select(F.coalesce("id", F.concat(F.lit("seq"), F.col("_place").cast("string"))).alias("id"), "seq")


def read_strings(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    """A table with a header, every column a string; a leading ``#`` of the first name is dropped."""
    df = spark.read.csv(path, sep=sep, header=True, inferSchema=False)
    return df.toDF(*[c.lstrip("#").strip() for c in df.columns])


def padded_id(col: str, width: int = 6) -> Column:
    """Ids without a trailing ``.0``, zero-padded to ``width``; longer ones stay whole."""
    text = F.regexp_replace(F.col(col).cast("string"), r"\.0$", "")
    return F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, "0"))


def cached_features(rows: DataFrame, cache: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows with cached features, rows without); a cache with two rows for a key is an error."""
    twice = cache.groupBy(key).count().where("count > 1").limit(1).collect()
    if twice:
        raise ExpectationError(f"the cache holds {twice[0][key]} twice")
    return rows.join(cache, key), rows.join(cache.select(key), key, "left_anti")
