"""Decoding a stream of delivered words, each record once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixmill.functions.language import Language
from helixmill.functions.names import normal_sequence
from helixmill.operators.codec import decode


def decode_stream(stream: DataFrame, language: Language, namespace: str, late: str = "60 days") -> DataFrame:
    """Rank, payload and status of each record of a stream (record_id, sequence, selector_bits, ingested_at).

    A record delivered again within the watermark counts once; its state is dropped after that.
    """
    stream = stream.withColumn("ingested_at", F.col("ingested_at").cast("timestamp"))
    once = stream.withWatermark("ingested_at", late).dropDuplicatesWithinWatermark(["record_id"])
    words = once.select("record_id", normal_sequence("sequence").alias("seq"), F.col("selector_bits").alias("bits"))
    return decode(words, language, namespace)
