"""The given tables with clean keys, each delivered row once, and the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixmill.functions.names import digest_key, name_key, normal_sequence
from helixmill.functions.sequence import eligible
from helixmill.sources import table as table

_BLANKS = "chr(32) || chr(9) || chr(13) || chr(10)"
_NAME = "nullif(lower(trim({}, " + _BLANKS + ")), '')"
_DIGEST = "nullif(trim(regexp_replace(lower(trim({}, " + _BLANKS + ")), '^(sha256:|0x)', ''), " + _BLANKS + "), '')"
_SEQ = "replace(upper(regexp_replace({}, '[^A-Za-z]', '', 'g')), 'U', 'T')"


def digest_sql(column: str) -> str:
    return _DIGEST.format(column)


def _once(rows: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Each record once, with the columns asked for; only those are read and shuffled, since a delivery repeats its row in full."""
    return (rows.select("record_id", *[c for c in columns if c != "record_id"]) if columns else rows).distinct()


def emitted(spark: SparkSession, data_dir: str, *columns: str) -> DataFrame:
    t = table(spark, data_dir, "emitted_crc16_codewords")
    rows = t.select(
        "record_id", name_key("selector_source_pool").alias("pool"), "library_id", F.col("selector_model").alias("model"), F.col("selector_bits").alias("bits"),
        F.col("message_sample_index").alias("sample"), "message_hex", "payload_hex", F.col("selected_choice_index").alias("choice"),
        normal_sequence("sequence").alias("seq"), digest_key("sequence_sha256").alias("digest"), F.col("fullcontext_score").alias("score"), "batch_no",
    )
    return _once(rows, columns)


def generated(spark: SparkSession, data_dir: str, *columns: str) -> DataFrame:
    t = table(spark, data_dir, "generated_selected_samples")
    rows = t.select(
        "record_id", name_key("selector_source_pool").alias("pool"), F.col("selector_model").alias("model"), F.col("selector_bits").alias("bits"), "payload_rank",
        F.col("choice_index").alias("choice"), "physical_rank", normal_sequence("sequence").alias("seq"), digest_key("sequence_sha256").alias("digest"), "gc_count", "max_homopolymer",
        F.col("variable_candidate_pairs").alias("pairs"), F.col("variable_weighted_pairs").alias("weighted"), F.col("source_model_score").alias("score"),
        F.col("cross_model_score").alias("cross"), "rerank", "decoded_payload",
    )
    return _once(rows, columns)


def public(spark: SparkSession, data_dir: str, *columns: str) -> DataFrame:
    t = table(spark, data_dir, "public_fiber_selected_samples")
    rows = t.select(
        "record_id", name_key("direction").alias("direction"), F.col("selector_model").alias("model"), F.col("selector_bits").alias("bits"), F.col("payload_rank").alias("payload"),
        F.col("choice_index").alias("choice"), "base_rank", digest_key("sequence_sha256").alias("digest"), F.col("observed_relative_efficiency").alias("outcome"),
        F.col("observed_low_efficiency_label").alias("event"), F.col("source_only_prediction").alias("prediction"), "rerank", "decoded_payload", "batch_no",
    )
    return _once(rows, columns)


EMITTED = f"""emitted AS (SELECT DISTINCT record_id, {_NAME.format("selector_source_pool")} AS pool, library_id, selector_model AS model, selector_bits AS bits,
  message_sample_index AS sample, message_hex, payload_hex, selected_choice_index AS choice, {_SEQ.format("sequence")} AS seq, {_DIGEST.format("sequence_sha256")} AS digest,
  fullcontext_score AS score, batch_no FROM emitted_crc16_codewords)"""
GENERATED = f"""generated AS (SELECT DISTINCT record_id, {_NAME.format("selector_source_pool")} AS pool, selector_model AS model, selector_bits AS bits, payload_rank,
  choice_index AS choice, physical_rank, {_SEQ.format("sequence")} AS seq, {_DIGEST.format("sequence_sha256")} AS digest, gc_count, max_homopolymer,
  variable_candidate_pairs AS pairs, variable_weighted_pairs AS weighted, source_model_score AS score, cross_model_score AS cross_, rerank, decoded_payload FROM generated_selected_samples)"""
PUBLIC = f"""public_ AS (SELECT DISTINCT record_id, {_NAME.format("direction")} AS direction, selector_model AS model, selector_bits AS bits, payload_rank AS payload,
  choice_index AS choice, base_rank, {_DIGEST.format("sequence_sha256")} AS digest, observed_relative_efficiency AS outcome, observed_low_efficiency_label AS event,
  source_only_prediction AS prediction, rerank, decoded_payload, batch_no FROM public_fiber_selected_samples)"""

DNA = "regexp_matches(seq, '^[ACGT]+$')"
GC = "(length(seq) - length(translate(seq, 'GC', '')))"
ELIGIBLE = f"regexp_matches(seq, '^[ACGT]{{108}}$') AND {GC} BETWEEN 49 AND 59 AND NOT regexp_matches(seq, 'AAAA|CCCC|GGGG|TTTT')"


def eligible_emitted(spark: SparkSession, data_dir: str, *columns: str) -> DataFrame:
    return emitted(spark, data_dir, "pool", "seq", *columns).where(eligible("seq") & F.col("pool").isNotNull())


#: Candidates with a finite score and outcome, for the fibers of a direction.
MEASURED = f"""{PUBLIC}, measured AS (SELECT * FROM public_ WHERE direction IS NOT NULL AND digest IS NOT NULL AND isfinite(outcome) AND isfinite(prediction))"""
FIBERS = MEASURED + """, book AS (SELECT *, row_number() OVER (PARTITION BY direction ORDER BY sha256('library|' || digest), digest, record_id) - 1 AS place FROM measured),
cut AS (SELECT *, place // 4 AS fiber, CAST(place % 4 AS INTEGER) AS slot, count(*) OVER (PARTITION BY direction, place // 4) AS n FROM book),
whole AS (SELECT * FROM cut WHERE n = 4),
keyed AS (SELECT *, CAST(round_even(prediction * 1e12, 0) AS BIGINT) AS key FROM whole),
best AS (SELECT *, row_number() OVER (PARTITION BY direction, fiber ORDER BY key DESC, slot) AS first_, row_number() OVER (PARTITION BY direction, fiber ORDER BY key, slot) AS last_,
  avg(outcome) OVER (PARTITION BY direction, fiber) AS fiber_mean, var_pop(outcome) OVER (PARTITION BY direction, fiber) AS outcome_variance FROM keyed)"""
