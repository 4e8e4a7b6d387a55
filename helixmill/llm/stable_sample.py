"""Problem 2: a sample of sequences that stays the same in every run and keeps its members as data grows.

A record's key is the digest of its sequence, in one spelling; its stratum has a fixed rate, a threshold on the salted hash of
the key. A key is selected if its hash is under the rate of any stratum in which it occurs. So all records of a sequence are in
or out together; partitioning, order and repeated deliveries do not matter; and more records can only add strata to a key and
raise its threshold, never lower it, so nothing that is selected is ever dropped. Rates may be raised later, not lowered.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixmill.functions.names import digest_key, name_key, normal_sequence
from helixmill.sources import table

SALT = "helixmill-1"
RATES = {"gcall": 0.05, "gcfix": 0.08, "gclow": 0.15, "gchigh": 0.15, "longrun": 0.2, "stemrich": 0.25, "gcall_to_gcfix": 0.06, "gcfix_to_gcall": 0.08}
OTHER_RATE = 0.1
_SPAN = 1 << 52


def raised(old: dict[str, float], new: dict[str, float]) -> dict[str, float]:
    """The rates after a change: each stratum's larger one."""
    return {s: max(old.get(s, 0.0), new.get(s, 0.0)) for s in old | new}


def key_hash(key: Column) -> Column:
    """52 bits of the salted SHA-256 of the key."""
    return F.conv(F.substring(F.sha2(F.concat(F.lit(SALT + "|"), key), 256), 1, 13), 16, 10).cast("long")


def threshold(stratum: Column, rates: dict[str, float], other: float) -> Column:
    """The stratum's rate as a hash bound; a null stratum has the rate of those without one of their own."""
    pick = reduce(lambda c, s: c.when(stratum == s, F.lit(int(rates[s] * _SPAN))), sorted(rates), F.when(F.lit(False), F.lit(0)))
    return pick.otherwise(F.lit(int(other * _SPAN))).cast("long")


def stable_sample(records: DataFrame, rates: dict[str, float] = RATES, other: float = OTHER_RATE) -> DataFrame:
    """The selected ones of ``records`` (origin, record_id, key, stratum, batch_no), each once.

    Records without a key are never selected; null strata and batches are kept as they are. Ties of the hash go in or out
    together. The column ``entered`` is the first batch after which the record is a member.
    """
    most = int(max([other, *rates.values()]) * _SPAN)
    few = records.withColumn("hash", key_hash(F.col("key"))).where(F.col("hash") < most).distinct()
    inside = few.where(F.col("hash") < threshold(F.col("stratum"), rates, other))
    members = inside.groupBy("key").agg(F.min("batch_no").alias("since"))
    return few.join(members, "key").select("origin", "record_id", "key", "stratum", "batch_no", F.greatest("batch_no", "since").alias("entered"))


def records_of(spark: SparkSession, data_dir: str) -> DataFrame:
    """Records of both tables by digest; where it is null, by the SHA-256 of the normal sequence."""
    own = F.when(F.length(normal_sequence("sequence")) > 0, F.sha2(normal_sequence("sequence"), 256))
    emitted = table(spark, data_dir, "emitted_crc16_codewords").select(
        F.lit("emitted").alias("origin"), "record_id", F.coalesce(digest_key("sequence_sha256"), own).alias("key"), name_key("selector_source_pool").alias("stratum"), "batch_no"
    )
    public = table(spark, data_dir, "public_fiber_selected_samples").select(
        F.lit("public").alias("origin"), "record_id", digest_key("sequence_sha256").alias("key"), name_key("direction").alias("stratum"), "batch_no"
    )
    return emitted.unionByName(public).where(F.col("key").isNotNull())


def p2_sample(spark: SparkSession, data_dir: str) -> DataFrame:
    return stable_sample(records_of(spark, data_dir))


def p2_growth(spark: SparkSession, data_dir: str) -> DataFrame:
    """Members that each batch added to each stratum."""
    sample = stable_sample(records_of(spark, data_dir))
    return sample.groupBy("stratum", "entered").agg(F.count("*").alias("added"))


_CASES = " ".join(f"WHEN stratum = '{s}' THEN {int(RATES[s] * _SPAN)}" for s in sorted(RATES))
_BLANKS = "chr(32) || chr(9) || chr(13) || chr(10)"
_SAMPLE_SQL = f"""
WITH r AS (
  SELECT 'emitted' AS origin, record_id, sequence_sha256 AS d, sequence AS s, lower(trim(selector_source_pool, {_BLANKS})) AS stratum, batch_no FROM emitted_crc16_codewords
  UNION ALL SELECT 'public', record_id, sequence_sha256, NULL, lower(trim(direction, {_BLANKS})), batch_no FROM public_fiber_selected_samples),
k AS (
  SELECT origin, record_id, nullif(stratum, '') AS stratum, batch_no,
    coalesce(nullif(trim(regexp_replace(lower(trim(d, {_BLANKS})), '^(sha256:|0x)', ''), {_BLANKS}), ''),
      CASE WHEN length(regexp_replace(s, '[^A-Za-z]', '', 'g')) > 0 THEN sha256(replace(upper(regexp_replace(s, '[^A-Za-z]', '', 'g')), 'U', 'T')) END) AS key FROM r),
h AS (
  SELECT DISTINCT *, CAST(('0x' || substr(sha256('{SALT}|' || key), 1, 13)) AS BIGINT) AS hash FROM k WHERE key IS NOT NULL),
m AS (
  SELECT key, min(batch_no) AS since FROM h WHERE hash < CASE {_CASES} ELSE {int(OTHER_RATE * _SPAN)} END GROUP BY key),
sample AS (
  SELECT origin, record_id, key, stratum, batch_no, greatest(batch_no, since) AS entered FROM h JOIN m USING (key))
"""
P2_SAMPLE_SQL = _SAMPLE_SQL + "SELECT * FROM sample"
P2_GROWTH_SQL = _SAMPLE_SQL + "SELECT stratum, entered, count(*) AS added FROM sample GROUP BY stratum, entered"
