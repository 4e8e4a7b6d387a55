"""Sequence functions, features, the codec and edits, over the codewords and samples."""

from __future__ import annotations

import uuid
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixmill.functions import sequence as S
from helixmill.functions.language import Dispersal, Language
from helixmill.functions.names import reverse_complement
from helixmill.operators import codec, edits, stems
from helixmill.plans import frames as T
from helixmill.plans.registry import register
from helixmill.sources import shared_folder, spread
from helixmill.streaming import decode_stream

_DNA_SQL = f"WITH {T.EMITTED}, dna AS (SELECT * FROM emitted WHERE {T.DNA})"
_RC_SQL = "translate(reverse(seq), 'ACGT', 'TGCA')"


def _dna(spark: SparkSession, d: str) -> DataFrame:
    return T.emitted(spark, d, "seq").where(S.is_dna("seq"))


@register("eligible_filter", f"WITH {T.EMITTED} SELECT record_id, pool FROM emitted WHERE {T.ELIGIBLE}")
def eligible_filter(spark: SparkSession, d: str) -> DataFrame:
    return T.emitted(spark, d, "pool", "seq").where(S.eligible("seq")).select("record_id", "pool")


@register("normal_sequence", f"WITH {T.EMITTED} SELECT record_id, seq, digest, sha256(seq) = digest AS digest_fits FROM emitted")
def normal_sequences(spark: SparkSession, d: str) -> DataFrame:
    return T.emitted(spark, d, "seq", "digest").select("record_id", "seq", "digest", (F.sha2("seq", 256) == F.col("digest")).alias("digest_fits"))


@register("gc_fraction", f"{_DNA_SQL} SELECT record_id, {T.GC} / length(seq) AS gc, -abs({T.GC} - 54) / 108 AS toy_score FROM dna")
def gc(spark: SparkSession, d: str) -> DataFrame:
    return _dna(spark, d).select("record_id", S.gc_fraction("seq").alias("gc"), (-F.abs(S.count_of("seq", "GC") - 54) / 108).alias("toy_score"))


_RUNS = " ".join(f"WHEN regexp_matches(seq, '{'|'.join(b * k for b in 'ACGT')}') THEN {k}" for k in range(40, 0, -1))


@register("max_homopolymer", f"{_DNA_SQL} SELECT record_id, CAST(CASE {_RUNS} END AS INTEGER) AS longest_run FROM dna")
def max_homopolymer(spark: SparkSession, d: str) -> DataFrame:
    return _dna(spark, d).select("record_id", S.longest_run("seq").alias("longest_run"))


@register("revcomp", f"{_DNA_SQL} SELECT record_id, {_RC_SQL} AS rc, left(seq, 24) AS head, right(seq, 24) AS tail FROM dna")
def revcomp(spark: SparkSession, d: str) -> DataFrame:
    return _dna(spark, d).select("record_id", reverse_complement("seq").alias("rc"), S.left_boundary("seq").alias("head"), S.right_boundary("seq").alias("tail"))


def _back(adapter: str) -> str:
    return adapter[::-1].translate(str.maketrans("ACGT", "TGCA"))


def _words_sql(boundary: str, adapter: str) -> str:
    listed = ", ".join(f"'{w}'" for w in S.words(_back(adapter), S.COMPLEMENT_K))
    return f"CAST(len(list_filter(range(1, length({boundary}) - 2), lambda i: substr({boundary}, i, 4) IN ({listed}))) AS INTEGER)"


@register(
    "kmer_complement_count",
    f"{_DNA_SQL} SELECT record_id, {_words_sql('left(seq, 24)', S.LEFT_ADAPTER)} AS left_left, {_words_sql('left(seq, 24)', S.RIGHT_ADAPTER)} AS left_right, "
    f"{_words_sql('right(seq, 24)', S.LEFT_ADAPTER)} AS right_left, {_words_sql('right(seq, 24)', S.RIGHT_ADAPTER)} AS right_right FROM dna WHERE length(seq) >= 24",
)
def kmer_complement_count(spark: SparkSession, d: str) -> DataFrame:
    head, tail = S.left_boundary("seq"), S.right_boundary("seq")
    pairs = {"left_left": (head, S.LEFT_ADAPTER), "left_right": (head, S.RIGHT_ADAPTER), "right_left": (tail, S.LEFT_ADAPTER), "right_right": (tail, S.RIGHT_ADAPTER)}
    return _dna(spark, d).where("length(seq) >= 24").select("record_id", *[S.complement_words(b, a).alias(n) for n, (b, a) in pairs.items()])


def _common_sql(boundary: str, adapter: str) -> str:
    back = _back(adapter)
    cases = " ".join(f"WHEN regexp_matches({boundary}, '{'|'.join(S.words(back, k))}') THEN {k}" for k in range(len(back), 0, -1))
    return f"CASE {cases} ELSE 0 END"


@register("adapter_lcs", f"{_DNA_SQL} SELECT record_id, {_common_sql('left(seq, 24)', S.LEFT_ADAPTER)} AS left_tract, {_common_sql('right(seq, 24)', S.RIGHT_ADAPTER)} AS right_tract FROM dna")
def adapter_lcs(spark: SparkSession, d: str) -> DataFrame:
    left, right = S.longest_common_with(S.left_boundary("seq"), _back(S.LEFT_ADAPTER)), S.longest_common_with(S.right_boundary("seq"), _back(S.RIGHT_ADAPTER))
    return _dna(spark, d).select("record_id", left.alias("left_tract"), right.alias("right_tract"))


STEM_SQL = f"""WITH {T.GENERATED}, dna AS (SELECT DISTINCT seq FROM generated WHERE {T.DNA}),
words AS (SELECT seq, i, substr(seq, i, 4) AS w FROM (SELECT seq, unnest(range(1, length(seq) - 2)) AS i FROM dna)),
ends AS (SELECT seq, i + 3 AS q, translate(reverse(w), 'ACGT', 'TGCA') AS w FROM words),
seeds AS (SELECT seq, i, q, unnest(range(4, (q - i - 2) // 2 + 1)) AS stem FROM words JOIN ends USING (seq, w) WHERE q >= i + 10),
stems AS (SELECT * FROM seeds WHERE substr(seq, i, stem) = translate(reverse(substr(seq, q - stem + 1, stem)), 'ACGT', 'TGCA'))
SELECT seq, CAST(count(stem) AS INTEGER) AS pairs, CAST(coalesce(sum(stem), 0) AS INTEGER) AS weighted, CAST(coalesce(max(stem), 0) AS INTEGER) AS longest,
  CAST(coalesce(min(q - i - 2 * stem + 1), -1) AS INTEGER) AS least_loop FROM dna LEFT JOIN stems USING (seq) GROUP BY seq"""


@register("stem_burden", STEM_SQL)
def stem_burden(spark: SparkSession, d: str) -> DataFrame:
    return stems.stem_burden(spread(T.generated(spark, d, "seq").where(S.is_dna("seq")).select("seq").distinct()), "seq")


@register("stem_burden_join", STEM_SQL)
def stem_burden_join(spark: SparkSession, d: str) -> DataFrame:
    return stems.stem_burden_join(T.generated(spark, d, "seq").where(S.is_dna("seq")).select("seq").distinct(), "seq")


@register("feature_row")
def feature_row(spark: SparkSession, d: str) -> DataFrame:
    """The twenty features of every sample, computed once a distinct sequence."""
    rows = T.generated(spark, d, "seq").where(S.is_dna("seq") & (F.length("seq") >= S.BOUNDARY))
    return rows.select("record_id", "seq").join(stems.features(rows.select("seq").distinct()), "seq").drop("seq")


_POSITION_SQL = f"""WITH {T.EMITTED}, ok AS (SELECT pool, seq FROM emitted WHERE pool IS NOT NULL AND {T.ELIGIBLE}),
spots AS (SELECT pool, unnest(range(1, 109)) AS position, seq FROM ok)"""


@register(
    "positional_freq",
    f"{_POSITION_SQL} SELECT pool, CAST(position AS INTEGER) AS position, {', '.join(f'''round(avg(CASE WHEN substr(seq, position, 1) = '{b}' THEN 1.0 ELSE 0.0 END), 6) AS {b.lower()}''' for b in 'ACGT')} FROM spots GROUP BY ALL",
)
def positional_freq(spark: SparkSession, d: str) -> DataFrame:
    at = T.eligible_emitted(spark, d).select("pool", F.posexplode(F.split("seq", "(?!^)(?!$)")).alias("position", "base"))
    share = [F.round(F.avg((F.col("base") == b).cast("double")), 6).alias(b.lower()) for b in "ACGT"]
    return at.groupBy("pool", (F.col("position") + 1).alias("position")).agg(*share)


_WINDOWS = {"first": (1, 1), "head": (1, 24), "tail": (85, 24), "full": (1, 108)}


@register(
    "window_freq",
    f"WITH {T.EMITTED}, ok AS (SELECT pool, seq FROM emitted WHERE pool IS NOT NULL AND {T.ELIGIBLE}) "
    + " UNION ALL ".join(
        f"SELECT pool, '{n}' AS span, {', '.join(f'''round(sum(length(substr(seq, {a}, {k})) - length(replace(substr(seq, {a}, {k}), '{b}', ''))) / ({k} * count(*)), 6) AS {b.lower()}''' for b in 'ACGT')} FROM ok GROUP BY pool"
        for n, (a, k) in _WINDOWS.items()
    ),
)
def window_freq(spark: SparkSession, d: str) -> DataFrame:
    spans = F.array(*[F.struct(F.lit(n).alias("span"), F.substring("seq", a, k).alias("part")) for n, (a, k) in _WINDOWS.items()])
    parts = T.eligible_emitted(spark, d).select("pool", F.inline(spans))
    share = [F.round(F.sum(S.count_of("part", b)) / F.sum(F.length("part")), 6).alias(b.lower()) for b in "ACGT"]
    return parts.groupBy("pool", "span").agg(*share)


_BITS = "list_transform(range(0, 4 * length(h)), lambda i: (CAST('0x' || substr(h, CAST(i // 4 + 1 AS INTEGER), 1) AS INTEGER) >> CAST(3 - i % 4 AS INTEGER)) & 1)"


@register(
    "crc16_payload",
    f"""WITH {T.EMITTED}, m AS (SELECT record_id, payload_hex, lower(substr(message_hex, 3)) AS raw FROM emitted WHERE message_hex IS NOT NULL),
p AS (SELECT *, CASE WHEN length(raw) % 2 = 1 THEN '0' || raw ELSE raw END AS h FROM m),
c AS (SELECT *, list_reduce(list_prepend(65535, list_transform({_BITS}, lambda b: CAST(b AS BIGINT))), lambda crc, b: xor((crc << 1) & 65535, CASE WHEN ((crc >> 15) & 1) <> b THEN 4129 ELSE 0 END)) AS crc FROM p)
SELECT record_id, CAST(crc AS INTEGER) AS crc, '0x' || raw || lower(lpad(hex(crc), 4, '0')) = lower(payload_hex) AS fits FROM c""",
)
def crc16_payload(spark: SparkSession, d: str) -> DataFrame:
    """CRC of each message, and whether message and CRC make the payload."""
    raw = T.emitted(spark, d, "message_hex", "payload_hex").where("message_hex is not null").select("record_id", "payload_hex", F.lower(F.expr("substr(message_hex, 3)")).alias("raw"))
    with_crc = raw.withColumn("crc", S.crc16("raw"))
    made = F.concat(F.lit("0x"), F.col("raw"), F.lpad(F.lower(F.hex("crc")), 4, "0"))
    return with_crc.select("record_id", "crc", (made == F.lower("payload_hex")).alias("fits"))


@register("codec_rank")
def codec_rank(spark: SparkSession, d: str) -> DataFrame:
    """Rank of every codeword in the language as a decimal string, its payload, or why it has none."""
    return codec.decode(spread(T.emitted(spark, d, "seq", "bits").select("record_id", "seq", "bits")), Language(), "helixmill-language")


@register("codec_roundtrip", f"WITH {T.EMITTED} SELECT pool, count(*) AS words, count(*) AS same FROM emitted WHERE pool IS NOT NULL AND {T.ELIGIBLE} GROUP BY pool")
def codec_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Eligible codewords that come back from their rank; all of them, if the codec is right."""
    ok = T.eligible_emitted(spark, d).select("record_id", "pool", "seq")
    back = codec.roundtrip(spread(ok), Language())
    return back.groupBy("pool").agg(F.count("*").alias("words"), F.count_if(F.col("seq") == F.col("again")).alias("same"))


@register("codec_encode")
def codec_encode(spark: SparkSession, d: str) -> DataFrame:
    """The best-scored member of each sample's fiber: payload, 2 ** bits candidates, and the choice that scores highest.

    Payloads beyond the domain have the status ``beyond`` and no word. The score is the closeness of the GC count to half; ``codec_encode_context`` takes
    the full context.
    """
    rows = T.generated(spark, d, "payload_rank", "bits").where("payload_rank is not null and bits is not null").select("record_id", "payload_rank", "bits")
    members = codec.candidates(spread(rows), Language(), "helixmill-language")
    key = F.when(F.col("seq").isNotNull(), S.score_key(-F.abs(S.count_of("seq", "GC") - 54) / 108))
    best = F.max_by(F.struct("choice", "seq", key.alias("key")), F.struct(key, -F.col("choice")))
    out = members.groupBy("record_id", "bits").agg(F.when(F.count("seq") > 0, best).alias("b"), F.count("*").alias("candidates"))
    return out.select("record_id", "bits", "candidates", F.when(F.col("b").isNull(), "beyond").otherwise("encoded").alias("status"), "b.choice", "b.seq", "b.key")


@register("codec_encode_decode")
def codec_encode_decode(spark: SparkSession, d: str) -> DataFrame:
    """Emitted words decoded again: per selector width, the payloads and choices that come back."""
    sent = codec_encode(spark, d).where("status = 'encoded'").withColumnRenamed("choice", "sent")
    rows = T.generated(spark, d, "payload_rank").select("record_id", F.col("payload_rank").alias("payload_sent"))
    back = codec.decode(sent.select("record_id", "seq", "bits", "sent"), Language(), "helixmill-language").join(rows, "record_id")
    same = (F.col("payload") == F.col("payload_sent")) & (F.col("choice") == F.col("sent"))
    return back.groupBy("bits").agg(F.count("*").alias("words"), F.count_if(same).alias("same"))


@register(
    "single_edit_enumeration",
    f"""WITH {T.EMITTED}, ok AS (SELECT DISTINCT pool, seq FROM emitted WHERE pool IS NOT NULL AND {T.ELIGIBLE}),
e AS (SELECT pool, 'substitution' AS kind, substr(seq, 1, i - 1) || b || substr(seq, i + 1) AS seq FROM (SELECT *, CAST(unnest(range(1, 109)) AS INTEGER) AS i FROM ok), (SELECT unnest(['A', 'C', 'G', 'T']) AS b) WHERE substr(seq, i, 1) <> b
 UNION ALL SELECT pool, 'insertion', substr(seq, 1, i) || b || substr(seq, i + 1) FROM (SELECT *, CAST(unnest(range(0, 109)) AS INTEGER) AS i FROM ok), (SELECT unnest(['A', 'C', 'G', 'T']) AS b)
 UNION ALL SELECT pool, 'deletion', substr(seq, 1, i - 1) || substr(seq, i + 1) FROM (SELECT *, CAST(unnest(range(1, 109)) AS INTEGER) AS i FROM ok))
SELECT pool, kind, count(*) AS edits, count(*) FILTER (length(seq) <> 108) AS wrong_length, count(*) FILTER (length(seq) = 108 AND NOT ({T.ELIGIBLE})) AS no_word, count(*) FILTER ({T.ELIGIBLE}) AS accepted FROM e GROUP BY pool, kind""",
)
def single_edit_enumeration(spark: SparkSession, d: str) -> DataFrame:
    """What every single edit of every distinct codeword comes to, each operation counted."""
    words = T.eligible_emitted(spark, d).select("pool", "seq").distinct()
    return edits.outcomes(edits.single_edits(words, "seq"), ["pool", "kind"], "edited")


def edit_outcomes(words: DataFrame, language: Language, namespace: str) -> DataFrame:
    """(pool, bits, kind, outcome, edits) of ``words`` (pool, bits, seq), all of the language."""
    told = edits.decoded_substitutions(spread(words), language, namespace)
    counts = told.groupBy("pool", "bits").agg(F.count("*").alias("words"), *[F.sum(c).alias(c) for c in ("no_word", "beyond", "same", "wrong")])
    outcomes = [("substitution", "rejected_constraint_or_alphabet", F.col("no_word")), ("substitution", "rejected_outside_power_of_two_domain", F.col("beyond"))]
    outcomes += [("substitution", "accepted_same_payload", F.col("same")), ("substitution", "accepted_wrong_payload", F.col("wrong"))]
    # an insertion or deletion changes the length, whatever it puts in or takes out
    outcomes += [("insertion", "rejected_length", F.col("words") * (4 * (language.length + 1))), ("deletion", "rejected_length", F.col("words") * language.length)]
    each = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(o).alias("outcome"), n.alias("edits")) for k, o, n in outcomes])
    return counts.select("pool", "bits", F.inline(each)).where("edits > 0")


@register("edit_decode_status")
def edit_decode_status(spark: SparkSession, d: str) -> DataFrame:
    """What the decoder says of every single edit of every codeword in the payload domain.

    Outcomes: ``rejected_length``, ``rejected_constraint_or_alphabet``, ``rejected_outside_power_of_two_domain``, ``accepted_same_payload`` and
    ``accepted_wrong_payload``, counted per pool, selector width and kind of edit.
    """
    words = T.eligible_emitted(spark, d, "bits").where("bits is not null").select("pool", "bits", "seq").distinct()
    return edit_outcomes(words, Language(), "helixmill-language")


@register(
    "linear_score",
    f"WITH {T.GENERATED} SELECT record_id, round(0.9e0 + 0.002e0 * gc_count + -0.004e0 * max_homopolymer + -0.0001e0 * pairs + 0.00002e0 * weighted, 9) AS linear FROM generated WHERE gc_count IS NOT NULL AND max_homopolymer IS NOT NULL AND pairs IS NOT NULL AND weighted IS NOT NULL",
)
def linear_score(spark: SparkSession, d: str) -> DataFrame:
    """A coefficient table as one expression, in table order."""
    weights = {"gc_count": 0.002, "max_homopolymer": -0.004, "pairs": -0.0001, "weighted": 0.00002}
    rows = T.generated(spark, d, *weights).na.drop(subset=list(weights))
    return rows.select("record_id", F.round(reduce(lambda a, n: a + F.lit(weights[n]) * F.col(n), weights, F.lit(0.9)), 9).alias("linear"))


@register("affine_permutation")
def affine_permutation(spark: SparkSession, d: str) -> DataFrame:
    """Payloads that are themselves after being spread over the language and gathered again, distinct ranks, and payloads beyond the domain, which have none."""
    lang = Language()
    way = Dispersal(lang.size, "helixmill-language")

    def run(batches):
        for batch in batches:
            payloads = [int(p) for p in batch.column(0).to_pylist()]
            out = [str(way.spread(p)) if 0 <= p < 1 << way.bits else None for p in payloads]
            back = [x is not None and way.gather(int(x)) == p for x, p in zip(out, payloads)]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(out, pa.string()), pa.array(back, pa.bool_())], ["bits", "physical", "back"])

    rows = T.generated(spark, d, "payload_rank", "bits").where("payload_rank is not null").select("payload_rank", "bits").distinct()
    spread = rows.mapInArrow(run, "bits int, physical string, back boolean")
    return spread.groupBy("bits").agg(F.count("*").alias("payloads"), F.count_if("back").alias("back"), F.countDistinct("physical").alias("ranks"), F.count_if(F.col("physical").isNull()).alias("beyond"))


@register("stream_decode")
def stream_decode(spark: SparkSession, d: str) -> DataFrame:
    """The codewords read as a stream, each record decoded once, up to what is there now."""
    schema = T.table(spark, d, "emitted_crc16_codewords").schema
    stream = spark.readStream.schema(schema).parquet(f"{d}/emitted_crc16_codewords*")
    folder = f"{shared_folder(spark)}/helixmill-stream-{uuid.uuid4().hex}"
    decoded = decode_stream(stream, Language(), "helixmill-language")
    decoded.writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start(f"{folder}/rows").awaitTermination()
    return spark.read.schema(decoded.schema).parquet(f"{folder}/rows")
