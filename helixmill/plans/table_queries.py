"""Joins with declared cardinality, set operations, grouped aggregates and reshaping over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from helixmill.functions import sequence as S
from helixmill.functions.names import digest_key, name_key, reverse_complement
from helixmill.operators import fibers as B
from helixmill.operators.expect import expect
from helixmill.operators.quantiles import with_quantiles
from helixmill.plans import frames as T
from helixmill.plans.fiber_queries import measured
from helixmill.plans.registry import register

_ONE = f"""{T.EMITTED}, {T.GENERATED}, e AS (SELECT digest, min(record_id) AS emitted_id FROM emitted WHERE digest IS NOT NULL GROUP BY digest),
g AS (SELECT digest, min(record_id) AS generated_id FROM generated WHERE digest IS NOT NULL GROUP BY digest)"""


def _first(df: DataFrame, name: str) -> DataFrame:
    return df.where("digest is not null").groupBy("digest").agg(F.min("record_id").alias(name))


@register("join_one_to_one", f"WITH {_ONE} SELECT digest, emitted_id, generated_id FROM e JOIN g USING (digest)")
def join_one_to_one(spark: SparkSession, d: str) -> DataFrame:
    left, right = _first(T.emitted(spark, d, "digest"), "emitted_id"), _first(T.generated(spark, d, "digest"), "generated_id")
    return left.join(right, "digest").select("digest", "emitted_id", "generated_id")


_RESULTS = "results AS (SELECT lower(trim(direction)) AS direction, selector_model AS model, selector_bits AS bits, any_value(paired_mean_outcome_gain) AS stated_gain FROM public_fiber_results GROUP BY 1, 2, 3)"


def _results(spark: SparkSession, d: str) -> DataFrame:
    t = T.table(spark, d, "public_fiber_results").groupBy(name_key("direction").alias("direction"), F.col("selector_model").alias("model"), F.col("selector_bits").alias("bits"))
    return expect(t.agg(F.first("paired_mean_outcome_gain").alias("stated_gain")), keys=["direction", "model", "bits"])


@register("join_many_to_one", f"WITH {T.PUBLIC}, {_RESULTS} SELECT record_id, direction, bits, stated_gain FROM public_ JOIN results USING (direction, model, bits)")
def join_many_to_one(spark: SparkSession, d: str) -> DataFrame:
    return T.public(spark, d, "direction", "model", "bits").join(_results(spark, d), ["direction", "model", "bits"]).select("record_id", "direction", "bits", "stated_gain")


@register(
    "join_left_null_audit",
    f"WITH {T.PUBLIC}, {_RESULTS} SELECT direction, count(*) AS rows_, count(*) FILTER (results.bits IS NULL) AS unmatched FROM public_ LEFT JOIN results USING (direction, model, bits) GROUP BY direction",
)
def join_left_null_audit(spark: SparkSession, d: str) -> DataFrame:
    known = _results(spark, d).withColumn("known", F.lit(True))
    both = T.public(spark, d, "direction", "model", "bits").join(known, ["direction", "model", "bits"], "left")
    return both.groupBy("direction").agg(F.count("*").alias("rows_"), F.count_if(F.col("known").isNull()).alias("unmatched"))


@register("anti_join_missing", f"WITH {T.EMITTED}, {T.PUBLIC} SELECT record_id, digest FROM public_ WHERE digest IS NOT NULL AND digest NOT IN (SELECT digest FROM emitted WHERE digest IS NOT NULL)")
def anti_join_missing(spark: SparkSession, d: str) -> DataFrame:
    known = T.emitted(spark, d, "digest").select("digest").where("digest is not null")
    return T.public(spark, d, "digest").where("digest is not null").join(known, "digest", "left_anti").select("record_id", "digest")


@register("semi_join_duplicates", f"WITH {T.EMITTED}, {T.GENERATED} SELECT record_id, seq FROM generated WHERE length(seq) > 0 AND seq IN (SELECT seq FROM emitted)")
def semi_join_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return T.generated(spark, d, "seq").where("length(seq) > 0").join(T.emitted(spark, d, "seq").select("seq"), "seq", "left_semi").select("record_id", "seq")


@register(
    "revcomp_intersection",
    f"WITH {T.EMITTED}, {T.GENERATED} SELECT record_id FROM generated WHERE {T.DNA} AND translate(reverse(seq), 'ACGT', 'TGCA') IN (SELECT seq FROM emitted WHERE {T.DNA} UNION ALL SELECT seq FROM generated WHERE {T.DNA})",
)
def revcomp_intersection(spark: SparkSession, d: str) -> DataFrame:
    own = T.generated(spark, d, "seq").where(S.is_dna("seq"))
    all_ = T.emitted(spark, d, "seq").where(S.is_dna("seq")).select(F.col("seq").alias("rc")).unionByName(own.select(F.col("seq").alias("rc")))
    return own.withColumn("rc", reverse_complement("seq")).join(all_, "rc", "left_semi").select("record_id")


@register("rerank_check", f"WITH {T.GENERATED} SELECT record_id, physical_rank = rerank AS rank_fits, decoded_payload = payload_rank AS payload_fits FROM generated")
def rerank_check(spark: SparkSession, d: str) -> DataFrame:
    """Do a sample's rank and payload come back as they were sent?"""
    return T.generated(spark, d, "physical_rank", "rerank", "decoded_payload", "payload_rank").select("record_id", (F.col("physical_rank") == F.col("rerank")).alias("rank_fits"), (F.col("decoded_payload") == F.col("payload_rank")).alias("payload_fits"))


@register(
    "lookup_join",
    f"""WITH {T.EMITTED}, {T.GENERATED}, look AS (SELECT digest, min(record_id) AS codeword, count(*) AS codewords, max(bits) AS widest FROM emitted WHERE digest IS NOT NULL GROUP BY digest)
SELECT record_id, codeword, codewords, widest FROM generated LEFT JOIN look USING (digest)""",
)
def lookup_join(spark: SparkSession, d: str) -> DataFrame:
    """Every sample with what a lookup table by digest says of it: three columns, null where the table has no such digest."""
    look = T.emitted(spark, d, "digest", "bits").where("digest is not null").groupBy("digest")
    look = look.agg(F.min("record_id").alias("codeword"), F.count("*").alias("codewords"), F.max("bits").alias("widest"))
    return T.generated(spark, d, "digest").join(look, "digest", "left").select("record_id", "codeword", "codewords", "widest")


@register(
    "rank_lookup",
    f"""WITH {T.MEASURED}, book AS (SELECT direction, digest, row_number() OVER (PARTITION BY direction ORDER BY sha256('library|' || digest), digest, record_id) - 1 AS place FROM measured),
first_ AS (SELECT direction, digest, min(place) AS again FROM book GROUP BY ALL)
SELECT direction, count(*) AS places, count(*) FILTER (place = again) AS same FROM book JOIN first_ USING (direction, digest) GROUP BY direction""",
)
def rank_lookup(spark: SparkSession, d: str) -> DataFrame:
    """From each place of a direction's codebook to its sequence, and from the sequence to its first place."""
    book = B.codebook(measured(spark, d), ["direction"], "digest", "library", "record_id").select("direction", "digest", F.col("base_rank").alias("place"))
    first = book.groupBy("direction", "digest").agg(F.min("place").alias("again"))
    return book.join(first, ["direction", "digest"]).groupBy("direction").agg(F.count("*").alias("places"), F.count_if(F.col("place") == F.col("again")).alias("same"))


@register("deliveries", "SELECT record_id, min(ingested_at) = max(ingested_at) AS once, count(*) AS deliveries FROM emitted_crc16_codewords GROUP BY record_id")
def deliveries(spark: SparkSession, d: str) -> DataFrame:
    t = T.table(spark, d, "emitted_crc16_codewords")
    return t.groupBy("record_id").agg((F.min("ingested_at") == F.max("ingested_at")).alias("once"), F.count("*").alias("deliveries"))


@register(
    "dedupe_first",
    f"""WITH d AS (SELECT {T.digest_sql("sequence_sha256")} AS digest, record_id, library_id, batch_no, ingested_at FROM emitted_crc16_codewords)
SELECT digest, record_id, library_id, batch_no FROM (SELECT *, row_number() OVER (PARTITION BY digest ORDER BY ingested_at, record_id) AS p FROM d WHERE digest IS NOT NULL) WHERE p = 1""",
)
def dedupe_first(spark: SparkSession, d: str) -> DataFrame:
    """The row that first came in with each digest, the smaller record id on ties; all later ones are dropped."""
    t = T.table(spark, d, "emitted_crc16_codewords").select(digest_key("sequence_sha256").alias("digest"), "ingested_at", "record_id", "library_id", "batch_no")
    first = F.min_by(F.struct("record_id", "library_id", "batch_no"), F.struct("ingested_at", "record_id"))
    return t.where("digest is not null").groupBy("digest").agg(first.alias("f")).select("digest", "f.*")


@register("duplicate_keys", f"WITH {T.EMITTED} SELECT pool, count(*) AS rows_, count(DISTINCT digest) AS digests, count(*) - count(DISTINCT digest) AS repeats FROM emitted WHERE digest IS NOT NULL GROUP BY pool")
def duplicate_keys(spark: SparkSession, d: str) -> DataFrame:
    n = F.countDistinct("digest")
    return T.emitted(spark, d, "pool", "digest").where("digest is not null").groupBy("pool").agg(F.count("*").alias("rows_"), n.alias("digests"), (F.count("*") - n).alias("repeats"))


@register("last_per_group", f"WITH {T.EMITTED} SELECT library_id, record_id, batch_no FROM (SELECT *, row_number() OVER (PARTITION BY library_id ORDER BY batch_no DESC, record_id DESC) AS p FROM emitted) WHERE p = 1")
def last_per_group(spark: SparkSession, d: str) -> DataFrame:
    last = T.emitted(spark, d, "library_id", "batch_no").groupBy("library_id").agg(F.max(F.struct("batch_no", "record_id")).alias("last"))
    return last.select("library_id", "last.record_id", "last.batch_no")


@register(
    "membership_digest",
    f"WITH {T.PUBLIC}, k AS (SELECT DISTINCT direction, substr(sha256(digest), 1, 2) AS bucket, digest FROM public_ WHERE digest IS NOT NULL), b AS (SELECT direction, bucket, count(*) AS n, sha256(string_agg(digest, chr(10) ORDER BY digest)) AS part FROM k GROUP BY ALL) SELECT direction, CAST(sum(n) AS BIGINT) AS members, sha256(string_agg(part, chr(10) ORDER BY bucket)) AS digest FROM b GROUP BY direction",
)
def membership_digest(spark: SparkSession, d: str) -> DataFrame:
    """Digest of a direction's set of members, in two steps, so that no row holds a whole direction's members."""
    keys = T.public(spark, d, "direction", "digest").where("digest is not null").select("direction", F.substring(F.sha2("digest", 256), 1, 2).alias("bucket"), "digest").distinct()
    joined = lambda col: F.sha2(F.array_join(col, "\n"), 256)
    parts = keys.groupBy("direction", "bucket").agg(F.count("*").alias("n"), joined(F.sort_array(F.collect_list("digest"))).alias("part"))
    listed = F.transform(F.sort_array(F.collect_list(F.struct("bucket", "part"))), lambda s: s["part"])
    return parts.groupBy("direction").agg(F.sum("n").alias("members"), joined(listed).alias("digest"))


@register("union_missing_columns", f"WITH {T.EMITTED}, {T.PUBLIC} SELECT record_id, 'emitted' AS origin, pool, NULL AS direction, batch_no FROM emitted UNION ALL SELECT record_id, 'public', NULL, direction, batch_no FROM public_")
def union_missing_columns(spark: SparkSession, d: str) -> DataFrame:
    a = T.emitted(spark, d, "pool", "batch_no").select("record_id", F.lit("emitted").alias("origin"), "pool", "batch_no")
    return a.unionByName(T.public(spark, d, "direction", "batch_no").select("record_id", F.lit("public").alias("origin"), "direction", "batch_no"), allowMissingColumns=True)


@register("except_names", "SELECT DISTINCT lower(trim(pool_or_direction)) AS name FROM paper2_assay_calibrated_selection_figure_source_data WHERE pool_or_direction IS NOT NULL EXCEPT SELECT lower(trim(direction)) FROM public_fiber_results")
def except_names(spark: SparkSession, d: str) -> DataFrame:
    left = T.table(spark, d, "paper2_assay_calibrated_selection_figure_source_data").select(name_key("pool_or_direction").alias("name")).where("name is not null")
    return left.distinct().join(T.table(spark, d, "public_fiber_results").select(name_key("direction").alias("name")), "name", "left_anti")


@register("intersect_names", f"WITH {T.EMITTED}, {T.GENERATED} SELECT DISTINCT model, bits FROM emitted INTERSECT SELECT model, bits FROM generated")
def intersect_names(spark: SparkSession, d: str) -> DataFrame:
    return T.emitted(spark, d, "model", "bits").select("model", "bits").intersect(T.generated(spark, d, "model", "bits").select("model", "bits"))


_RUNS = "runs AS (SELECT DISTINCT result_id, lower(trim(selector_source_pool)) AS pool, selector_model AS model, selector_bits AS bits, own_model_mean_gain_vs_fiber AS gain, choices_changed_by_quantization AS changed, quantized_extremum_tie_fibers AS ties, minimum_raw_top_gap AS gap, cross_model_mean_gain_vs_fiber AS cross_ FROM generated_fiber_results)"


def _runs(spark: SparkSession, d: str) -> DataFrame:
    t = T.table(spark, d, "generated_fiber_results")
    return t.select(
        "result_id", name_key("selector_source_pool").alias("pool"), F.col("selector_model").alias("model"), F.col("selector_bits").alias("bits"), F.col("own_model_mean_gain_vs_fiber").alias("gain"),
        F.col("choices_changed_by_quantization").alias("changed"), F.col("quantized_extremum_tie_fibers").alias("ties"), F.col("minimum_raw_top_gap").alias("gap"), F.col("cross_model_mean_gain_vs_fiber").alias("cross_"),
    ).distinct()


@register(
    "gain_groups",
    f"WITH {_RUNS} SELECT pool, model, bits, count(*) AS n, min(gain) AS least, round(quantile_cont(gain, 0.5), 12) AS median, max(gain) AS most, round(avg(CASE WHEN gain > 0 THEN 1.0 ELSE 0.0 END), 6) AS positive, CAST(sum(changed) AS BIGINT) AS changed, CAST(sum(ties) AS BIGINT) AS ties, min(gap) AS gap FROM runs WHERE isfinite(gain) GROUP BY ALL",
)
def gain_groups(spark: SparkSession, d: str) -> DataFrame:
    """Minimum, median and maximum of gains per setting, the share above zero, and the determinism sums."""
    rows, group = _runs(spark, d).where(S.finite("gain")), ["pool", "model", "bits"]
    out = rows.groupBy(*group).agg(
        F.count("*").alias("n"), F.min("gain").alias("least"), F.max("gain").alias("most"), F.round(F.avg((F.col("gain") > 0).cast("double")), 6).alias("positive"),
        F.sum("changed").alias("changed"), F.sum("ties").alias("ties"), F.min("gap").alias("gap"),
    )
    return with_quantiles(out, rows, group, "gain", {"median": 0.5}, 12)


@register(
    "gain_scopes",
    f"WITH {_RUNS} "
    + " UNION ALL ".join(
        f"SELECT '{n}' AS scope, {p} AS pool, {b} AS bits, count(*) AS n, round(avg(gain), 12) AS gain, round(avg(cross_), 12) AS cross_gain FROM runs WHERE isfinite(gain) AND isfinite(cross_) GROUP BY ALL"
        for n, p, b in (("pool", "pool", "CAST(NULL AS INTEGER)"), ("width", "CAST(NULL AS VARCHAR)", "bits"), ("setting", "pool", "bits"))
    ),
)
def gain_scopes(spark: SparkSession, d: str) -> DataFrame:
    rows = _runs(spark, d).where(S.finite("gain") & S.finite("cross_"))
    out = None
    for scope, keys in (("pool", ["pool"]), ("width", ["bits"]), ("setting", ["pool", "bits"])):
        one = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.round(F.avg("gain"), 12).alias("gain"), F.round(F.avg("cross_"), 12).alias("cross_gain")).withColumn("scope", F.lit(scope))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


@register(
    "value_counts_json",
    f"WITH {_RUNS}, c AS (SELECT pool, bits, count(*) AS n FROM runs WHERE bits IS NOT NULL AND pool IS NOT NULL GROUP BY ALL) SELECT pool, '{{' || string_agg('\"' || bits || '\":' || n, ',' ORDER BY bits) || '}}' AS counts FROM c GROUP BY pool",
)
def value_counts_json(spark: SparkSession, d: str) -> DataFrame:
    counts = _runs(spark, d).where("bits is not null and pool is not null").groupBy("pool", "bits").agg(F.count("*").alias("n"))
    return counts.groupBy("pool").agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct("bits", "n"))))).alias("counts"))


_TYPES = ("click", "error", "purchase", "signup", "view")


@register(
    "cpm_pivot",
    "WITH t AS (SELECT event_type, count(*) AS total FROM events GROUP BY 1), c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL), p AS (SELECT user_id, event_type, n, 1e6 * n / total AS cpm FROM c JOIN t USING (event_type)) SELECT user_id, "
    + ", ".join(f"round(coalesce(max(cpm) FILTER (event_type = '{t}'), 0), 6) AS {t}, coalesce(max(n) FILTER (event_type = '{t}'), 0) = 0 AS {t}_missing" for t in _TYPES)
    + ", round(log2((coalesce(max(cpm) FILTER (event_type = 'view'), 0) + 1) / ((coalesce(max(cpm) FILTER (event_type = 'click'), 0) + coalesce(max(cpm) FILTER (event_type = 'error'), 0)) / 2 + 1)), 6) AS log2_change FROM p GROUP BY user_id",
)
def cpm_pivot(spark: SparkSession, d: str) -> DataFrame:
    """Counts per million of five samples side by side, flags of missing ones, and the log2 fold change over the mean of two."""
    ev = T.table(spark, d, "events")
    total = ev.groupBy("event_type").agg(F.count("*").alias("total"))
    per = ev.groupBy("user_id", "event_type").agg(F.count("*").alias("n")).join(total, "event_type").withColumn("cpm", 1e6 * F.col("n") / F.col("total"))
    wide = per.groupBy("user_id").pivot("event_type", list(_TYPES)).agg(F.max("cpm")).na.fill(0.0)
    change = F.log2((F.col("view") + 1) / ((F.col("click") + F.col("error")) / 2 + 1))
    return wide.select("user_id", *[F.round(t, 6).alias(t) for t in _TYPES], *[(F.col(t) == 0).alias(f"{t}_missing") for t in _TYPES], F.round(change, 6).alias("log2_change"))


_MEASURES = ("gc_count", "max_homopolymer", "pairs", "weighted")


@register(
    "smd_pooled",
    f"WITH {T.GENERATED}, long AS ({' UNION ALL '.join(f'''SELECT pool, '{m}' AS feature, CAST({m} AS DOUBLE) AS v, score >= 1.0 AS high FROM generated WHERE isfinite(score) AND {m} IS NOT NULL''' for m in _MEASURES)}), "
    "s AS (SELECT pool, feature, avg(v) FILTER (high) - avg(v) FILTER (NOT high) AS gap, sqrt((var_samp(v) FILTER (high) + var_samp(v) FILTER (NOT high)) / 2) AS sd FROM long WHERE pool IS NOT NULL GROUP BY ALL) SELECT pool, feature, round(CASE WHEN sd > 0 THEN gap / sd END, 6) AS smd FROM s",
)
def smd_pooled(spark: SparkSession, d: str) -> DataFrame:
    """Standardised difference of each feature between high and low scores, wide rows made long first."""
    rows = T.generated(spark, d, "pool", "score", *_MEASURES).where(S.finite("score") & F.col("pool").isNotNull()).select("pool", (F.col("score") >= 1.0).alias("high"), *[F.col(m).cast("double").alias(m) for m in _MEASURES])
    long = rows.unpivot(["pool", "high"], list(_MEASURES), "feature", "v").where("v is not null")
    on = lambda f, high: f(F.when(F.col("high") == high, F.col("v")))
    sd = F.sqrt((on(F.var_samp, True) + on(F.var_samp, False)) / 2)
    return long.groupBy("pool", "feature").agg(F.round(F.when(sd > 0, (on(F.avg, True) - on(F.avg, False)) / sd), 6).alias("smd"))


@register(
    "binned_median",
    f"WITH {T.GENERATED}, ok AS (SELECT pool, score, cross_ FROM generated WHERE pool IS NOT NULL AND isfinite(score) AND isfinite(cross_)), "
    f"e AS (SELECT pool, list_sort(list_distinct(quantile_cont(score, [{', '.join(str(round(i / 9, 12)) for i in range(1, 9))}]))) AS edges FROM ok GROUP BY pool), "
    "b AS (SELECT pool, len(list_filter(edges, lambda x: x < score)) AS bin, cross_ FROM ok JOIN e USING (pool)) SELECT pool, bin, count(*) AS n, round(quantile_cont(cross_, 0.5), 9) AS median FROM b GROUP BY ALL",
)
def binned_median(spark: SparkSession, d: str) -> DataFrame:
    """Median of one score over nine quantile bins of another; equal edges make one."""
    ok = T.generated(spark, d, "pool", "score", "cross").where(F.col("pool").isNotNull() & S.finite("score") & S.finite("cross"))
    at = {f"e{i}": round(i / 9, 12) for i in range(1, 9)}
    edges = with_quantiles(ok.select("pool").distinct(), ok, ["pool"], "score", at).select("pool", F.array_distinct(F.array(*at)).alias("edges"))
    bins = ok.join(edges, "pool").withColumn("bin", F.size(F.filter("edges", lambda e: e < F.col("score"))).cast("long")).select("pool", "bin", "cross")
    return with_quantiles(bins.groupBy("pool", "bin").agg(F.count("*").alias("n")), bins, ["pool", "bin"], "cross", {"median": 0.5}, 9)


@register(
    "quantile_table",
    f"WITH {T.EMITTED} SELECT pool, count(*) AS n, min(score) AS least, round(quantile_cont(score, 0.01), 9) AS q01, round(quantile_cont(score, 0.25), 9) AS q25, round(quantile_cont(score, 0.5), 9) AS q50, round(quantile_cont(score, 0.75), 9) AS q75, round(quantile_cont(score, 0.99), 9) AS q99, max(score) AS most FROM emitted WHERE pool IS NOT NULL AND isfinite(score) GROUP BY pool",
)
def quantile_table(spark: SparkSession, d: str) -> DataFrame:
    rows = T.emitted(spark, d, "pool", "score").where(F.col("pool").isNotNull() & S.finite("score"))
    out = rows.groupBy("pool").agg(F.count("*").alias("n"), F.min("score").alias("least"), F.max("score").alias("most"))
    return with_quantiles(out, rows, ["pool"], "score", {"q01": 0.01, "q25": 0.25, "q50": 0.5, "q75": 0.75, "q99": 0.99}, 9)


@register(
    "panel_long",
    "WITH r AS (SELECT DISTINCT row_id, panel, model, baseline_value, extended_value, delta_extended_minus_baseline FROM paper2_assay_calibrated_selection_figure_source_data WHERE panel IN ('d', 'e')) "
    + " UNION ALL ".join(f"SELECT row_id, panel, '{c}' AS measure, {c} AS value FROM r WHERE {c} IS NOT NULL" for c in ("baseline_value", "extended_value", "delta_extended_minus_baseline")),
)
def panel_long(spark: SparkSession, d: str) -> DataFrame:
    """One row a measure of the increment panels."""
    cols = ["baseline_value", "extended_value", "delta_extended_minus_baseline"]
    t = T.table(spark, d, "paper2_assay_calibrated_selection_figure_source_data").where(F.col("panel").isin("d", "e")).select("row_id", "panel", "model", *cols).distinct()
    return t.unpivot(["row_id", "panel"], cols, "measure", "value").where("value is not null")


@register(
    "panel_retention",
    "SELECT row_id, lower(trim(pool_or_direction)) AS source, model, round(retention_fraction, 4) AS fraction, outcome_gain_vs_pool AS gain, outcome_gain_ci_2p5 AS low, outcome_gain_ci_97p5 AS high FROM (SELECT DISTINCT row_id, panel, pool_or_direction, model, retention_fraction, outcome_gain_vs_pool, outcome_gain_ci_2p5, outcome_gain_ci_97p5 FROM paper2_assay_calibrated_selection_figure_source_data) WHERE panel = 'c' AND retention_fraction IS NOT NULL",
)
def panel_retention(spark: SparkSession, d: str) -> DataFrame:
    """Feed of the retention panel: gains with their intervals."""
    t = T.table(spark, d, "paper2_assay_calibrated_selection_figure_source_data").where("panel = 'c' and retention_fraction is not null")
    cols = [F.col("outcome_gain_vs_pool").alias("gain"), F.col("outcome_gain_ci_2p5").alias("low"), F.col("outcome_gain_ci_97p5").alias("high")]
    return t.select("row_id", name_key("pool_or_direction").alias("source"), "model", F.round("retention_fraction", 4).alias("fraction"), *cols).distinct()


@register(
    "rate_benefit",
    f"WITH {_RUNS} SELECT pool, bits, round(avg(gain) * 1000, 10) AS gain_milli, round(avg(cross_) * 1000, 10) AS cross_milli FROM runs WHERE isfinite(gain) AND isfinite(cross_) AND model = 'P5_combined_context' GROUP BY ALL",
)
def rate_benefit(spark: SparkSession, d: str) -> DataFrame:
    ok = _runs(spark, d).where(S.finite("gain") & S.finite("cross_") & (F.col("model") == "P5_combined_context"))
    return ok.groupBy("pool", "bits").agg(F.round(F.avg("gain") * 1000, 10).alias("gain_milli"), F.round(F.avg("cross_") * 1000, 10).alias("cross_milli"))


@register("score_windows", f"WITH {T.PUBLIC} SELECT record_id, direction, round(avg(prediction) OVER (PARTITION BY direction, payload), 9) AS fiber_mean, round(var_pop(prediction) OVER (PARTITION BY direction, payload), 12) AS fiber_variance FROM public_ WHERE direction IS NOT NULL AND isfinite(prediction)")
def score_windows(spark: SparkSession, d: str) -> DataFrame:
    """Mean and variance of each payload's fiber beside its rows."""
    w = Window.partitionBy("direction", "payload")
    rows = T.public(spark, d, "direction", "payload", "prediction").where(F.col("direction").isNotNull() & S.finite("prediction"))
    return rows.select("record_id", "direction", F.round(F.avg("prediction").over(w), 9).alias("fiber_mean"), F.round(F.var_pop("prediction").over(w), 12).alias("fiber_variance"))


_RULES = {
    "bits_add_up": "payload_bits_after_selection = base_fixed_payload_bits - selector_bits",
    "width_is_a_power": "candidates_per_payload = pow(2, selector_bits)",
    "own_shares_add_up": "abs(own_model_negative_gain_fraction + own_model_zero_gain_fraction + fibers_improved_in_own_model_fraction - 1) <= 5e-6",
    "cross_shares_add_up": "abs(cross_model_negative_gain_fraction + cross_model_zero_gain_fraction + fibers_improved_in_cross_model_fraction - 1) <= 5e-6",
    "interval_holds_the_mean": "own_model_mean_gain_vs_fiber >= own_gain_ci_2p5 AND own_model_mean_gain_vs_fiber <= own_gain_ci_97p5",
    "quantiles_ascend": "cross_model_gain_q25 <= cross_model_gain_median AND cross_model_gain_median <= cross_model_gain_q75",
    "round_trips": "selected_roundtrip_failures = 0",
}


@register(
    "claim_checks",
    " UNION ALL ".join(f"SELECT '{n}' AS rule, count(*) AS rows_, count(*) FILTER ({r}) AS held, count(*) FILTER (NOT ({r})) AS broken FROM (SELECT DISTINCT * EXCLUDE (ingested_at) FROM generated_fiber_results)" for n, r in _RULES.items()),
)
def claim_checks(spark: SparkSession, d: str) -> DataFrame:
    """How many results keep each rule, in one pass; nulls neither keep nor break one."""
    t = T.table(spark, d, "generated_fiber_results").drop("ingested_at").distinct()
    sums = [F.count_if(F.expr(r)).alias(f"h_{n}") for n, r in _RULES.items()] + [F.count_if(~F.expr(r)).alias(f"b_{n}") for n, r in _RULES.items()]
    rows = F.array(*[F.struct(F.lit(n).alias("rule"), F.col("rows_"), F.col(f"h_{n}").alias("held"), F.col(f"b_{n}").alias("broken")) for n in _RULES])
    return t.agg(F.count("*").alias("rows_"), *sums).select(F.inline(rows))


@register(
    "first_missing_rank",
    f"WITH {T.PUBLIC}, r AS (SELECT DISTINCT direction, base_rank FROM public_ WHERE direction IS NOT NULL AND base_rank IS NOT NULL), c AS (SELECT direction, base_rank + 1 AS rank FROM r UNION SELECT direction, 0 FROM r) SELECT direction, min(rank) AS first_missing FROM c ANTI JOIN r ON c.direction = r.direction AND c.rank = r.base_rank GROUP BY direction",
)
def first_missing_rank(spark: SparkSession, d: str) -> DataFrame:
    """The least rank of each direction that no record has."""
    ranks = T.public(spark, d, "direction", "base_rank").where("direction is not null and base_rank is not null").select("direction", "base_rank").distinct()
    tries = ranks.select("direction", F.explode(F.array(F.lit(0).cast("long"), F.col("base_rank") + 1)).alias("base_rank"))
    return tries.join(ranks, ["direction", "base_rank"], "left_anti").groupBy("direction").agg(F.min("base_rank").alias("first_missing"))


@register(
    "library_sizes",
    f"WITH {T.EMITTED} SELECT library_id, count(*) AS rows_, CAST(sum(length(seq)) AS BIGINT) AS letters, count(DISTINCT seq) AS distinct_seqs FROM emitted WHERE seq IS NOT NULL GROUP BY library_id",
)
def library_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Size of each library: records, letters and distinct sequences."""
    rows = T.emitted(spark, d, "library_id", "seq").where("seq is not null")
    return rows.groupBy("library_id").agg(F.count("*").alias("rows_"), F.sum(F.length("seq")).cast("long").alias("letters"), F.countDistinct("seq").alias("distinct_seqs"))
