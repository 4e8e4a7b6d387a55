"""Fiber selection over the measured candidates of each direction, retention and abstention."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from helixmill.functions import sequence as S
from helixmill.operators import fibers as B
from helixmill.operators.positions import positions
from helixmill.operators.quantiles import with_quantiles
from helixmill.plans import frames as T
from helixmill.plans.registry import register
from helixmill.sources import materialise

_G = ["direction"]


def measured(spark: SparkSession, d: str) -> DataFrame:
    return T.public(spark, d, "direction", "digest", "choice", "outcome", "event", "prediction").where(F.col("direction").isNotNull() & F.col("digest").isNotNull() & S.finite("outcome") & S.finite("prediction"))


def book(spark: SparkSession, d: str) -> DataFrame:
    rows = measured(spark, d).select("record_id", "direction", "digest", "outcome", "event", "prediction")
    return B.codebook(rows, _G, "digest", "library", "record_id")


def whole(spark: SparkSession, d: str, width: int = 4) -> DataFrame:
    return B.whole_fibers(B.fibers(book(spark, d), width), _G, width)


@register("codebook_lock", f"WITH {T.FIBERS} SELECT record_id, direction, place AS base_rank, fiber, slot AS choice FROM cut")
def codebook_lock(spark: SparkSession, d: str) -> DataFrame:
    return B.fibers(book(spark, d), 4).select("record_id", "direction", "base_rank", "fiber", "choice")


@register("fiber_argmax", f"WITH {T.FIBERS} SELECT direction, fiber, slot AS choice, key, record_id FROM best WHERE first_ = 1")
def fiber_argmax(spark: SparkSession, d: str) -> DataFrame:
    return B.chosen(whole(spark, d), _G, "prediction").select("direction", "fiber", "choice", "key", "record_id")


@register("fiber_argmin", f"WITH {T.FIBERS} SELECT direction, fiber, slot AS choice, key, record_id FROM best WHERE last_ = 1")
def fiber_argmin(spark: SparkSession, d: str) -> DataFrame:
    return B.chosen(whole(spark, d), _G, "prediction", lowest=True).select("direction", "fiber", "choice", "key", "record_id")


@register("fiber_first_pass", f"WITH {T.FIBERS} SELECT direction, fiber, min(slot) FILTER (prediction >= 1.0) AS choice, count(*) AS width FROM whole GROUP BY direction, fiber")
def fiber_first_pass(spark: SparkSession, d: str) -> DataFrame:
    return B.first_passing(whole(spark, d), _G, F.col("prediction") >= 1.0)


@register(
    "fiber_margin_top2",
    f"WITH {T.FIBERS} SELECT direction, fiber, max(prediction) FILTER (first_ = 1) - max(prediction) FILTER (first_ = 2) AS margin, max(key) FILTER (first_ = 1) AS key FROM best GROUP BY direction, fiber",
)
def fiber_margin_top2(spark: SparkSession, d: str) -> DataFrame:
    return B.margins(whole(spark, d), _G, "prediction")


_GAINS_SQL = f"WITH {T.FIBERS}, gain AS (SELECT *, outcome - fiber_mean AS g FROM best WHERE first_ = 1)"


@register(
    "fiber_gain_summary",
    _GAINS_SQL
    + """, lib AS (SELECT direction, avg(outcome) AS mean_, stddev_pop(outcome) AS sd, avg(event) AS event_rate FROM whole GROUP BY direction)
SELECT direction, count(*) AS fibers, round(any_value(mean_), 9) AS library_mean, round(avg(outcome), 9) AS selected_mean, round(avg(g), 9) AS gain, round(avg(g) / any_value(sd), 6) AS standardised_gain,
  round(avg(event) - any_value(event_rate), 6) AS event_change, round(avg(outcome_variance), 12) AS fiber_variance, round(avg(CASE WHEN g < 0 THEN 1.0 ELSE 0.0 END), 6) AS negative, round(quantile_cont(g, 0.5), 9) AS median_gain
FROM gain JOIN lib USING (direction) GROUP BY direction""",
)
def fiber_gain_summary(spark: SparkSession, d: str) -> DataFrame:
    """Flagship: what the best-scored choice of each fiber gains over the fiber's mean outcome."""
    rows = whole(spark, d)
    w = Window.partitionBy("direction", "fiber")
    wide = rows.withColumns({"fiber_mean": F.avg("outcome").over(w), "variance": F.var_pop("outcome").over(w)})
    picked = B.ranked_choices(wide, _G, "prediction").select("direction", "place", "outcome", "fiber_mean", "event", "variance")
    picked = materialise(picked, "gain-summary")  # read for the sums and for the median
    first, g = F.col("place") == 1, F.col("outcome") - F.col("fiber_mean")
    one = lambda x: F.avg(F.when(first, x))
    out = picked.groupBy("direction").agg(
        F.count_if(first).alias("fibers"), F.round(F.avg("outcome"), 9).alias("library_mean"), F.round(one(F.col("outcome")), 9).alias("selected_mean"), F.round(one(g), 9).alias("gain"),
        F.round(one(g) / F.stddev_pop("outcome"), 6).alias("standardised_gain"), F.round(one(F.col("event")) - F.avg("event"), 6).alias("event_change"),
        F.round(one(F.col("variance")), 12).alias("fiber_variance"), F.round(one((g < 0).cast("double")), 6).alias("negative"),
    )
    return with_quantiles(out, picked.where(first).select("direction", g.alias("g")), _G, "g", {"median_gain": 0.5}, 9)


@register(
    "choice_stability",
    f"""WITH {T.FIBERS}, raw AS (SELECT *, row_number() OVER (PARTITION BY direction, fiber ORDER BY prediction DESC, slot) AS raw_ FROM best),
f AS (SELECT direction, fiber, max(CASE WHEN first_ = 1 THEN slot END) <> max(CASE WHEN raw_ = 1 THEN slot END) AS changed, max(key) FILTER (first_ = 1) = max(key) FILTER (first_ = 2) AS tied,
  max(prediction) FILTER (raw_ = 1) - max(prediction) FILTER (raw_ = 2) AS gap FROM raw GROUP BY direction, fiber)
SELECT direction, count(*) AS fibers, count(*) FILTER (changed) AS changed, count(*) FILTER (tied) AS tied, min(gap) AS least_gap, round(quantile_cont(gap, 0.5), 12) AS median_gap FROM f GROUP BY direction""",
)
def choice_stability(spark: SparkSession, d: str) -> DataFrame:
    """Choices that whole-number keys change against raw scores, tied best keys, and the raw gap of the best two."""
    w = Window.partitionBy("direction", "fiber").orderBy(F.col("prediction").desc(), "choice")
    rows = B.ranked_choices(whole(spark, d), _G, "prediction").withColumn("raw", F.row_number().over(w))
    at = lambda n, p, v: F.max(F.when(F.col(p) == n, F.col(v)))
    per = rows.groupBy("direction", "fiber").agg(
        (at(1, "place", "choice") != at(1, "raw", "choice")).alias("changed"), (at(1, "place", "key") == at(2, "place", "key")).alias("tied"), (at(1, "raw", "prediction") - at(2, "raw", "prediction")).alias("gap")
    )
    per = materialise(per, "stability")  # read for the counts and for the median
    out = per.groupBy("direction").agg(F.count("*").alias("fibers"), F.count_if("changed").alias("changed"), F.count_if("tied").alias("tied"), F.min("gap").alias("least_gap"))
    return with_quantiles(out, per, _G, "gap", {"median_gap": 0.5}, 12)


@register(
    "rejection_baseline",
    f"""WITH {T.FIBERS}, t AS (SELECT direction, prediction AS least FROM (SELECT direction, prediction, row_number() OVER (PARTITION BY direction ORDER BY prediction DESC) AS p, count(*) OVER (PARTITION BY direction) AS n FROM measured) WHERE p = ceil(0.25e0 * n)),
f AS (SELECT direction, fiber, min(slot) FILTER (prediction >= least) AS hit FROM whole JOIN t USING (direction) GROUP BY direction, fiber)
SELECT direction, count(*) AS fibers, count(*) FILTER (hit IS NULL) AS failed, round(avg(coalesce(hit + 1, 4)), 6) AS attempts FROM f GROUP BY direction""",
)
def rejection_baseline(spark: SparkSession, d: str) -> DataFrame:
    """First candidate over the score of the direction's best quarter; attempts count the width where none is."""
    rows = book(spark, d)
    n = rows.groupBy("direction").agg(F.count("*").alias("n"))
    ranked = positions(rows.select("direction", (-F.col("prediction")).alias("worst"), "record_id", "prediction"), _G, ["worst", "record_id"], "place")
    least = ranked.join(n, "direction").where(F.col("place") + 1 == F.ceil(0.25 * F.col("n"))).select("direction", F.col("prediction").alias("least"))
    cut = B.whole_fibers(B.fibers(rows, 4), _G, 4).join(least, "direction")
    per = B.first_passing(cut, _G, F.col("prediction") >= F.col("least"))
    return per.groupBy("direction").agg(
        F.count("*").alias("fibers"), F.count_if(F.col("choice").isNull()).alias("failed"), F.round(F.avg(F.coalesce(F.col("choice") + 1, F.lit(4))), 6).alias("attempts")
    )


_SEEDS = 32


@register(
    "mapping_sensitivity",
    f"""WITH {T.MEASURED}, seeds AS (SELECT unnest(range({_SEEDS})) AS seed),
book AS (SELECT seed, measured.*, row_number() OVER (PARTITION BY direction, seed ORDER BY sha256('map' || seed || '|' || digest), digest, record_id) - 1 AS place FROM measured, seeds),
cut AS (SELECT *, place // 4 AS fiber, place % 4 AS slot, count(*) OVER (PARTITION BY direction, seed, place // 4) AS n FROM book),
best AS (SELECT *, row_number() OVER (PARTITION BY direction, seed, fiber ORDER BY CAST(round_even(prediction * 1e12, 0) AS BIGINT) DESC, slot) AS first_, avg(outcome) OVER (PARTITION BY direction, seed, fiber) AS m FROM cut WHERE n = 4),
s AS (SELECT direction, seed, avg(outcome - m) AS gain FROM best WHERE first_ = 1 GROUP BY direction, seed)
SELECT direction, count(*) AS mappings, round(min(gain), 9) AS least, round(quantile_cont(gain, 0.5), 9) AS median, round(max(gain), 9) AS most, round(avg(CASE WHEN gain > 0 THEN 1.0 ELSE 0.0 END), 6) AS positive FROM s GROUP BY direction""",
)
def mapping_sensitivity(spark: SparkSession, d: str) -> DataFrame:
    """The mean gain under 32 orders of the codebook."""
    rows = measured(spark, d).select("record_id", "direction", "digest", "outcome", "prediction", F.explode(F.sequence(F.lit(0), F.lit(_SEEDS - 1))).alias("seed"))
    group = ["direction", "seed"]
    locked = rows.withColumn("lock", F.sha2(F.concat(F.lit("map"), F.col("seed"), F.lit("|"), F.col("digest")), 256))
    cut = B.whole_fibers(B.fibers(positions(locked, group, ["lock", "digest", "record_id"]), 4), group, 4)
    per = B.gains(cut, group, "prediction", "outcome").groupBy(*group).agg(F.avg("gain").alias("gain"))
    return per.groupBy("direction").agg(
        F.count("*").alias("mappings"), F.round(F.min("gain"), 9).alias("least"), F.round(F.percentile("gain", 0.5), 9).alias("median"), F.round(F.max("gain"), 9).alias("most"),
        F.round(F.avg((F.col("gain") > 0).cast("double")), 6).alias("positive"),
    )


_SHARES = (1.0, 0.9, 0.75)


_KEPT = " UNION ALL ".join(
    f"SELECT direction, {q}e0 AS share, count(*) AS kept, round(avg(g), 9) AS gain FROM m JOIN (SELECT direction, quantile_cont(margin, {round(1 - q, 10)}) AS t FROM m GROUP BY direction) USING (direction) WHERE margin >= t GROUP BY direction"
    for q in _SHARES
)


@register(
    "abstention",
    f"""{_GAINS_SQL}, two AS (SELECT direction, fiber, max(prediction) FILTER (first_ = 1) - max(prediction) FILTER (first_ = 2) AS margin FROM best GROUP BY direction, fiber),
m AS (SELECT gain.direction, g, margin FROM gain JOIN two ON gain.direction = two.direction AND gain.fiber = two.fiber) {_KEPT}""",
)
def abstention(spark: SparkSession, d: str) -> DataFrame:
    """Mean gain when fibers of small score margins are left out; ties at the threshold stay."""
    rows = whole(spark, d)
    per = B.gains(rows, _G, "prediction", "outcome").select("direction", "fiber", "gain").join(B.margins(rows, _G, "prediction"), ["direction", "fiber"])
    per = materialise(per, "abstention")  # read for the thresholds and for the fibers they keep
    edges = with_quantiles(per.select("direction").distinct(), per, _G, "margin", {f"t{i}": round(1 - q, 10) for i, q in enumerate(_SHARES)})
    shares = F.array(*[F.struct(F.lit(q).alias("share"), F.col(f"t{i}").alias("t")) for i, q in enumerate(_SHARES)])
    wide = per.join(edges, "direction").select("direction", "gain", "margin", F.inline(shares))
    return wide.where(F.col("margin") >= F.col("t")).groupBy("direction", "share").agg(F.count("*").alias("kept"), F.round(F.avg("gain"), 9).alias("gain"))


@register(
    "topk_retention",
    f"WITH {T.MEASURED}, r AS (SELECT record_id, direction, row_number() OVER (PARTITION BY direction ORDER BY prediction DESC, record_id) AS p, count(*) OVER (PARTITION BY direction) AS n FROM measured) SELECT record_id, direction FROM r WHERE p <= greatest(1, ceil(0.25e0 * n))",
)
def topk_retention(spark: SparkSession, d: str) -> DataFrame:
    """The best-scored quarter of each direction, at least one; ties by record."""
    rows = measured(spark, d).select("record_id", "direction", (-F.col("prediction")).alias("worst"))
    n = rows.groupBy("direction").agg(F.count("*").alias("n"))
    placed = positions(rows, _G, ["worst", "record_id"], "place").join(n, "direction")
    return placed.where(F.col("place") < F.greatest(F.lit(1), F.ceil(0.25 * F.col("n")))).select("record_id", "direction")


@register(
    "bottom2pct_label",
    f"WITH {T.MEASURED}, c AS (SELECT *, cume_dist() OVER (PARTITION BY direction ORDER BY outcome) AS f FROM measured), t AS (SELECT direction, min(outcome) AS edge FROM c WHERE f > 0.02 GROUP BY direction) SELECT record_id, direction, outcome < edge AS low FROM measured JOIN t USING (direction)",
)
def bottom2pct_label(spark: SparkSession, d: str) -> DataFrame:
    """Outcomes strictly under the least one whose share of rows at or below it is over 2 percent."""
    rows = measured(spark, d).select("record_id", "direction", "outcome")
    n = rows.groupBy("direction").agg(F.count("*").alias("n"))
    edge = positions(rows, _G, ["outcome", "record_id"], "place").join(n, "direction").where((F.col("place") + 1) / F.col("n") > 0.02).groupBy("direction").agg(F.min("outcome").alias("edge"))
    return rows.join(edge, "direction").select("record_id", "direction", (F.col("outcome") < F.col("edge")).alias("low"))


@register(
    "hard_filter",
    f"WITH {T.GENERATED} SELECT pool, count(*) AS rows_, count(*) FILTER (gc_count / 108 > 0.4 AND gc_count / 108 < 0.6 AND max_homopolymer < 5 AND weighted < 150) AS passed FROM generated WHERE pool IS NOT NULL GROUP BY pool",
)
def hard_filter(spark: SparkSession, d: str) -> DataFrame:
    share = F.col("gc_count") / 108
    ok = (share > 0.4) & (share < 0.6) & (F.col("max_homopolymer") < 5) & (F.col("weighted") < 150)
    return T.generated(spark, d, "pool", "gc_count", "max_homopolymer", "weighted").where("pool is not null").groupBy("pool").agg(F.count("*").alias("rows_"), F.count_if(ok).alias("passed"))


@register(
    "retention_rate_penalty",
    "SELECT row_id, round(-log2(retention_fraction), 9) AS bits, round(-log2(retention_fraction) / 108, 9) AS bits_per_letter FROM (SELECT DISTINCT row_id, retention_fraction FROM paper2_assay_calibrated_selection_figure_source_data) WHERE retention_fraction > 0 AND isfinite(retention_fraction)",
)
def retention_rate_penalty(spark: SparkSession, d: str) -> DataFrame:
    t = T.table(spark, d, "paper2_assay_calibrated_selection_figure_source_data").select("row_id", "retention_fraction").distinct()
    t = t.where((F.col("retention_fraction") > 0) & S.finite("retention_fraction"))
    return t.select("row_id", F.round(S.rate_penalty("retention_fraction"), 9).alias("bits"), F.round(S.rate_penalty("retention_fraction") / 108, 9).alias("bits_per_letter"))


@register(
    "public_decode",
    f"WITH {T.PUBLIC} SELECT direction, bits, count(*) AS rows_, count(*) FILTER (base_rank >> bits = payload) AS payload_fits, count(*) FILTER (base_rank % (1 << bits) = choice) AS choice_fits, count(*) FILTER (decoded_payload = payload) AS decoded_fits FROM public_ WHERE bits IS NOT NULL GROUP BY direction, bits",
)
def public_decode(spark: SparkSession, d: str) -> DataFrame:
    """Payload and choice from the base rank, beside those delivered."""
    t = T.public(spark, d, "direction", "bits", "base_rank", "payload", "choice", "decoded_payload").where("bits is not null")
    up = F.expr("shiftleft(1L, bits)")
    return t.groupBy("direction", "bits").agg(
        F.count("*").alias("rows_"), F.count_if(F.expr("shiftright(base_rank, bits)") == F.col("payload")).alias("payload_fits"),
        F.count_if(F.col("base_rank") % up == F.col("choice")).alias("choice_fits"), F.count_if(F.col("decoded_payload") == F.col("payload")).alias("decoded_fits"),
    )

