"""Rank statistics, inference, models and separation audits over the given tables."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixmill.functions import sequence as S
from helixmill.operators import fibers as B
from helixmill.operators import logistic, ridge, separation, stats, twostage
from helixmill.operators.positions import average_ranks, positions
from helixmill.plans import frames as T
from helixmill.plans.fiber_queries import measured, whole
from helixmill.plans.registry import register
from helixmill.sources import materialise

_FEATURES = ["gc_count", "max_homopolymer", "pairs", "weighted"]
_SCORED = f"{T.GENERATED}, ok AS (SELECT * FROM generated WHERE pool IS NOT NULL AND isfinite(score) AND isfinite(cross_))"


def _scored(spark: SparkSession, d: str) -> DataFrame:
    columns = ("pool", "score", "cross", "choice", "digest", *_FEATURES)
    return T.generated(spark, d, *columns).where(F.col("pool").isNotNull() & S.finite("score") & S.finite("cross"))


_RANK = "rank() OVER (PARTITION BY {g} ORDER BY {v}) + (count(*) OVER (PARTITION BY {g}, {v}) - 1) / 2"


@register("avg_rank", f"WITH {_SCORED} SELECT record_id, pool, CAST({_RANK.format(g='pool', v='gc_count')} AS DOUBLE) AS gc_rank FROM ok WHERE gc_count IS NOT NULL")
def avg_rank(spark: SparkSession, d: str) -> DataFrame:
    return average_ranks(_scored(spark, d).where("gc_count is not null").select("record_id", "pool", "gc_count"), ["pool"], "gc_count", "gc_rank").drop("gc_count")


@register(
    "spearman",
    f"WITH {_SCORED}, r AS (SELECT pool, {_RANK.format(g='pool', v='score')} AS x, {_RANK.format(g='pool', v='cross_')} AS y FROM ok) SELECT pool, count(*) AS n, round(corr(x, y), 6) AS spearman FROM r GROUP BY pool",
)
def spearman(spark: SparkSession, d: str) -> DataFrame:
    return stats.spearman(_scored(spark, d), ["pool"], "score", "cross")


_LABELLED = f"{T.MEASURED}, lab AS (SELECT * FROM measured WHERE event IS NOT NULL)"


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    return measured(spark, d).where("event is not null").withColumn("risk", -F.col("prediction"))


@register(
    "auc_ranksum",
    f"WITH {_LABELLED}, r AS (SELECT direction, event, {_RANK.format(g='direction', v='-prediction')} AS r FROM lab), s AS (SELECT direction, count(*) FILTER (event = 1) AS p, count(*) FILTER (event = 0) AS n, sum(r) FILTER (event = 1) AS t FROM r GROUP BY direction) "
    "SELECT direction, p AS positives, CASE WHEN p > 0 AND n > 0 THEN round((t - p * (p + 1) / 2) / (p * n), 6) END AS auc FROM s",
)
def auc_ranksum(spark: SparkSession, d: str) -> DataFrame:
    return stats.auc(_labelled(spark, d), ["direction"], "risk", "event")


@register(
    "average_precision",
    f"WITH {_LABELLED}, s AS (SELECT direction, prediction, sum(event) AS p, count(*) AS n FROM lab GROUP BY ALL), c AS (SELECT direction, p, sum(p) OVER w AS tp, sum(n) OVER w AS upto FROM s WINDOW w AS (PARTITION BY direction ORDER BY prediction)) SELECT direction, CASE WHEN sum(p) > 0 THEN round(sum(p * tp / upto) / sum(p), 6) END AS average_precision FROM c GROUP BY direction",
)
def average_precision(spark: SparkSession, d: str) -> DataFrame:
    return stats.average_precision(_labelled(spark, d), ["direction"], "risk", "event")


@register("brier", f"WITH {_LABELLED} SELECT direction, count(*) AS n, round(avg((1 / (1 + exp(100 * (prediction - 1))) - event) ** 2), 9) AS brier FROM lab GROUP BY direction")
def brier(spark: SparkSession, d: str) -> DataFrame:
    p = 1 / (1 + F.exp(100 * (F.col("prediction") - 1)))
    return _labelled(spark, d).groupBy("direction").agg(F.count("*").alias("n"), F.round(F.avg((p - F.col("event")) * (p - F.col("event"))), 9).alias("brier"))


@register(
    "regression_metrics",
    f"WITH {T.MEASURED} SELECT direction, count(*) AS n, round(1 - sum((outcome - prediction) ** 2) / (count(*) * var_pop(outcome)), 6) AS r2, round(avg(abs(outcome - prediction)), 9) AS mae, round(sqrt(avg((outcome - prediction) ** 2)), 9) AS rmse FROM measured GROUP BY direction",
)
def regression_metrics(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("outcome") - F.col("prediction")
    return measured(spark, d).groupBy("direction").agg(
        F.count("*").alias("n"), F.round(1 - F.try_divide(F.sum(e * e), F.count("*") * F.var_pop("outcome")), 6).alias("r2"), F.round(F.avg(F.abs(e)), 9).alias("mae"), F.round(F.sqrt(F.avg(e * e)), 9).alias("rmse")
    )


@register(
    "weighted_midranks",
    f"WITH {_SCORED}, w AS (SELECT pool, gc_count, sum(choice + 1) AS w FROM ok WHERE gc_count IS NOT NULL AND choice IS NOT NULL GROUP BY ALL), c AS (SELECT *, sum(w) OVER (PARTITION BY pool ORDER BY gc_count) AS upto FROM w) SELECT record_id, pool, CAST(upto - w + (w + 1) / 2 AS DOUBLE) AS midrank FROM ok JOIN c USING (pool, gc_count) WHERE choice IS NOT NULL",
)
def weighted_midranks(spark: SparkSession, d: str) -> DataFrame:
    rows = _scored(spark, d).where("gc_count is not null and choice is not null").select("record_id", "pool", "gc_count", (F.col("choice") + 1).alias("w"))
    return stats.weighted_ranks(rows, ["pool"], "gc_count", "w", "midrank").select("record_id", "pool", "midrank")


@register(
    "weighted_correlation",
    f"WITH {_SCORED}, w AS (SELECT pool, score AS x, cross_ AS y, choice + 1 AS w FROM ok WHERE choice IS NOT NULL), m AS (SELECT pool, sum(w * x) / sum(w) AS mx, sum(w * y) / sum(w) AS my FROM w GROUP BY pool) SELECT pool, round(sum(w * (x - mx) * (y - my)) / sqrt(sum(w * (x - mx) ** 2) * sum(w * (y - my) ** 2)), 6) AS correlation FROM w JOIN m USING (pool) GROUP BY pool",
)
def weighted_correlation(spark: SparkSession, d: str) -> DataFrame:
    rows = _scored(spark, d).where("choice is not null").select("pool", F.col("score").alias("x"), F.col("cross").alias("y"), (F.col("choice") + 1).alias("w"))
    w, mean = F.col("w"), lambda v: F.sum(F.col("w") * F.col(v)) / F.sum("w")
    both = rows.join(rows.groupBy("pool").agg(mean("x").alias("mx"), mean("y").alias("my")), "pool")
    x, y = F.col("x") - F.col("mx"), F.col("y") - F.col("my")
    return both.groupBy("pool").agg(F.round(F.try_divide(F.sum(w * x * y), F.sqrt(F.sum(w * x * x) * F.sum(w * y * y))), 6).alias("correlation"))


_SIDES = f"""{T.GENERATED}, ways AS (SELECT DISTINCT direction, lower(trim(source_pool)) AS s, lower(trim(target_pool)) AS t FROM public_fiber_results),
sides AS (SELECT direction, CASE WHEN pool = s THEN 0 ELSE 1 END AS side, score, gc_count FROM generated JOIN ways ON pool IN (s, t) WHERE isfinite(score))"""


def _sides(spark: SparkSession, d: str) -> DataFrame:
    ways = T.table(spark, d, "public_fiber_results").select("direction", F.lower(F.trim("source_pool")).alias("s"), F.lower(F.trim("target_pool")).alias("t")).distinct()
    ends = ways.select("direction", F.inline(F.array(F.struct(F.col("s").alias("pool"), F.lit(0).alias("side")), F.struct(F.col("t").alias("pool"), F.lit(1).alias("side")))))
    return T.generated(spark, d, "pool", "score", "gc_count").where(S.finite("score")).join(ends, "pool").select("direction", "side", "score", "gc_count")


@register(
    "ks_wasserstein",
    f"""WITH {_SIDES}, c AS (SELECT direction, score, count(*) FILTER (side = 0) AS a, count(*) FILTER (side = 1) AS b FROM sides GROUP BY ALL),
f AS (SELECT direction, score, abs(sum(a) OVER w / sum(a) OVER g - sum(b) OVER w / sum(b) OVER g) AS gap, lead(score) OVER w AS next FROM c WINDOW w AS (PARTITION BY direction ORDER BY score), g AS (PARTITION BY direction))
SELECT direction, round(max(gap), 6) AS ks, round(coalesce(sum(gap * (next - score)), 0), 9) AS wasserstein FROM f GROUP BY direction""",
)
def ks_wasserstein(spark: SparkSession, d: str) -> DataFrame:
    return stats.two_sample(_sides(spark, d), ["direction"], "score", "side")


@register(
    "feature_overlap",
    f"""WITH {_SIDES}, e AS (SELECT direction, min(gc_count) FILTER (side = 0) AS lo, max(gc_count) FILTER (side = 0) AS hi, avg(gc_count) FILTER (side = 0) AS m0, avg(gc_count) FILTER (side = 1) AS m1,
sqrt((var_pop(gc_count) FILTER (side = 0) + var_pop(gc_count) FILTER (side = 1)) / 2) AS sd FROM sides WHERE gc_count IS NOT NULL GROUP BY direction)
SELECT direction, any_value(lo) AS least, any_value(hi) AS most, round(any_value(m0), 6) AS source_mean, round(any_value(m1), 6) AS target_mean, round(any_value((m1 - m0) / sd), 6) AS smd, round(avg(CASE WHEN gc_count BETWEEN lo AND hi THEN 1.0 ELSE 0.0 END) FILTER (side = 1), 6) AS inside FROM sides JOIN e USING (direction) WHERE gc_count IS NOT NULL GROUP BY direction""",
)
def feature_overlap(spark: SparkSession, d: str) -> DataFrame:
    rows = _sides(spark, d).where("gc_count is not null")
    on = lambda f, k: f(F.when(F.col("side") == k, F.col("gc_count")))
    ends = rows.groupBy("direction").agg(
        on(F.min, 0).alias("least"), on(F.max, 0).alias("most"), on(F.avg, 0).alias("m0"), on(F.avg, 1).alias("m1"), F.sqrt((on(F.var_pop, 0) + on(F.var_pop, 1)) / 2).alias("sd")
    )
    inside = rows.where("side = 1").join(ends, "direction").groupBy("direction").agg(F.round(F.avg(F.col("gc_count").between(F.col("least"), F.col("most")).cast("double")), 6).alias("inside"))
    out = ends.join(inside, "direction", "left")
    return out.select("direction", "least", "most", F.round("m0", 6).alias("source_mean"), F.round("m1", 6).alias("target_mean"), F.round(F.try_divide(F.col("m1") - F.col("m0"), F.col("sd")), 6).alias("smd"), "inside")


_REPLICATES, _CHOICES, _SHUFFLES = 2000, 100_000, 500
_GAIN = f"{T.FIBERS}, g AS (SELECT direction, fiber, outcome - fiber_mean AS gain FROM best WHERE first_ = 1)"


def _gains(spark: SparkSession, d: str) -> DataFrame:
    gains = B.gains(whole(spark, d), ["direction"], "prediction", "outcome").select("direction", "fiber", "gain")
    return materialise(gains.withColumn("name", F.concat("direction", F.lit("|"), F.col("fiber").cast("string"))), "gains")


_WEIGHT = "(" + " + ".join(f"CASE WHEN u >= {int(65536 * sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)))} THEN 1 ELSE 0 END" for k in range(8)) + ")"
_BOOT = f"""{_GAIN}, h AS (SELECT direction, gain, block, sha256('boot|' || block || '|' || direction || '|' || fiber) AS h FROM g, (SELECT unnest(range({_REPLICATES // 16})) AS block)),
u AS (SELECT direction, gain, block * 16 + lane AS replicate, CAST('0x' || substr(h, CAST(lane * 4 + 1 AS INTEGER), 4) AS INTEGER) AS u FROM h, (SELECT unnest(range(16)) AS lane)),
boot AS (SELECT direction, replicate, sum({_WEIGHT} * gain) / nullif(sum({_WEIGHT}), 0) AS mean FROM u GROUP BY ALL)"""


@register("boot_mean_hash", f"WITH {_BOOT} SELECT direction, round(quantile_cont(mean, 0.025), 9) AS low, round(quantile_cont(mean, 0.975), 9) AS high, round(avg(mean), 9) AS middle FROM boot GROUP BY direction")
def boot_mean_hash(spark: SparkSession, d: str) -> DataFrame:
    """Percentile interval of the mean gain over resamples of the fibers, all replicates in one pass over the rows."""
    boot = stats.bootstrap_means(_gains(spark, d), "direction", "name", "gain", _REPLICATES, "boot")
    q = F.percentile("mean", [0.025, 0.975])
    return boot.groupBy("direction").agg(F.round(q[0], 9).alias("low"), F.round(q[1], 9).alias("high"), F.round(F.avg("mean"), 9).alias("middle"))


@register("bca_interval")
def bca_interval(spark: SparkSession, d: str) -> DataFrame:
    """BCa interval of the mean gain per direction, the acceleration from the third moment of the gains."""
    g = _gains(spark, d)
    own = g.groupBy("direction").agg(F.avg("gain").alias("mean"), F.count("*").alias("n"), F.coalesce(F.skewness("gain"), F.lit(0.0)).alias("skew"))
    boot = stats.bootstrap_means(g, "direction", "name", "gain", _REPLICATES, "boot").groupBy("direction").agg(F.collect_list("mean").alias("b"))  # one entry a replicate
    rows = boot.join(own, "direction").where("n > 1").collect()  # one row a direction
    out = [(r["direction"], r["mean"], *stats.bca(r["mean"], r["b"], r["skew"] / (6 * r["n"] ** 0.5))) for r in rows]
    return spark.createDataFrame(out, "direction string, mean double, low double, high double")


@register(
    "random_choice_hash",
    f"""WITH {_GAIN}, lib AS (SELECT direction, fiber, list(outcome - fiber_mean ORDER BY slot) AS gains FROM best GROUP BY ALL),
h AS (SELECT direction, gains, block, sha256('pick|' || block || '|' || direction || '|' || fiber) AS h FROM lib, (SELECT unnest(range({-(-_CHOICES // 64)})) AS block)),
b AS (SELECT direction, block * 64 + lane AS replicate, avg(gains[1 + (strpos('0123456789abcdef', substr(h, CAST(lane + 1 AS INTEGER), 1)) - 1) % 4]) AS gain FROM h, (SELECT unnest(range(64)) AS lane) WHERE block * 64 + lane < {_CHOICES} GROUP BY ALL),
o AS (SELECT direction, round(avg(gain), 10) AS seen FROM g GROUP BY direction)
SELECT direction, count(*) FILTER (round(b.gain, 10) >= seen) AS beaten, round((count(*) FILTER (round(b.gain, 10) >= seen) + 1) / (count(*) + 1), 6) AS p,
round((count(*) FILTER (abs(round(b.gain, 10)) >= abs(seen)) + 1) / (count(*) + 1), 6) AS p_two_sided FROM b JOIN o USING (direction) GROUP BY direction""",
)
def random_choice_hash(spark: SparkSession, d: str) -> DataFrame:
    """Is the choice better than random ones? One- and two-sided p over choices drawn by hash."""
    rows = whole(spark, d)
    seen = B.gains(rows, ["direction"], "prediction", "outcome").groupBy("direction").agg(F.round(F.avg("gain"), 10).alias("seen"))
    members = rows.groupBy("direction", "fiber").agg(F.array_sort(F.collect_list(F.struct("choice", "outcome"))).alias("m"), F.avg("outcome").alias("mean"))  # four to a fiber
    members = members.select("direction", F.concat("direction", F.lit("|"), F.col("fiber").cast("string")).alias("name"), F.transform("m", lambda x: x["outcome"] - F.col("mean")).alias("gains"))
    drawn = stats.random_choices(members, "direction", "name", "gains", _CHOICES, "pick").withColumn("gain", F.round("mean", 10))
    beaten, either = F.count_if(F.col("gain") >= F.col("seen")), F.count_if(F.abs("gain") >= F.abs("seen"))
    p = lambda n: F.round((n + 1) / (F.count("*") + 1), 6)
    return drawn.join(seen, "direction").groupBy("direction").agg(beaten.alias("beaten"), p(beaten).alias("p"), p(either).alias("p_two_sided"))


@register("paired_diff_boot", f"WITH {_BOOT}, o AS (SELECT direction, avg(gain) AS gain FROM g GROUP BY direction) SELECT direction, round(any_value(gain), 9) AS gain, round(stddev_samp(mean), 9) AS error, count(*) FILTER (mean > 0) AS above FROM boot JOIN o USING (direction) GROUP BY direction")
def paired_diff_boot(spark: SparkSession, d: str) -> DataFrame:
    g = _gains(spark, d)
    boot = stats.bootstrap_means(g, "direction", "name", "gain", _REPLICATES, "boot").groupBy("direction").agg(F.round(F.stddev_samp("mean"), 9).alias("error"), F.count_if(F.col("mean") > 0).alias("above"))
    return g.groupBy("direction").agg(F.round(F.avg("gain"), 9).alias("gain")).join(boot, "direction").select("direction", "gain", "error", "above")


_ASSOCIATED, _OUTCOMES = _FEATURES, ("score", "cross", "high", "wide")


def _associated(spark: SparkSession, d: str) -> DataFrame:
    """Average ranks of features and outcomes per pool; ``high`` and ``wide`` are labels: a cross score of 1 or more, four choices or more."""
    rows = _scored(spark, d).na.drop(subset=_FEATURES).where("choice is not null").select("record_id", "pool", *_FEATURES, "score", "cross", (F.col("cross") >= 1).cast("int").alias("high"), (F.col("choice") >= 4).cast("int").alias("wide"))
    for c in (*_FEATURES, "score", "cross"):
        rows = average_ranks(rows, ["pool"], c, f"r_{c}").drop(c)
    return materialise(rows, "associated")


def _association(feature: str, outcome: str) -> Column:
    """Rank correlation with a measured outcome; area under the curve of a label."""
    x = F.col(f"r_{feature}")
    if outcome in ("score", "cross"):
        y = F.col(f"r_{outcome}")
        return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))
    p, n = F.count_if(F.col(outcome) == 1), F.count_if(F.col(outcome) == 0)
    return F.try_divide(F.sum(F.when(F.col(outcome) == 1, x)) - p * (p + 1) / 2, p * n)


def _association_sql(feature: str, outcome: str) -> str:
    if outcome in ("score", "cross"):
        return f"CASE WHEN stddev_pop(r_{feature}) > 0 AND stddev_pop(r_{outcome}) > 0 THEN corr(r_{feature}, r_{outcome}) END"
    return f"(sum(r_{feature}) FILTER ({outcome} = 1) - count(*) FILTER ({outcome} = 1) * (count(*) FILTER ({outcome} = 1) + 1) / 2) / nullif(count(*) FILTER ({outcome} = 1) * count(*) FILTER ({outcome} = 0), 0)"


_PAIRS = [(f, o) for f in _ASSOCIATED for o in _OUTCOMES]
_RANKED_SQL = ", ".join(f"CAST({_RANK.format(g='pool', v=v)} AS DOUBLE) AS r_{n}" for n, v in [*((f, f) for f in _FEATURES), ("score", "score"), ("cross", "cross_")])
_SIDE_Y = ("r_score", "r_cross", "high", "wide")


@register(
    "perm_envelope_hash",
    f"""WITH {_SCORED}, k AS (SELECT * FROM ok WHERE {" AND ".join(f"{f} IS NOT NULL" for f in _FEATURES)} AND choice IS NOT NULL),
r AS (SELECT record_id, pool, CAST(cross_ >= 1 AS INTEGER) AS high, CAST(choice >= 4 AS INTEGER) AS wide, {_RANKED_SQL}, row_number() OVER (PARTITION BY pool ORDER BY record_id) AS place FROM k),
h AS (SELECT record_id, pool, {", ".join(_SIDE_Y)}, block, sha256('perm|' || block || '|' || record_id) AS h FROM r, (SELECT unnest(range({_SHUFFLES // 4})) AS block)),
l AS (SELECT *, block * 4 + lane AS replicate, substr(h, CAST(lane * 16 + 1 AS INTEGER), 16) AS lock FROM h, (SELECT unnest(range(4)) AS lane)),
s AS (SELECT pool, replicate, {", ".join(_SIDE_Y)}, row_number() OVER (PARTITION BY pool, replicate ORDER BY lock, record_id) AS place FROM l),
n AS (SELECT pool, replicate, {", ".join(f"{_association_sql(f, o)} AS {f}_{o}" for f, o in _PAIRS)} FROM s JOIN (SELECT pool, place, {", ".join(f"r_{f}" for f in _FEATURES)} FROM r) USING (pool, place) GROUP BY ALL),
o AS (SELECT pool, {", ".join(f"{_association_sql(f, o)} AS {f}_{o}" for f, o in _PAIRS)} FROM r GROUP BY pool)
"""
    + " UNION ALL ".join(
        f"SELECT n.pool, '{f}' AS feature, '{o}' AS outcome, round(any_value(o.{f}_{o}), 6) AS association, round(quantile_cont(n.{f}_{o}, 0.025), 6) AS low, round(quantile_cont(n.{f}_{o}, 0.975), 6) AS high FROM n JOIN o ON n.pool = o.pool GROUP BY n.pool"
        for f, o in _PAIRS
    ),
)
def perm_envelope_hash(spark: SparkSession, d: str) -> DataFrame:
    """Association of four features with four outcomes per pool, against the envelope of 500 shuffles of the outcomes.

    A shuffle sorts the records by a lock from a hash, one SHA-256 for four shuffles, and gives the outcomes to the places of the unshuffled ones.
    """
    rows = _associated(spark, d)
    named = [_association(f, o).alias(f"{f}_{o}") for f, o in _PAIRS]
    long = lambda df: df.select("pool", F.inline(F.array(*[F.struct(F.lit(f).alias("feature"), F.lit(o).alias("outcome"), F.col(f"{f}_{o}").alias("a")) for f, o in _PAIRS])))
    fixed = positions(rows.select("record_id", "pool", *[f"r_{f}" for f in _FEATURES]), ["pool"], ["record_id"], "place").drop("record_id")
    blocks = rows.select("record_id", "pool", *_SIDE_Y, F.explode(F.sequence(F.lit(0), F.lit(_SHUFFLES // 4 - 1))).alias("block"))
    digest = F.sha2(F.concat(F.lit("perm|"), F.col("block").cast("string"), F.lit("|"), F.col("record_id").cast("string")), 256)
    lanes = F.array(*[F.struct((F.col("block") * 4 + i).alias("replicate"), F.substring("h", 16 * i + 1, 16).alias("lock")) for i in range(4)])
    shuffled = blocks.withColumn("h", digest).select("record_id", "pool", *_SIDE_Y, F.inline(lanes))
    placed = positions(shuffled, ["pool", "replicate"], ["lock", "record_id"], "place").drop("lock", "record_id")
    null = long(placed.join(fixed, ["pool", "place"]).groupBy("pool", "replicate").agg(*named))
    q = F.percentile("a", [0.025, 0.975])
    ends = null.groupBy("pool", "feature", "outcome").agg(F.round(q[0], 6).alias("low"), F.round(q[1], 6).alias("high"))
    seen = long(rows.groupBy("pool").agg(*named)).withColumn("association", F.round("a", 6)).drop("a")
    return seen.join(ends, ["pool", "feature", "outcome"]).select("pool", "feature", "outcome", "association", "low", "high")


@register(
    "ridge_one_feature",
    f"WITH {_SCORED}, z AS (SELECT pool, count(*) AS n, avg(gc_count) AS mx, stddev_pop(gc_count) AS sd, avg(score) AS my, covar_pop(gc_count, score) AS cxy FROM ok WHERE gc_count IS NOT NULL GROUP BY pool) SELECT pool, n, round(n * cxy / sd / (n + 1e0) / sd, 9) AS slope, round(my - mx * (n * cxy / sd / (n + 1e0) / sd), 9) AS intercept FROM z WHERE sd > 0",
)
def ridge_one_feature(spark: SparkSession, d: str) -> DataFrame:
    """Standardised ridge of one feature with penalty 1, in closed form."""
    rows = _scored(spark, d).where("gc_count is not null")
    z = rows.groupBy("pool").agg(F.count("*").alias("n"), F.avg("gc_count").alias("mx"), F.stddev_pop("gc_count").alias("sd"), F.avg("score").alias("my"), F.covar_pop("gc_count", "score").alias("cxy"))
    slope = F.col("n") * F.col("cxy") / F.col("sd") / (F.col("n") + 1) / F.col("sd")
    return z.where("sd > 0").select("pool", "n", F.round(slope, 9).alias("slope"), F.round(F.col("my") - F.col("mx") * slope, 9).alias("intercept"))


@register("ridge_cv")
def ridge_cv(spark: SparkSession, d: str) -> DataFrame:
    """Ridge on four features per pool: five folds by the SHA-256 of the sequence's digest, copies together, choose the penalty, all rows fit the coefficients."""
    rows = _scored(spark, d).na.drop(subset=_FEATURES).where("digest is not null").withColumn("fold", F.conv(F.substring(F.sha2(F.concat(F.lit("fold|"), F.col("digest")), 256), 1, 8), 16, 10).cast("long") % 5)
    parts: dict[str, list] = {}
    for r in ridge.moments(rows, ["pool", "fold"], _FEATURES, "score").collect():  # five rows a pool
        parts.setdefault(r["pool"], []).append((r["fold"], ridge.gram(r.asDict(), _FEATURES, "score")))
    out = []
    for pool, folds in sorted(parts.items()):
        grams = [g for _, g in sorted(folds, key=lambda x: x[0])]
        if len(grams) > 1:
            alpha = ridge.best_alpha(grams)
            intercept, beta = ridge.solve(sum(grams), alpha)
            out.append((pool, alpha, round(intercept, 9), *[round(float(b), 12) for b in beta]))
    return spark.createDataFrame(out, "pool string, alpha double, intercept double, " + ", ".join(f"{f} double" for f in _FEATURES))


_WORDS = f"{T.EMITTED}, {T.GENERATED}, w AS (SELECT seq, min(record_id) AS id FROM (SELECT seq, record_id FROM emitted UNION ALL SELECT seq, record_id FROM generated) WHERE regexp_matches(seq, '^[ACGT]{{108}}$') GROUP BY seq)"


def _words(spark: SparkSession, d: str) -> DataFrame:
    both = T.emitted(spark, d, "seq").unionByName(T.generated(spark, d, "seq"))
    return both.where(S.is_dna("seq") & (F.length("seq") == S.LENGTH)).groupBy("seq").agg(F.min("record_id").alias("id"))


@register("hamming_pairs", f"WITH {_WORDS} SELECT a.id AS id_a, b.id AS id_b, CAST(hamming(a.seq, b.seq) AS INTEGER) AS distance FROM w a JOIN w b ON a.id < b.id WHERE hamming(a.seq, b.seq) <= 8")
def hamming_pairs(spark: SparkSession, d: str) -> DataFrame:
    """All pairs of distinct words within eight substitutions."""
    return separation.pairs_within(_words(spark, d), "id", "seq", S.LENGTH, 8)


@register(
    "hamming_nearest",
    f"WITH {_WORDS}, d AS (SELECT a.id AS query, hamming(a.seq, b.seq) AS distance, b.id AS neighbour FROM w a JOIN w b ON a.id <> b.id WHERE a.id % 20 = 0) SELECT query, distance, neighbour FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY distance, neighbour) AS p FROM d) WHERE p = 1",
)
def hamming_nearest(spark: SparkSession, d: str) -> DataFrame:
    """The nearest other word of every word whose id is divisible by 20, the query set, against all words."""
    words = materialise(_words(spark, d), "words")  # read for queries and rows, and counted
    return separation.nearest(words.where("id % 20 = 0"), words, "id", "seq", S.LENGTH)


@register("logistic_transfer")
def logistic_transfer(spark: SparkSession, d: str) -> DataFrame:
    """Low-efficiency risk fitted on one direction and tried on all others of the same target: rows, events, Brier score."""
    rows = _labelled(spark, d).select("direction", ((F.col("prediction") - 1) * 1000).alias("x"), (F.col("choice") / 4).alias("c"), "event").where("c is not null")
    rows = materialise(rows, "logistic")
    models = logistic.fit(rows, "direction", ["x", "c"], "event")
    names = F.array(*[F.lit(n) for n in sorted(models)])
    pairs = rows.withColumnRenamed("direction", "tried").withColumn("fitted", F.explode(names)).where("fitted <> tried")
    pairs = pairs.where(F.element_at(F.split("fitted", "_to_"), -1) == F.element_at(F.split("tried", "_to_"), -1))
    p = logistic.probability(models, "fitted", ["x", "c"])
    return pairs.groupBy("fitted", "tried").agg(F.count("*").alias("n"), F.sum(F.col("event").cast("long")).alias("events"), F.round(F.avg((p - F.col("event")) ** 2), 9).alias("brier"))


@register("two_stage_bootstrap")
def two_stage_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    """Both stages resampled: the source pool's ridge model is refitted with a penalty of its own choice, the target pool's fibers are drawn again.

    Per direction the mean, interval and median of the gain over 2,000 replicates, the share above zero, and how often each penalty
    was chosen, as JSON. Weights come from hashes of replicate and record, so any partitioning gives the same replicates.
    """
    rows = materialise(_scored(spark, d).na.drop(subset=_FEATURES).where("digest is not null").select("record_id", "pool", "digest", *_FEATURES, "score", "cross"), "two-stage")
    ways = T.table(spark, d, "public_fiber_results").select("direction", F.lower(F.trim("source_pool")).alias("source"), F.lower(F.trim("target_pool")).alias("pool")).distinct()
    folds = F.conv(F.substring(F.sha2(F.concat(F.lit("fold|"), F.col("digest")), 256), 1, 8), 16, 10).cast("long") % 5
    models = materialise(twostage.refits(rows.withColumn("fold", folds.cast("int")), "pool", "fold", "record_id", _FEATURES, "score", _REPLICATES, "source"), "two-stage-models")
    cut = B.whole_fibers(B.fibers(B.codebook(rows, ["pool"], "digest", "two-stage", "record_id"), 4), ["pool"], 4)
    packs = cut.groupBy("pool", "fiber").agg(F.array_sort(F.collect_list(F.struct("choice", "cross", *[F.col(f).cast("double").alias(f) for f in _FEATURES]))).alias("m"))  # four to a fiber
    flat = [F.col(f"m.{c}").alias(c) for c in ("cross", *_FEATURES)]
    tried = packs.join(ways, "pool").select("direction", "source", F.concat("direction", F.lit("|"), F.col("fiber").cast("string")).alias("name"), *flat)
    gains = twostage.replicate_gains(tried, models.withColumnRenamed("pool", "source"), "source", "direction", "name", _FEATURES, "cross", _REPLICATES, "fiber")
    per = materialise(gains.join(models.select(F.col("pool").alias("source"), "replicate", "alpha"), ["source", "replicate"]), "two-stage-gains")
    chosen = per.groupBy("direction", "alpha").agg(F.count("*").alias("n")).groupBy("direction")
    chosen = chosen.agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct("alpha", "n"))))).alias("alphas"))  # one entry a penalty
    q = F.percentile("gain", [0.025, 0.5, 0.975])  # one value a replicate
    return per.groupBy("direction").agg(
        F.count("*").alias("replicates"), F.round(F.avg("gain"), 9).alias("mean"), F.round(q[0], 9).alias("low"), F.round(q[1], 9).alias("median"), F.round(q[2], 9).alias("high"),
        F.round(F.avg((F.col("gain") > 0).cast("double")), 6).alias("positive"),
    ).join(chosen, "direction")
