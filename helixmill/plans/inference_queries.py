"""Paired and masked bootstraps, tests, audits and report tables over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixmill.functions import sequence as S
from helixmill.functions.names import name_key
from helixmill.operators import fibers as B
from helixmill.operators import separation, stats
from helixmill.operators.positions import positions
from helixmill.operators.quantiles import with_quantiles
from helixmill.plans import frames as T
from helixmill.plans import stat_queries as Q
from helixmill.plans import table_queries
from helixmill.plans.fiber_queries import measured, whole
from helixmill.plans.registry import register
from helixmill.sources import materialise

_REPLICATES = Q._REPLICATES


def _resampled(rows: str, seed: str, sums: str) -> str:
    """SQL of the sums of each Poisson resample of ``rows`` (direction, record_id...), as ``boot``."""
    return f"""h AS (SELECT {rows}.*, block, sha256('{seed}|' || block || '|' || record_id) AS h FROM {rows}, (SELECT unnest(range({_REPLICATES // 16})) AS block)),
u AS (SELECT * EXCLUDE (h, block), block * 16 + lane AS replicate, CAST('0x' || substr(h, CAST(lane * 4 + 1 AS INTEGER), 4) AS INTEGER) AS u FROM h, (SELECT unnest(range(16)) AS lane)),
d AS (SELECT * EXCLUDE (u), {Q._WEIGHT} AS w FROM u), boot AS (SELECT direction, replicate, {sums} FROM d GROUP BY ALL)"""


_PROPORTIONS = (0.9, 0.75, 0.5, 0.25)
_KEEP = [f"CASE WHEN p < greatest(1, ceil({q}e0 * n)) THEN 1 ELSE 0 END" for q in _PROPORTIONS]


@register(
    "selection_boot",
    f"""WITH {T.MEASURED}, r AS (SELECT direction, record_id, outcome, event, row_number() OVER (PARTITION BY direction ORDER BY prediction DESC, record_id) - 1 AS p, count(*) OVER (PARTITION BY direction) AS n FROM measured WHERE event IS NOT NULL),
{_resampled("r", "select", "sum(w) AS a, sum(w * outcome) AS ay, sum(w * event) AS ae, " + ", ".join(f"sum(w * {k}) AS k{i}, sum(w * {k} * outcome) AS y{i}, sum(w * {k} * event) AS e{i}" for i, k in enumerate(_KEEP)))}
"""
    + " UNION ALL ".join(
        f"""SELECT direction, {q}e0 AS share, round(quantile_cont(y{i} / nullif(k{i}, 0) - ay / nullif(a, 0), 0.025), 9) AS gain_low, round(quantile_cont(y{i} / nullif(k{i}, 0) - ay / nullif(a, 0), 0.975), 9) AS gain_high,
round(quantile_cont(e{i} / nullif(k{i}, 0) - ae / nullif(a, 0), 0.025), 9) AS event_low, round(quantile_cont(e{i} / nullif(k{i}, 0) - ae / nullif(a, 0), 0.975), 9) AS event_high FROM boot GROUP BY direction"""
        for i, q in enumerate(_PROPORTIONS)
    ),
)
def selection_boot(spark: SparkSession, d: str) -> DataFrame:
    """Intervals of what keeping the best-scored share of a direction changes in outcome and event rate; all shares under the same weights.

    Every mask is a column of its rows' ones, outcomes and events, so one pass adds up all masks of all replicates.
    """
    rows = measured(spark, d).where("event is not null").select("record_id", "direction", "outcome", "event", (-F.col("prediction")).alias("worst"))
    n = rows.groupBy("direction").agg(F.count("*").alias("n"))
    placed = positions(rows, ["direction"], ["worst", "record_id"], "p").join(n, "direction")
    values = {"a": F.lit(1), "ay": F.col("outcome"), "ae": F.col("event")}
    for i, q in enumerate(_PROPORTIONS):
        kept = (F.col("p") < F.greatest(F.lit(1), F.ceil(q * F.col("n")))).cast("int")
        values |= {f"k{i}": kept, f"y{i}": kept * F.col("outcome"), f"e{i}": kept * F.col("event")}
    boot = stats.bootstrap_sums(placed.select("direction", "record_id", *[v.alias(c) for c, v in values.items()]), "direction", "record_id", list(values), _REPLICATES, "select")
    change = lambda i, v: F.try_divide(F.col(f"{v}{i}"), F.col(f"k{i}")) - F.try_divide(F.col(f"a{v}"), F.col("a"))
    long = boot.select("direction", F.inline(F.array(*[F.struct(F.lit(q).alias("share"), change(i, "y").alias("gain"), change(i, "e").alias("event")) for i, q in enumerate(_PROPORTIONS)])))
    ends = lambda c: [F.round(F.percentile(c, p), 9).alias(f"{c}_{side}") for side, p in (("low", 0.025), ("high", 0.975))]  # noqa: E731  one value a replicate
    return long.groupBy("direction", "share").agg(*ends("gain"), *ends("event"))


_FOLD = "CAST('0x' || substr(sha256('fold|' || digest), 1, 8) AS BIGINT) % 5"
_METRICS_SQL = {"mae": "b1 / nullif(a, 0) - x1 / nullif(a, 0)", "rmse": "sqrt(b2 / nullif(a, 0)) - sqrt(x2 / nullif(a, 0))"}


@register(
    "metric_delta_boot",
    f"""WITH {T.MEASURED}, f AS (SELECT *, {_FOLD} AS fold FROM measured), m AS (SELECT direction, fold, sum(outcome) AS s, count(*) AS c FROM f GROUP BY ALL), t AS (SELECT direction, sum(s) AS s_, sum(c) AS c_ FROM m GROUP BY direction),
r AS (SELECT direction, record_id, outcome - (s_ - s) / (c_ - c) AS e, outcome - prediction AS x FROM f JOIN m USING (direction, fold) JOIN t USING (direction) WHERE c_ > c),
o AS (SELECT direction, avg(abs(e)) - avg(abs(x)) AS mae, sqrt(avg(e * e)) - sqrt(avg(x * x)) AS rmse FROM r GROUP BY direction),
{_resampled("r", "delta", "sum(w) AS a, sum(w * abs(e)) AS b1, sum(w * e * e) AS b2, sum(w * abs(x)) AS x1, sum(w * x * x) AS x2")}
"""
    + " UNION ALL ".join(f"SELECT direction, '{m}' AS metric, round(any_value({m}), 9) AS gained, round(quantile_cont({x}, 0.025), 9) AS low, round(quantile_cont({x}, 0.975), 9) AS high FROM boot JOIN o USING (direction) GROUP BY direction" for m, x in _METRICS_SQL.items()),
)
def metric_delta_boot(spark: SparkSession, d: str) -> DataFrame:
    """How much smaller the errors of the delivered prediction are than those of the mean of the other folds, with paired intervals.

    Both models' errors of a row carry the same weight in a replicate. Folds go by the SHA-256 of the digest, copies together.
    """
    rows = measured(spark, d).select("record_id", "direction", "digest", "outcome", "prediction")
    rows = rows.withColumn("fold", F.conv(F.substring(F.sha2(F.concat(F.lit("fold|"), "digest"), 256), 1, 8), 16, 10).cast("long") % 5)
    per = rows.groupBy("direction", "fold").agg(F.sum("outcome").alias("s"), F.count("*").alias("c"))
    total = per.groupBy("direction").agg(F.sum("s").alias("s_"), F.sum("c").alias("c_"))
    base = rows.join(per, ["direction", "fold"]).join(total, "direction").where("c_ > c")
    e, x = F.col("outcome") - (F.col("s_") - F.col("s")) / (F.col("c_") - F.col("c")), F.col("outcome") - F.col("prediction")
    errors = materialise(base.select("direction", "record_id", F.lit(1).alias("a"), F.abs(e).alias("b1"), (e * e).alias("b2"), F.abs(x).alias("x1"), (x * x).alias("x2")), "errors")
    names = ["a", "b1", "b2", "x1", "x2"]
    mean = lambda c: F.try_divide(F.col(c), F.col("a"))
    deltas = F.array(F.struct(F.lit("mae").alias("metric"), (mean("b1") - mean("x1")).alias("g")), F.struct(F.lit("rmse").alias("metric"), (F.sqrt(mean("b2")) - F.sqrt(mean("x2"))).alias("g")))
    seen = errors.groupBy("direction").agg(*[F.sum(c).alias(c) for c in names]).select("direction", F.inline(deltas)).select("direction", "metric", F.round("g", 9).alias("gained"))
    boot = stats.bootstrap_sums(errors, "direction", "record_id", names, _REPLICATES, "delta").select("direction", F.inline(deltas))
    ends = boot.groupBy("direction", "metric").agg(F.round(F.percentile("g", 0.025), 9).alias("low"), F.round(F.percentile("g", 0.975), 9).alias("high"))  # one value a replicate
    return seen.join(ends, ["direction", "metric"])


@register(
    "ks_test",
    f"""WITH {Q._SIDES}, c AS (SELECT direction, score, count(*) FILTER (side = 0) AS a, count(*) FILTER (side = 1) AS b FROM sides GROUP BY ALL),
f AS (SELECT direction, sum(a) OVER g AS na, sum(b) OVER g AS nb, abs(sum(a) OVER w / sum(a) OVER g - sum(b) OVER w / sum(b) OVER g) AS gap FROM c WINDOW w AS (PARTITION BY direction ORDER BY score), g AS (PARTITION BY direction)),
k AS (SELECT direction, CAST(any_value(na) AS BIGINT) AS na, CAST(any_value(nb) AS BIGINT) AS nb, round(max(gap), 6) AS ks FROM f GROUP BY direction), t AS (SELECT *, ks * sqrt(na * nb / (na + nb)) AS t FROM k)
SELECT direction, na AS sources, nb AS targets, ks, round(CASE WHEN t < 0.2 THEN 1.0 ELSE least(1.0, greatest(0.0, 2 * list_sum([CASE WHEN i % 2 = 1 THEN 1.0 ELSE -1.0 END * exp(-2 * i * i * t * t) FOR i IN range(1, 101)]))) END, 9) AS p FROM t""",
)
def ks_test(spark: SparkSession, d: str) -> DataFrame:
    """Do the scores of a direction's two pools have one distribution? Distance and asymptotic two-sided p."""
    sides = materialise(Q._sides(spark, d), "ks-sides")
    sizes = sides.groupBy("direction").agg(F.count_if(F.col("side") == 0).alias("sources"), F.count_if(F.col("side") == 1).alias("targets"))
    out = stats.two_sample(sides, ["direction"], "score", "side").join(sizes, "direction")
    return out.select("direction", "sources", "targets", "ks", F.round(stats.ks_p(F.col("ks"), F.col("sources").cast("double"), F.col("targets").cast("double")), 9).alias("p"))


_POOL_WORDS = f"{T.GENERATED}, ways AS (SELECT DISTINCT direction, lower(trim(source_pool)) AS s, lower(trim(target_pool)) AS t FROM public_fiber_results), w AS (SELECT pool, seq, min(record_id) AS id FROM generated WHERE pool IS NOT NULL AND regexp_matches(seq, '^[ACGT]{{108}}$') GROUP BY pool, seq)"


@register(
    "hamming_audit",
    f"""WITH {_POOL_WORDS}, n AS (SELECT direction, a.id AS query, min((hamming(a.seq, b.seq), b.id)) AS m FROM ways JOIN w a ON a.pool = t JOIN w b ON b.pool = s AND a.id <> b.id WHERE a.id % 20 = 0 GROUP BY ALL), x AS (SELECT direction, query, m[1] AS distance, m[2] AS neighbour FROM n),
c AS (SELECT direction, min((distance, query, neighbour)) AS c FROM x GROUP BY direction)
SELECT direction, count(*) AS asked, CAST(any_value(c)[1] AS BIGINT) AS least, any_value(c)[2] AS closest, any_value(c)[3] AS closest_source, round(avg(distance), 9) AS mean, count(*) FILTER (distance <= 8) AS near,
round(quantile_cont(distance, 0.01), 6) AS q01, round(quantile_cont(distance, 0.05), 6) AS q05, round(quantile_cont(distance, 0.5), 6) AS median, CAST(max(distance) AS BIGINT) AS most FROM x JOIN c USING (direction) GROUP BY direction""",
)
def hamming_audit(spark: SparkSession, d: str) -> DataFrame:
    """How far a direction's target words (the query set: ids divisible by 20) are from all its source words: quantiles and the closest pair."""
    rows = T.generated(spark, d, "pool", "seq").where(F.col("pool").isNotNull() & S.is_dna("seq") & (F.length("seq") == S.LENGTH))
    words = materialise(rows.groupBy("pool", "seq").agg(F.min("record_id").alias("id")), "pool-words")
    ways = T.table(spark, d, "public_fiber_results").select("direction", name_key("source_pool").alias("source"), name_key("target_pool").alias("target")).distinct()
    asked = words.where("id % 20 = 0").join(ways, F.col("pool") == F.col("target")).select("direction", "id", "seq")
    given = words.join(ways, F.col("pool") == F.col("source")).select("direction", "id", "seq")
    near = materialise(separation.nearest(asked, given, "id", "seq", S.LENGTH, ("direction",)), "audit")
    closest = F.min(F.struct("distance", "query", "neighbour"))
    out = near.groupBy("direction").agg(F.count("*").alias("asked"), closest.alias("c"), F.round(F.avg("distance"), 9).alias("mean"), F.count_if(F.col("distance") <= 8).alias("near"), F.max("distance").alias("most"))
    out = out.select("direction", "asked", F.col("c.distance").alias("least"), F.col("c.query").alias("closest"), F.col("c.neighbour").alias("closest_source"), "mean", "near", "most")
    return with_quantiles(out, near, ["direction"], "distance", {"q01": 0.01, "q05": 0.05, "median": 0.5}, 6)


@register(
    "negative_fibers",
    f"""WITH {T.FIBERS}, g AS (SELECT direction, outcome - fiber_mean AS g FROM best WHERE first_ = 1), s AS (SELECT direction, stddev_pop(outcome) AS sd FROM whole GROUP BY direction)
SELECT direction, count(*) AS fibers, round(quantile_cont(g, 0.01), 9) AS q01, round(quantile_cont(g, 0.05), 9) AS q05, round(quantile_cont(g, 0.25), 9) AS q25, round(quantile_cont(g, 0.5), 9) AS median, round(quantile_cont(g, 0.75), 9) AS q75, round(quantile_cont(g, 0.95), 9) AS q95,
round(avg(CASE WHEN g < 0 THEN 1.0 ELSE 0.0 END), 6) AS negative, round(avg(CASE WHEN abs(g) <= 0.01 * sd THEN 1.0 ELSE 0.0 END), 6) AS near_zero, round(avg(g) FILTER (g < 0), 9) AS mean_loss FROM g JOIN s USING (direction) GROUP BY direction""",
)
def negative_fibers(spark: SparkSession, d: str) -> DataFrame:
    """How gains spread over a direction's fibers: quantiles, shares below zero and within a hundredth of a deviation of it, and the mean loss."""
    rows = materialise(whole(spark, d), "negative-fibers")
    sd = rows.groupBy("direction").agg(F.stddev_pop("outcome").alias("sd"))
    g = materialise(B.gains(rows, ["direction"], "prediction", "outcome").select("direction", "gain"), "negative-gains").join(sd, "direction")
    out = g.groupBy("direction").agg(
        F.count("*").alias("fibers"), F.round(F.avg((F.col("gain") < 0).cast("double")), 6).alias("negative"), F.round(F.avg((F.abs("gain") <= 0.01 * F.col("sd")).cast("double")), 6).alias("near_zero"),
        F.round(F.avg(F.when(F.col("gain") < 0, F.col("gain"))), 9).alias("mean_loss"),
    )
    return with_quantiles(out, g.select("direction", "gain"), ["direction"], "gain", {"q01": 0.01, "q05": 0.05, "q25": 0.25, "median": 0.5, "q75": 0.75, "q95": 0.95}, 9)


_LONG = " UNION ALL ".join(f"SELECT pool, {i} AS place, '{m}' AS feature, CAST({m} AS DOUBLE) AS v, score >= 1.0 AS high FROM generated WHERE isfinite(score) AND {m} IS NOT NULL" for i, m in enumerate(table_queries._MEASURES))


@register(
    "largest_smd",
    f"WITH {T.GENERATED}, long AS ({_LONG}), s AS (SELECT pool, place, feature, round((avg(v) FILTER (high) - avg(v) FILTER (NOT high)) / nullif(sqrt((var_samp(v) FILTER (high) + var_samp(v) FILTER (NOT high)) / 2), 0), 6) AS smd FROM long WHERE pool IS NOT NULL GROUP BY ALL) "
    "SELECT pool, feature, smd FROM (SELECT *, row_number() OVER (PARTITION BY pool ORDER BY abs(smd) DESC, place) AS p FROM s WHERE smd IS NOT NULL) WHERE p = 1",
)
def largest_smd(spark: SparkSession, d: str) -> DataFrame:
    """The feature that differs most between high and low scores of a pool, the first listed on ties."""
    place = F.array_position(F.array(*[F.lit(m) for m in table_queries._MEASURES]), F.col("feature"))
    best = F.max_by(F.struct("feature", "smd"), F.struct(F.abs("smd"), -place))
    return table_queries.smd_pooled(spark, d).where("smd is not null").groupBy("pool").agg(best.alias("b")).select("pool", "b.feature", "b.smd")


@register(
    "event_table",
    f"""WITH {T.PUBLIC}, e AS (SELECT * FROM public_ WHERE direction IS NOT NULL AND event IS NOT NULL)
SELECT direction, 'library' AS selector, CAST(NULL AS INTEGER) AS bits, count(*) AS rows_, CAST(sum(event) AS BIGINT) AS events, round(avg(event), 9) AS rate FROM e GROUP BY direction
UNION ALL SELECT direction, model, bits, count(*), CAST(sum(event) AS BIGINT), round(avg(event), 9) FROM e WHERE model IS NOT NULL AND bits IS NOT NULL GROUP BY direction, model, bits""",
)
def event_table(spark: SparkSession, d: str) -> DataFrame:
    """Low-efficiency events: a reference row a direction, and one a selector and width of it."""
    rows = T.public(spark, d, "direction", "model", "bits", "event").where("direction is not null and event is not null")
    sums = [F.count("*").alias("rows_"), F.sum(F.col("event").cast("long")).alias("events"), F.round(F.avg("event"), 9).alias("rate")]
    detail = rows.where("model is not null and bits is not null").groupBy("direction", F.col("model").alias("selector"), "bits").agg(*sums)
    return rows.groupBy("direction").agg(*sums).withColumn("selector", F.lit("library")).unionByName(detail, allowMissingColumns=True)


@register(
    "event_gate",
    f"WITH {T.MEASURED}, e AS (SELECT direction, count(*) AS rows_, CAST(coalesce(sum(event), 0) AS BIGINT) AS events FROM measured GROUP BY direction) SELECT *, CASE WHEN events >= 100 THEN 'nested' WHEN events >= 30 THEN 'undefined' ELSE 'descriptive' END AS analysis FROM e",
)
def event_gate(spark: SparkSession, d: str) -> DataFrame:
    """What a direction's number of events allows: nested models from 100 on, description only under 30, neither between."""
    e = measured(spark, d).groupBy("direction").agg(F.count("*").alias("rows_"), F.coalesce(F.sum(F.col("event").cast("long")), F.lit(0)).alias("events"))
    return e.withColumn("analysis", F.when(F.col("events") >= 100, "nested").when(F.col("events") >= 30, "undefined").otherwise("descriptive"))


@register(
    "interval_join",
    f"""WITH {Q._BOOT}, i AS (SELECT lower(trim(direction)) AS key, quantile_cont(mean, 0.025) AS low, quantile_cont(mean, 0.975) AS high FROM boot GROUP BY 1), {table_queries._RESULTS}
SELECT results.direction, model, bits, stated_gain, round(low, 9) AS low, round(high, 9) AS high, stated_gain >= low AND stated_gain <= high AS inside FROM results LEFT JOIN i ON results.direction = key""",
)
def interval_join(spark: SparkSession, d: str) -> DataFrame:
    """Every stated gain with the interval found for its direction, null where there is none, and whether the interval holds it."""
    boot = stats.bootstrap_means(Q._gains(spark, d), "direction", "name", "gain", _REPLICATES, "boot")
    q = F.percentile("mean", [0.025, 0.975])  # one value a replicate
    ends = boot.groupBy(F.lower(F.trim("direction")).alias("direction")).agg(q[0].alias("low"), q[1].alias("high"))
    inside = (F.col("stated_gain") >= F.col("low")) & (F.col("stated_gain") <= F.col("high"))
    joined = table_queries._results(spark, d).join(ends, "direction", "left")
    return joined.select("direction", "model", "bits", "stated_gain", F.round("low", 9).alias("low"), F.round("high", 9).alias("high"), inside.alias("inside"))


_CHECKS = {"payload": "base_rank >> bits = payload", "choice": "base_rank % (1 << bits) = choice", "decoded": "decoded_payload = payload"}


@register(
    "decode_failures",
    f"WITH {T.PUBLIC} " + " UNION ALL ".join(f"SELECT direction, '{n}' AS test, count(*) AS rows_, count(*) FILTER (NOT ({c})) AS failed, count(*) FILTER (({c}) IS NULL) AS unknown FROM public_ WHERE bits IS NOT NULL GROUP BY direction" for n, c in _CHECKS.items()),
)
def decode_failures(spark: SparkSession, d: str) -> DataFrame:
    """The failures of a direction's round trips, one row a test; rows without a value are unknown."""
    t = T.public(spark, d, "direction", "bits", "base_rank", "payload", "choice", "decoded_payload").where("bits is not null")
    held = {"payload": F.expr("shiftright(base_rank, bits) = payload"), "choice": F.expr("base_rank % shiftleft(1L, bits) = choice"), "decoded": F.expr("decoded_payload = payload")}
    wide = t.groupBy("direction").agg(F.count("*").alias("rows_"), *[F.count_if(~x).alias(f"f_{n}") for n, x in held.items()], *[F.count_if(x.isNull()).alias(f"u_{n}") for n, x in held.items()])
    return wide.select("direction", F.inline(F.array(*[F.struct(F.lit(n).alias("test"), F.col("rows_"), F.col(f"f_{n}").alias("failed"), F.col(f"u_{n}").alias("unknown")) for n in held])))


@register(
    "paired_selectors",
    f"WITH {T.FIBERS}, p AS (SELECT direction, fiber, max(outcome) FILTER (first_ = 1) - max(outcome) FILTER (last_ = 1) AS d FROM best GROUP BY ALL) SELECT direction, count(*) AS fibers, round(avg(d), 9) AS difference, round(stddev_samp(d) / sqrt(count(*)), 9) AS error, count(*) FILTER (d > 0) AS won, count(*) FILTER (d < 0) AS lost FROM p GROUP BY direction",
)
def paired_selectors(spark: SparkSession, d: str) -> DataFrame:
    """The best-scored against the worst-scored choice of the same fiber, paired by conditional sums in one pass."""
    ranked = B.ranked_choices(whole(spark, d), ["direction"], "prediction").withColumn("low", F.struct("key", "choice"))
    diff = F.max(F.when(F.col("place") == 1, F.col("outcome"))) - F.min_by("outcome", "low")
    per = ranked.groupBy("direction", "fiber").agg(diff.alias("d"))
    return per.groupBy("direction").agg(
        F.count("*").alias("fibers"), F.round(F.avg("d"), 9).alias("difference"), F.round(F.stddev_samp("d") / F.sqrt(F.count("*")), 9).alias("error"), F.count_if(F.col("d") > 0).alias("won"), F.count_if(F.col("d") < 0).alias("lost")
    )


@register(
    "missing_references",
    f"WITH {T.GENERATED}, {T.PUBLIC}, c AS (SELECT digest, count(*) AS n FROM public_ WHERE digest IS NOT NULL GROUP BY digest), r AS (SELECT record_id, pool, coalesce(n, 0) AS n FROM generated LEFT JOIN c USING (digest) WHERE pool IS NOT NULL) SELECT pool, count(*) AS references_, count(*) FILTER (n = 0) AS missing, CAST(sum(n) AS BIGINT) AS reads FROM r GROUP BY pool",
)
def missing_references(spark: SparkSession, d: str) -> DataFrame:
    """References of each pool, those never counted, and the counts, 0 where there is none."""
    counts = T.public(spark, d, "digest").where("digest is not null").groupBy("digest").agg(F.count("*").alias("n"))
    rows = T.generated(spark, d, "pool", "digest").where("pool is not null").join(counts, "digest", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return rows.groupBy("pool").agg(F.count("*").alias("references_"), F.count_if(F.col("n") == 0).alias("missing"), F.sum("n").alias("reads"))
