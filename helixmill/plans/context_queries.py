"""The choice codec with the full context model: candidates, their features, a fitted coefficient table, the best choice."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixmill.functions import sequence as S
from helixmill.functions.language import Language
from helixmill.functions.names import name_key
from helixmill.operators import codec, members, ridge, stats, stems
from helixmill.plans import frames as T
from helixmill.plans.registry import register
from helixmill.sources import materialise, spread

NAMESPACE = "helixmill-language"
FEATURES = [
    "gc_deviation", "longest_run", "share_a", "share_c", "share_g", "share_t", "own_pairs", "own_weighted", "own_longest", "full_pairs", "full_weighted", "full_longest",
    *(f"{side}_{adapter}_{kind}" for side in ("left", "right") for adapter in ("left", "right") for kind in ("tract", "words")),
]
_COMPOSITION = FEATURES[:6]
#: Nested sets of features, from composition alone to the full context.
MODELS = {"composition": _COMPOSITION, "proxy": [*_COMPOSITION, "own_weighted"], "adapters": [*_COMPOSITION, *FEATURES[12:]], "combined": [*_COMPOSITION, *FEATURES[12:], "own_weighted"], "amplicon": [*_COMPOSITION, "full_weighted"], "context": FEATURES}
FOLDS = 5


def fold_of(seq: str, folds: int = FOLDS, seed: str = "fold") -> Column:
    """The fold of a sequence, from its SHA-256: copies of one sequence stay together, in every engine and partitioning."""
    return F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}|"), F.col(seq)), 256), 1, 8), 16, 10).cast("long") % folds


def _featured(spark: SparkSession, d: str, features: Callable[[DataFrame], DataFrame] = stems.features) -> DataFrame:
    rows = T.generated(spark, d, "pool", "seq", "score", "cross").where(F.col("pool").isNotNull() & S.is_dna("seq") & (F.length("seq") >= S.BOUNDARY) & S.finite("score"))
    return materialise(rows.join(features(rows.select("seq").distinct()), "seq"), "context-features")


def _grams(rows: DataFrame) -> dict[str, list]:
    """The moments of all features and the score in each pool and fold, five small rows a pool: one pass serves every model."""
    out: dict[str, list] = {}
    for r in ridge.moments(rows.withColumn("fold", fold_of("seq")), ["pool", "fold"], FEATURES, "score").orderBy("pool", "fold").collect():
        out.setdefault(r["pool"], []).append(ridge.gram(r.asDict(), FEATURES, "score"))
    return {pool: grams for pool, grams in sorted(out.items()) if len(grams) > 1}


def _of_model(grams: list[np.ndarray], features: list[str]) -> list[np.ndarray]:
    at = [0, *(FEATURES.index(f) + 1 for f in features), len(FEATURES) + 1]
    return [g[np.ix_(at, at)] for g in grams]


def _fits(featured: DataFrame) -> list[tuple]:
    """(pool, alpha, intercept, coefficients...) of each pool's full context model of the delivered score."""
    out = []
    for pool, grams in _grams(featured).items():
        alpha = ridge.best_alpha(grams)
        intercept, beta = ridge.solve(sum(grams), alpha)
        out.append((pool, alpha, intercept, *map(float, beta)))
    return out


def context_models(spark: SparkSession, d: str) -> DataFrame:
    """(pool, alpha, intercept, b_feature...) of each pool's full context model of the delivered score, one row a pool."""
    return spark.createDataFrame(_fits(_featured(spark, d)), "pool string, alpha double, intercept double, " + ", ".join(f"b_{f} double" for f in FEATURES))


def linear(prefix: str = "") -> Column:
    """The coefficient table applied to a feature row, in table order."""
    return reduce(lambda a, f: a + F.col(f"{prefix}b_{f}") * F.col(f), FEATURES, F.col(f"{prefix}intercept"))


def scored_members(spark: SparkSession, d: str, models: DataFrame | None = None, namespace: str = NAMESPACE) -> DataFrame:
    """(record_id, pool, bits, choice, seq, score, features...): every member of every sample's fiber; null words and scores beyond the domain."""
    rows = T.generated(spark, d, "pool", "payload_rank", "bits").where("pool is not null and payload_rank is not null and bits is not null")
    wide = stems.features(codec.candidates(spread(rows), Language(), namespace), dealt=True)  # each member is featured where it is made
    return wide.join(context_models(spark, d) if models is None else models, "pool", "left").withColumn("score", linear())


@register("codec_encode_context")
def codec_encode_context(spark: SparkSession, d: str) -> DataFrame:
    """Encoding by the full context: of each payload's 2 ** bits words the one whose whole-number score is highest, the smallest index on ties.

    Status ``encoded``, ``beyond`` for a payload outside the domain, ``no model`` for a pool without a fit.
    """
    members = scored_members(spark, d).withColumn("key", F.when(F.col("score").isNotNull(), S.score_key("score")))
    best = F.max_by(F.struct("choice", "seq", "key"), F.struct("key", -F.col("choice")))
    out = members.groupBy("record_id", "pool", "bits").agg(F.when(F.count("key") > 0, best).alias("b"), F.count("*").alias("candidates"), F.count("seq").alias("words"))
    status = F.when(F.col("words") == 0, "beyond").when(F.col("b").isNull(), "no model").otherwise("encoded")
    return out.select("record_id", "pool", "bits", "candidates", status.alias("status"), "b.choice", "b.seq", "b.key")


@register("generated_fiber_gains")
def generated_fiber_gains(spark: SparkSession, d: str) -> DataFrame:
    """What the choices gain over their fibers, under the pool's own model and under its cross evaluator's.

    Per pool, cross pool and selector width: fibers, mean, quartiles and extremes of the gains, and the fractions of negative and zero ones.
    """
    cross = T.table(spark, d, "generated_fiber_results").select(name_key("selector_source_pool").alias("pool"), name_key("cross_evaluator_pool").alias("cross_pool")).where("pool <> cross_pool").distinct()
    models = context_models(spark, d)
    theirs = models.select(F.col("pool").alias("cross_pool"), *[F.col(c).alias(f"x_{c}") for c in models.columns if c not in ("pool", "alpha")])
    both = scored_members(spark, d).where("score is not null").join(cross, "pool").join(theirs, "cross_pool").withColumn("cross_score", linear("x_"))
    best = F.max_by(F.struct("score", "cross_score"), F.struct(S.score_key("score"), -F.col("choice")))
    fibers = both.groupBy("record_id", "pool", "cross_pool", "bits").agg(best.alias("b"), F.avg("score").alias("own_mean"), F.avg("cross_score").alias("cross_mean"))
    gains = fibers.select("pool", "cross_pool", "bits", (F.col("b.score") - F.col("own_mean")).alias("own"), (F.col("b.cross_score") - F.col("cross_mean")).alias("cross"))
    out = [F.count("*").alias("fibers")]
    for side in ("own", "cross"):
        q = F.approx_percentile(side, [0.25, 0.5, 0.75], 10_000)
        out += [F.round(F.avg(side), 12).alias(f"{side}_mean"), F.round(F.min(side), 12).alias(f"{side}_least"), F.round(F.max(side), 12).alias(f"{side}_most")]
        out += [F.round(q[i], 12).alias(f"{side}_q{p}") for i, p in enumerate((25, 50, 75))]
        out += [F.avg((F.col(side) < 0).cast("double")).alias(f"{side}_negative"), F.avg((F.col(side) == 0).cast("double")).alias(f"{side}_zero")]
    return gains.groupBy("pool", "cross_pool", "bits").agg(*out)


_NAMESPACES = 8


@register("generated_namespaces")
def generated_namespaces(spark: SparkSession, d: str) -> DataFrame:
    """How much the mean gain of a pool and width depends on the namespace that spreads its payloads: least, median and most of eight.

    Each namespace sends the payloads to other words, so every one expands, features and scores all fibers anew under the same models.
    """
    rows = T.generated(spark, d, "pool", "payload_rank", "bits").where("pool is not null and payload_rank is not null and bits is not null")
    records = rows.groupBy("record_id", "pool", "bits").agg(F.collect_list("payload_rank").alias("payloads"))
    fits = {pool: [intercept, *beta] for pool, _, intercept, *beta in _fits(_featured(spark, d, lambda df: members.features(df, FEATURES)))}
    parts = members.namespace_gains(spread(records), Language(), [f"{NAMESPACE}-{i}" for i in range(_NAMESPACES)], fits)
    per = parts.groupBy("pool", "bits", "namespace").agg((F.sum("gain") / F.sum("fibers")).alias("gain"), F.sum("fibers").alias("fibers"))
    return per.groupBy("pool", "bits").agg(
        F.count("*").alias("namespaces"), F.sum("fibers").alias("fibers"), F.round(F.min("gain"), 12).alias("least"), F.round(F.percentile("gain", 0.5), 12).alias("median"), F.round(F.max("gain"), 12).alias("most"),
        F.count_if(F.col("gain") > 0).alias("positive"),
    )


@register("coefficient_summary")
def coefficient_summary(spark: SparkSession, d: str) -> DataFrame:
    """Per model and feature, over the fits of all pools with one fold left out: median, quartiles and signs of the standardised coefficient."""
    every, out = _grams(_featured(spark, d)), []
    for name, features in MODELS.items():
        for pool, all_ in every.items():
            grams = _of_model(all_, features)
            for held in grams:
                g = sum(grams) - held
                sd = np.sqrt(np.maximum(np.diag(g)[1:-1] / g[0, 0] - (g[0, 1:-1] / g[0, 0]) ** 2, 0))
                _, beta = ridge.solve(g, ridge.best_alpha([h for h in grams if h is not held] if len(grams) > 2 else grams))
                out += [(name, pool, f, float(b)) for f, b in zip(features, beta * sd)]
    fits = spark.createDataFrame(out, "model string, pool string, feature string, b double")  # one row a model, pool, fold and feature
    q = F.percentile("b", [0.25, 0.5, 0.75])
    return fits.groupBy("model", "feature").agg(
        F.count("*").alias("fits"), *[F.round(q[i], 12).alias(n) for i, n in enumerate(("q25", "median", "q75"))],
        F.count_if(F.col("b") > 0).alias("positive"), F.count_if(F.col("b") < 0).alias("negative"), F.count_if(F.col("b") == 0).alias("zero"),
    )


@register("ridge_nested_cv")
def ridge_nested_cv(spark: SparkSession, d: str) -> DataFrame:
    """Nested cross-validation of every set of features: per pool and model the held-out rows, penalties chosen, and R squared.

    Each fold is held out once; the others choose the penalty among themselves and fit. All from the moments of each pool and fold.
    """
    every, out = _grams(_featured(spark, d)), []
    for name, features in MODELS.items():
        for pool, all_ in every.items():
            grams = _of_model(all_, features)
            if len(grams) < 3:
                continue
            error, alphas, whole = 0.0, [], sum(grams)
            for held in grams:
                inner = [g for g in grams if g is not held]
                alphas.append(ridge.best_alpha(inner))
                error += ridge.squared_error(held, *ridge.solve(whole - held, alphas[-1]))
            spread_ = whole[-1, -1] - whole[0, -1] ** 2 / whole[0, 0]
            out.append((pool, name, len(features), int(whole[0, 0]), min(alphas), max(alphas), round(float(1 - error / spread_), 9) if spread_ > 0 else None))
    return spark.createDataFrame(out, "pool string, model string, features int, n long, least_alpha double, most_alpha double, r_squared double")


@register("ridge_transfer")
def ridge_transfer(spark: SparkSession, d: str) -> DataFrame:
    """Every model fitted on one pool and tried on every other: rows, rank correlation with the other pool's score, mean squared error."""
    rows = _featured(spark, d)
    every, fitted = _grams(rows), []
    for name, features in MODELS.items():
        for pool, all_ in every.items():
            grams = _of_model(all_, features)
            intercept, beta = ridge.solve(sum(grams), ridge.best_alpha(grams))
            own = dict(zip(features, map(float, beta)))
            fitted.append((pool, name, intercept, *[own.get(f, 0.0) for f in FEATURES]))
    models = spark.createDataFrame(fitted, "source string, model string, intercept double, " + ", ".join(f"b_{f} double" for f in FEATURES))
    ways = T.table(spark, d, "public_fiber_results").select(name_key("source_pool").alias("source"), name_key("target_pool").alias("pool")).distinct()
    tried = materialise(rows.join(ways, "pool").join(models, "source").select("source", "pool", "model", "score", linear().alias("predicted")), "context-transfer")
    group = ["source", "pool", "model"]
    error = tried.groupBy(*group).agg(F.round(F.avg((F.col("predicted") - F.col("score")) ** 2), 12).alias("squared_error"))
    return stats.spearman(tried.withColumn("predicted", F.round("predicted", 12)), group, "predicted", "score").join(error, group)
