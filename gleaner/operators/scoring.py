"""Logistic scoring model: preprocessing, fitting, scoring, threshold choice."""

from __future__ import annotations

import datetime as dt
import math
import sys
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.ml.classification import (
    LogisticRegression,
    RandomForestClassificationModel,
    RandomForestClassifier,
)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleaner.config import (
    FEATURE_VERSION,
    NUMERIC_FEATURES,
    RETRIEVAL_TOP_K,
    SOURCE_TYPES,
)
from gleaner.functions.text import count_tokens
from gleaner.operators import metrics, retrieval, rules
from gleaner.operators.features import extract_features
from gleaner.plans.ordering import slice_of
from gleaner.plans.sizing import broadcast_if, fits_broadcast, materialise

ONE_HOT = tuple(f"is_{t}" for t in SOURCE_TYPES)
MODEL_COLUMNS = (*NUMERIC_FEATURES, *ONE_HOT)
THRESHOLDS = [step / 100 for step in range(5, 95, 5)]


@dataclass(frozen=True)
class Scaler:
    mean: tuple[float, ...]
    std: tuple[float, ...]


@dataclass(frozen=True)
class LogisticModel:
    """Fitted parameters: nine scaled features, four indicators, intercept."""

    scaler: Scaler
    coef: tuple[float, ...]
    intercept: float

    def vector(self) -> tuple[float, ...]:
        return (*self.coef, self.intercept)


@dataclass(frozen=True)
class Metadata:
    corpus_id: str
    trained_at: str
    feature_version: str
    train_examples: int
    val_examples: int
    test_examples: int
    threshold: float
    val_metrics: dict
    test_metrics: dict


# What the retention rules need of a scored pair.
PRUNED = ("query_id", "chunk_id", "doc_id", "position", "rank", "retrieval_score", "score", "tokens")


def fit_scaler(features: DataFrame) -> Scaler:
    """Means and population deviations in one aggregate.

    A column that is constant up to rounding is left unscaled."""
    row = features.agg(
        F.count("*").alias("n"),
        *[F.avg(c).alias(f"m_{c}") for c in NUMERIC_FEATURES],
        *[F.stddev_pop(c).alias(f"s_{c}") for c in NUMERIC_FEATURES],
    ).first()
    means = [float(row[f"m_{c}"] or 0.0) for c in NUMERIC_FEATURES]
    stds = [float(row[f"s_{c}"] or 0.0) for c in NUMERIC_FEATURES]
    slack = row["n"] * sys.float_info.epsilon
    varies = [s * s > slack * s * s + (slack * m) ** 2 for s, m in zip(stds, means)]
    return Scaler(mean=tuple(means), std=tuple(s if v else 1.0 for s, v in zip(stds, varies)))


def model_columns(scaler: Scaler) -> list[Column]:
    """Scaled numeric columns, then one indicator per source type (an unknown
    type is all zeros)."""
    scaled = [
        ((F.col(c) - F.lit(m)) / F.lit(s)).alias(c)
        for c, m, s in zip(NUMERIC_FEATURES, scaler.mean, scaler.std)
    ]
    hot = [
        F.coalesce((F.col("source_type") == t).cast("double"), F.lit(0.0)).alias(n)
        for t, n in zip(SOURCE_TYPES, ONE_HOT)
    ]
    return [*scaled, *hot]


def features_to_frame(features: DataFrame, scaler: Scaler, *keep: str) -> DataFrame:
    """Model columns in fixed order, assembled to ``features``."""
    frame = features.select(*keep, *model_columns(scaler))
    return VectorAssembler(inputCols=list(MODEL_COLUMNS), outputCol="features").transform(frame)


def balanced_weights(examples: DataFrame, label: str = "label", least_classes: int = 0) -> DataFrame:
    """Weight ``n / (classes * n_class)`` per row; fewer than ``least_classes`` classes raise.

    Class counts come from one aggregate (two groups), not from a window over a
    class, which would pull a class into one task."""
    counts = {r[label]: r["n"] for r in examples.groupBy(label).agg(F.count("*").alias("n")).collect()}
    if len(counts) < least_classes:
        raise ValueError("training needs both relevant and irrelevant examples")
    if not counts:
        return examples.withColumn("weight", F.lit(1.0))
    total = sum(counts.values())
    weight = F.lit(None).cast("double")
    for value, n in counts.items():
        weight = F.when(F.col(label) == value, total / (len(counts) * n)).otherwise(weight)
    return examples.withColumn("weight", weight)


def fit_logistic(examples: DataFrame, label: str = "label") -> LogisticModel:
    """Weighted logistic loss with L2 1e-4 over balanced classes."""
    weighted = balanced_weights(examples, label, least_classes=2)
    scaler = fit_scaler(examples)
    frame = features_to_frame(weighted, scaler, label, "weight")
    fitted = LogisticRegression(
        labelCol=label,
        weightCol="weight",
        regParam=1e-4,
        elasticNetParam=0.0,
        standardization=False,
    ).fit(frame)
    return LogisticModel(
        scaler, tuple(float(x) for x in fitted.coefficients), float(fitted.intercept)
    )


def fit_forest(
    examples: DataFrame, scaler: Scaler, label: str = "label", trees: int = 200, seed: int = 0
) -> RandomForestClassificationModel:
    """The alternative classifier on the same preprocessing and weights."""
    frame = features_to_frame(balanced_weights(examples, label), scaler, label, "weight")
    return RandomForestClassifier(
        labelCol=label, weightCol="weight", numTrees=trees, maxDepth=6, seed=seed
    ).fit(frame)


def score_forest(
    model: RandomForestClassificationModel, scaler: Scaler, features: DataFrame, *keep: str
) -> DataFrame:
    scored = model.transform(features_to_frame(features, scaler, *keep))
    return scored.select(
        *keep, F.get(vector_to_array("probability"), F.lit(1)).alias("score")
    )


def probability(model: LogisticModel) -> Column:
    """Probability of relevance as plain column arithmetic."""
    z = F.lit(model.intercept)
    for w, x in zip(model.coef, model_columns(model.scaler)):
        z = z + F.lit(w) * x
    return 1 / (1 + F.exp(-z))


def predict(features: DataFrame, model: LogisticModel, name: str = "score") -> DataFrame:
    return features.withColumn(name, probability(model))


NO_MODEL = "no model"


def predict_or_explain(features: DataFrame, model: LogisticModel | None, version: str | None = None) -> DataFrame:
    """Adds score, ``score_error`` and ``model_version``.

    A row that cannot be scored has no score and says why: there is no model, or which
    feature (the first in model order) is missing or not a number.  It raises nothing,
    so one bad row only disables pruning for its own question.
    """
    if model is None:
        nothing = {"score": F.lit(None).cast("double"), "score_error": F.lit(NO_MODEL), "model_version": F.lit(None).cast("string")}
        return features.withColumns(nothing)
    missing = lambda c: F.col(c).isNull() | F.isnan(F.col(c).cast("double"))
    error = F.coalesce(*[F.when(missing(c), F.lit(f"feature {c} is missing")) for c in NUMERIC_FEATURES])
    found = predict(features.withColumn("score_error", error), model)
    return found.withColumns({"score": F.when(F.col("score_error").isNull(), F.col("score")), "model_version": F.lit(version)})


def threshold_table(
    scored: DataFrame, label: str = "label", score: str = "score", keys: Sequence[str] = ()
) -> DataFrame:
    """F1 at every candidate threshold.

    Scores are counted by the number of thresholds they clear (at most nineteen
    groups per key, combined on the map side); the rest is suffix sums over those
    few rows.  A null score clears none."""
    clears = F.coalesce(F.when(F.col(score).isNotNull(), slice_of(F.col(score), THRESHOLDS)), F.lit(0))
    cleared = scored.groupBy(*keys, clears.alias("_b")).agg(
        F.count(F.when(F.col(label) == 1, 1)).alias("pos"),
        F.count(F.when(F.col(label) == 0, 1)).alias("neg"),
    )
    per_key = cleared.groupBy(*keys).agg(F.collect_list(F.struct("_b", "pos", "neg")).alias("_h"))
    candidates = F.array(*[F.struct(F.lit(i + 1).alias("i"), F.lit(t).alias("threshold")) for i, t in enumerate(THRESHOLDS)])
    counted = per_key.select(*keys, "_h", F.inline(candidates))
    over = lambda field, test: F.aggregate(
        F.filter("_h", test), F.lit(0).cast("long"), lambda a, x: a + x[field]
    )
    counts = counted.select(
        *keys,
        "threshold",
        over("pos", lambda x: x["_b"] >= F.col("i")).alias("tp"),
        over("pos", lambda x: x["_b"] < F.col("i")).alias("fn"),
        over("neg", lambda x: x["_b"] >= F.col("i")).alias("fp"),
    )
    return metrics.rates_from_counts(counts, [*keys, "threshold"])


def select_threshold(
    scored: DataFrame, label: str = "label", score: str = "score", keys: Sequence[str] = ()
) -> DataFrame:
    """The candidate with the best F1, the lowest on ties (18 rows per key)."""
    table = threshold_table(scored, label, score, keys)
    if not keys:
        return table.orderBy(F.col("f1").desc(), "threshold").limit(1).select("threshold", "f1")
    best = Window.partitionBy(*keys).orderBy(F.col("f1").desc(), "threshold")
    return (
        table.withColumn("_r", F.row_number().over(best))
        .filter(F.col("_r") == 1)
        .select(*keys, "threshold", "f1")
    )


def rank_with_features(
    queries: DataFrame,
    chunks: DataFrame,
    k: int = RETRIEVAL_TOP_K,
    scope: Sequence[str] = (),
    retriever: retrieval.Retriever | None = None,
    token_count=count_tokens,
    postings: retrieval.Postings | None = None,
    fetch: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Retrieve and featurise: keys, feature columns, ``retrieval_score, tokens``.

    Postings of the chunks, where they are at hand, save reading the text; ``fetch``
    gives chunk rows for ranked ones, so that only their documents are read.
    """
    if retriever:
        ranked = retriever(queries, chunks, k)
    else:
        ranked = materialise(retrieval.retrieve(queries, chunks if postings is None else postings, k, scope=scope))
    keys = [*scope, "query_id"]
    bound = queries.count() * k
    pairs = retrieval.with_chunk_columns(
        ranked,
        fetch(ranked) if fetch else chunks,
        ["doc_id", "position", "text", "doc_title", "heading", "source_type"],
        scope,
        max_rows=bound,
    )
    texts = queries.select(*keys, "query_text")
    pairs = pairs.join(broadcast_if(fits_broadcast(texts, "query_text"), texts), keys)
    counted = pairs.withColumn("tokens", token_count(F.col("text")))
    # tokens rides with the chunk id so that text stops here
    features = extract_features(
        counted.withColumn("chunk_id", F.struct("chunk_id", "tokens")), keys
    )
    return features.select(
        *keys,
        F.col("chunk_id.chunk_id").alias("chunk_id"),
        F.col("chunk_id.tokens").alias("tokens"),
        *[c for c in features.columns if c not in (*keys, "chunk_id", "score")],
        F.col("score").alias("retrieval_score"),
    )


def build_examples(
    queries: DataFrame,
    chunks: DataFrame,
    evidence: DataFrame,
    k: int = RETRIEVAL_TOP_K,
    split: str | None = "split",
    **source,
) -> DataFrame:
    """Labelled examples; with ``split`` every split is fitted on its own chunks,
    all in one job.  ``source``: postings and fetch of :func:`rank_with_features`."""
    scope = [split] if split else []
    featured = rank_with_features(queries, chunks, k, scope, **source)
    return retrieval.assign_labels(featured, evidence)


def prune(
    queries: DataFrame,
    chunks: DataFrame,
    model: LogisticModel | None,
    k: int = RETRIEVAL_TOP_K,
    policy: dict | None = None,
    preset: str = "balanced",
    retriever: retrieval.Retriever | None = None,
    model_version: str | None = None,
    **source,
) -> DataFrame:
    """Decisions for all queries at once; ``source``: postings and fetch of :func:`rank_with_features`.

    Without a model nothing is pruned: scores are null and every ranked chunk is
    kept, marked ``fallback_unpruned``.  ``disabled_reason`` says why a question was not
    pruned, ``model_version`` which model scored it.
    """
    featured = rank_with_features(queries, chunks, k, retriever=retriever, **source)
    scored = predict_or_explain(featured, model, model_version)
    light = scored.select(*PRUNED, "score_error", "model_version")
    ruled = rules.with_policy(light, **policy) if policy else rules.with_preset(light, preset)
    return rules.explain(rules.apply_rules(ruled))


def _metrics_row(scored: DataFrame, threshold: float) -> dict:
    pred = scored.withColumn("pred", (F.col("score") >= threshold).cast("int"))
    return metrics.classification_metrics(pred).first().asDict()


def train_and_evaluate(
    queries: DataFrame,
    chunks: DataFrame,
    evidence: DataFrame,
    corpus_id: str,
    k: int = RETRIEVAL_TOP_K,
    save: Callable[[LogisticModel, Metadata], str] | None = None,
    **source,
) -> tuple[LogisticModel, Metadata]:
    """Fit on train, choose the threshold on val, report once on test.

    ``queries`` and ``chunks`` carry a ``split`` column; ``source`` as for
    :func:`build_examples`.  ``save`` (say, ``artifacts.publish``) gets the result.
    """
    examples = materialise(build_examples(queries, chunks, evidence, k, **source))
    return evaluate(examples, corpus_id, save)


def evaluate(
    examples: DataFrame, corpus_id: str, save: Callable[[LogisticModel, Metadata], str] | None = None
) -> tuple[LogisticModel, Metadata]:
    """As :func:`train_and_evaluate`, over labelled examples that are at hand."""
    part = lambda name: examples.filter(F.col("split") == name)
    model = fit_logistic(part("train"))
    counts = {r["split"]: r["count"] for r in examples.groupBy("split").count().collect()}
    val, test = predict(part("val"), model), predict(part("test"), model)
    has_val, has_test = counts.get("val", 0) > 0, counts.get("test", 0) > 0
    threshold = float(select_threshold(val).first()["threshold"]) if has_val else 0.5
    metadata = Metadata(
        corpus_id=corpus_id,
        trained_at=dt.datetime.now(dt.UTC).isoformat(),
        feature_version=FEATURE_VERSION,
        train_examples=counts.get("train", 0),
        val_examples=counts.get("val", 0),
        test_examples=counts.get("test", 0),
        threshold=threshold,
        val_metrics=_metrics_row(val, threshold) if has_val else {},
        test_metrics=_metrics_row(test, threshold) if has_test else {},
    )
    if save:
        save(model, metadata)
    return model, metadata


def coef_vector_distance(a: Column, b: Column) -> Column:
    """L2 distance of two parameter arrays."""
    return F.sqrt(
        F.aggregate(
            F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v
        )
    )


def coef_distance(a: LogisticModel, b: LogisticModel) -> float:
    return math.dist(a.vector(), b.vector())


def canary_set(
    examples: DataFrame, size: int = 20, split: str = "val", order: Sequence[str] = ("query_id", "rank")
) -> DataFrame:
    """Known-positive pairs of the validation split, first ``size`` in order."""
    positives = examples.filter((F.col("split") == split) & (F.col("label") == 1))
    return positives.orderBy(*order).limit(size)


def canary_recall(canary: DataFrame, model: LogisticModel) -> DataFrame:
    """Share of canary pairs scored at least one half; 1.0 for an empty canary."""
    hit = F.avg((probability(model) >= 0.5).cast("double"))
    return canary.agg(F.coalesce(hit, F.lit(1.0)).alias("canary_recall"))



def parameters(spark: SparkSession, model: LogisticModel) -> DataFrame:
    """Model parameters as rows ``name, mean, std, coef`` (fourteen rows)."""
    rows = [
        (n, float(m), float(s), float(c))
        for n, m, s, c in zip(NUMERIC_FEATURES, model.scaler.mean, model.scaler.std, model.coef)
    ]
    rows += [(n, 0.0, 1.0, float(c)) for n, c in zip(ONE_HOT, model.coef[len(NUMERIC_FEATURES):])]
    rows.append(("intercept", 0.0, 1.0, float(model.intercept)))
    return spark.createDataFrame(rows, "name string, mean double, std double, coef double")


