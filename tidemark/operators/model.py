"""Single fits of the direction classifier with Spark ML."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.ml.classification import (
    GBTClassificationModel,
    GBTClassifier,
    LogisticRegression,
    LogisticRegressionModel,
)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark import fixed_values as fx
from tidemark.core import hash_bucket, hash_key, ordinal
from tidemark.functions.signals import clamp, num0, num0_columns
from tidemark.operators.folds import event_chunks, event_order
from tidemark.session import cut_lineage

_FLAT = 1e-9


@dataclass
class FittedModel:
    """A fitted classifier with the standardisation it was trained under."""

    backend: str
    features: list[str]
    means: list[float]
    stds: list[float]
    train_events: int
    model: object
    extras: dict = field(default_factory=dict)


def feature_moments(df: DataFrame, features: Sequence[str]) -> tuple[list[float], list[float]]:
    """Mean and population deviation per feature; a flat feature counts as 1.

    Two numbers per feature come to the driver.
    """
    aggs = [F.avg(num0(F.col(c))).alias(f"m_{i}") for i, c in enumerate(features)]
    aggs += [F.stddev_pop(num0(F.col(c))).alias(f"s_{i}") for i, c in enumerate(features)]
    row = num0_columns(df, features).agg(*aggs).first()
    n = len(features)
    stds = [x if x is not None and x >= _FLAT else 1.0 for x in row[n:]]
    return [x or 0.0 for x in row[:n]], stds


def standardize(
    df: DataFrame, features: Sequence[str], means: Sequence[float], stds: Sequence[float]
) -> DataFrame:
    """Features as (x - mean) / std; missing ones count as 0 before that."""
    filled = num0_columns(df, features)
    return filled.withColumns(
        {c: (F.col(c) - F.lit(m)) / F.lit(s) for c, m, s in zip(features, means, stds)}
    )


def _assembled(df: DataFrame, features: Sequence[str], means, stds) -> DataFrame:
    assembler = VectorAssembler(inputCols=list(features), outputCol="__x")
    return assembler.transform(standardize(df, features, means, stds))


def fit_classifier(
    train: DataFrame,
    features: Sequence[str] = fx.ENHANCED_FEATURES,
    backend: str = "trees",
    label: str = "label",
    seed: int = 42,
    trees: int = 80,
    least_rows: int = 15,
    **extras,
) -> FittedModel:
    """Fit boosted trees, or a class-balanced logistic regression ("logistic").

    ``trees`` and ``least_rows`` (rows per leaf) hold for boosted trees and do not
    depend on the size of the data. Raises ValueError without rows, or with one
    class only.
    """
    counts = train.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col(label) == 1).alias("ones")
    ).first()
    n, ones = counts["n"], counts["ones"]
    if n == 0:
        raise ValueError("empty training set")
    if ones in (0, n):
        raise ValueError("need two classes in the training labels")
    features = list(features)
    means, stds = feature_moments(train, features)
    rows = _assembled(train, features, means, stds).withColumn(
        "__y", F.col(label).cast("double")
    )
    if backend == "trees":
        estimator = GBTClassifier(
            featuresCol="__x",
            labelCol="__y",
            maxIter=trees,
            stepSize=0.05,
            maxDepth=5,
            minInstancesPerNode=least_rows,
            subsamplingRate=0.9,
            seed=seed,
        )
    else:
        weight = F.when(F.col("__y") == 1, n / (2.0 * ones)).otherwise(n / (2.0 * (n - ones)))
        rows = rows.withColumn("__w", weight)
        # The penalty is spread over the summed weights, which equal n.
        estimator = LogisticRegression(
            featuresCol="__x",
            labelCol="__y",
            weightCol="__w",
            maxIter=2000,
            tol=1e-9,
            regParam=1.0 / n,
            standardization=False,
        )
    return FittedModel(backend, features, means, stds, n, estimator.fit(rows), dict(extras))


def with_prediction(df: DataFrame, proba: Column) -> DataFrame:
    """Add probability of up, label, signal and confidence."""
    return df.withColumn("proba", proba).withColumns(
        {
            "prediction": (F.col("proba") >= 0.5).cast("int"),
            "signal": F.when(F.col("proba") >= 0.5, 1).otherwise(-1),
            "confidence": F.greatest(F.col("proba"), 1.0 - F.col("proba")),
        }
    )


def predict(model: FittedModel, df: DataFrame) -> DataFrame:
    """Add the model's prediction; the columns of ``df`` stay as they are.

    Only ``proba``, ``prediction``, ``signal`` and ``confidence`` are added or replaced.
    """
    inputs = [f"__f{i}" for i in range(len(model.features))]
    scaled = df.withColumns(
        {
            i: (num0(F.col(c)) - F.lit(m)) / F.lit(s)
            for i, c, m, s in zip(inputs, model.features, model.means, model.stds)
        }
    )
    vector = VectorAssembler(inputCols=inputs, outputCol="__x").transform(scaled)
    scored = model.model.transform(vector)
    proba = vector_to_array("probability")[1].alias("__proba")
    return with_prediction(
        scored.select(*[F.col(f"`{c}`") for c in df.columns], proba), F.col("__proba")
    ).drop("__proba")


def momentum_predict(df: DataFrame) -> DataFrame:
    """What stands in for a model when the training labels have one class."""
    move = num0(F.col("baseline_pre_7d_return_pct"))
    return df.withColumns(
        {
            "proba": clamp(0.5 + F.abs(move) / 24.0, 0.5, 0.95),
            "prediction": (move > 0).cast("int"),
            "signal": F.when(move > 0, 1).otherwise(-1),
        }
    ).withColumn("confidence", F.greatest(F.col("proba"), 1.0 - F.col("proba")))


def fit_predict(
    train: DataFrame, test: DataFrame, features: Sequence[str], backend: str = "trees"
) -> DataFrame:
    """Score ``test`` with a model of ``train``; by momentum if ``train`` lacks one of the classes."""
    classes = train.agg(F.min("label").alias("low"), F.max("label").alias("high")).first()
    if classes["low"] is None or classes["low"] == classes["high"]:
        return momentum_predict(test)
    return predict(fit_classifier(train, features, backend), test)


def save_model(model: FittedModel, path: str, spark: SparkSession) -> None:
    """Write the Spark ML model and its metadata under ``path``."""
    model.model.write().overwrite().save(f"{path}/model")
    meta = {
        "backend": model.backend,
        "features": model.features,
        "means": model.means,
        "stds": model.stds,
        "train_events": model.train_events,
        "extras": model.extras,
    }
    spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode(
        "overwrite"
    ).text(f"{path}/meta")


def load_model(path: str, spark: SparkSession) -> FittedModel:
    meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
    kind = GBTClassificationModel if meta["backend"] == "trees" else LogisticRegressionModel
    return FittedModel(model=kind.load(f"{path}/model"), **meta)


def importances(model: FittedModel, spark: SparkSession) -> DataFrame:
    """(feature, gain) of a tree model; one row per feature."""
    gains = model.model.featureImportances.toArray()
    return spark.createDataFrame(
        [(f, float(g)) for f, g in zip(model.features, gains)], "feature string, gain double"
    )


def permutation_importance(
    train: DataFrame, features: Sequence[str], repeats: int = 20, seed: int = 42
) -> DataFrame:
    """Mean and deviation of the accuracy lost when one feature is shuffled.

    A logistic model is linear, so shuffling feature j moves a row's margin by
    weight_j times (new value - own value). Each repeat pairs every row with one
    other row by position, and all features are read off that pair.
    """
    features = list(features)
    fitted = fit_classifier(train, features, backend="logistic")
    weights = [float(w) for w in fitted.model.coefficients]
    rows = standardize(train, features, fitted.means, fitted.stds)
    margin = F.lit(float(fitted.model.intercept))
    for c, w in zip(features, weights):
        margin = margin + F.lit(w) * F.col(c)
    base = cut_lineage(
        ordinal(
            rows.select(
                "symbol", "t_event", "label", F.array(*features).alias("x"), margin.alias("z")
            ),
            event_order(),
            event_chunks(),
            name="place",
        )
    )
    drawn = base.select(
        "symbol", "t_event", "x", F.explode(F.sequence(F.lit(1), F.lit(repeats))).alias("repeat")
    ).withColumn("key", hash_key(seed, F.col("repeat"), F.col("symbol"), F.col("t_event")))
    shuffled = ordinal(
        drawn, [F.col("key")], [hash_bucket(F.col("key"))], by=["repeat"], name="place"
    ).select("repeat", "place", F.col("x").alias("other"))
    pairs = base.join(shuffled, "place")

    def right(z: Column) -> Column:
        return F.when((z >= 0).cast("int") == F.col("label"), 1.0).otherwise(0.0)

    lost = [
        F.avg(
            right(F.col("z"))
            - right(F.col("z") + F.lit(w) * (F.col("other")[i] - F.col("x")[i]))
        ).alias(f"d{i}")
        for i, w in enumerate(weights)
    ]
    per_repeat = pairs.groupBy("repeat").agg(*lost)
    named = F.array(
        *[
            F.struct(F.lit(c).alias("feature"), F.col(f"d{i}").alias("drop"))
            for i, c in enumerate(features)
        ]
    )
    return (
        per_repeat.select(F.explode(named).alias("e"))
        .groupBy(F.col("e.feature").alias("feature"))
        .agg(
            F.round(F.avg("e.drop"), 6).alias("importance_mean"),
            F.round(F.stddev_pop("e.drop"), 6).alias("importance_std"),
        )
        .withColumn(
            "rank", F.row_number().over(Window.orderBy(F.desc("importance_mean"), "feature"))
        )
    )
