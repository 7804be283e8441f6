"""Opaque scorers: native columns, Arrow batches with an artificial cost, and models loaded once a worker."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankwell.functions.columns import relu, softmax_at

Scorer = Callable[[DataFrame], DataFrame]


def relu_scorer(value: str, delay: float = 0.0) -> Scorer:
    """max(0, value). With a delay, seconds for each element, it runs as an opaque function over Arrow batches."""
    if not delay:
        return lambda d: d.withColumn("score", relu(F.col(value)))

    @F.pandas_udf(T.DoubleType())
    def slow(x: pd.Series) -> pd.Series:
        time.sleep(delay * len(x))
        return x.clip(lower=0.0)

    return lambda d: d.withColumn("score", slow.asNondeterministic()(F.col(value).cast("double")))


def softmax_scorer(vector: str, index: int) -> Scorer:
    """The softmax share of one class, from an array of logits."""
    return lambda d: d.withColumn("score", softmax_at(F.col(vector), index))


def batch_scorer(columns: list[str], load: Callable[[], Callable[[pd.DataFrame], pd.Series]]) -> Scorer:
    """Any model: `load` runs once for each task and returns what scores a batch."""

    @F.pandas_udf(T.DoubleType())
    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        model = load()
        for b in batches:
            yield model(b).astype("float64")

    return lambda d: d.withColumn("score", score.asNondeterministic()(F.struct(*columns)))


def trees_scorer(model: PipelineModel) -> Scorer:
    """Predictions of a fitted regression, not below 0."""
    return lambda d: model.transform(d).withColumn("score", relu(F.col("prediction"))).drop("__features", "prediction")


def fit_trees(train: DataFrame, features: list[str], label: str, depth: int = 7, step: float = 0.3, rounds: int = 20, seed: int = 42) -> PipelineModel:
    """A gradient boosted regression."""
    vector = VectorAssembler(inputCols=features, outputCol="__features")
    trees = GBTRegressor(featuresCol="__features", labelCol=label, maxDepth=depth, stepSize=step, maxIter=rounds, seed=seed)
    return Pipeline(stages=[vector, trees]).fit(train)


def save_model(model: PipelineModel, path: str) -> None:
    """Write a fitted model to a folder that all executors share."""
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def rmse(df: DataFrame, predicted: str, label: str) -> DataFrame:
    gap = F.col(predicted) - F.col(label)
    return df.agg(F.sqrt(F.avg(gap * gap)).alias("rmse"))


SCORERS: dict[str, Callable[..., Scorer]] = {"relu": relu_scorer, "softmax": softmax_scorer, "batch": batch_scorer, "trees": trees_scorer}


def scorer(kind: str, **params) -> Scorer:
    """A scorer by name."""
    if kind not in SCORERS:
        raise ValueError(f"unknown scorer {kind!r}; there are {sorted(SCORERS)}")
    return SCORERS[kind](**params)
