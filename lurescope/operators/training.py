"""Training and judging a classifier on the tabular features; its measures are measured."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lurescope.operators.dataset import by_hash
from lurescope.operators.evaluation import confusion
from lurescope.sources.registry import append_models


def numeric_features(df: DataFrame, without: tuple[str, ...]) -> list[str]:
    return [c for c, kind in df.dtypes if kind == "double" and c not in without]


def parted(df: DataFrame, key: str, share: float = 0.8, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(train, test) by the hash of KEY: a row keeps its side whatever else the table holds, and nothing is shuffled."""
    place = F.pmod(by_hash(key, seed), F.lit(1000))
    return df.filter(place < int(share * 1000)), df.filter(place >= int(share * 1000))


def trained(train: DataFrame, features: list[str], label: str = "label") -> PipelineModel:
    """Median imputation, then logistic regression; rows without a label are left out."""
    filled = [f"_{c}" for c in features]
    steps = [Imputer(strategy="median", inputCols=features, outputCols=filled), VectorAssembler(inputCols=filled, outputCol="_x"), LogisticRegression(featuresCol="_x", labelCol=label, regParam=0.01)]
    return Pipeline(stages=steps).fit(train.filter(F.col(label).isNotNull()))


def predicted(model: PipelineModel, rows: DataFrame, key: str, label: str = "label") -> DataFrame:
    """``KEY, LABEL, prob``."""
    return model.transform(rows).select(key, label, F.element_at(vector_to_array("probability"), 2).alias("prob"))


def retrained(df: DataFrame, key: str, label: str = "label") -> tuple[PipelineModel, DataFrame]:
    """(model, its measures on the rows left out): what a registry entry should hold."""
    train, test = parted(df, key)
    model = trained(train, numeric_features(df, (key, label)), label)
    return model, confusion(predicted(model, test, key, label), "prob", label)


def retrained_and_registered(df: DataFrame, key: str, registry: str, weights: str, name: str = "tabular classifier", version: str | None = None, label: str = "label") -> DataFrame:
    """Trains, writes the model to WEIGHTS and appends its measured values to REGISTRY; the measures.

    The VERSION is the time of training unless one is given, so that later models sort behind earlier ones.
    """
    model, measures = retrained(df, key, label)
    model.write().overwrite().save(weights)
    version = version or datetime.now(timezone.utc).strftime("v%Y.%m.%d.%H%M%S")
    found = measures.select(F.lit(name).alias("model_name"), F.lit(version).alias("version"), "accuracy", "precision", "recall", F.col("f1").alias("f1_score"), F.lit(weights).alias("weights_filepath"))
    append_models(found, registry)
    return measures
