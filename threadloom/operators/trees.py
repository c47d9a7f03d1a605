"""Boosted trees with a random search and a grid around its best."""

from __future__ import annotations

import random

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.evaluation import BinaryClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Values that the random search draws from.
DEPTHS, TREES, STEPS, SHARES = (2, 3, 4, 5, 6), (10, 20, 30, 40), (0.05, 0.1, 0.2, 0.3), (0.6, 0.7, 0.8, 0.9, 1.0)


def split(df: DataFrame, key: str, parts: int = 5) -> tuple[DataFrame, DataFrame]:
    """Training and test rows: a fifth of the keys, by a hash, are for testing; every run agrees."""
    test = F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 8), 16, 10).cast("long") % parts == 0
    return df.filter(~test), df.filter(test)


def _stages(features: list[str], label: str, classify: bool, **params) -> Pipeline:
    kind = GBTClassifier if classify else GBTRegressor
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="_features", handleInvalid="keep"), kind(featuresCol="_features", labelCol=label, seed=42, **params)])


def fit(df: DataFrame, features: list[str], label: str, classify: bool = True, **params) -> PipelineModel:
    """A classifier, or a regressor of log(y + 1), whose squared error is the squared log error of y."""
    rows = df if classify else df.withColumn("_log", F.log1p(label))
    return _stages(features, label if classify else "_log", classify, **params).fit(rows)


def predict(model: PipelineModel, df: DataFrame, classify: bool = True) -> DataFrame:
    """df with pred: the probability of class 1, or the value on its own scale, not below 0."""
    out = model.transform(df)
    value = vector_to_array("probability")[1] if classify else F.greatest(F.expm1("prediction"), F.lit(0.0))
    return out.withColumn("pred", value).select(*df.columns, "pred")


def search(df: DataFrame, features: list[str], label: str, classify: bool = True, draws: int = 20, folds: int = 5, seed: int = 42, parallelism: int = 4) -> tuple[PipelineModel, dict]:
    """The best of draws random settings by cross-validation, then of a 3 x 3 x 3 grid around it."""
    rows = df if classify else df.withColumn("_log", F.log1p(label))
    target = label if classify else "_log"
    pipeline = _stages(features, target, classify)
    stage = pipeline.getStages()[-1]
    judge = BinaryClassificationEvaluator(labelCol=target, metricName="areaUnderPR") if classify else RegressionEvaluator(labelCol=target, metricName="rmse")
    names = ("maxDepth", "maxIter", "stepSize", "subsamplingRate")
    every = [dict(zip(names, x, strict=True)) for x in ((d, t, s, r) for d in DEPTHS for t in TREES for s in STEPS for r in SHARES)]

    def best(settings: list[dict]) -> tuple[PipelineModel, dict]:
        grid = [{stage.getParam(k): v for k, v in x.items()} for x in settings] or ParamGridBuilder().build()
        found = CrossValidator(estimator=pipeline, estimatorParamMaps=grid, evaluator=judge, numFolds=folds, seed=seed, parallelism=parallelism).fit(rows)
        scores = found.avgMetrics
        at = (max if judge.isLargerBetter() else min)(range(len(scores)), key=scores.__getitem__)
        return found.bestModel, settings[at]

    _, first = best(random.Random(seed).sample(every, min(draws, len(every))))
    around = [first | {"maxDepth": max(1, first["maxDepth"] + d), "maxIter": max(1, first["maxIter"] + t), "stepSize": first["stepSize"] * s} for d in (-1, 0, 1) for t in (-5, 0, 5) for s in (0.5, 1.0, 1.5)]
    unique = list({tuple(x.items()): x for x in around}.values())
    return best(unique)
