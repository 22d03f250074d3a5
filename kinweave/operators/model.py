"""A gradient-boosted matcher on pair features."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .features import FEATURES


#: Rounds and learning rate of the published training, which stops early on the validation side.
PUBLISHED = {"rounds": 350, "step": 0.04}


def train(pairs: DataFrame, features: list[str] = FEATURES, rounds: int = 40, step: float = 0.1, seed: int = 42, valid: str | None = None, tolerance: float = 0.001) -> PipelineModel:
    """The model of pairs with the features and a label. valid: a boolean column that marks pairs kept out of training; rounds
    stop when the error on them no longer falls by the tolerance."""
    gbt = GBTClassifier(labelCol="label", featuresCol="features", maxIter=rounds, stepSize=step, maxDepth=6, subsamplingRate=0.8, featureSubsetStrategy="0.8", minInstancesPerNode=25, seed=seed)
    if valid is not None:
        gbt = gbt.setValidationIndicatorCol(valid).setParams(validationTol=tolerance)
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features"), gbt]).fit(pairs.withColumn("label", F.col("label").cast("double")))


def scored(model: PipelineModel, pairs: DataFrame) -> DataFrame:
    """pairs with score, the probability of a match."""
    return model.transform(pairs).withColumn("score", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")


def importance(model: PipelineModel, features: list[str] = FEATURES) -> DataFrame:
    from pyspark.sql import SparkSession

    values = model.stages[-1].featureImportances.toArray().tolist()
    return SparkSession.active().createDataFrame(list(zip(features, values)), "feature string, importance double").orderBy(F.desc("importance"), "feature")


def areas(model: PipelineModel, pairs: DataFrame) -> dict[str, float]:
    """Areas under the ROC and the precision-recall curve."""
    out = model.transform(pairs.withColumn("label", F.col("label").cast("double")))
    return {m: BinaryClassificationEvaluator(labelCol="label", metricName=m).evaluate(out) for m in ("areaUnderROC", "areaUnderPR")}


def ablation(pairs: DataFrame, valid: DataFrame, bundles: dict[str, list[str]], rounds: int = 20) -> list[dict]:
    """For each bundle of features: its size and the areas of a model trained on pairs, on valid."""
    out = []
    for name, names in bundles.items():
        out.append({"bundle": name, "features": len(names)} | areas(train(pairs, names, rounds), valid))
    return out
