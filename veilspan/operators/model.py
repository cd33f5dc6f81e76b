"""A confidence model for detections, in Spark ML."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspan.operators.features import context_features, pattern_features, text_features


def with_features(df: DataFrame, text: str, context: str) -> tuple[DataFrame, list[str]]:
    """The rows with one column per feature."""
    cols = text_features(F.col(text)) | pattern_features(F.col(text), F.lit(None)) | context_features(F.col(text), F.coalesce(context, F.lit("")))
    return df.withColumns({k: F.coalesce(c, F.lit(0.0)) for k, c in cols.items()}), sorted(cols)


def area(scored: DataFrame, label: str) -> float:
    """The area under the ROC curve; 0.5 where only one label is there."""
    if scored.select(label).distinct().limit(2).count() < 2:
        return 0.5
    return round(BinaryClassificationEvaluator(labelCol=label, rawPredictionCol="confidence").evaluate(scored), 6)


def save(model, calibration, folder: str, stamp: str) -> str:
    """Write both parts of a model under a version, which sorts by time; the folder it is in."""
    path = f"{folder}/{stamp}"
    model.write().overwrite().save(f"{path}/pipeline")
    calibration.write().overwrite().save(f"{path}/calibration")
    return path


def versions(spark: SparkSession, folder: str) -> list[str]:
    """The stored versions, newest first; none where there is no folder."""
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted((f.getPath().getName() for f in files.listStatus(at) if f.isDirectory()), reverse=True) if files.exists(at) else []


def latest(spark: SparkSession, folder: str):
    """The newest stored model as (pipeline, calibration), or None."""
    found = versions(spark, folder)
    return (PipelineModel.load(f"{folder}/{found[0]}/pipeline"), IsotonicRegressionModel.load(f"{folder}/{found[0]}/calibration")) if found else None


def importance(features: dict[str, Column]) -> dict[str, Column]:
    """What each feature weighs at least: its size, 0.01 where it is zero or missing."""
    return {k: F.when(F.coalesce(F.abs(c), F.lit(0.0)) > 0, F.abs(c)).otherwise(0.01) for k, c in features.items()}


def split(df: DataFrame, key: str, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Four fifths to learn from and one to test on, by the hash of the key."""
    part = F.pmod(F.xxhash64(F.lit(seed), key), F.lit(5))
    return df.where(part != 0), df.where(part == 0)


def train(df: DataFrame, features: list[str], label: str, rounds: int = 20, depth: int = 4):
    """Scaled features, boosted trees, and an isotonic fit of the score: (pipeline, calibration)."""
    stages = [
        VectorAssembler(inputCols=features, outputCol="raw", handleInvalid="keep"),
        StandardScaler(inputCol="raw", outputCol="features", withMean=True),
        GBTClassifier(labelCol=label, featuresCol="features", maxIter=rounds, maxDepth=depth, stepSize=0.1, seed=42),
    ]
    learn, rest = df.where(F.pmod(F.xxhash64("id"), F.lit(3)) != 0), df.where(F.pmod(F.xxhash64("id"), F.lit(3)) == 0)
    model = Pipeline(stages=stages).fit(learn)
    scored = model.transform(rest).withColumn("score", vector_to_array("probability")[1])
    calibration = IsotonicRegression(featuresCol="score", labelCol=label, predictionCol="confidence").fit(scored)
    return model, calibration


def score(df: DataFrame, model, calibration) -> DataFrame:
    return calibration.transform(model.transform(df).withColumn("score", vector_to_array("probability")[1]))
