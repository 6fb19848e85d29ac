"""Gradient-boosted trees of Spark ML on an array of features, with optional isotonic calibration."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Share of the training rows, of 4, that fit the calibration instead of the trees.
CALIBRATION_PART = 4
#: Weight of the uncalibrated score, which orders the rows inside one step of the calibration.
ORDER_WEIGHT = 0.001


def _raw(model, rows: DataFrame) -> DataFrame:
    scored = model.transform(rows.withColumn("_vector", array_to_vector("features")))
    keep = [F.col(f"`{c}`") for c in rows.columns]
    return scored.select(*keep, F.get(vector_to_array("_probability"), F.lit(1)).alias("_raw"))


def fit(
    training: DataFrame, key: Column, calibrate: bool, rounds: int = 20, depth: int = 3, rate: float = 0.3, parts: int | None = 4
) -> Callable[[DataFrame], DataFrame]:
    """A function that adds ``score`` (0 to 1) to rows with ``features``.

    ``training``: features (array<double>), label (0 or 1). ``key`` deals rows to trees and calibration. ``parts``: tasks of each step
    of each tree, for a bounded number of rows; None leaves the rows in the tasks that read them.
    Without rows of both labels the score is the mean label, 0 without any row; where the calibration part lacks a label,
    scores stay as the trees give them.
    """
    part = F.pmod(F.xxhash64(key, F.lit(4)), F.lit(CALIBRATION_PART)) == 0
    seen = training.agg(
        F.count("*"), F.avg("label"), F.countDistinct(F.when(~part, F.col("label"))), F.countDistinct(F.when(part, F.col("label")))
    ).first()
    calibrate = calibrate and seen[2] == 2 and seen[3] == 2
    if not calibrate and training.select("label").distinct().count() < 2:
        return lambda rows: rows.withColumn("score", F.lit(float(seen[1] or 0)))
    few = (lambda rows: rows) if parts is None else (lambda rows: rows.coalesce(parts))
    grown = (training.filter(~part) if calibrate else training).select(
        array_to_vector("features").alias("_vector"), F.col("label").cast("double").alias("label")
    )
    trees = GBTClassifier(featuresCol="_vector", labelCol="label", maxIter=rounds, maxDepth=depth, stepSize=rate, seed=1)
    model = trees.setProbabilityCol("_probability").setRawPredictionCol("_margin").setPredictionCol("_label").fit(few(grown))
    if not calibrate:
        return lambda rows: _raw(model, rows).withColumnRenamed("_raw", "score")
    held = _raw(model, few(training.filter(part))).select(F.col("label").cast("double").alias("label"), F.col("_raw"))
    steps = IsotonicRegression(featuresCol="_raw", labelCol="label", predictionCol="_step").fit(held)

    def score(rows: DataFrame) -> DataFrame:
        out = steps.transform(_raw(model, rows))
        calibrated = (1 - ORDER_WEIGHT) * F.col("_step") + ORDER_WEIGHT * F.col("_raw")
        return out.withColumn("score", calibrated).drop("_step", "_raw")

    return score
