"""Scoring of feature vectors with small models that were fitted in Spark."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import argmax, dot, softmax, top_k, vector


#: Fixed value: what is said of a prediction below the threshold.
LOW_CONFIDENCE = "Low confidence: treat this prediction as uncertain."


def centroids(rows: DataFrame, label: str, features: str) -> dict:
    """The mean vector of each class. The driver gets classes times dimensions, whatever the rows."""
    values = rows.select(F.col(label).alias("label"), F.posexplode(features).alias("pos", "value"))
    means = values.groupBy("label", "pos").agg(F.avg(F.col("value").cast("double")).alias("mean")).orderBy("label", "pos").collect()
    out: dict = {}
    for r in means:
        out.setdefault(r["label"], []).append(r["mean"])
    return out


def logits(features: Column, model: Sequence[Sequence[float]]) -> Column:
    """The dot product with each class's vector, in their order."""
    return F.array(*(dot(features, vector(m)) for m in model))


def predicted(rows: DataFrame, features: str, model: dict) -> DataFrame:
    """Adds logits, probabilities, prediction (a class of model, the first of equal ones) and confidence."""
    names = sorted(model)
    out = rows.withColumn("logits", logits(F.col(features), [model[n] for n in names]))
    out = out.withColumn("probabilities", softmax(F.col("logits")))
    out = out.withColumn("prediction", F.get(F.array(*map(F.lit, names)), argmax(F.col("logits"))))
    return out.withColumn("confidence", F.array_max("probabilities"))


def top_classes(rows: DataFrame, k: int, classes: Sequence) -> DataFrame:
    """One row per input row and rank (from 1): class and probability of the k likeliest."""
    if not 1 <= k <= len(classes):
        raise ValueError("k must lie between 1 and the number of classes")
    best = rows.select("*", F.posexplode(top_k(F.col("probabilities"), k)).alias("at", "best"))
    return best.select("*", (F.col("at") + 1).alias("rank"), F.get(F.array(*map(F.lit, classes)), F.col("best.place")).alias("class"), F.col("best.value").alias("probability")).drop("at", "best")


def flag_low_confidence(rows: DataFrame, threshold: float) -> DataFrame:
    """Adds low_confidence (strictly below threshold) and warning (null otherwise)."""
    low = F.col("confidence") < threshold
    return rows.withColumn("low_confidence", low).withColumn("warning", F.when(low, LOW_CONFIDENCE))
