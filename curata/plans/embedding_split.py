"""The evaluation that many queries share: embeddings split by digest, class centroids of the one part scored on the other."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import split_key
from ..operators import score
from ..operators.ranking import by_digest

CLASSES = list(range(10))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings with is_train: the first 70 % of each label in digest order."""
    rows = table(spark, sf_dir, "embeddings").withColumn("key", split_key(42, F.col("label"), F.col("vec_id")))
    return by_digest(rows, ["label"], "key", ["vec_id"], "pos", "n").withColumn("is_train", F.col("pos") < F.floor(F.col("n") * 0.7)).drop("key", "pos", "n")


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, label, logits, probabilities, prediction, confidence of the other part."""
    rows = split(spark, sf_dir)
    model = score.centroids(rows.where("is_train"), "label", "embedding")
    return score.predicted(rows.where("NOT is_train"), "embedding", model).drop("embedding", "is_train")


#: CTEs: keyed, part, z (vec_id, label, cls, z), p (with probability) and scored (vec_id, label, prediction, confidence).
SQL = """
keyed AS (
  SELECT vec_id, label, embedding, row_number() OVER (PARTITION BY label ORDER BY sha256('42:' || label || ':' || vec_id), vec_id) - 1 AS pos, count(*) OVER (PARTITION BY label) AS n FROM embeddings
), part AS (SELECT vec_id, label, embedding, pos < floor(n * 0.7::DOUBLE) AS is_train FROM keyed
), v AS (SELECT vec_id, label, is_train, CAST(unnest(embedding) AS DOUBLE) AS x, generate_subscripts(embedding, 1) AS k FROM part
), c AS (SELECT label AS cls, k, avg(x) AS m FROM v WHERE is_train GROUP BY label, k
), z AS MATERIALIZED (SELECT vec_id, v.label, cls, sum(x * m) AS z FROM v JOIN c USING (k) WHERE NOT is_train GROUP BY vec_id, v.label, cls
), p AS MATERIALIZED (SELECT vec_id, label, cls, exp(z - max(z) OVER (PARTITION BY vec_id)) / sum(exp(z - m)) OVER (PARTITION BY vec_id) AS probability FROM (SELECT *, max(z) OVER (PARTITION BY vec_id) AS m FROM z)
), scored AS MATERIALIZED (SELECT vec_id, label, arg_max(cls, (probability, -cls)) AS prediction, max(probability) AS confidence FROM p GROUP BY vec_id, label)
"""
