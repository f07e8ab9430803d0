"""Trainers of pyspark.ml on feature arrays."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LinearSVC, MultilayerPerceptronClassifier, OneVsRest, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import augment
from ..functions.vectors import fourier_features, fourier_plan
from ..sources.manifest import read_json, write_json
from ..sources.scratch import folder, settled


def prepared(rows: DataFrame, features: str) -> DataFrame:
    """rows whose features are there, as a vector column."""
    return rows.where(F.col(features).isNotNull()).withColumn("vector", array_to_vector(F.col(features).cast("array<double>")))


def forest(rows: DataFrame, features: str, label: str, trees: int = 20, seed: int = 42) -> PipelineModel:
    return Pipeline(stages=[RandomForestClassifier(featuresCol="vector", labelCol=label, numTrees=trees, seed=seed)]).fit(prepared(rows, features))


def perceptron(rows: DataFrame, features: str, label: str, layers: list[int], rounds: int = 30, seed: int = 42) -> PipelineModel:
    return Pipeline(stages=[MultilayerPerceptronClassifier(featuresCol="vector", labelCol=label, layers=layers, maxIter=rounds, seed=seed)]).fit(prepared(rows, features))


def _without_summary(model: PipelineModel) -> PipelineModel:
    """The model as it is after saving and loading: a fitted machine holds its training's summary and with it the session,
    which tasks can't be sent."""
    path = folder(SparkSession.active())
    model.write().save(path)
    return PipelineModel.load(path)


def linear_svc(rows: DataFrame, features: str, label: str, rounds: int = 20) -> PipelineModel:
    """One linear machine per class."""
    svc = OneVsRest(classifier=LinearSVC(featuresCol="vector", labelCol=label, maxIter=rounds), featuresCol="vector", labelCol=label)
    return _without_summary(Pipeline(stages=[svc]).fit(prepared(rows, features)))


@dataclass(frozen=True)
class KernelMachine:
    """Linear machines, one per class, on random Fourier features: gamma of the kernel, the plan of the features, and the
    fitted machines."""

    gamma: float
    plan: list
    machines: PipelineModel

    def apply(self, rows: DataFrame, features: str) -> DataFrame:
        """rows with prediction; rows without features are left out."""
        (mapped,) = _free(rows, "fourier")
        return apply(self.machines, rows.withColumn(mapped, fourier_features(F.col(features), self.plan)), mapped).drop(mapped)

    def save(self, path: str, contract: dict) -> dict:
        return save(self.machines, path, contract, {"gamma": self.gamma, "fourier": self.plan})


def load_kernel_machine(spark: SparkSession, path: str, expected: dict) -> KernelMachine:
    machines, said = load(spark, path, ["gamma", "fourier"], expected)
    return KernelMachine(said["gamma"], said["fourier"], machines)


def _free(rows: DataFrame, name: str) -> list[str]:
    while name.lower() in (c.lower() for c in rows.columns):
        name = "_" + name
    return [name]


def kernel_scale(rows: DataFrame, features: str) -> tuple[int, float]:
    """The features' number, and the usual gamma: 1 / (number x variance of all values), 1 for constant values."""
    values = rows.where(F.col(features).isNotNull()).select(F.col(features).cast("array<double>").alias("x"))
    low, high, spread = values.select(F.size("x").alias("d"), F.explode("x").alias("v")).agg(F.min("d"), F.max("d"), F.var_pop("v")).first()
    if low is None or low != high:
        raise ValueError("a kernel machine needs rows, all with equally many features")
    return low, 1 / (low * spread) if spread else 1.0


def rbf_svc(rows: DataFrame, features: str, label: str, n: int = 512, gamma: float | None = None, rounds: int = 30, penalty: float = 1e-3, seed: int = 42) -> KernelMachine:
    """A machine with the kernel exp(-gamma |x - y|^2), approximated by n random Fourier features of each row and fitted
    in the features' space, so that no row meets another and a model's size does not grow with the rows. gamma: by
    kernel_scale() where not given. Rows without features are left out; no rows, or rows of unlike sizes, are errors."""
    size, usual = kernel_scale(rows, features)
    plan = fourier_plan(size, n, usual if gamma is None else gamma, seed)
    (mapped,) = _free(rows, "fourier")
    svc = OneVsRest(classifier=LinearSVC(featuresCol="vector", labelCol=label, maxIter=rounds, regParam=penalty), featuresCol="vector", labelCol=label, parallelism=4)
    # The features are computed once and written: each round of each machine reads them.
    known = settled(rows.where(F.col(features).isNotNull()).select(F.col(label), fourier_features(F.col(features), plan).alias(mapped)))
    fitted = _without_summary(Pipeline(stages=[svc]).fit(prepared(known, mapped)))
    return KernelMachine(usual if gamma is None else gamma, plan, fitted)


def apply(model: PipelineModel, rows: DataFrame, features: str) -> DataFrame:
    """rows with prediction."""
    return model.transform(prepared(rows, features)).drop("vector", "rawPrediction", "probability")


class ModelError(ValueError):
    """A saved model is not what is expected."""


def save(model: PipelineModel, path: str, contract: dict, more: dict | None = None) -> dict:
    """Saves a model and its contract (what it was fitted on and how) below path; more may not replace the contract's
    fields. Returns what was saved beside the model."""
    clash = set(contract) & set(more or {})
    if clash:
        raise ModelError(f"fields of the contract can't be replaced: {', '.join(sorted(clash))}")
    said = contract | (more or {})
    model.write().save(f"{path}/model")
    write_json(SparkSession.active(), f"{path}/contract.json", said)
    return said


def load(spark: SparkSession, path: str, required: Sequence[str], expected: dict) -> tuple[PipelineModel, dict]:
    """A saved model and its contract, if it has all required fields and the expected values."""
    said = read_json(spark, f"{path}/contract.json")
    missing = [f for f in required if f not in said]
    if missing:
        raise ModelError(f"fields are missing: {', '.join(sorted(missing))}")
    other = [k for k, v in expected.items() if said.get(k) != v]
    if other:
        raise ModelError(f"another contract: {', '.join(sorted(other))}")
    return PipelineModel.load(f"{path}/model"), said


#: Lowest and highest whole number of each setting of a run that has a range; None: without limit.
WHOLE = {"epochs": (1, 100), "batch": (1, None), "size": (1, None), "patience": (1, None), "repeat": (1, None), "per_class": (1, None), "per_split": (1, None)}


def check_training(said: dict) -> None:
    """An error for the first setting of a run, by name, that no run takes: whole numbers outside their range, a rate or
    profile that is none, a limit per class beside one per split, a selection by anything but validation or stress. None
    stands for a setting that is not given; unknown names are errors."""
    for name, value in sorted(said.items()):
        if value is None:
            continue
        if name in WHOLE:
            low, high = WHOLE[name]
            fits = isinstance(value, int) and not isinstance(value, bool) and value >= low and (high is None or value <= high)
        elif name == "rate":
            fits = isinstance(value, (int, float)) and 0 < value < float("inf")
        elif name == "profile":
            fits = value in augment.PROFILES
        elif name == "select_on":
            fits = value in ("validation", "stress")
        else:
            raise ValueError(f"no setting named {name}")
        if not fits:
            raise ValueError(f"{name} can't be {value!r}")
    if said.get("per_class") is not None and said.get("per_split") is not None:
        raise ValueError("per_class and per_split exclude each other")
