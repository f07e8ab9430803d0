"""A dense classifier of feature rows, trained by synchronous data-parallel steps.

Rows are dealt once into batches of fixed members (by a seeded digest of their key), each one row of a written table. A
step broadcasts the weights, every task sums the gradients of its batches, and the sums are added up in a tree; the
driver applies one AdamW update. What a batch does (noise, dropped units, normalisation by its own mean and variance)
depends on its members and the epoch alone, so the weights don't depend on how the table is partitioned, but for the
order in which sums are rounded.
"""

from __future__ import annotations

import copy
import math
import platform
from collections.abc import Iterator, Sequence
from dataclasses import asdict, dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.hashing import split_key
from ..sources.manifest import read_json, write_json
from ..sources.scratch import settled
from .pictures import Mlp
from .ranking import by_digest
from .training import ModelError

#: The normalisation's addend and the share of a step in its stored statistics, the optimiser's decays and
#: addend, the smoothing of labels.
EPSILON, MOMENTUM, DECAYS, ADDEND, SMOOTHING = 1e-5, 0.1, (0.9, 0.999), 1e-8, 0.05
#: Sums that one driver collects; more are added up in a further round of tasks.
FAN_IN = 32


class TrainingError(ValueError):
    """Rows that nothing can be learned from, or settings that no run takes."""


@dataclass(frozen=True)
class Settings:
    """epochs at most; rows of a batch and batches of a step (0: all); how a step moves; noise on features and share of
    units dropped in training; epochs without a better validation loss after which training ends."""

    epochs: int = 120
    batch: int = 256
    batches_a_step: int = 0
    rate: float = 2e-3
    decay: float = 1e-4
    dropout: float = 0.3
    hidden: tuple[int, ...] = (256, 128)
    jitter: float = 0.01
    seed: int = 42
    patience: int = 15

    def __post_init__(self):
        if min(self.epochs, self.batch - 1, self.rate, self.patience, *self.hidden) <= 0 or min(self.batches_a_step, self.decay, self.jitter) < 0 or not 0 <= self.dropout < 1:
            raise TrainingError("epochs, rate, patience and layers must be positive, batches have two rows at least, and shares lie below 1")


@dataclass
class Fitted:
    """The network of the best epoch, and one record per epoch: epoch, rate, train_loss, validation_loss, accuracy."""

    model: Mlp
    best_epoch: int
    best_loss: float
    history: list[dict] = field(default_factory=list)
    settings: Settings = Settings()
    classes: list = field(default_factory=list)


def batched(rows: DataFrame, key: str, features: str, place: str, size: int, seed: int) -> DataFrame:
    """no, n, x (little-endian doubles, row by row) and y: rows dealt into batches of about size rows in the order of a
    seeded digest of key (ties: by features and place). Rows without features or place are left out."""
    known = rows.where(F.col(features).isNotNull() & F.col(place).isNotNull())
    known = known.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key"), F.col(features).cast("array<double>").alias("x"), F.col(place).cast("int").alias("y"))
    ranked = by_digest(known.withColumn("digest", split_key(seed, F.col("key"))), [], "digest", ["x", "y"], "at", "rows")
    batches = F.greatest(F.lit(1), F.floor(F.col("rows") / size))
    dealt = ranked.select(F.floor(F.col("at") * batches / F.col("rows")).alias("no"), "at", "x", "y")
    one = dealt.groupBy("no").agg(F.array_sort(F.collect_list(F.struct("at", "x", "y"))).alias("own"))
    return settled(one.select("no", F.size("own").alias("n"), F.flatten(F.col("own.x")).alias("x"), F.col("own.y").alias("y")))


def flat(model: Mlp) -> np.ndarray:
    """What is learned, in one row: weights and biases, then scales and shifts of the normalisation."""
    return np.concatenate([a.ravel() for w, b in model.layers for a in (w, b)] + [a for g, s, *_ in model.norms for a in (g, s)])


def filled(model: Mlp, values: np.ndarray) -> None:
    """Sets what is learned from one row."""
    at = 0

    def take(like: np.ndarray) -> np.ndarray:
        nonlocal at
        at += like.size
        return values[at - like.size : at].reshape(like.shape).copy()

    model.layers = [(take(w), take(b)) for w, b in model.layers]
    model.norms = [(take(g), take(s), m, v) for g, s, m, v in model.norms]


def gradients(model: Mlp, x: np.ndarray, y: np.ndarray, keep: Sequence[np.ndarray], smoothing: float = SMOOTHING) -> tuple[float, np.ndarray, np.ndarray]:
    """Of one batch, summed over its rows: the loss, its gradient in the order of flat(), and after that each
    normalisation's mean and variance (unbiased). keep: for each hidden layer, what its units are multiplied with."""
    n, through, out = len(x), [], x
    for (w, b), (gamma, beta, *_), mask in zip(model.layers, model.norms, keep, strict=False):
        z = out @ w.T + b
        mean, variance = z.mean(0), z.var(0)
        unit = (z - mean) / np.sqrt(variance + EPSILON)
        a = unit * gamma + beta
        through.append((out, unit, variance, a > 0, mask, mean))
        out = np.maximum(a, 0) * mask
    w, b = model.layers[-1]
    z = out @ w.T + b
    z = z - z.max(1, keepdims=True)
    logs = z - np.log(np.exp(z).sum(1, keepdims=True))
    target = np.full_like(logs, smoothing / logs.shape[1])
    target[np.arange(n), y] += 1 - smoothing
    loss = float(-(target * logs).sum())
    up = np.exp(logs) - target
    layers, norms = [(up.T @ out, up.sum(0))], []
    down = up @ w
    for (before, unit, variance, positive, mask, _), (w, _), (gamma, *_) in zip(reversed(through), reversed(model.layers[:-1]), reversed(model.norms), strict=True):
        up = down * mask * positive
        norms.append(((up * unit).sum(0), up.sum(0)))
        up = up * gamma
        up = (up - up.mean(0) - unit * (up * unit).mean(0)) / np.sqrt(variance + EPSILON)
        layers.append((up.T @ before, up.sum(0)))
        down = up @ w
    grad = np.concatenate([a.ravel() for pair in reversed(layers) for a in pair] + [a for pair in reversed(norms) for a in pair])
    seen = np.concatenate([a for _, _, variance, _, _, mean in through for a in (mean, variance * n / max(1, n - 1))] or [np.zeros(0)])
    return loss, grad, seen


def _sum_tree(parts: DataFrame) -> list[np.ndarray]:
    """The sum of the rows of a binary column of doubles, added up in tasks until FAN_IN rows at most are left."""
    def add(batches: Iterator) -> Iterator:
        import pyarrow as pa

        total = None
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                own = np.frombuffer(raw, "<f8")
                total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sum"])

    n = parts.rdd.getNumPartitions()
    while n > FAN_IN:
        n = max(FAN_IN, math.isqrt(n))
        parts = parts.repartition(n).mapInArrow(add, "sum binary")
    return [np.frombuffer(r["sum"], "<f8") for r in parts.collect()]


def _step(batches: DataFrame, model: Mlp, settings: Settings, epoch: int) -> np.ndarray:
    """Rows, batches, loss, gradient and statistics of one step, summed over batches."""
    shared = batches.sparkSession.sparkContext.broadcast(model)

    def run(parts: Iterator) -> Iterator:
        import pyarrow as pa

        total = None
        for part in parts:
            for no, n, x, y in zip(*(part.column(c) for c in ("no", "n", "x", "y")), strict=True):
                rows, places = np.asarray(x.values).reshape(n.as_py(), -1), np.asarray(y.values)
                draw = np.random.default_rng([settings.seed, epoch, no.as_py()])
                if settings.jitter:
                    rows = rows + draw.normal(0, settings.jitter, rows.shape)
                keep = [(draw.random((len(rows), h)) >= settings.dropout) / (1 - settings.dropout) for h in settings.hidden]
                loss, grad, seen = gradients(shared.value, rows, places, keep)
                own = np.concatenate([[len(rows), 1, loss], grad, seen])
                total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sum"])

    sums = _sum_tree(batches.mapInArrow(run, "sum binary"))
    return np.sum(sums, 0) if sums else np.zeros(0)


def evaluate(batches: DataFrame, model: Mlp, smoothing: float = SMOOTHING) -> tuple[float, float]:
    """Mean loss and accuracy over a table of batches, with the stored statistics."""
    shared = batches.sparkSession.sparkContext.broadcast(model)

    def run(parts: Iterator) -> Iterator:
        import pyarrow as pa

        total = np.zeros(3)
        for part in parts:
            for n, x, y in zip(*(part.column(c) for c in ("n", "x", "y")), strict=True):
                places, z = np.asarray(y.values), shared.value.forward(np.asarray(x.values).reshape(n.as_py(), -1))
                z = z - z.max(1, keepdims=True)
                logs = z - np.log(np.exp(z).sum(1, keepdims=True))
                own = (1 - smoothing) * logs[np.arange(len(places)), places] + smoothing * logs.mean(1)
                total += [len(places), -own.sum(), (z.argmax(1) == places).sum()]
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sum"])

    n, loss, right = np.sum(_sum_tree(batches.mapInArrow(run, "sum binary")), 0).tolist()
    return loss / n, right / n


def fit(train: DataFrame, validation: DataFrame, key: str, features: str, label: str, settings: Settings = Settings()) -> Fitted:
    """Trains on train and keeps the weights of the epoch with the lowest loss on validation.

    The rate falls along half a cosine over the epochs asked for. An epoch takes all batches of train, in steps of
    batches_a_step batches whose members change places with the epoch. Labels are those of train in their order; rows
    without features or label, and validation rows of other labels, are left out. Every row of a table must have as many
    features as the first; under two rows of train, one label only or an empty validation table are errors.
    """
    classes = [r[0] for r in train.where(F.col(label).isNotNull()).select(label).distinct().orderBy(label).collect()]
    if len(classes) < 2:
        raise TrainingError("training needs two labels at least")
    spark = train.sparkSession
    places = F.broadcast(spark.createDataFrame(list(enumerate(classes)), f"place int, label {train.schema[label].dataType.simpleString()}"))

    def table(rows: DataFrame) -> DataFrame:
        own = rows.select(F.col(key).alias("key"), F.col(features).alias("x"), F.col(label).alias("label")).join(places, "label")
        return batched(own, "key", "x", "place", settings.batch, settings.seed)

    own, held = table(train), table(validation)
    shape = own.unionByName(held).agg(F.max(F.size("x") / F.col("n")).alias("most"), F.min(F.size("x") / F.col("n")).alias("least")).first()
    n_batches, least = own.agg(F.count("*"), F.min("n")).first()
    if not n_batches or least < 2 or held.isEmpty() or shape["most"] != shape["least"] or shape["most"] % 1:
        raise TrainingError("training needs rows of equally many features, two of them to learn from and one to judge by")
    model = Mlp((int(shape["most"]), *settings.hidden, len(classes)), settings.seed)
    return descend(Dense, model, own, held, n_batches, classes, settings)


class Dense:
    """What descend() needs to know of a kind of network: the dense one here."""

    @staticmethod
    def flat(model: Mlp) -> np.ndarray:
        return flat(model)

    @staticmethod
    def filled(model: Mlp, values: np.ndarray) -> None:
        filled(model, values)

    @staticmethod
    def follow(model: Mlp, seen: np.ndarray) -> None:
        model.norms = followed(model.norms, seen)

    @staticmethod
    def step(batches: DataFrame, model: Mlp, settings: Settings, epoch: int) -> np.ndarray:
        return _step(batches, model, settings, epoch)

    @staticmethod
    def judge(batches: DataFrame, model: Mlp) -> tuple[float, float]:
        return evaluate(batches, model)


def descend(kind, model, own: DataFrame, held: DataFrame, n_batches: int, classes: list, settings: Settings) -> Fitted:
    """The rounds of a training: steps over own, a table with one batch a row (column no), by AdamW along half a cosine, and
    after each epoch a judgement on held; the network of the best one is kept."""
    values = kind.flat(model)
    first, second, steps = np.zeros_like(values), np.zeros_like(values), 0
    a_step = settings.batches_a_step or n_batches
    slices = -(-n_batches // a_step)
    fitted = Fitted(model, 0, math.inf, [], settings, classes)
    for epoch in range(1, settings.epochs + 1):
        rate = settings.rate * (1 + math.cos(math.pi * (epoch - 1) / settings.epochs)) / 2
        loss = rows = 0.0
        for k in range(slices):
            part = own if slices == 1 else own.where(F.pmod(F.xxhash64("no", F.lit(epoch)), F.lit(slices)) == k)
            total = kind.step(part, model, settings, epoch)
            if not total.size:
                continue  # no batch fell into this slice
            n, met, own_loss = total[:3].tolist()
            grad, seen = total[3 : 3 + values.size] / n, total[3 + values.size :] / met
            steps += 1
            first = DECAYS[0] * first + (1 - DECAYS[0]) * grad
            second = DECAYS[1] * second + (1 - DECAYS[1]) * grad**2
            move = (first / (1 - DECAYS[0] ** steps)) / (np.sqrt(second / (1 - DECAYS[1] ** steps)) + ADDEND)
            values = values * (1 - rate * settings.decay) - rate * move
            kind.filled(model, values)
            kind.follow(model, seen)
            loss, rows = loss + own_loss, rows + n
        judged, accuracy = kind.judge(held, model)
        fitted.history.append({"epoch": epoch, "rate": rate, "train_loss": loss / rows, "validation_loss": judged, "accuracy": accuracy})
        if judged < fitted.best_loss:
            fitted.best_epoch, fitted.best_loss, fitted.model = epoch, judged, copy.deepcopy(model)
        elif epoch - fitted.best_epoch >= settings.patience:
            break
    return fitted


def followed(norms: list[tuple], seen: np.ndarray) -> list[tuple]:
    """The normalisations with stored statistics moved towards those of a step's batches."""
    out, at = [], 0
    for gamma, beta, mean, variance in norms:
        n = len(mean)
        out.append((gamma, beta, (1 - MOMENTUM) * mean + MOMENTUM * seen[at : at + n], (1 - MOMENTUM) * variance + MOMENTUM * seen[at + n : at + 2 * n]))
        at += 2 * n
    return out


def predict(rows: DataFrame, fitted: Fitted, features: str, name: str = "prediction") -> DataFrame:
    """rows with the label of the network's highest score (ties: the first), null without features."""
    shared = rows.sparkSession.sparkContext.broadcast((fitted.model, fitted.classes))
    kind = type(fitted.classes[0])
    kept = rows.drop(name)
    schema = T.StructType([*kept.schema.fields, T.StructField(name, {int: T.LongType(), str: T.StringType()}.get(kind, T.DoubleType()))])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_type

        model, classes = shared.value
        for batch in batches:
            values = batch.column(features).to_pylist()
            known = [v for v in values if v is not None]
            best = iter(model.forward(np.array(known, float)).argmax(1).tolist() if known else [])
            found = pa.array([None if v is None else classes[next(best)] for v in values], to_arrow_type(schema[name].dataType))
            yield pa.RecordBatch.from_arrays([*batch.columns, found], names=[*batch.schema.names, name])

    return kept.mapInArrow(run, schema)


def save(fitted: Fitted, spark: SparkSession, path: str, contract: dict) -> dict:
    """Saves the network, how it was trained and the contract of its features below path; contract may not replace what
    describes the network. Returns what was saved beside the weights."""
    said = {
        "sizes": [w.shape[1] for w, _ in fitted.model.layers] + [len(fitted.classes)], "classes": fitted.classes, "best_epoch": fitted.best_epoch, "best_validation_loss": fitted.best_loss,
        "epochs_completed": len(fitted.history), "parameter_count": fitted.model.parameters(), "configuration": asdict(fitted.settings) | {"hidden": list(fitted.settings.hidden)}, "history": fitted.history,
        "environment": {"python": platform.python_version(), "platform": platform.platform(), "spark": spark.version, "numpy": np.__version__},
    }
    clash = set(said) & set(contract)
    if clash:
        raise ModelError(f"fields of the network can't be replaced: {', '.join(sorted(clash))}")
    stored = np.concatenate([a for *_, mean, variance in fitted.model.norms for a in (mean, variance)] or [np.zeros(0)])
    weights = [("learned", flat(fitted.model).tolist()), ("stored", stored.tolist())]
    spark.createDataFrame(weights, "part string, data array<double>").coalesce(1).write.parquet(f"{path}/weights")
    write_json(spark, f"{path}/network.json", said | contract)
    return said | contract


def load(spark: SparkSession, path: str, expected: dict) -> tuple[Mlp, dict]:
    """A saved network and what was saved beside it, if that has the expected values."""
    said = read_json(spark, f"{path}/network.json")
    missing = [f for f in ("sizes", "classes", "parameter_count") if f not in said]
    other = [k for k, v in expected.items() if said.get(k) != v]
    if missing or other:
        raise ModelError(f"another contract: {', '.join(sorted(missing + other))}")
    parts = {r["part"]: np.array(r["data"], float) for r in spark.read.parquet(f"{path}/weights").collect()}
    model = Mlp(tuple(said["sizes"]))
    if model.parameters() != said["parameter_count"] or len(parts["learned"]) != said["parameter_count"]:
        raise ModelError("the weights are not those of the described network")
    filled(model, parts["learned"])
    at, norms = 0, []
    for gamma, beta, mean, _ in model.norms:
        n = len(mean)
        norms.append((gamma, beta, parts["stored"][at : at + n], parts["stored"][at + n : at + 2 * n]))
        at += 2 * n
    model.norms = norms
    return model, said
