"""Training of the compact picture network, by the same steps as the dense one.

Batches of pictures are dealt once, by a seeded digest of their paths, into rows of a written table. In each epoch every
picture is augmented anew from its own bytes by a profile, with parameters that its path and the epoch decide; a task
computes its batches' gradients through convolutions as matrix products; sums meet in a tree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import augment
from ..functions.hashing import split_key
from ..sources.scratch import settled
from .network import EPSILON, SMOOTHING, Fitted, Settings, TrainingError, _sum_tree, descend, followed
from .pictures import Cnn, array_of
from .ranking import by_digest


def _windows(x: np.ndarray) -> np.ndarray:
    """Each place's 3 x 3 surroundings in all channels as a row: pictures x channels x height x width to a matrix."""
    seen = np.lib.stride_tricks.sliding_window_view(np.pad(x, ((0, 0), (0, 0), (1, 1), (1, 1))), (3, 3), axis=(2, 3))
    return seen.transpose(0, 2, 3, 1, 4, 5).reshape(-1, x.shape[1] * 9)


def _spread(rows: np.ndarray, shape: tuple[int, ...]) -> np.ndarray:
    """The reverse of _windows(): what each place gets from all the surroundings it is part of."""
    n, c, h, w = shape
    parts, out = rows.reshape(n, h, w, c, 3, 3), np.zeros((n, c, h + 2, w + 2))
    for a in range(3):
        for b in range(3):
            out[:, :, a : a + h, b : b + w] += parts[..., a, b].transpose(0, 3, 1, 2)
    return out[:, :, 1:-1, 1:-1]


def _pooled(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The largest of each 2 x 2 places, and which of them it was (the first of equal ones)."""
    n, c, h, w = x.shape
    four = x[:, :, : h // 2 * 2, : w // 2 * 2].reshape(n, c, h // 2, 2, w // 2, 2).transpose(0, 1, 2, 4, 3, 5).reshape(n, c, h // 2, w // 2, 4)
    which = four.argmax(-1)
    return np.take_along_axis(four, which[..., None], -1)[..., 0], which


def _unpooled(up: np.ndarray, which: np.ndarray, shape: tuple[int, ...]) -> np.ndarray:
    n, c, h, w = shape
    four = np.zeros((*up.shape, 4))
    np.put_along_axis(four, which[..., None], up[..., None], -1)
    out = np.zeros(shape)
    out[:, :, : h // 2 * 2, : w // 2 * 2] = four.reshape(n, c, h // 2, w // 2, 2, 2).transpose(0, 1, 2, 4, 3, 5).reshape(n, c, h // 2 * 2, w // 2 * 2)
    return out


def flat(model: Cnn) -> np.ndarray:
    """What is learned, in one row: weight, scale and shift of each layer, then the last layer's weights and bias."""
    return np.concatenate([a.ravel() for block in model.blocks for w, g, b, *_ in block for a in (w, g, b)] + [model.weights.ravel(), model.bias])


def filled(model: Cnn, values: np.ndarray) -> None:
    at = 0

    def take(like: np.ndarray) -> np.ndarray:
        nonlocal at
        at += like.size
        return values[at - like.size : at].reshape(like.shape).copy()

    model.blocks = [[(take(w), take(g), take(b), m, v) for w, g, b, m, v in block] for block in model.blocks]
    model.weights, model.bias = take(model.weights), take(model.bias)


def gradients(model: Cnn, x: np.ndarray, y: np.ndarray, keep: np.ndarray, smoothing: float = SMOOTHING) -> tuple[float, np.ndarray, np.ndarray]:
    """Of one batch (pictures x channels x height x width), summed over its pictures: the loss, its gradient in the order
    of flat(), and each layer's mean and variance (unbiased). keep: what the last layer's inputs are multiplied with."""
    through: list = []
    for block in model.blocks:
        layers = []
        for w, gamma, beta, *_ in block:
            rows = _windows(x)
            z = (rows @ w.reshape(len(w), -1).T).reshape(len(x), *x.shape[2:], len(w)).transpose(0, 3, 1, 2)
            mean, variance = z.mean((0, 2, 3)), z.var((0, 2, 3))
            unit = (z - mean[:, None, None]) / np.sqrt(variance + EPSILON)[:, None, None]
            a = unit * gamma[:, None, None] + beta[:, None, None]
            layers.append((rows, x.shape, unit, mean, variance, a > 0))
            x = np.maximum(a, 0)
        before = x.shape
        x, which = _pooled(x)
        through.append((layers, before, which))
    means = x.mean((2, 3)) * keep
    z = means @ model.weights.T + model.bias
    z = z - z.max(1, keepdims=True)
    logs = z - np.log(np.exp(z).sum(1, keepdims=True))
    target = np.full_like(logs, smoothing / logs.shape[1])
    target[np.arange(len(y)), y] += 1 - smoothing
    up = np.exp(logs) - target
    grads: list = [(up.T @ means).ravel(), up.sum(0)]
    down = np.broadcast_to(((up @ model.weights) * keep)[:, :, None, None] / (x.shape[2] * x.shape[3]), x.shape)
    for block, (layers, before, which) in zip(reversed(model.blocks), reversed(through), strict=True):
        down = _unpooled(down, which, before)
        for (w, gamma, *_), (rows, shape, unit, _, variance, positive) in zip(reversed(block), reversed(layers), strict=True):
            up = down * positive
            scale, shift = (up * unit).sum((0, 2, 3)), up.sum((0, 2, 3))
            up = up * gamma[:, None, None]
            up = (up - up.mean((0, 2, 3))[:, None, None] - unit * (up * unit).mean((0, 2, 3))[:, None, None]) / np.sqrt(variance + EPSILON)[:, None, None]
            each = up.transpose(0, 2, 3, 1).reshape(-1, len(w))
            grads = [(each.T @ rows).ravel(), scale, shift, *grads]
            down = _spread(each @ w.reshape(len(w), -1), shape)
    n = lambda unit: unit.shape[0] * unit.shape[2] * unit.shape[3]
    seen = [s for layers, *_ in through for _, _, unit, mean, variance, _ in layers for s in (mean, variance * n(unit) / max(1, n(unit) - 1))]
    return float(-(target * logs).sum()), np.concatenate(grads), np.concatenate(seen)


def batched(rows: DataFrame, place: str, size: int, seed: int) -> DataFrame:
    """no, n, own: pictures (path, height, width, channels, data and place) dealt into batches of about size in the order of
    a seeded digest of their paths. Rows without a picture or a place are left out."""
    known = rows.where(F.col("data").isNotNull() & F.col(place).isNotNull()).withColumn("digest", split_key(seed, F.coalesce("path", F.lit(""))))
    ranked = by_digest(known, [], "digest", ["path", place], "at", "rows")
    dealt = ranked.withColumn("no", F.floor(F.col("at") * F.greatest(F.lit(1), F.floor(F.col("rows") / size)) / F.col("rows")))
    own = F.array_sort(F.collect_list(F.struct("at", "path", "height", "width", "channels", "data", F.col(place).cast("int").alias("y"))))
    return settled(dealt.groupBy("no").agg(own.alias("own")).select("no", F.size("own").alias("n"), "own"))


def _decoded(own: list[dict]) -> list[np.ndarray]:
    return [array_of(r["data"], r["height"], r["width"], r["channels"]) for r in own]


class Pictures:
    """The kind of network that descend() trains here: pictures of size x size, augmented by a profile."""

    def __init__(self, size: int, profile: str):
        self.size, self.profile = size, profile

    def flat(self, model: Cnn) -> np.ndarray:
        return flat(model)

    def filled(self, model: Cnn, values: np.ndarray) -> None:
        filled(model, values)

    def follow(self, model: Cnn, seen: np.ndarray) -> None:
        layers = iter(followed([(g, b, m, v) for block in model.blocks for _, g, b, m, v in block], seen))
        model.blocks = [[(w, *next(layers)) for w, *_ in block] for block in model.blocks]

    def step(self, batches: DataFrame, model: Cnn, settings: Settings, epoch: int) -> np.ndarray:
        shared, size, profile = batches.sparkSession.sparkContext.broadcast(model), self.size, self.profile

        def run(parts: Iterator) -> Iterator:
            import pyarrow as pa

            total = None
            for part in parts:
                for k in range(part.num_rows):  # one batch of pictures at a time
                    no, own = part.column("no")[k].as_py(), part.column("own")[k].as_py()
                    x = []
                    for r, image in zip(own, _decoded(own), strict=True):
                        changes = augment.drawn(profile, augment.generator(settings.seed, epoch, r["path"]), *image.shape[:2], size)
                        x.append(augment.normalised(image, size, changes))
                    draw = np.random.default_rng([settings.seed, epoch, no])
                    keep = (draw.random((len(own), shared.value.weights.shape[1])) >= settings.dropout) / (1 - settings.dropout)
                    loss, grad, seen = gradients(shared.value, np.stack(x).astype(float), np.array([r["y"] for r in own]), keep)
                    found = np.concatenate([[len(own), 1, loss], grad, seen])
                    total = found if total is None else total + found
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sum"])

        sums = _sum_tree(batches.mapInArrow(run, "sum binary"))
        return np.sum(sums, 0) if sums else np.zeros(0)

    def judge(self, batches: DataFrame, model: Cnn) -> tuple[float, float]:
        shared, size = batches.sparkSession.sparkContext.broadcast(model), self.size

        def run(parts: Iterator) -> Iterator:
            import pyarrow as pa

            total = np.zeros(3)
            for part in parts:
                for k in range(part.num_rows):
                    own = part.column("own")[k].as_py()
                    for r, image in zip(own, _decoded(own), strict=True):
                        z = shared.value.forward(augment.normalised(image, size).astype(float))
                        logs = z - z.max() - np.log(np.exp(z - z.max()).sum())
                        total += [1, -((1 - SMOOTHING) * logs[r["y"]] + SMOOTHING * logs.mean()), z.argmax() == r["y"]]
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sum"])

        n, loss, right = np.sum(_sum_tree(batches.mapInArrow(run, "sum binary")), 0).tolist()
        return loss / n, right / n


def fit(train: DataFrame, validation: DataFrame, label: str, size: int, channels: tuple[int, ...] = (24, 48, 96), profile: str = augment.DEFAULT, settings: Settings = Settings(epochs=12, batch=64, rate=1e-3, dropout=0.2, patience=3)) -> Fitted:
    """Trains the compact network on pictures (path, height, width, channels, data and label) and keeps the weights of the
    epoch with the lowest loss on validation, whose pictures are not augmented. Labels are those of train in their order;
    rows without picture or label, and validation rows of other labels, are left out. An unknown profile, one label only, a
    single picture, no validation picture, or a size that the blocks can't halve are errors."""
    augment.profile(profile)
    if size < 1 << len(channels):
        raise TrainingError(f"pictures of {size} can't be halved {len(channels)} times")
    classes = [r[0] for r in train.where(F.col(label).isNotNull()).select(label).distinct().orderBy(label).collect()]  # one row a class
    if len(classes) < 2:
        raise TrainingError("training needs two labels at least")
    kind = train.schema[label].dataType.simpleString()
    places = F.broadcast(train.sparkSession.createDataFrame(list(enumerate(classes)), f"place int, label {kind}"))
    columns = ["path", "height", "width", "channels", "data"]
    table = lambda rows: batched(rows.select(*columns, F.col(label).alias("label")).join(places, "label"), "place", settings.batch, settings.seed)
    own, held = table(train), table(validation)
    n_batches, least = own.agg(F.count("*"), F.min("n")).first()
    if not n_batches or least < 2 or held.isEmpty():
        raise TrainingError("training needs two pictures to learn from and one to judge by")
    return descend(Pictures(size, profile), Cnn(channels, len(classes), settings.seed), own, held, n_batches, classes, settings)


def predict(rows: DataFrame, fitted: Fitted, size: int, name: str = "prediction") -> DataFrame:
    """Pictures (path, height, width, channels, data and others) without data, with the label of the highest score."""
    from .pictures import map_pictures

    shared = rows.sparkSession.sparkContext.broadcast((fitted.model, fitted.classes))
    kind = {int: "long", str: "string"}.get(type(fitted.classes[0]), "double")
    return map_pictures(rows, lambda x, _: shared.value[1][int(shared.value[0].forward(augment.normalised(x, size).astype(float)).argmax())], name, kind)
