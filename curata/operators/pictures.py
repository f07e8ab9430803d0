"""Pictures as rows: decoding by Spark, numpy on Arrow batches, networks with fixed weights."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import augment, jpeg, pixels

#: Turned pictures whose paths may be sent to all tasks; more are joined by a shuffle.
BROADCAST_TURNED = 100_000


def read(spark: SparkSession, path: str) -> DataFrame:
    """path, height, width, channels, data (rows of BGR bytes, as Spark decodes); files that can't be decoded are left out."""
    found = spark.read.format("image").option("dropInvalid", "true").option("recursiveFileLookup", "true").load(path)
    return found.select(F.regexp_replace("image.origin", "^file:/+", "file:/").alias("path"), "image.height", "image.width", F.col("image.nChannels").alias("channels"), "image.data")


def undecodable(spark: SparkSession, path: str) -> DataFrame:
    """path of the files below path that read() leaves out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")
    return files.join(read(spark, path).select("path"), "path", "left_anti")


def orientations(spark: SparkSession, path: str) -> DataFrame:
    """path, orientation (2 to 8) of the files below path that ask to be turned. Files without the tag, of other formats
    or with a damaged one don't appear."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for k in range(batch.num_rows):  # one file's bytes at a time
                how = jpeg.orientation(batch.column(1)[k].as_py())
                if how > 1:
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1), pa.array([how], pa.int32())], names=["path", "orientation"])

    return files.mapInArrow(run, "path string, orientation int")


def read_upright(spark: SparkSession, path: str) -> DataFrame:
    """read(), with the pictures turned as their files ask; height and width are those of the turned picture."""
    told = orientations(spark, path)
    told = F.broadcast(told) if told.limit(BROADCAST_TURNED + 1).count() <= BROADCAST_TURNED else told
    rows = read(spark, path).join(told.withColumn("path", F.regexp_replace("path", "^file:/+", "file:/")), "path", "left")
    columns = ["path", "height", "width", "channels", "data"]

    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            for r in batch.itertuples():
                if r.orientation > 1:  # null: as it is
                    x = np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, r.channels)
                    x = np.ascontiguousarray(jpeg.turned(x, int(r.orientation)))
                    batch.at[r.Index, "height"], batch.at[r.Index, "width"], batch.at[r.Index, "data"] = x.shape[0], x.shape[1], x.tobytes()
            yield batch[columns]

    return rows.mapInPandas(run, rows.select(*columns).schema)


def augmented(rows: DataFrame, profile: str, epoch: int, size: int, key: str = "path", seed: int = 42) -> DataFrame:
    """Pictures as a profile's training input of an epoch: column tensor, 3 x size x size normalised values. What is drawn
    depends on seed, epoch and the row's key alone. An unknown profile is an error."""
    augment.profile(profile)

    def make(x: np.ndarray, row) -> list[float]:
        draw = augment.generator(seed, epoch, getattr(row, key))
        return augment.normalised(x, size, augment.drawn(profile, draw, *x.shape[:2], size)).ravel().tolist()

    return map_pictures(rows, make, "tensor", "array<float>")


def array_of(data: bytes, height: int, width: int, channels: int) -> np.ndarray:
    """RGB from the decoder's bytes."""
    x = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    return np.repeat(x, 3, 2) if channels == 1 else x[..., 2::-1]


def map_pictures(rows: DataFrame, make, column: str, kind: str) -> DataFrame:
    """rows without data, with column = make(RGB array, row)."""
    kept = [c for c in rows.columns if c != "data" and c != column]
    schema = T.StructType([*rows.select(*kept).schema.fields, *T.StructType.fromDDL(f"{column} {kind}").fields])

    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            made = [make(array_of(r.data, r.height, r.width, r.channels), r) for r in batch.itertuples()]
            yield batch[kept].assign(**{column: made})

    return rows.mapInPandas(run, schema)


def grey_vectors(rows: DataFrame, size: int = 64) -> DataFrame:
    """Pictures as features: size x size grey values from 0 to 1, row by row, as many batches as the pictures fill."""
    return map_pictures(rows, lambda x, _: (pixels.to_bytes(pixels.resize(pixels.grey_bytes(x)[..., None], size, size)) / 255).ravel().tolist(), "features", "array<double>")


def with_dhash(rows: DataFrame) -> DataFrame:
    return map_pictures(rows, lambda x, _: pixels.dhash(x), "dhash", "long")


def with_quality(rows: DataFrame) -> DataFrame:
    """Adds why a picture is not usable, or null."""
    return map_pictures(rows, lambda x, _: pixels.usable(x), "refused", "string")


def corrupted(rows: DataFrame) -> DataFrame:
    """Pictures under their row's corruption (columns corruption, seed), as RGB bytes."""
    return map_pictures(rows, lambda x, r: pixels.corrupt(x, r.corruption, int(r.seed)).tobytes(), "pixels", "binary")


#: Fixed value: a compact network has fewer parameters.
MOST_PARAMETERS = 1_000_000


class Cnn:
    """Three blocks of two 3 x 3 convolutions with normalisation and a pool, then an average and a linear layer."""

    def __init__(self, channels: tuple[int, ...] = (24, 48, 96), classes: int = 26, seed: int = 0):
        rng, before = np.random.default_rng(seed), 3
        self.blocks = []
        for width in channels:
            block = []
            for _ in range(2):
                block.append((rng.normal(0, (2 / (9 * before)) ** 0.5, (width, before, 3, 3)), *(np.full(width, v) for v in (1.0, 0.0, 0.0, 1.0))))
                before = width
            self.blocks.append(block)
        self.weights, self.bias = rng.normal(0, 0.1, (classes, before)), np.zeros(classes)
        if self.parameters() >= MOST_PARAMETERS:
            raise ValueError(f"{self.parameters()} parameters are too many for a compact network")

    def parameters(self) -> int:
        return sum(w.size + g.size + b.size for block in self.blocks for w, g, b, *_ in block) + self.weights.size + self.bias.size

    def forward(self, x: np.ndarray) -> np.ndarray:
        """Logits of one channels x height x width picture."""
        for block in self.blocks:
            for w, gamma, beta, mean, variance in block:
                padded = np.pad(x, ((0, 0), (1, 1), (1, 1)))
                seen = np.lib.stride_tricks.sliding_window_view(padded, (3, 3), axis=(1, 2))
                y = np.einsum("oikl,ihwkl->ohw", w, seen, optimize=True)
                scale = gamma / np.sqrt(variance + 1e-5)
                x = np.maximum(0, y * scale[:, None, None] + (beta - mean * scale)[:, None, None])
            c, h, w = x.shape
            x = x[:, : h // 2 * 2, : w // 2 * 2].reshape(c, h // 2, 2, w // 2, 2).max((2, 4))
        return self.weights @ x.mean((1, 2)) + self.bias


class Mlp:
    """Dense layers with normalisation, the positive part between them."""

    def __init__(self, sizes: tuple[int, ...] = (79, 256, 128, 26), seed: int = 0):
        rng = np.random.default_rng(seed)
        self.layers = [(rng.normal(0, (2 / a) ** 0.5, (b, a)), np.zeros(b)) for a, b in zip(sizes, sizes[1:], strict=False)]
        self.norms = [tuple(np.full(n, v) for v in (1.0, 0.0, 0.0, 1.0)) for n in sizes[1:-1]]

    def parameters(self) -> int:
        return sum(w.size + b.size for w, b in self.layers) + sum(g.size + b.size for g, b, *_ in self.norms)

    def forward(self, x: np.ndarray) -> np.ndarray:
        """Logits of rows of features."""
        for (w, b), (gamma, beta, mean, variance) in zip(self.layers, self.norms, strict=False):
            x = np.maximum(0, (x @ w.T + b - mean) / np.sqrt(variance + 1e-5) * gamma + beta)
        w, b = self.layers[-1]
        return x @ w.T + b


def with_logits(rows: DataFrame, model: Cnn, size: int) -> DataFrame:
    """Pictures with the network's logits; the model goes to each executor once."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    return map_pictures(rows, lambda x, _: shared.value.forward(pixels.preprocess(x, size)).tolist(), "logits", "array<double>")


def feature_logits(rows: DataFrame, features: str, model: Mlp) -> DataFrame:
    """rows with the logits of their feature arrays; null features stay null."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    schema = T.StructType([*rows.drop("logits").schema.fields, T.StructField("logits", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            values = batch.column(features).to_pylist()
            known = [v for v in values if v is not None]
            made = iter(shared.value.forward(np.array(known, float)).tolist() if known else [])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([None if v is None else next(made) for v in values], pa.list_(pa.float64()))], names=[*batch.schema.names, "logits"])

    return rows.drop("logits").mapInArrow(run, schema)
