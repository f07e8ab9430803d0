"""Spark data sources for stored arrays: .npz files of features and blobs of 32-bit floats with a registry.

    register(spark)
    spark.read.format("npz").option("size", 79).load("s3://bucket/train.npz")
    spark.read.format("float_blob").option("registry", "model.json").load("model.f32")

The driver reads headers only. Each partition is a range of rows, or of one tensor's values, and reads its own bytes
through pyarrow's file systems, so paths may be local files or URIs of a shared store.
"""

from __future__ import annotations

import json
import math
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Rows, and values of a tensor, that a partition reads where nothing else is asked; rows of one Arrow batch.
ROWS, VALUES, BATCH = 65_536, 1 << 20, 4096
KINDS = {"f4": T.FloatType(), "f8": T.DoubleType(), "i1": T.ByteType(), "i2": T.ShortType(), "i4": T.IntegerType(), "i8": T.LongType(), "u1": T.ShortType(), "u2": T.IntegerType(), "u4": T.LongType(), "b1": T.BooleanType()}


class ArrayError(ValueError):
    """Stored arrays are not what is expected."""


def opened(path: str):
    """A file, by path or URI, for reading at any place."""
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem().open_input_file(path)
    system, inner = fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))
    return system.open_input_file(inner)


def text_of(path: str) -> str:
    """A small text file, or the parts of a folder that Spark wrote, in their order."""
    from pyarrow import fs

    system, inner = (fs.LocalFileSystem(), path) if "://" not in path else fs.FileSystem.from_uri(path)
    if system.get_file_info(inner).type == fs.FileType.Directory:
        parts = sorted(f.path for f in system.get_file_info(fs.FileSelector(inner)) if f.base_name.startswith("part-"))
    else:
        parts = [inner]
    out = []
    for part in parts:
        with system.open_input_file(part) as f:
            out.append(f.read().decode())
    return "".join(out)


@dataclass
class Member:
    """One array of a .npz file: its name, type, rows, shape of a row, and where its values begin."""

    name: str
    dtype: np.dtype
    rows: int
    shape: tuple[int, ...]
    begin: int

    @property
    def width(self) -> int:
        return self.dtype.itemsize * math.prod(self.shape)


def members(path: str) -> list[Member]:
    """The arrays of a .npz file, by its headers."""
    found = []
    with opened(path) as raw:
        try:
            archive = zipfile.ZipFile(raw)
        except zipfile.BadZipFile as error:
            raise ArrayError(f"{path} is no .npz file") from error
        for name in sorted(archive.namelist()):
            with archive.open(name) as f:
                read = {(1, 0): np.lib.format.read_array_header_1_0, (2, 0): np.lib.format.read_array_header_2_0}.get(np.lib.format.read_magic(f))
                if read is None:
                    raise ArrayError(f"{name} has an unknown version")
                shape, by_column, dtype = read(f)
                if dtype.str[1:] not in KINDS or not 1 <= len(shape) <= 2 or (by_column and len(shape) > 1):
                    raise ArrayError(f"{name} holds {shape} of {dtype}; rows of numbers are read")
                found.append(Member(name.removesuffix(".npy"), dtype, int(shape[0]), tuple(map(int, shape[1:])), f.tell()))
    return found


@dataclass
class Range(InputPartition):
    begin: int
    end: int


class NpzReader(DataSourceReader):
    def __init__(self, path: str, rows: int):
        self.path, self.rows = path, rows

    def partitions(self) -> list[Range]:
        total = members(self.path)[0].rows
        return [Range(at, min(total, at + self.rows)) for at in range(0, total, self.rows)]

    def read(self, partition: Range) -> Iterator:
        import pyarrow as pa

        own = members(self.path)
        with opened(self.path) as raw:
            archive = zipfile.ZipFile(raw)
            files = []
            for m in own:
                f = archive.open(f"{m.name}.npy")
                f.seek(m.begin + partition.begin * m.width)
                files.append(f)
            for at in range(partition.begin, partition.end, BATCH):
                n = min(BATCH, partition.end - at)
                columns = []
                for m, f in zip(own, files, strict=True):
                    held = f.read(n * m.width)
                    if len(held) != n * m.width:
                        raise ArrayError(f"{m.name} ends before its last row")
                    values = np.frombuffer(held, m.dtype)
                    values = values.astype(_wide(m.dtype))
                    flat = pa.array(values)
                    columns.append(pa.ListArray.from_arrays(pa.array(np.arange(0, len(values) + 1, m.shape[0] or 1, dtype=np.int32)[: n + 1]), flat) if m.shape else flat)
                yield pa.RecordBatch.from_arrays(columns, names=[m.name for m in own])


def _wide(dtype: np.dtype) -> np.dtype:
    """The type in the machine's byte order that Spark has for dtype."""
    return np.dtype({"u1": "i2", "u2": "i4", "u4": "i8", "b1": "?"}.get(dtype.str[1:], dtype.str[1:]))


class NpzSource(DataSource):
    """Arrays of a .npz file as columns, row by row: numbers, or arrays of numbers for arrays of two dimensions.

    Options: path; size, how many numbers a row of `features` must have; rows, how many a partition reads (of a
    compressed file each partition unpacks what comes before). Arrays of unlike length, none at all, no rows, or a wrong
    size are errors.
    """

    @classmethod
    def name(cls) -> str:
        return "npz"

    def schema(self) -> T.StructType:
        found, size = members(self.options["path"]), self.options.get("size")
        if not found or len({m.rows for m in found}) > 1:
            raise ArrayError(f"arrays of unlike length: { {m.name: m.rows for m in found} }")
        if not found[0].rows:
            raise ArrayError("no rows")
        for m in found:
            if m.name == "features" and size is not None and m.shape != (int(size),):
                raise ArrayError(f"rows of {m.shape} features, not {size}")
        return T.StructType([T.StructField(m.name, T.ArrayType(KINDS[m.dtype.str[1:]]) if m.shape else KINDS[m.dtype.str[1:]]) for m in found])

    def reader(self, schema: T.StructType) -> NpzReader:
        return NpzReader(self.options["path"], int(self.options.get("rows", ROWS)))


@dataclass
class Piece(InputPartition):
    name: str
    shape: tuple[int, ...]
    offset: int
    start: int
    length: int


class BlobReader(DataSourceReader):
    def __init__(self, path: str, registry: dict, values: int):
        self.path, self.registry, self.values = path, registry, values

    def partitions(self) -> list[Piece]:
        out = []
        for t in self.registry["tensors"]:
            for at in range(0, max(1, t["length"]), self.values):
                out.append(Piece(t["name"], tuple(t["shape"]), t["offset"], at, min(self.values, t["length"] - at)))
        return out

    def read(self, piece: Piece) -> Iterator:
        import pyarrow as pa

        with opened(self.path) as f:
            f.seek(4 * (piece.offset + piece.start))
            raw = f.read(4 * piece.length)
        if len(raw) != 4 * piece.length:
            raise ArrayError(f"{piece.name} ends before its last value")
        values = pa.array(np.frombuffer(raw, "<f4").astype("f4"))
        offsets = pa.array([0, piece.length], pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array([piece.name]), pa.array([list(piece.shape)], pa.list_(pa.int64())), pa.array([piece.start], pa.int64()), pa.ListArray.from_arrays(offsets, values)], names=["name", "shape", "start", "data"])


class BlobSource(DataSource):
    """Tensors of a blob of little-endian 32-bit floats: name, shape, start, data; long tensors come in pieces that begin
    at start. Options: path; registry, the JSON document beside it; format, which the registry must name; values, how
    many a piece has at most. A blob of another length than its registry says is an error, as are tensors that lie
    outside it or have another length than their shape."""

    @classmethod
    def name(cls) -> str:
        return "float_blob"

    def schema(self) -> str:
        registry = self._registry()
        wanted = self.options.get("format")
        if wanted is not None and registry.get("format") != wanted:
            raise ArrayError(f"format {registry.get('format')!r}, not {wanted!r}")
        with opened(self.options["path"]) as f:
            size = f.size()
        if size != 4 * registry["float_count"]:
            raise ArrayError(f"{size} bytes, but {registry['float_count']} values in the registry")
        for t in registry["tensors"]:
            if t["length"] != math.prod(t["shape"]) or t["offset"] < 0 or t["offset"] + t["length"] > registry["float_count"]:
                raise ArrayError(f"tensor {t['name']} does not lie in the blob")
        return "name string, shape array<long>, start long, data array<float>"

    def _registry(self) -> dict:
        return json.loads(text_of(self.options["registry"]))

    def reader(self, schema: T.StructType) -> BlobReader:
        return BlobReader(self.options["path"], self._registry(), int(self.options.get("values", VALUES)))


def register(spark: SparkSession) -> None:
    """Makes both formats known to a session."""
    spark.dataSource.register(NpzSource)
    spark.dataSource.register(BlobSource)
