"""Networks as files for other runtimes: one blob, its registry, and outputs on a fixed input that a reader must match."""

from __future__ import annotations

import hashlib
import json

import numpy as np
from pyspark.sql import SparkSession

from ..functions import blobs
from ..sources import arrays
from .pictures import MOST_PARAMETERS, Cnn

#: The size and first state of the input that parity is checked on, and how far outputs may lie apart.
SIZE, SEED, APART = 64, 42, 1e-5


def parity_input(size: int = SIZE, seed: int = SEED) -> np.ndarray:
    """Channels x size x size numbers from -1 to 1, the sequence of vectors.lcg()."""
    out, state = np.empty(3 * size * size), seed
    for k in range(len(out)):
        #: Multiplier, increment, modulus.
        state = (state * 1664525 + 1013904223) % (1 << 32)
        out[k] = state / (1 << 32) * 2 - 1
    return out.astype("f4").astype(float).reshape(3, size, size)


def probabilities(model: Cnn, x: np.ndarray) -> np.ndarray:
    z = model.forward(x)
    p = np.exp(z - z.max())
    return p / p.sum()


def tensors(model: Cnn) -> dict[str, np.ndarray]:
    """What a network is made of, in its order."""
    out: dict[str, np.ndarray] = {}
    for k, block in enumerate(model.blocks):
        for j, parts in enumerate(block):
            out |= {f"block{k}.{j}.{name}": x for name, x in zip(("weight", "scale", "shift", "mean", "variance"), parts, strict=True)}
    return out | {"classifier.weight": model.weights, "classifier.bias": model.bias}


def _written(path: str, content: bytes) -> None:
    from pyarrow import fs

    system, inner = (fs.LocalFileSystem(), path) if "://" not in path else fs.FileSystem.from_uri(path)
    system.create_dir(inner.rsplit("/", 1)[0], recursive=True)
    with system.open_output_stream(inner) as f:
        f.write(content)


def export(model: Cnn, path: str, classes: list[str], size: int = SIZE, **more) -> dict:
    """Writes path.f32 and path.json: the registry with the blob's digest and the outputs on parity_input(). A network is
    at most MOST_PARAMETERS values, so one file by the driver holds it. Returns the registry."""
    if model.parameters() >= MOST_PARAMETERS:
        raise blobs.BlobError("too many parameters for one blob")
    registry, blob = blobs.pack(tensors(model), class_names=list(classes), image_size=size, channels=[b[0][0].shape[0] for b in model.blocks], **more)
    single = rebuilt(registry, blobs.unpack(registry, blob))  # what a reader has: 32-bit values
    registry |= {"weight_sha256": hashlib.sha256(blob).hexdigest(), "parity": {"seed": SEED, "expected": probabilities(single, parity_input(size)).tolist()}}
    _written(f"{path}.f32", blob)
    _written(f"{path}.json", json.dumps(registry, indent=2, sort_keys=True).encode())
    return registry


def rebuilt(registry: dict, parts: dict[str, np.ndarray]) -> Cnn:
    """The network of a registry from its tensors."""
    model = Cnn(tuple(registry["channels"]), len(registry["class_names"]))
    wanted = tensors(model)
    wrong = [name for name, x in wanted.items() if name not in parts or parts[name].shape != x.shape]
    if wrong or set(parts) != set(wanted):
        raise blobs.BlobError(f"tensors missing or of another shape: {', '.join(sorted(wrong or set(parts) - set(wanted)))}")
    model.blocks = [[tuple(parts[f"block{k}.{j}.{name}"].astype(float) for name in ("weight", "scale", "shift", "mean", "variance")) for j in range(len(block))] for k, block in enumerate(model.blocks)]
    model.weights, model.bias = parts["classifier.weight"].astype(float), parts["classifier.bias"].astype(float)
    return model


def load(spark: SparkSession, path: str, classes: list[str] | None = None) -> tuple[Cnn, dict]:
    """The network that export() wrote and its registry. Tensors are read by tasks, one or more a tensor; a task compares
    the blob's digest and the outputs on the fixed input, and refuses a network that differs in either."""
    arrays.register(spark)
    registry = json.loads(arrays.text_of(f"{path}.json"))
    if classes is not None and registry.get("class_names") != list(classes):
        raise blobs.BlobError("a network of other classes")
    read = spark.read.format("float_blob").option("registry", f"{path}.json").option("format", blobs.PICTURES).load(f"{path}.f32")
    if registry["float_count"] >= MOST_PARAMETERS:
        raise blobs.BlobError("too many parameters for a compact network")
    pieces: dict[str, list] = {}
    for r in read.collect():  # bounded by MOST_PARAMETERS
        pieces.setdefault(r.name, []).append((r.start, r.shape, r.data))
    model = rebuilt(registry, {name: np.concatenate([np.array(d, "f4") for _, _, d in sorted(own)]).reshape(own[0][1]) for name, own in pieces.items()})
    said = spark.sparkContext.broadcast((model, registry))

    def check(batches):
        import pyarrow as pa

        own, told = said.value
        for _ in batches:
            digest = hashlib.sha256()
            with arrays.opened(f"{path}.f32") as f:
                while held := f.read(1 << 20):
                    digest.update(held)
            apart = np.abs(probabilities(own, parity_input(told["image_size"], told["parity"]["seed"])) - told["parity"]["expected"]).max()
            yield pa.RecordBatch.from_arrays([pa.array([digest.hexdigest()]), pa.array([float(apart)])], names=["digest", "apart"])

    found = spark.range(1, numPartitions=1).mapInArrow(check, "digest string, apart double").first()
    if found.digest != registry["weight_sha256"]:
        raise blobs.BlobError("the blob's bytes are not those that were exported")
    if not found.apart <= APART:
        raise blobs.BlobError(f"outputs lie {found.apart} from those recorded")
    return model, registry
