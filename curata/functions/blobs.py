"""Weights of a network as one blob of 32-bit floats with a registry of its tensors."""

from __future__ import annotations

import numpy as np

#: Fixed value: the name of the format for pictures.
PICTURES = "asl-browser-cnn-v1"


class BlobError(ValueError):
    """A blob does not fit its registry."""


def pack(tensors: dict[str, np.ndarray], kind: str = PICTURES, **more) -> tuple[dict, bytes]:
    """The registry (format, float_count, tensors with name, shape, offset and length) and the blob."""
    entries, at = [], 0
    for name, x in tensors.items():
        entries.append({"name": name, "shape": list(x.shape), "offset": at, "length": int(x.size)})
        at += int(x.size)
    blob = b"".join(np.ascontiguousarray(x, "<f4").tobytes() for x in tensors.values())
    return {"format": kind, "float_count": at, "tensors": entries, **more}, blob


def unpack(registry: dict, blob: bytes, kind: str = PICTURES, **expected) -> dict[str, np.ndarray]:
    """The tensors by name; another format, contract or length is an error."""
    other = [k for k, v in {"format": kind, **expected}.items() if registry.get(k) != v]
    if other:
        raise BlobError(f"another {', '.join(other)}")
    if len(blob) != 4 * registry["float_count"]:
        raise BlobError("the blob's length does not match its registry")
    whole = np.frombuffer(blob, "<f4")
    return {t["name"]: whole[t["offset"] : t["offset"] + t["length"]].reshape(t["shape"]) for t in registry["tensors"]}
