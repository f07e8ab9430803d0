"""Quality classifier: attention-based multiple-instance learning over a document's passages."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import charcodes
from .arrow import by_text
from .sampling import bounded, id_remainder


@dataclass(frozen=True)
class Settings:
    """passage: code points of one; sample: labelled rows that the model is fitted on, at most about so many; passages: of
    each of them so many at most, spread evenly over the whole text, go to the driver (scores are of all passages)."""

    passage: int = 512
    passages: int = 32
    hashed: int = 128
    hidden: int = 32
    gate: int = 16
    sample: int = 5000
    epochs: int = 12
    batch: int = 32
    rate: float = 3e-3
    decay: float = 1e-4
    seed: int = 9


def passage_features(text: str, s: Settings) -> np.ndarray:
    """One row per passage of the whole text (an empty text has one): shares of character classes, of changes between
    classes, of hashed characters and pairs, and how often the passage's four-character pieces occur again in the text."""
    c = charcodes.codes(text).astype(np.uint64)
    kinds, k = charcodes.classes(c), len(charcodes.CLASSES)
    n = max(1, -(-len(c) // s.passage))
    at = np.arange(len(c)) // s.passage
    size = np.maximum(np.bincount(at, minlength=n), 1)[:, None]

    def shares(slots: np.ndarray, own: np.ndarray, width: int) -> np.ndarray:
        return np.bincount(own * width + slots, minlength=n * width).reshape(n, width) / size

    pairs = kinds[:-1].astype(np.int64) * k + kinds[1:]
    mixed = lambda x: ((x * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(57)).astype(np.int64) % s.hashed
    fours = c[:-3] * np.uint64(0x9E3779B97F4A7C15) + c[1:-2] * np.uint64(0xC2B2AE3D27D4EB4F) + c[2:-1] * np.uint64(0x165667B19E3779F9) + c[3:] if len(c) > 3 else c[:0]
    _, back, times = np.unique(fours, return_inverse=True, return_counts=True) if len(fours) else (None, np.zeros(0, np.int64), np.zeros(0))
    again = np.bincount(at[: len(fours)], weights=np.log2(times[back]) if len(fours) else None, minlength=n)[:, None] / size
    return np.hstack([np.sqrt(shares(kinds.astype(np.int64), at, k)), np.sqrt(shares(pairs, at[:-1], k * k)), np.sqrt(shares(mixed(c), at, s.hashed)), np.sqrt(shares(mixed(c[:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + c[1:]), at[:-1], s.hashed)), again / 8, np.minimum(size, s.passage) / s.passage]).astype(np.float32)


def width(s: Settings) -> int:
    k = len(charcodes.CLASSES)
    return k + k * k + 2 * s.hashed + 2


def start(s: Settings) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(s.seed)
    shapes = {"W": (width(s), s.hidden), "b": (s.hidden,), "V": (s.hidden, s.gate), "U": (s.hidden, s.gate), "w": (s.gate,), "o": (s.hidden,), "c": ()}
    return {k: rng.normal(0, 1 / np.sqrt(x[0]), x) if len(x) == 2 or k in "wo" else np.zeros(x) for k, x in shapes.items()}


def forward(p: dict, x: np.ndarray, bag: np.ndarray, n: int) -> dict:
    """Passages x, bag of each (rising), n bags: encodings, attention weights within the bag, bag vectors, scores."""
    h = np.tanh(x @ p["W"] + p["b"])
    tv, su = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
    e = (tv * su) @ p["w"]
    top = np.full(n, -np.inf)
    np.maximum.at(top, bag, e)
    a = np.exp(e - top[bag])
    a /= np.bincount(bag, a, n)[bag]
    z = np.zeros((n, h.shape[1]))
    np.add.at(z, bag, a[:, None] * h)
    return {"h": h, "tv": tv, "su": su, "a": a, "z": z, "y": 1 / (1 + np.exp(-(z @ p["o"] + p["c"])))}


def gradients(p: dict, x: np.ndarray, bag: np.ndarray, f: dict, y: np.ndarray) -> dict:
    """Of the mean log loss, by hand through the attention."""
    d = (f["y"] - y) / len(y)
    dz = d[:, None] * p["o"]
    da = (dz[bag] * f["h"]).sum(1)
    de = f["a"] * (da - np.bincount(bag, f["a"] * da, len(y))[bag])
    dtv = de[:, None] * f["su"] * p["w"] * (1 - f["tv"] ** 2)
    dsu = de[:, None] * f["tv"] * p["w"] * f["su"] * (1 - f["su"])
    dh = f["a"][:, None] * dz[bag] + dtv @ p["V"].T + dsu @ p["U"].T
    dx = dh * (1 - f["h"] ** 2)
    return {"W": x.T @ dx, "b": dx.sum(0), "V": f["h"].T @ dtv, "U": f["h"].T @ dsu, "w": (f["tv"] * f["su"]).T @ de, "o": f["z"].T @ d, "c": d.sum()}


@dataclass(frozen=True)
class Model:
    settings: Settings
    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]


def train(bags: list[np.ndarray], y: np.ndarray, s: Settings) -> Model:
    """Adam with decoupled decay over bags of passages and their document labels."""
    p = start(s)
    if not bags:
        return Model(s, np.zeros(width(s)), np.ones(width(s)), p)
    means = np.array([b.mean(0) for b in bags])
    mean, scale = means.mean(0), 1 / np.maximum(means.std(0), 0.02)
    m, v, step, rng = {k: 0.0 for k in p}, {k: 0.0 for k in p}, 0, np.random.default_rng(s.seed)
    for _ in range(s.epochs):
        order = rng.permutation(len(bags))
        for at in range(0, len(order), s.batch):
            own = order[at : at + s.batch]
            x, bag, step = (np.vstack([bags[i] for i in own]) - mean) * scale, charcodes.runs([len(bags[i]) for i in own]), step + 1
            g = gradients(p, x, bag, forward(p, x, bag, len(own)), y[own])
            for k in p:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                p[k] = p[k] * (1 - s.rate * s.decay) - s.rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return Model(s, mean, scale, p)


def held_out() -> Column:
    """The documents whose labels no model may see."""
    return id_remainder("doc_id", 5) == 0


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model:
    """Learns from docs (doc_id, text) and labels (doc_id, quality 0 or 1).

    At most about settings.sample labelled ids are used, chosen by a hash of doc_id; of repeated labels of one id the
    mean counts, of rows that repeat a doc_id the lowest text (null as empty). Of a text of more than settings.passages
    passages that many are learned from, so what the driver gets is bounded by the two settings. Rows without quality are
    left out; without any row the model is untrained; further columns are not read.
    """
    s = settings

    def learned(text: str) -> bytes:
        own = passage_features(text, s)
        return own[np.unique(np.linspace(0, len(own) - 1, min(len(own), s.passages)).round().astype(int))].tobytes()

    def bags(batches: Iterator) -> Iterator:
        import pandas as pd

        for batch in batches:
            for i in range(0, len(batch), 200):
                part = batch.iloc[i : i + 200]
                yield pd.DataFrame({"key": part["key"], "quality": part["quality"], "bag": [learned(x if isinstance(x, str) else "") for x in part["text"]]})

    known = labels.where(F.col("quality").isNotNull()).groupBy("doc_id").agg(F.avg("quality").alias("quality"))
    # The chosen labels are few by the sample's bound, so they go to the texts.
    chosen = F.broadcast(bounded(known, "doc_id", s.sample, s.seed))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(chosen, "doc_id")
    rows = rows.groupBy("doc_id", "quality").agg(F.min("text").alias("text")).select(F.xxhash64("doc_id").alias("key"), "quality", "text")
    got = rows.mapInPandas(bags, "key long, quality double, bag binary").toPandas().sort_values(["key", "quality"], kind="stable")
    return train([np.frombuffer(x, np.float32).reshape(-1, width(s)) for x in got["bag"]], got["quality"].to_numpy(float), s)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """Adds score, 0 to 1, to docs (text and any further columns); a null text is scored as an empty one, a text of any
    length whole. Repeated rows are scored alike, each on its own; an empty table gives no rows; a column of docs named score
    is replaced, others pass through."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(texts: list[str | None]) -> dict[str, list]:
        m = shared.value
        bags = [passage_features(x or "", m.settings) for x in texts]
        out = forward(m.weights, (np.vstack(bags) - m.mean) * m.scale, charcodes.runs([len(b) for b in bags]), len(bags))
        return {"score": out["y"].tolist()}

    return by_text(docs, score, "score double", rows=64)
