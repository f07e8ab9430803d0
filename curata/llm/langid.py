"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Follow-the-regularised-leader with elastic-net penalties fits the weights; a temperature, fitted on rows kept apart from
that, calibrates the probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import charcodes
from .arrow import by_text
from .sampling import bounded_by, id_remainder

UNDETERMINED = "und"


@dataclass(frozen=True)
class Settings:
    """features: hashed n-grams; sample: rows that the weights and the temperature are fitted on, at most about so many."""

    features: int = 1 << 14
    sample: int = 6000
    epochs: int = 6
    least_steps: int = 800
    batch: int = 32
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 2e-4
    l2: float = 1e-4
    seed: int = 5


def ngram_counts(text: str, features: int) -> np.ndarray:
    """How often each hashed character n-gram (1 to 3, lower case) occurs in the whole text."""
    c = charcodes.codes(text.lower()).astype(np.uint64)
    one = c * np.uint64(0x9E3779B97F4A7C15)
    two = one[:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + one[1:]
    three = two[:-1] * np.uint64(0x165667B19E3779F9) + one[2:]
    shift = np.uint64(64 - (features.bit_length() - 1))
    mixed = [((x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> shift).astype(np.int64) for x in (one, two, three)]
    return np.bincount(np.concatenate(mixed), minlength=features)


def document_frequencies(docs: DataFrame, features: int) -> tuple[np.ndarray, int]:
    """In how many texts each hashed n-gram occurs, over all docs; and the number of texts. Fixed in size."""

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        seen, n = np.zeros(features, np.int64), 0
        for batch in batches:
            for text in (x.as_py() for x in batch.column(0)):
                seen += ngram_counts(text, features) > 0
                n += 1
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, features), pa.int32()), pa.array(np.concatenate([[n], seen]), pa.int64())], ["slot", "n"])

    total = docs.select("text").mapInArrow(count, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(features + 1, np.int64)
    out[total["slot"].to_numpy() + 1] = total["n"].to_numpy()
    return out[1:], int(out[0])


def tf_idf(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Rows of damped counts times idf, of unit length (all zero: zero)."""
    x = np.sqrt(counts) * idf
    return (x / np.maximum(np.sqrt((x * x).sum(-1, keepdims=True)), 1e-12)).astype(np.float32)


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, classes: int, idf: np.ndarray, s: Settings) -> np.ndarray:
    """Weights (features + 1 for the bias, by class) by the proximal update; rows are (slots, counts)."""
    z, n, rng = np.zeros((s.features + 1, classes)), np.zeros((s.features + 1, classes)), np.random.default_rng(s.seed)

    def weights() -> np.ndarray:
        return np.where(np.abs(z) <= s.l1, 0.0, -(z - np.sign(z) * s.l1) / ((s.beta + np.sqrt(n)) / s.alpha + s.l2))

    for _ in range(max(s.epochs, s.least_steps * s.batch // max(1, len(rows)))):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), s.batch):
            own = order[at : at + s.batch]
            x, w = dense(rows, own, idf, s.features), weights()
            g = x.T @ (softmax(x @ w) - np.eye(classes)[y[own]]) / len(own)
            z += g - (np.sqrt(n + g * g) - np.sqrt(n)) / s.alpha * w
            n += g * g
    return weights()


def dense(rows: list[tuple[np.ndarray, np.ndarray]], own, idf: np.ndarray, features: int) -> np.ndarray:
    """The TF-IDF rows of own, with a last column of ones for the bias."""
    counts = np.zeros((len(own), features), np.float32)
    for i, k in enumerate(own):
        counts[i, rows[k][0]] = rows[k][1]
    return np.hstack([tf_idf(counts, idf), np.ones((len(own), 1), np.float32)])


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The divisor of logits with the least negative log-likelihood, by golden-section search on its logarithm."""
    low, high = np.log(0.01), np.log(10.0)
    loss = lambda t: -np.log(softmax(logits / np.exp(t))[np.arange(len(y)), y] + 1e-12).mean()
    ratio = (5**0.5 - 1) / 2
    for _ in range(40):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


@dataclass(frozen=True)
class Model:
    labels: list[str]
    idf: np.ndarray
    weights: np.ndarray
    heat: float
    features: int


def fit(docs: DataFrame, settings: Settings = Settings()) -> Model:
    """Learns from docs (doc_id, text, lang) with a text and a lang. Document frequencies count all of them; the weights
    and the temperature come from a sample of at most about settings.sample rows, one in five for the temperature; every
    language has its quota of them, so a rare one is learned from a large table too."""
    s = settings
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    df, n = document_frequencies(usable, s.features)
    if not n:
        return Model([], np.zeros(s.features), np.zeros((s.features + 1, 0)), 1.0, s.features)
    idf = np.log((1 + n) / (1 + df)) + 0.05

    def sparse(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for i in range(0, batch.num_rows, 200):
                part, rows = batch.slice(i, 200), []
                for text in part.column(1).to_pylist():
                    counts = ngram_counts(text, s.features)
                    at = np.flatnonzero(counts)
                    rows.append((at.astype("<u4").tobytes(), counts[at].astype("<u4").tobytes()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), *(pa.array([r[k] for r in rows], pa.binary()) for k in (0, 1))], ["doc_id", "lang", "slots", "counts"])

    sample = bounded_by(usable, "doc_id", "lang", s.sample, s.seed).select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    got = sample.mapInArrow(sparse, "doc_id long, lang string, slots binary, counts binary").toPandas()
    got = got.sort_values(["doc_id", "slots", "counts"], kind="stable")
    labels = sorted(set(got["lang"]))
    y = np.array([labels.index(x) for x in got["lang"]])
    rows = [(np.frombuffer(a, "<u4"), np.frombuffer(b, "<u4")) for a, b in zip(got["slots"], got["counts"], strict=True)]
    if not rows:
        return Model([], idf, np.zeros((s.features + 1, 0)), 1.0, s.features)
    apart = np.arange(len(rows)) % 5 == 4
    w = ftrl([r for r, a in zip(rows, apart, strict=True) if not a], y[~apart], len(labels), idf, s)
    own = np.flatnonzero(apart)
    logits = np.vstack([dense(rows, own[i : i + 64], idf, s.features) @ w for i in range(0, len(own), 64)]) if len(own) else np.zeros((0, len(labels)))
    heat = temperature(logits, y[own]) if len(own) else 1.0
    return Model(labels, idf.astype(np.float32), w.astype(np.float32), heat, s.features)


def predict(docs: DataFrame, model: Model, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """Adds lang_pred and score (its probability), under these names, to docs (text, any further columns), reading whole
    texts, whatever their length.

    A text that is null or has no letter gets `und` and score 0. Without a single learned language all are `und`. Of
    languages with equal scores the first by name is taken; repeated rows are scored alike, each on its own; an empty table
    gives no rows; columns of docs with the added names are replaced, others pass through.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(texts: list[str | None]) -> dict[str, list]:
        m = shared.value
        texts = [x or "" for x in texts]
        lettered = np.array([charcodes.has_letter(charcodes.codes(x)) for x in texts], dtype=bool)
        if not m.labels:
            return dict(zip(names, ([UNDETERMINED] * len(texts), [0.0] * len(texts)), strict=True))
        counts = np.stack([ngram_counts(x, m.features) for x in texts])
        p = softmax((tf_idf(counts, m.idf) @ m.weights[:-1] + m.weights[-1]) / m.heat)
        best = p.argmax(1)
        return dict(zip(names, ([m.labels[k] if ok else UNDETERMINED for k, ok in zip(best, lettered, strict=True)], np.where(lettered, p[np.arange(len(best)), best], 0.0).tolist()), strict=True))

    return by_text(docs, score, f"`{names[0]}` string, `{names[1]}` double", rows=64)


def held_out() -> Column:
    """The documents whose labels no model may see."""
    return id_remainder("doc_id", 4) == 2
