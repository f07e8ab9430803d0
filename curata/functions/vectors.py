"""Arithmetic on numeric arrays: scores, layers and geometry as Column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def vector(values: Sequence[float]) -> Column:
    """A constant array of doubles."""
    return F.array(*(F.lit(float(v)) for v in values))


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y))


def linear(x: Column, weights: Sequence[Sequence[float]], bias: Sequence[float]) -> Column:
    """A dense layer with fixed weights, one row per output."""
    return F.array(*(dot(x, vector(w)) + F.lit(float(b)) for w, b in zip(weights, bias, strict=True)))


def batch_norm_relu(x: Column, gamma: Column, beta: Column, mean: Column, variance: Column, epsilon: float = 1e-5) -> Column:
    """Normalisation with stored statistics, then the positive part."""
    scaled = F.zip_with(F.zip_with(x, mean, lambda v, m: v - m), F.zip_with(gamma, variance, lambda g, v: g / F.sqrt(v + epsilon)), lambda d, s: d * s)
    return F.zip_with(scaled, beta, lambda v, b: F.greatest(F.lit(0.0), v + b))


def softmax(logits: Column) -> Column:
    """Probabilities; the largest logit is taken off first."""
    powers = F.transform(logits, lambda z: F.exp(z - F.array_max(logits)))
    return F.transform(powers, lambda p: p / total(powers))


def argmax(values: Column) -> Column:
    """Place of the largest value, the first of equal ones."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def top_k(values: Column, k: int) -> Column:
    """(place, value) of the k largest, falling; equal ones by place."""
    ranked = F.array_sort(F.transform(values, lambda v, i: F.struct((-v).alias("minus"), i.alias("place"))))
    return F.transform(F.slice(ranked, 1, k), lambda r: F.struct(r["place"].alias("place"), (-r["minus"]).alias("value")))


def cross_entropy(probabilities: Column, place: Column, smoothing: float = 0.0) -> Column:
    """Log loss of the class at place, with label smoothing over all classes."""
    logs = F.transform(probabilities, lambda p: -F.ln(F.greatest(p, F.lit(1e-12))))
    return (1 - smoothing) * F.get(logs, place) + smoothing * total(logs) / F.size(logs)


def jitter(values: Column, scale: float, seed: int, key: Column) -> Column:
    """values with normal noise that depends on seed, key and place only, so on no partitioning."""
    def unit(i: Column, salt: int) -> Column:
        drawn = F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(str(salt)), key.cast("string"), i.cast("string")))
        return (F.conv(F.substring(drawn, 1, 10), 16, 10).cast("long") + 1) / F.lit(float((1 << 40) + 1))

    return F.transform(values, lambda v, i: v + scale * F.sqrt(-2 * F.ln(unit(i, 1))) * F.cos(2 * F.pi() * unit(i, 2)))


def fourier_plan(dimension: int, n: int, gamma: float, seed: int = 42) -> list[dict]:
    """n random directions w and turns b: with them, the dot product of fourier_features() of x and y comes close to
    exp(-gamma |x - y|^2). Its standard error is below 1 / sqrt(n)."""
    import numpy as np

    draw = np.random.default_rng(seed)
    ways, turns = draw.normal(0, (2 * gamma) ** 0.5, (n, dimension)), draw.uniform(0, 2 * np.pi, n)
    return [{"w": w.tolist(), "b": float(b)} for w, b in zip(ways, turns, strict=True)]


def fourier_features(values: Column, plan: list[dict]) -> Column:
    """The random Fourier features of an array by a plan; null for null. The plan is one constant of the expression."""
    import json

    ways = F.from_json(F.lit(json.dumps(plan)), "array<struct<w:array<double>,b:double>>")
    scale = (2 / max(1, len(plan))) ** 0.5
    return F.when(values.isNotNull(), F.transform(ways, lambda p: F.cos(dot(values, p["w"]) + p["b"]) * scale))


def lcg(n: int, seed: int = 42) -> Column:
    """n numbers from -1 to 1 of the linear congruential sequence that parity checks feed to models."""
    #: Multiplier, increment, modulus.
    states = F.aggregate(F.sequence(F.lit(1), F.lit(n)), F.array(F.lit(seed).cast("long")), lambda a, _: F.concat(a, F.array(F.pmod(F.element_at(a, -1) * 1664525 + 1013904223, F.lit(1 << 32)))))
    return F.transform(F.slice(states, 2, n), lambda s: s / F.lit(float(1 << 32)) * 2 - 1)


def even_channels(channels: Column, shown: int = 8) -> Column:
    """Numbers of shown channels, evenly spread from the first to the last; halves go to the even number."""
    return F.transform(F.sequence(F.lit(0), F.lit(shown - 1)), lambda k: F.bround(k * (channels - 1) / (shown - 1)).cast("int"))
