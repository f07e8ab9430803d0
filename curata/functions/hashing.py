"""Digests, hexadecimal words and bit patterns as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def digest(column: Column | str) -> Column:
    """SHA-256 of bytes or text, lower-case hex; null for null."""
    return F.sha2(F.col(column) if isinstance(column, str) else column, 256)


def split_key(seed: int, *parts: Column) -> Column:
    """The digest that puts records into a reproducible random order: seed and parts with colons between."""
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), *(p.cast("string") for p in parts)), 256)


def hex16(bits: Column) -> Column:
    """A 64-bit word as 16 lower-case hex digits."""
    return F.lpad(F.lower(F.hex(bits)), 16, "0")


def from_hex16(text: Column) -> Column:
    """The 64-bit word of 16 hex digits, with the sign that its highest bit gives it."""
    return F.conv(text, 16, -10).cast("long")


def hamming(a: Column, b: Column) -> Column:
    """How many bits of two 64-bit words differ."""
    return F.bit_count(a.bitwiseXOR(b))


def seed_of(sha: Column) -> Column:
    """A 32-bit seed from the first 8 digits of a digest."""
    return F.conv(F.substring(sha, 1, 8), 16, 10).cast("long")


def pack_bits(flags: Column) -> Column:
    """A 64-bit word from an array of at most 64 booleans, the first one highest."""
    return F.aggregate(flags, F.lit(0).cast("long"), lambda word, bit: F.shiftleft(word, 1).bitwiseOR(bit.cast("long")))


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once for each row, however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def gradient_bits(grid: Column, rows: int = 8, columns: int = 9) -> Column:
    """The difference hash of a grid given row by row: whether each cell exceeds the one to its right."""
    at = F.sequence(F.lit(0), F.lit(rows * (columns - 1) - 1))
    cell = lambda i: F.floor(i / (columns - 1)).cast("int") * columns + i % (columns - 1)
    return bound(grid, lambda g: pack_bits(F.transform(at, lambda i: F.get(g, cell(i)) > F.get(g, cell(i) + 1))))


def token_grid(text: Column, cells: int = 72) -> Column:
    """How many words of text fall into each cell, by the first 4 hex digits of the word's md5."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: w != "")
    places = F.transform(words, lambda w: (F.conv(F.substring(F.md5(w), 1, 4), 16, 10).cast("int") % cells).cast("int"))
    # Each cell once more, in order: a cell's run ends where the next one begins, and is one longer than its words.
    ordered = F.sort_array(F.concat(places, F.sequence(F.lit(0), F.lit(cells - 1))))
    ends = bound(ordered, lambda own: F.filter(F.sequence(F.lit(0), F.size(own) - 1), lambda i: F.coalesce(F.get(own, i) != F.get(own, i + 1), F.lit(True))))
    return bound(ends, lambda own: F.transform(own, lambda e, k: e - F.coalesce(F.get(own, k - 1), F.lit(-1)) - 1))
