"""Texts as numpy arrays of code points, for the operators that count characters."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import cache

import numpy as np

#: The classes of characters, in this order.
CLASSES = ("lower", "upper", "other letter", "digit", "space", "sentence mark", "other mark", "symbol", "rest")


def codes(text: str | None) -> np.ndarray:
    """The code points of text; lone surrogates count as they are."""
    return np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), "<u4")


def _class(char: str) -> int:
    kind = unicodedata.category(char)
    if kind in ("Ll", "Lu"):
        return 0 if kind == "Ll" else 1
    if kind[0] in "LM":
        return 2
    if kind[0] == "N":
        return 3
    if kind[0] == "Z" or char in "\t\n\r\x0b\x0c":
        return 4
    if char in ".,;:!?'\"-()":
        return 5
    return 6 if kind[0] == "P" else 7 if kind[0] == "S" else 8


#: The ranges of code points outside which every one is private, reserved or not assigned.
ASSIGNED = ((0, 0x40000), (0xE0000, 0xE0200))


def _table(of: Callable[[str], int], rest: int) -> np.ndarray:
    """of for each code point."""
    out = np.full(0x110000, rest, np.uint8)
    for a, b in ASSIGNED:
        out[a:b] = [of(chr(c)) for c in range(a, b)]
    return out


@cache
def class_table() -> np.ndarray:
    """The class of each code point."""
    return _table(_class, CLASSES.index("rest"))


@cache
def letter_table() -> np.ndarray:
    """Whether each code point is a letter by its category; marks, digits and symbols are none."""
    return _table(str.isalpha, 0).astype(bool)


def classes(points: np.ndarray) -> np.ndarray:
    """The class of each code point."""
    return class_table()[points]


def has_letter(points: np.ndarray) -> bool:
    """Whether a letter is among the code points."""
    return bool(letter_table()[points].any())


def runs(lengths: list[int]) -> np.ndarray:
    """For each element of concatenated arrays of these lengths, the number of its array."""
    return np.repeat(np.arange(len(lengths)), lengths)


def blocks(texts, chars: int = 400_000):
    """Lists of texts (null: empty) of about so many characters together, in order."""
    block, held = [], 0
    for text in texts:
        text = text if isinstance(text, str) else ""
        block.append(text)
        held += len(text)
        if held >= chars:
            yield block
            block, held = [], 0
    if block:
        yield block
