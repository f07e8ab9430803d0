"""Quality rules: counts of a text's words and lines, and how far its histograms lie from those of its language."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import charcodes, shingles
from .arrow import by_text

#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
BASE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


@dataclass(frozen=True)
class Rules:
    """A text fails by counts, or by a distance (0 to 1) over its limit if it has min_words or more."""

    least_words: int = 10
    repeat_percent: int = 20
    min_words: int = 40
    common: int = 64
    most_class_distance: float = 0.065**0.5
    most_word_distance: float = 0.22**0.5


@dataclass(frozen=True)
class Counted:
    """Of several texts together. counts: one row of BASE for each text; classes: its histogram of character classes;
    own and lowered: for each word of all texts the number of its text, and the hash of the word in lower case."""

    counts: np.ndarray
    classes: np.ndarray
    own: np.ndarray
    lowered: np.ndarray


def _encoded(texts: list[str]) -> tuple[np.ndarray, list[int]]:
    """The texts' bytes with a line end between, and how many bytes each has."""
    raw = [x.encode("utf-8", "surrogatepass") for x in texts]
    return np.frombuffer(b"\n".join(raw), np.uint8), [len(x) for x in raw]


def repeated_windows(hashes: np.ndarray, own: np.ndarray, width: int = 5) -> np.ndarray:
    """Which words lie in a window of width words that their text has twice or more, its first place included."""
    n = len(hashes) - width + 1
    covered = np.zeros(max(0, len(hashes)) + 1, np.int64)
    if n > 1:
        inside = np.flatnonzero(own[:n] == own[width - 1 :])
        mixed = own[inside].astype(np.uint64)
        for k in range(width):
            mixed = shingles.mix(mixed * np.uint64(0x9E3779B97F4A7C15) + hashes[inside + k])
        order = np.argsort(mixed, kind="stable")
        same = mixed[order][1:] == mixed[order][:-1]
        again = inside[np.union1d(order[1:][same], order[:-1][same])]
        covered[again] += 1
        covered[again + width] -= 1
    return np.cumsum(covered)[:-1] > 0


def counted(texts: list[str]) -> Counted:
    """Words are told apart by 64-bit hashes, so that two different ones of a text count as equal with a probability of 2^-64."""
    n = len(texts)
    raw, sizes = _encoded(texts)
    begin, _, hashes = shingles.words(raw, shingles.byte_values(fold=False))
    starts = np.cumsum([0, *(x + 1 for x in sizes)])
    own = np.searchsorted(starts, begin, "right") - 1
    lowered = shingles.words(_encoded([x.lower() for x in texts])[0], shingles.byte_values(fold=False))[2]
    points = charcodes.codes("\n".join(texts))
    of = np.repeat(np.arange(n), [len(x) + (k < n - 1) for k, x in enumerate(texts)])
    kinds = len(charcodes.CLASSES)
    classes = np.bincount(of * kinds + charcodes.classes(points), minlength=n * kinds).reshape(n, kinds)
    classes[: n - 1, charcodes.CLASSES.index("space")] -= 1  # the line ends between texts
    spaces = (points == 32) | ((points >= 9) & (points <= 13))
    symbols = np.zeros(128, bool)
    symbols[[ord(x) for x in SYMBOLS]] = True
    lines = [[y for y in x.split("\n") if y.strip(" \t\n\x0b\x0c\r")] for x in texts]
    per_text = lambda flags, at: np.bincount(at[flags], minlength=n)
    counts = [np.bincount(own, minlength=n), per_text(~spaces, of), per_text(symbols[np.minimum(points, 127)] & (points < 128), of), [len(x) - len(set(x)) for x in lines], per_text(repeated_windows(hashes, own), own)]
    return Counted(np.array(counts, np.int64).T, classes, own, lowered)


def base_failed(counts: np.ndarray, rules: Rules) -> np.ndarray:
    """For rows of BASE."""
    return (counts[:, 0] < rules.least_words) | (100 * counts[:, 4] > rules.repeat_percent * counts[:, 0])


def jensen_shannon(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The distance of each row of p from q (histograms of any sums over 0), the root of their divergence to base 2: 0 for
    equal ones, 1 for those with nothing in common."""
    p, q = p / np.maximum(p.sum(-1, keepdims=True), 1e-12), q / max(q.sum(), 1e-12)
    m = (p + q) / 2
    part = lambda a: np.sum(np.where(a > 0, a * np.log2(np.where(a > 0, a, 1) / np.where(m > 0, m, 1)), 0.0), -1)
    return np.sqrt(np.clip((part(p) + part(np.broadcast_to(q, m.shape))) / 2, 0.0, 1.0))


@dataclass(frozen=True)
class Reference:
    """classes: counts of the character classes; words: the common words' hashes, rising, with their counts and, last, that
    of all others."""

    classes: np.ndarray
    words: np.ndarray
    counts: np.ndarray


def references(docs: DataFrame, rules: Rules = Rules(), chars: int = 4_000_000) -> dict[str, Reference]:
    """For each language of docs (text, lang) its histograms over all texts: character classes, and its most common words
    with one entry for the rest. Every text and word is counted; the driver gets the languages' histograms only."""

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def told(langs: list[str], texts: list[str]):
            names = sorted(set(langs))
            place = {x: k for k, x in enumerate(names)}
            of = np.array([place[x] for x in langs])
            kinds, parts = len(charcodes.CLASSES), []
            for k, name in enumerate(names):
                own = [x.lower() for x, o in zip(texts, of, strict=True) if o == k]
                hashes, n = np.unique(shingles.words(_encoded(own)[0], shingles.byte_values(fold=False))[2].view(np.int64), return_counts=True)
                classes = np.bincount(charcodes.classes(charcodes.codes("".join(x for x, o in zip(texts, of, strict=True) if o == k))), minlength=kinds)
                parts.append((name, 0, np.arange(kinds), classes))
                parts.append((name, 1, hashes, n))
            sizes = [len(p[2]) for p in parts]
            columns = [pa.array(np.repeat(np.array([p[i] for p in parts], object if i == 0 else np.int32), sizes), t) for i, t in ((0, pa.string()), (1, pa.int32()))]
            return pa.RecordBatch.from_arrays([*columns, *(pa.array(np.concatenate([p[i] for p in parts]), pa.int64()) for i in (2, 3))], ["lang", "kind", "word", "n"])

        langs, texts, held = [], [], 0
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                langs.append(lang)
                texts.append(text)
                held += len(text)
                if held >= chars:
                    yield told(langs, texts)
                    langs, texts, held = [], [], 0
        if texts:
            yield told(langs, texts)

    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")
    counts = known.mapInArrow(count, "lang string, kind int, word long, n long").groupBy("lang", "kind", "word").agg(F.sum("n").alias("n"))
    by = Window.partitionBy("lang", "kind")
    # Two steps, so that no task sorts all words of a language: the first ranks within hashed parts.
    parts = counts.withColumn("part", F.pmod("word", F.lit(64)))
    most = max(rules.common, len(charcodes.CLASSES))
    leading = parts.withColumn("r", F.row_number().over(Window.partitionBy("lang", "kind", "part").orderBy(F.desc("n"), "word"))).where(F.col("r") <= most)
    sums = parts.groupBy("lang", "kind").agg(F.sum("n").alias("total"))
    top = leading.withColumn("r", F.row_number().over(by.orderBy(F.desc("n"), "word"))).where(F.col("r") <= most)
    out: dict[str, Reference] = {}
    rows = top.join(F.broadcast(sums), ["lang", "kind"]).select("lang", "kind", "word", "n", "total").toPandas().sort_values(["lang", "n", "word"], ascending=[True, False, True])
    for lang, own in rows.groupby("lang"):
        letters = np.zeros(len(charcodes.CLASSES))
        for x in own[own.kind == 0].itertuples():
            letters[int(x.word)] = x.n
        words = own[own.kind == 1].head(rules.common)
        rest = float(words["total"].iloc[0] - words["n"].sum()) if len(words) else 0.0
        words = words.assign(word=words["word"].to_numpy(np.int64).view(np.uint64)).sort_values("word")
        out[lang] = Reference(letters, words["word"].to_numpy(np.uint64), np.array([*words["n"], rest], dtype=float))
    return out


def distances(found: Counted, reference: Reference) -> tuple[np.ndarray, np.ndarray]:
    """Of each text's character classes and common words."""
    k = len(reference.words)
    at = np.searchsorted(reference.words, found.lowered)
    hit = reference.words[np.minimum(at, k - 1)] == found.lowered if k else np.zeros(len(at), bool)
    slots = np.where(hit, at, k)
    own = np.bincount(found.own * (k + 1) + slots, minlength=len(found.counts) * (k + 1)).reshape(-1, k + 1)
    return jensen_shannon(found.classes.astype(float), reference.classes), jensen_shannon(own.astype(float), reference.counts)


def judge(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Adds to docs (text, lang) the counts of BASE, base_failed, class_distance, word_distance and kept.

    A text is compared with each language's reference and judged by the nearest one (by the sum of squares; of equally near
    ones the first by name), so that a wrong or missing lang can't condemn it. Below min_words there is no verdict by
    distance, only by counts, and both distances are 0. A null text is empty; texts are counted whole, whatever their length. Where no row
    has a lang there is nothing to compare with and the counts decide alone. Repeated rows are judged alike, each on its
    own; an empty table gives no rows; columns of docs named as the added ones are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(references(docs, rules))

    def make(texts: list[str | None]) -> dict[str, list]:
        found = counted([x or "" for x in texts])
        failed = base_failed(found.counts, rules)
        far = np.zeros((2, len(texts)))
        if shared.value:
            each = np.array([distances(found, r) for _, r in sorted(shared.value.items())])
            nearest = (each**2).sum(1).argmin(0)
            far = np.where(found.counts[:, 0] >= rules.min_words, each[nearest, :, np.arange(len(texts))].T, 0.0)
        kept = ~failed & (far[0] <= rules.most_class_distance) & (far[1] <= rules.most_word_distance)
        names = [f.split()[0] for f in BASE.split(", ")]
        return dict(zip(names, found.counts.T, strict=True)) | {"base_failed": failed, "class_distance": far[0], "word_distance": far[1], "kept": kept}

    return by_text(docs, make, f"{BASE}, base_failed boolean, class_distance double, word_distance double, kept boolean")
