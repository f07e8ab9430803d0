"""Copies, conflicts and overlaps by digest, and a similarity join of 64-bit fingerprints."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import settled


class LeakError(ValueError):
    """Records that must be apart share content."""


def exact_groups(rows: DataFrame, digest: str) -> DataFrame:
    """digest and n of each content that occurs more than once."""
    return rows.groupBy(digest).agg(F.count("*").alias("n")).where("n > 1")


def duplicate_summary(rows: DataFrame, digest: str) -> DataFrame:
    """One row: groups of copies, and copies beyond the first of each."""
    return exact_groups(rows, digest).agg(F.count("*").alias("n_groups"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n_extra"))


def first_seen_pairs(rows: DataFrame, digest: str, key: str) -> DataFrame:
    """(first, later) for each copy: the lowest key of its content and its own. The lowest keys come from an aggregate, so
    that a content of any share of the rows needs no task of its own."""
    low = rows.groupBy(digest).agg(F.min(key).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    return rows.join(low, digest).where(F.col(key) != F.col("first")).select("first", F.col(key).alias("later"))


def spanning(rows: DataFrame, digest: str, partition: str) -> DataFrame:
    """Contents that occur in several values of partition: digest, n_partitions, n_rows."""
    out = rows.groupBy(digest).agg(F.countDistinct(partition).alias("n_partitions"), F.count("*").alias("n_rows"))
    return out.where("n_partitions > 1")


def refuse_spanning(rows: DataFrame, digest: str, partition: str, what: str) -> DataFrame:
    """rows, or an error that names the lowest digest that occurs in several values of partition."""
    low = spanning(rows, digest, partition).agg(F.min(digest)).first()[0]
    if low is not None:
        raise LeakError(f"{what}: {low}")
    return rows


def overlap(left: DataFrame, right: DataFrame, digest: str) -> DataFrame:
    """Distinct digests on both sides."""
    return left.select(digest).intersect(right.select(digest))


#: Needles, one word or a few characters each, that may be sent to all tasks; more are joined by a shuffle.
BROADCAST_NEEDLES = 100_000


def contained(rows: DataFrame, needles: DataFrame, text: str, needle: str) -> DataFrame:
    """Rows of rows whose text contains a needle, with the needle's columns; an empty needle is in nothing.

    A needle's words but its first and last stand whole in any text that contains it, so its longest one finds the texts
    to search. Needles without such a word are found by their first characters, as many as the shortest of them has (8 at
    most). Only what is found so is searched.
    """
    inner = F.slice(F.split(F.col(needle), r"\s+"), 2, F.greatest(F.lit(0), F.size(F.split(F.col(needle), r"\s+")) - 2))
    longest = F.array_max(F.transform(inner, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    told = needles.where(F.col(needle) != "").withColumn("__word", longest)
    by_word, by_head = told.where(F.col("__word").isNotNull()), told.where(F.col("__word").isNull()).drop("__word")
    shortest, short, long = needles.where(F.col(needle) != "").agg(F.min(F.when(F.size(inner) == 0, F.length(needle))), F.count_if(F.size(inner) == 0), F.count_if(F.size(inner) > 0)).first()
    few = lambda df, n: F.broadcast(df) if n <= BROADCAST_NEEDLES else df
    found = []
    if long or not short:
        words = rows.withColumn("__word", F.explode(F.array_distinct(F.split(F.col(text), r"\s+"))))
        found.append(words.join(few(by_word, long), "__word").where(F.contains(F.col(text), F.col(needle))).drop("__word"))
    if short:
        n = min(8, shortest)
        places = F.when(F.length(text) >= n, F.sequence(F.lit(1), F.length(text) - n + 1)).otherwise(F.array().cast("array<int>"))
        heads = rows.withColumn("__head", F.explode(F.array_distinct(F.transform(places, lambda i: F.substring(F.col(text), i, F.lit(n))))))
        found.append(heads.join(few(by_head.withColumn("__head", F.left(F.col(needle), F.lit(n))), short), "__head").where(F.contains(F.col(text), F.col(needle))).drop("__head"))
    return found[0] if len(found) == 1 else found[0].unionByName(found[1])


def clean_supplement(extra: DataFrame, known: DataFrame, digest: str, key: str) -> DataFrame:
    """Rows of extra whose content is not known, the first of each content."""
    fresh = extra.join(known.select(digest).distinct(), digest, "left_anti")
    low = fresh.groupBy(digest).agg(F.min(key).alias("__low"))
    return fresh.join(low, digest).where(F.col(key) == F.col("__low")).drop("__low")


def overlap_counts(extra: DataFrame, known: DataFrame, digest: str, split: str) -> DataFrame:
    """How many rows of extra each split already has. A digest in several splits counts for the last by name."""
    last = known.groupBy(digest).agg(F.max(split).alias(split))
    return extra.join(last, digest).groupBy(split).agg(F.count("*").alias("n"))


#: Words of a key, as a power of two: a key's row, shuffled and sorted, costs as much as so many comparisons.
KEY_WORDS_BITS = 5


def hamming_pairs(rows: DataFrame, bits: str, most: int, side: str | None = None, kept: int | None = None) -> DataFrame:
    """(a, b, distance, n_pairs): fingerprints at most `most` bits apart, and how many pairs of rows that makes.

    Equal fingerprints are counted first, so copies cost nothing. 64 bits are cut into most + kept blocks; two words that
    differ in at most `most` bits agree on `kept` blocks at least, so an equi-join on every choice of so many blocks
    finds all, on keys of many bits. A pair is only taken at its first common choice, so no distinct is needed. side: only
    pairs of rows on different sides, the lower one left; else a pair is unordered and equal words pair within themselves.
    kept: without it, the fewest blocks (2 at least) with which a key has about 2 ** KEY_WORDS_BITS words at most for random
    ones, however many there are; a word has a key for each choice (21 for some million words at 5 bits, 56 for a hundred
    million, 126 for a thousand million). The result doesn't depend on it.
    """
    if not 0 <= most < 64:
        raise ValueError("most must be 0 to 63")
    keys = [bits] + ([side] if side else [])
    # Nulls go after the table is written: a filter before the grouping would have Spark compute each fingerprint twice.
    words = settled(rows.groupBy(*keys).agg(F.count("*").alias("n"))).where(F.col(bits).isNotNull())
    if kept is None:
        need = max(1, words.count() >> KEY_WORDS_BITS).bit_length()
        kept = next((k for k in range(2, 64 - most) if 64 * k // (most + k) >= need), 2)
    kept = max(1, min(kept, 64 - most))
    cuts = [64 * k // (most + kept) for k in range(most + kept + 1)]
    masks = [sum(((1 << cuts[k + 1]) - (1 << cuts[k])) for k in own) for own in combinations(range(most + kept), kept)]
    masks = [m - (1 << 64) if m >> 63 else m for m in masks]
    under = lambda w, m: w.bitwiseAND(F.lit(m).cast("long"))
    keyed = words.withColumn("key", F.explode(F.array(*(F.struct(F.lit(k).alias("no"), under(F.col(bits), m).alias("value")) for k, m in enumerate(masks)))))
    a = keyed.select(F.col(bits).alias("a"), F.col("n").alias("n_a"), *([F.col(side).alias("side_a")] if side else []), F.col("key.no").alias("no"), F.col("key.value").alias("value"))
    b = keyed.select(F.col(bits).alias("b"), F.col("n").alias("n_b"), *([F.col(side).alias("side_b")] if side else []), F.col("key.no").alias("no_b"), F.col("key.value").alias("value_b"))
    # A key for each choice makes rows many times what Spark takes the words' files for: they must never be broadcast. The
    # merge sorts by value first, which tells rows apart where the number of the choice doesn't.
    met = a.join(b.hint("merge"), (F.col("value") == F.col("value_b")) & (F.col("no") == F.col("no_b")) & ((F.col("side_a") < F.col("side_b")) if side else (F.col("a") <= F.col("b"))))
    near = met.withColumn("apart", F.col("a").bitwiseXOR(F.col("b"))).withColumn("distance", F.bit_count("apart")).where(F.col("distance") <= most)
    first = F.array_position(F.array(*(under(F.col("apart"), m) == 0 for m in masks)), True) - 1
    near = near.where(F.col("no") == first)
    n = F.col("n_a") * F.col("n_b") if side else F.when(F.col("a") == F.col("b"), F.col("n_a") * (F.col("n_a") - 1) / 2).otherwise(F.col("n_a") * F.col("n_b"))
    return near.withColumn("n_pairs", n.cast("long")).where("n_pairs > 0").select(*(["side_a", "side_b"] if side else []), "a", "b", "distance", "n_pairs")


def candidate_samples(rows: DataFrame, pairs: DataFrame, bits: str, side: str, keep: str, limit: int = 100) -> DataFrame:
    """The first limit pairs of rows behind the pairs of hamming_pairs(side=...), in the order of sides, distance,
    fingerprints and the rows' keep column: a report's samples. Each pair of fingerprints gives one pair of rows at least,
    so the first limit of those are enough."""
    order = ["side_a", "side_b", "distance", "a", "b"]
    first = pairs.orderBy(*order).limit(limit).select(*order)
    one = lambda name: rows.select(F.col(bits).alias(name), F.col(side).alias(f"side_{name}"), F.struct(keep).alias(f"row_{name}"))
    met = first.join(one("a"), ["a", "side_a"]).join(one("b"), ["b", "side_b"])
    return met.select("side_a", "side_b", "distance", "a", "b", F.col(f"row_a.{keep}").alias("left"), F.col(f"row_b.{keep}").alias("right")).orderBy(*order, "left", "right").limit(limit)
