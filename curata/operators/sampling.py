"""Samples and repetitions that follow from an order of rows, never from partitions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import split_key
from .ranking import by_number, first_of

#: The names of the stress benchmark in their order, and those no training augmentation resembles.
CORRUPTIONS = ("jpeg_q25", "gaussian_noise", "gamma_low", "gamma_high", "hue_shift", "contrast_crush", "letterbox", "downscale")
BENCHMARK = "stress-v1"


def even_sample(rows: DataFrame, label: str, key: str, per_class: int) -> DataFrame:
    """per_class rows of each class (all of a smaller one), evenly spread over the order of the number key."""
    if per_class < 1:
        raise ValueError("per_class must be positive")
    ranked = by_number(rows, [label], key, "__pos", "__n")
    take = F.least(F.lit(per_class).cast("long"), F.col("__n"))
    # Place p takes row int(p * n / take): a row is taken if one of the two places around its share lands on it.
    step = F.col("__n") / take
    near = F.floor(F.col("__pos") / step)
    landed = F.lit(False)
    for d in (-1, 0, 1, 2):
        p = near + d
        landed = landed | ((p >= 0) & (p < take) & (F.least(F.floor(p * step), F.col("__n") - 1) == F.col("__pos")))
    return ranked.where(landed).drop("__pos", "__n")


def round_robin(rows: DataFrame, label: str, key: str, limit: int) -> DataFrame:
    """limit rows, taking the first of each class, then the second of each, classes in their order."""
    ranked = by_number(rows, [label], key, "__pos")
    return ranked.orderBy("__pos", label).limit(limit).drop("__pos")


def every_nth(rows: DataFrame, by: Sequence[str], key: str, n: int) -> DataFrame:
    """Every n-th row of each group, the first included."""
    return by_number(rows, by, key, "__pos").where(F.col("__pos") % n == 0).drop("__pos")


def first_per_class(rows: DataFrame, label: str, order: str) -> DataFrame:
    return first_of(rows, [label], order)


def seeded_pick(rows: DataFrame, key: str, k: int, seed: int = 42) -> DataFrame:
    """k rows without replacement, the same ones on every run."""
    return rows.orderBy(split_key(seed, F.col(key)), key).limit(k)


def repeated_union(primary: DataFrame, extra: DataFrame, repeat: int) -> DataFrame:
    """primary and repeat copies of extra."""
    if repeat < 1:
        raise ValueError("repeat must be positive")
    return primary.unionByName(extra.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.lit(repeat)))).drop("__copy"))


def corruption_at(position: Column, names: Sequence[str] = CORRUPTIONS) -> Column:
    """The corruption of the row at a position, in turn."""
    return F.element_at(F.array(*map(F.lit, names)), (F.pmod(position, F.lit(len(names))) + 1).cast("int"))


def with_corruption(rows: DataFrame, key: str, names: Sequence[str] = CORRUPTIONS) -> DataFrame:
    """Adds position (by the number key) and corruption; fewer rows than corruptions are an error."""
    if rows.limit(len(names)).count() < len(names):
        raise ValueError("the benchmark needs at least one row per corruption")
    ranked = by_number(rows, [], key, "position")
    return ranked.withColumn("corruption", corruption_at(F.col("position"), names))


#: Rows whose lines may meet in one row.
ORDERED_ROWS = 100_000


def ordered_digest(rows: DataFrame, order: Sequence[str], line: Column) -> DataFrame:
    """One row (digest, n_rows): SHA-256 of all lines in order, as a benchmark of few rows is named. The lines meet in one
    row; over ORDERED_ROWS rows are an error, and row_set_digest() is for them."""
    if rows.limit(ORDERED_ROWS + 1).count() > ORDERED_ROWS:
        raise ValueError(f"an ordered digest takes {ORDERED_ROWS} rows at most")
    said = F.array_sort(F.collect_list(F.struct(*order, line.alias("__line"))))
    return rows.agg(F.sha2(F.array_join(F.transform(said, lambda s: s["__line"]), ""), 256).alias("digest"), F.count("*").alias("n_rows"))


def row_set_digest(rows: DataFrame, line: Column) -> DataFrame:
    """One row (digest, n_rows) that names a set of rows by their lines, whatever their number and order."""
    return tree_digest(rows, line)


def first_rows(rows: DataFrame, key: str, n: int) -> DataFrame:
    """The first n rows in the order of a unique key."""
    return rows.orderBy(key).limit(n)


def tree_digest(rows: DataFrame, line: Column, buckets: int = 65536) -> DataFrame:
    """One row (digest, n_rows) for row sets of any size and order: lines meet by bucket of their own digest, then the
    buckets' digests meet."""
    own = rows.select(F.sha2(line, 256).alias("d")).groupBy("d").agg(F.count("*").alias("n"))
    leaf = own.groupBy(F.pmod(F.xxhash64("d"), F.lit(buckets)).alias("bucket")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "d", "n"))), "\n"), 256).alias("d"), F.sum("n").alias("n"))
    return leaf.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("bucket", "d"))), lambda s: s["d"]), "\n"), 256).alias("digest"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"))
