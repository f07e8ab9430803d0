"""Row numbers that no single task has to count."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import settled

#: Chunks at most, whose counts one window may hold.
CHUNKS = 1 << 16


def positions(rows: DataFrame, by: Sequence[str], order: Sequence[Column | str], chunk: Column, name: str = "pos", total: str | None = None) -> DataFrame:
    """Numbers the rows of each group of by from 0 in the given order.

    chunk must rise with the order: rows are numbered within chunks in parallel and chunks are then set behind each
    other, so a group may hold any share of the rows. total: also adds the group's size under this name.
    """
    by = list(by)
    rows = rows.withColumn("__chunk", chunk)
    keys = [*by, "__chunk"]
    counts = rows.groupBy(*keys).agg(F.count("*").alias("__n"))
    whole = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    ahead = whole.orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*keys, F.coalesce(F.sum("__n").over(ahead), F.lit(0)).alias("__ahead"), F.sum("__n").over(whole).alias("__all"))
    renamed = counts.select(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)), "__ahead", "__all")
    match = F.lit(True)
    for i, k in enumerate(keys):
        match = match & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    own = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
    out = rows.withColumn("__own", own).join(renamed, match).withColumn(name, F.col("__ahead") + F.col("__own"))
    if total:
        out = out.withColumn(total, F.col("__all"))
    return out.drop("__chunk", "__own", "__ahead", "__all", *(f"__k{i}" for i in range(len(keys))))


def by_digest(rows: DataFrame, by: Sequence[str], key: str, ties: Sequence[str], name: str = "pos", total: str | None = None) -> DataFrame:
    """positions() in the order of a hexadecimal digest."""
    return positions(rows, by, [key, *ties], F.substring(key, 1, 4), name, total)


def by_number(rows: DataFrame, by: Sequence[str], key: str, name: str = "pos", total: str | None = None, width: int = 4096) -> DataFrame:
    """positions() in the order of a unique whole number. Chunks are ranges of width numbers, or wider ones where the
    numbers are spread so far that there would be more than CHUNKS of them."""
    low, high = rows.agg(F.min(key), F.max(key)).first()
    if low is not None:
        width = max(width, -(-(int(high) - int(low) + 1) // CHUNKS))
    return positions(rows, by, [key], F.floor((F.col(key) - F.lit(low)) / width), name, total)


def by_range(rows: DataFrame, by: Sequence[str], order: Sequence[str], name: str = "pos", total: str | None = None) -> DataFrame:
    """positions() in an order of any kind: rows are dealt out by ranges of the order, whose numbers are the chunks, and
    written down, since ranges are found by sampling. Rows that are equal in the order may take each other's numbers."""
    dealt = settled(rows.repartitionByRange(*by, *order).withColumn("__range", F.spark_partition_id()))
    return positions(dealt, by, order, F.col("__range"), name, total).drop("__range")


def first_of(rows: DataFrame, by: Sequence[str], order: str) -> DataFrame:
    """The row with the lowest value of order in each group of by."""
    best = F.min_by(F.struct(*rows.columns), F.struct(order)).alias("__row")
    return rows.groupBy(*by).agg(best).select("__row.*")
