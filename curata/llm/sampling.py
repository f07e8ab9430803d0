"""Held-out rows and bounded samples, decided by doc_id alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def id_remainder(doc_id: str, of: int) -> Column:
    """crc32 of the id as text (null: empty), modulo of."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(of))


def bounded(rows: DataFrame, key: str, most: int, seed: int) -> DataFrame:
    """One row for each of about most values of key, those with the lowest hashes; all where there are no more.

    For fitting models only. A key that many rows repeat counts once, so the bound holds for any data.
    """
    n = rows.count()
    if n > most:
        rows = rows.where(F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1 << 40)) < int((1 << 40) * most / n))
    return rows.dropDuplicates([key])


def quotas(sizes: list[int], most: int) -> list[float]:
    """How many of each group's keys to take, about most together: shares in proportion, but at least most / 2, divided
    by the number of groups, of each (all of a smaller group; one at least)."""
    if sum(sizes) <= most:
        return [float(n) for n in sizes]
    least = max(1.0, most / (2 * len(sizes)))
    own = lambda share: [min(n, max(share * n, least)) for n in sizes]
    low, high = 0.0, 1.0
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if sum(own(middle)) <= most else (low, middle)
    return own(low)


def bounded_by(rows: DataFrame, key: str, group: str, most: int, seed: int) -> DataFrame:
    """One row for each of about most pairs of group and key, by quotas(): no group is left out, however rare it is.
    All pairs where there are no more. Keys with the lowest hashes; repeated ones count once. Groups must not be null.

    For fitting models only: what it takes to the driver is one row for each group.
    """
    scale = 1 << 40
    hashed = F.pmod(F.xxhash64(F.lit(seed), key), F.lit(scale))
    n = F.count_distinct(key) + F.max(F.col(key).isNull().cast("long"))
    sizes = rows.groupBy(group).agg(n.alias("n"), F.min(hashed).alias("low")).collect()
    if sum(r["n"] for r in sizes) > most:
        limits = [(r[group], max(r["low"] + 1, int(scale * q / r["n"]))) for r, q in zip(sizes, quotas([r["n"] for r in sizes], most), strict=True)]
        kind = rows.schema[group].dataType.simpleString()
        wanted = rows.sparkSession.createDataFrame(limits, f"__group {kind}, __limit long")
        rows = rows.join(F.broadcast(wanted), F.col(group) == F.col("__group"))
        rows = rows.where(hashed < F.col("__limit")).drop("__group", "__limit")
    return rows.dropDuplicates([key, group])
