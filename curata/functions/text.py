"""Small text helpers as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def utc_stamp(at: Column | None = None) -> Column:
    """A moment (now) as ISO 8601 in UTC; the session's time zone plays no part."""
    zone = F.current_timezone()
    return F.date_format(F.to_utc_timestamp(F.current_timestamp() if at is None else at, zone), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


def flat(text: Column) -> Column:
    """text with every run of white space as one space, none at its ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def sorted_json(**fields: Column) -> Column:
    """A JSON object of the fields, keys in order."""
    return F.to_json(F.struct(*(fields[k].alias(k) for k in sorted(fields))))


def seeded_uniform(seed: int, *key: Column) -> Column:
    """A number from 0 to 1 that follows from the seed and the row's key alone, whatever the partitions."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *key), 11) / F.lit(float(1 << 53))
