"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

#: A word is a run of characters other than space and the ASCII controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables as a DataFrame."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(taken: Iterable[str], *names: str) -> list[str]:
    """names, each with as many underscores ahead as it takes to differ from every name in taken, whatever its case."""
    ahead, lower = "_", [t.lower() for t in taken]
    while any(t.startswith(ahead) for t in lower):
        ahead += "_"
    return [ahead + n for n in names]


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new path below the folder that driver and executors share (spark.checkpoint.dir).

    Where that setting is missing a temporary folder serves, but only in local mode, where one machine runs everything.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        context = spark.sparkContext
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = getattr(shared_folder, "local", None)
        if base is None:
            base = shared_folder.local = tempfile.mkdtemp(prefix="curata-")
            atexit.register(shutil.rmtree, base, ignore_errors=True)
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str, compression: str = "snappy") -> DataFrame:
    """df, written as Parquet to the shared folder and read again: later reads survive lost executors and repeat no work.

    zstd packs better, but its writers hold native memory until the JVM collects them, so it is for large tables only.
    """
    spark = df.sparkSession
    path = shared_folder(spark, label)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
