"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []


def folder(spark: SparkSession) -> str:
    """A new path below spark.checkpoint.dir. Without that setting a temporary folder serves, in local mode only."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="curata-core-"))
            atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
        base = _own[0]
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def settled(df: DataFrame) -> DataFrame:
    """df, written and read again: later reads repeat none of its work, also when executors are lost."""
    path = folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
