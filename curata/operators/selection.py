"""Choice among epochs and runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def best_epoch(history: DataFrame, run: Sequence[str], epoch: str, loss: str) -> DataFrame:
    """Per run the epoch with the lowest loss, the earliest of equal ones, and that loss."""
    best = F.min(F.struct(loss, epoch)).alias("b")
    return history.groupBy(*run).agg(best).select(*run, F.col(f"b.{epoch}").alias("best_epoch"), F.col(f"b.{loss}").alias("best_loss"))


def early_stopping(history: DataFrame, run: Sequence[str], epoch: str, loss: str, patience: int) -> DataFrame:
    """history up to the epoch at which training stops, with improved and stale (epochs since the last improvement).

    A run's epochs are few by nature, so one task takes a run. Only a strictly lower loss improves.
    """
    if patience < 1:
        raise ValueError("patience must be positive")
    own = Window.partitionBy(*run) if run else Window.partitionBy(F.lit(0))
    order = own.orderBy(epoch)
    low = F.min(loss).over(order.rowsBetween(Window.unboundedPreceding, -1))
    out = history.withColumn("improved", low.isNull() | (F.col(loss) < low)).withColumn("__number", F.row_number().over(order))
    last = F.max(F.when(F.col("improved"), F.col("__number"))).over(order.rowsBetween(Window.unboundedPreceding, 0))
    out = out.withColumn("stale", F.col("__number") - last)
    stop = F.min(F.when(F.col("stale") >= patience, F.col("__number"))).over(own)
    return out.withColumn("__stop", stop).where(F.col("__stop").isNull() | (F.col("__number") <= F.col("__stop"))).drop("__number", "__stop")


def rank_runs(runs: DataFrame, score: str, ties: Sequence[Column]) -> DataFrame:
    """Adds rank by falling score, then ties. Runs are few, one row each."""
    return runs.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc(score), *ties)))


def require_comparable(runs: DataFrame, fields: Sequence[str]) -> DataFrame:
    """runs, or an error if they differ in a field that makes their scores comparable."""
    seen = runs.agg(*(F.count_distinct(F.struct(f)).alias(f) for f in fields)).first()
    different = [f for f in fields if seen[f] > 1]
    if different:
        raise ValueError(f"runs differ in {', '.join(different)}")
    return runs


def percent(value: Column, digits: int = 2) -> Column:
    """A share as text, n/a for null."""
    return F.coalesce(F.concat(F.format_number(value * 100, digits), F.lit("%")), F.lit("n/a"))


def complete_runs(history: DataFrame, metadata: DataFrame, run: str, epoch: str = "epoch", best: str = "best_epoch") -> DataFrame:
    """The best epoch's record of each run that has both documents and that epoch."""
    return history.join(metadata, run).where(F.col(epoch) == F.col(best))


def markdown(runs: DataFrame, columns: Sequence[str]) -> str:
    """A ranking as a table of text; for a handful of rows that are ready to be read, more than 1,000 are an error."""
    rows = [[str(r[c]) for c in columns] for r in runs.select(*columns).limit(1001).collect()]
    if len(rows) > 1000:
        raise ValueError("more than 1,000 runs for one table of text")
    return "\n".join("| " + " | ".join(r) + " |" for r in [list(columns), ["---"] * len(columns), *rows])
