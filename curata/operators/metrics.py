"""Evaluation of classifiers: every figure as a small DataFrame over rows with truth and prediction."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges of values that percentiles() sorts apart.
RANGES = 64


def classes(rows: DataFrame, names: Sequence) -> DataFrame:
    """The label domain as a table; it is given, not derived, so classes without rows are in it."""
    kind = "string" if names and isinstance(names[0], str) else "int"
    return rows.sparkSession.createDataFrame([(n,) for n in names], f"class {kind}")


def confusion(rows: DataFrame, truth: str, prediction: str, names: Sequence) -> DataFrame:
    """truth, prediction, n for every pair of the domain, zeros included."""
    cells = rows.sparkSession.createDataFrame([(a, b) for a in names for b in names], f"truth {'string' if isinstance(names[0], str) else 'int'}, prediction {'string' if isinstance(names[0], str) else 'int'}")
    counts = rows.groupBy(F.col(truth).alias("truth"), F.col(prediction).alias("prediction")).agg(F.count("*").alias("n"))
    return cells.join(counts, ["truth", "prediction"], "left").select("truth", "prediction", F.coalesce("n", F.lit(0)).alias("n"))


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def report(rows: DataFrame, truth: str, prediction: str, names: Sequence) -> DataFrame:
    """class, support, predicted, correct, precision, recall, f1 of every class of the domain; 0 / 0 counts as 0."""
    sides = rows.select(F.explode(F.array(F.struct(F.col(truth).alias("class"), F.lit(1).alias("is_truth"), F.lit(0).alias("is_pred"), (F.col(truth) == F.col(prediction)).cast("int").alias("hit")), F.struct(F.col(prediction).alias("class"), F.lit(0).alias("is_truth"), F.lit(1).alias("is_pred"), F.lit(0).alias("hit")))).alias("s")).select("s.*")
    sums = sides.groupBy("class").agg(F.sum("is_truth").alias("support"), F.sum("is_pred").alias("predicted"), F.sum("hit").alias("correct"))
    dense = classes(rows, names).join(sums, "class", "left").select("class", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("support", "predicted", "correct")))
    dense = dense.withColumn("precision", ratio(F.col("correct"), F.col("predicted"))).withColumn("recall", ratio(F.col("correct"), F.col("support")))
    return dense.withColumn("f1", ratio(2 * F.col("correct"), F.col("support") + F.col("predicted")))


def summary(rows: DataFrame, truth: str, prediction: str, names: Sequence) -> DataFrame:
    """One row: accuracy, macro_f1 over all classes of the domain, macro_f1_supported over those with rows, n, correct."""
    r = report(rows, truth, prediction, names)
    return r.agg(ratio(F.sum("correct"), F.sum("support")).alias("accuracy"), F.avg("f1").alias("macro_f1"), F.avg(F.when(F.col("support") > 0, F.col("f1"))).alias("macro_f1_supported"), F.sum("support").alias("n"), F.sum("correct").alias("correct"))


def detection_aware(rows: DataFrame, detected: Column, correct: Column) -> DataFrame:
    """One row: considered, detected, detection_rate, accuracy_detected, accuracy_over_all (a miss counts as wrong)."""
    hit = F.count_if(detected & correct)
    return rows.agg(F.count("*").alias("considered"), F.count_if(detected).alias("detected"), ratio(F.count_if(detected), F.count("*")).alias("detection_rate"), ratio(hit, F.count_if(detected)).alias("accuracy_detected"), ratio(hit, F.count("*")).alias("accuracy_over_all"))


def missed_per_class(rows: DataFrame, label: str, detected: Column) -> DataFrame:
    """class and n_missed, where there are any."""
    return rows.groupBy(F.col(label).alias("class")).agg(F.count_if(~detected).alias("n_missed")).where("n_missed > 0")


def accuracy_by(rows: DataFrame, by: str, correct: Column) -> DataFrame:
    return rows.groupBy(by).agg(ratio(F.count_if(correct), F.count("*")).alias("accuracy"), F.count_if(correct).alias("correct"), F.count("*").alias("total"))


def pooled_accuracy(rows: DataFrame, by: str, names: Sequence[str], correct: Column) -> DataFrame:
    """One row: correct, total and accuracy over the named groups together; accuracy is null without rows."""
    own = rows.where(F.col(by).isin(*names))
    return own.agg(F.count_if(correct).alias("correct"), F.count("*").alias("total"), F.try_divide(F.count_if(correct).cast("double"), F.count("*")).alias("accuracy"))


def mean_loss(rows: DataFrame, loss: Column, correct: Column) -> DataFrame:
    """One row: loss and accuracy per row, which batches weighted by size give as well."""
    return rows.agg(F.avg(loss).alias("loss"), ratio(F.count_if(correct), F.count("*")).alias("accuracy"), F.count("*").alias("n"))


def percentiles(rows: DataFrame, value: str, shares: dict[str, float]) -> DataFrame:
    """One row: exact percentiles, linear between neighbours, and n.

    Values are counted, cut into ranges at approximate quantiles, and only the ranges that hold a wanted rank are sorted,
    so no task holds more than a range's distinct values."""
    known = rows.where(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("v")).agg(F.count("*").alias("n"))
    cuts, n = known.agg(F.percentile_approx("v", [k / RANGES for k in range(1, RANGES)], 10 * RANGES), F.sum("n")).first()
    spark = rows.sparkSession
    if not n:
        return spark.range(1).select(*(F.lit(None).cast("double").alias(name) for name in shares), F.lit(0).cast("long").alias("n"))
    cuts = sorted(set(cuts))
    known = known.withColumn("range", F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.col("v"))))
    ahead, at = {}, 0
    for r in known.groupBy("range").agg(F.sum("n").alias("n")).orderBy("range").collect():  # RANGES rows at most
        ahead[r["range"]] = (at, at + r["n"])
        at += r["n"]
    ranks = {x for share in shares.values() for x in (math.floor(share * (n - 1)), math.ceil(share * (n - 1)))}
    wanted = [(k, a) for k, (a, b) in ahead.items() if any(a <= x < b for x in ranks)]
    own = known.join(F.broadcast(spark.createDataFrame(wanted, "range int, ahead long")), "range")
    own = own.withColumn("upto", F.col("ahead") + F.sum("n").over(Window.partitionBy("range").orderBy("v")))
    hit = F.array(*(F.lit(x) for x in sorted(ranks)))
    found = own.where(F.exists(hit, lambda x: (x < F.col("upto")) & (x >= F.col("upto") - F.col("n")))).select("v", "upto", "n").collect()  # two rows a percentile at most
    at_rank = {x: r["v"] for r in found for x in ranks if r["upto"] - r["n"] <= x < r["upto"]}
    out = []
    for share in shares.values():
        exact = share * (n - 1)
        low, high = at_rank[math.floor(exact)], at_rank[math.ceil(exact)]
        out.append(low + (high - low) * (exact - math.floor(exact)))
    return spark.createDataFrame([(*out, n)], ", ".join(f"`{name}` double" for name in shares) + ", n long")


def peak(history: DataFrame, value: str) -> DataFrame:
    """One row: the largest value over all epochs that have one, or null."""
    return history.agg(F.max(value).alias("peak"))


def peaks(history: DataFrame, by: str, value: str) -> DataFrame:
    """by and peak(): the largest value of each run, null for a run without any."""
    return history.groupBy(by).agg(F.max(value).alias("peak"))


def by_padding(rows: DataFrame, padding: str, scored: Column, correct: Column, images: int) -> DataFrame:
    """padding, scored, correct, accuracy_over_all_images (of images, misses included) and accuracy_where_detected (null
    where nothing was scored)."""
    n, right = F.count_if(scored), F.count_if(scored & correct)
    return rows.groupBy(padding).agg(n.alias("scored"), right.alias("correct"), ratio(right, F.lit(images)).alias("accuracy_over_all_images"), F.try_divide(right.cast("double"), n).alias("accuracy_where_detected"))


def verdicts(rows: DataFrame, truth: str, prediction: str) -> DataFrame:
    """Adds verdict: correct or incorrect; a missing prediction is incorrect."""
    return rows.withColumn("verdict", F.when(F.col(truth).eqNullSafe(F.col(prediction)), "correct").otherwise("incorrect"))


def zero_recall(table: DataFrame) -> DataFrame:
    """Classes of a report() that have rows, none of them right."""
    return table.where("support > 0 AND correct = 0").select("class")


def extremes(table: DataFrame) -> DataFrame:
    """One row: best and worst class of a report() by recall; ties by name."""
    own = table.where("support > 0")
    return own.agg(F.min_by("class", F.struct((-F.col("recall")).alias("r"), F.col("class").alias("c"))).alias("best"), F.min_by("class", F.struct("recall", "class")).alias("worst"))


def counts_by_split(rows: DataFrame, split: str, label: str) -> DataFrame:
    """split, label, n per class, per split (label null) and in all (both null)."""
    return rows.rollup(split, label).agg(F.count("*").alias("n"))


def split_ratios(rows: DataFrame, split: str) -> DataFrame:
    """split, n and its share of all rows."""
    counts = rows.groupBy(split).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("__all"))
    return counts.join(F.broadcast(total)).select(split, "n", (F.col("n") / F.col("__all")).alias("ratio"))
