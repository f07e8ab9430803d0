"""Python's own shuffle of a class's places, without the places ever meeting in one task.

The shuffle goes down from the last place: at step i it swaps places i and j, j drawn from 0 to i. Only the drawn numbers
depend on each other. What lies on a place follows from them by pointers: just before step i, place p holds what lay on
place s just before step s, where s is the last step before i (the smallest number above i) that drew p; or still its
own. So place i ends up with what its drawn place held then, and chains of such steps are followed by doubling.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import settled

#: Drawn numbers that are handed on at a time.
BLOCK = 65_536


def draws(sizes: DataFrame, seed: int) -> DataFrame:
    """label, n, i, j: the swaps that random.Random("<seed>:<label>").shuffle() makes of n places, for each row (label, n)
    of sizes. One stream a class, BLOCK numbers in memory."""
    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for batch in batches:
            for label, n in zip(batch["label"], batch["n"], strict=True):
                own, made = random.Random(f"{seed}:{label}"), []
                for i in range(int(n) - 1, 0, -1):
                    made.append((i, own.randrange(i + 1)))
                    if len(made) == BLOCK or i == 1:
                        yield pd.DataFrame(made, columns=["i", "j"]).assign(label=label, n=n)[["label", "n", "i", "j"]]
                        made = []

    kind = sizes.schema["label"].dataType.simpleString()
    return sizes.select("label", "n").repartition("label").mapInPandas(run, f"label {kind}, n long, i long, j long")


def order(sizes: DataFrame, seed: int) -> DataFrame:
    """label, n, at, place: which place each place of a shuffled class comes from. Labels are told apart as they are; a
    null label's seed reads None."""
    named = sizes.select(F.to_json(F.struct(F.col("label").alias("of"))).alias("class"), "label", "n")
    steps = settled(draws(named.select("label", "n"), seed).withColumn("class", F.to_json(F.struct(F.col("label").alias("of")))).drop("label"))
    # The step above i that drew the same place; a place is drawn a few times, about as often as log(n).
    steps = steps.withColumn("later", F.lead("i").over(Window.partitionBy("class", "j").orderBy("i")))
    held = steps.where("i > j").groupBy("class", F.col("j").alias("p")).agg(F.min("i").alias("q"))
    ends = settled(held.withColumn("moved", F.lit(True)))
    while not ends.where("moved").isEmpty():
        further = ends.select("class", F.col("p").alias("q"), F.col("q").alias("next"))
        ends = settled(ends.drop("moved").join(further, ["class", "q"], "left").select("class", "p", F.coalesce("next", "q").alias("q"), F.col("next").isNotNull().alias("moved")))
    whole = steps.select("class", "n", F.col("i").alias("at"), "j", "later").unionByName(named.where("n > 0").select("class", "n", F.lit(0).cast("long").alias("at"), F.lit(0).cast("long").alias("j"), F.lit(None).cast("long").alias("later")))
    # Place 0 holds in the end what a step 0 that draws it would find.
    first = held.where("p = 0").select("class", F.col("q").alias("zero"))
    whole = whole.join(first, "class", "left").withColumn("later", F.when(F.col("at") == 0, F.col("zero")).otherwise(F.col("later"))).drop("zero")
    found = whole.join(ends.select("class", F.col("p").alias("later"), "q"), ["class", "later"], "left")
    placed = found.select("class", "n", "at", F.coalesce("q", "later", "j").alias("place"))
    return placed.join(named.select("class", "label"), "class").select("label", "n", "at", "place")
