"""How filters of documents interact, whatever order they run in, from one count per set of failed filters.

Each document fails some set of filters, its mask. Counts per part and mask are all that the audit needs: the subset-zeta
transform of the counts tells, for every set of filters at once, how many documents fail none but those; the survivors
of a set of filters are that value at its complement, and a step of an order removes the difference between the
survivors of two sets that differ by its filter. The same holds for the documents that carry a label.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"


def own_failures(docs: DataFrame) -> DataFrame:
    """docs (with a column text), and in the column mask the filters that a text fails by itself: bit 0 under 200 words,
    bit 1 fewer distinct words than half of its words, bit 2 over 3 % capitals A-Z, bit 3 any of #$%&*|."""
    body = F.coalesce(F.col("text"), F.lit(""))
    words = docs.withColumn("mask", F.filter(F.split(body, SPACE), lambda w: w != ""))
    n, capitals = F.size("mask"), F.length(body) - F.length(F.regexp_replace(body, "[A-Z]+", ""))
    fails = [n < 200, 100 * F.size(F.array_distinct("mask")).cast("long") < 50 * n.cast("long"), 100 * capitals.cast("long") > 3 * F.length(body).cast("long"), body.rlike("[#$%&*|]")]
    return words.withColumn("mask", sum((F.when(b, 1 << k).otherwise(0) for k, b in enumerate(fails)), F.lit(0)))


def mask_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The number n of documents per part (their lang; null: the empty string), mask, good and toxic.

    Bits 0 to 3 are own_failures(), bit 4 is a text that a smaller doc_id has too; null texts are empty, whole texts
    count. Texts meet as SHA-256 digests; rows are counted per document first and then per text, so a text on any share
    of the rows sends a few rows from each task. A null doc_id is smaller than none, larger than none and has no label;
    rows that repeat a doc_id count one by one and are no copies of each other; a document is good (quality 1) or toxic
    where any of its labels says so. Further columns are not read; empty tables give no rows.
    """
    rows = own_failures(docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), "text"))
    rows = rows.select("doc_id", "part", "mask", F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("digest"))
    rows = rows.groupBy("doc_id", "part", "mask", "digest").agg(F.count("*").alias("n"))
    says = lambda c: F.coalesce(F.bool_or(F.col(c) == 1), F.lit(False))
    said = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(says("quality").alias("good"), says("toxic").alias("toxic"))
    rows = rows.join(said, "doc_id", "left").fillna(False, ["good", "toxic"])

    known = F.col("doc_id").isNotNull()
    by_text = rows.groupBy("digest", "part", "mask", "good", "toxic").agg(
        F.sum("n").alias("n"),
        F.coalesce(F.sum(F.when(~known, F.col("n"))), F.lit(0)).alias("nameless"),
        F.min(F.when(known, F.struct("doc_id", "n"))).alias("least"),
    )
    # Rows of a text: at most one per part and labels.
    by_text = by_text.withColumn("first", F.min("least.doc_id").over(Window.partitionBy("digest")))
    own = F.col("nameless") + F.when(F.col("least.doc_id") == F.col("first"), F.col("least.n")).otherwise(0)
    apart = F.explode(F.array(F.struct(F.col("mask"), own.alias("n")), F.struct((F.col("mask") + 16).alias("mask"), (F.col("n") - own).alias("n"))))
    split = by_text.select("part", "good", "toxic", apart.alias("s")).where("s.n > 0")
    return split.groupBy("part", F.col("s.mask").alias("mask"), "good", "toxic").agg(F.sum("s.n").alias("n"))


def _add_neighbours(counts: Column, bit: int) -> Column:
    """One pass of the subset-zeta transform: sets with the filter also take the value of the set without it."""
    without = F.transform(counts, lambda _, i: F.when(i.bitwiseAND(bit) != 0, F.get(counts, i - bit)).otherwise(0))
    return F.zip_with(counts, without, lambda c, d: c + d)


def survivors(counts: DataFrame, filters: int, part: str, mask: str, measures: dict[str, Column]) -> DataFrame:
    """One row per part, and for each measure (a number per row of counts) an array: at s, its sum over the documents
    that fail no filter of the set s."""
    sets = range(1 << filters)
    sums = [F.coalesce(F.sum(F.when(F.col(mask) == s, v)), F.lit(0)).cast("long").alias(f"{name}_{s}") for name, v in measures.items() for s in sets]
    out = counts.groupBy(F.col(part).alias("part")).agg(*sums).select("part", *(F.array(*(f"{name}_{s}" for s in sets)).alias(name) for name in measures))
    for k in range(filters):
        out = out.select("part", *(_add_neighbours(F.col(name), 1 << k).alias(name) for name in measures))
    # What fails no filter of s fails at most the complement of s, which stands at the mirrored place.
    return out.select("part", *(F.reverse(name).alias(name) for name in measures))


def _over_orders(left: Column, filters: int) -> Column:
    """Per filter, what it removes summed over all orders: a set of other filters stands ahead of it in as many orders as
    its members and the rest can be ordered."""
    sums = []
    for k in range(filters):
        ahead = [s for s in range(1 << filters) if not s >> k & 1]
        times = [math.factorial(s.bit_count()) * math.factorial(filters - 1 - s.bit_count()) for s in ahead]
        sums.append(sum((n * (F.get(left, F.lit(s)) - F.get(left, F.lit(s | 1 << k))) for s, n in zip(ahead, times, strict=True)), F.lit(0)))
    return F.array(*sums)


def audit(counts: DataFrame, letters: str, labels: Sequence[str] = ("good", "toxic"), part: str = "part", mask: str = "mask", n: str = "n") -> DataFrame:
    """One row per part, order of all filters and step, from numbers n of documents per part, mask (bit k: letters[k]
    fails) and boolean columns of labels.

    kept, removed, redundant (fail the step's filter, but went before) and unique_fails (fail it alone) are numbers of
    documents; <label>_lost are the removed ones with that label; shapley is what the filter removes summed over all
    orders. A part is one row of 2^filters numbers a measure from the first step on, so the number of documents no longer
    matters. Null masks and labels count as none; a null part is a part; an empty table gives no rows.
    """
    filters, full = len(letters), (1 << len(letters)) - 1
    measures = {"m": F.col(n)} | {f"m{k}": F.when(F.col(x), F.col(n)) for k, x in enumerate(labels)}
    left = survivors(counts, filters, part, mask, measures).withColumn("shapley", _over_orders(F.col("m"), filters))
    steps = left.withColumn("filter_order", F.explode(F.array(*(F.lit("".join(p)) for p in permutations(letters)))))
    steps = steps.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(filters))))
    places = [F.instr("filter_order", x) for x in letters]
    before = sum((F.when(p < F.col("step"), 1 << k).otherwise(0) for k, p in enumerate(places)), F.lit(0))
    which = sum((F.when(p == F.col("step"), k).otherwise(0) for k, p in enumerate(places)), F.lit(0))
    steps = steps.withColumns({"s": before, "k": which}).withColumn("bit", F.pow(F.lit(2), F.col("k")).cast("int"))
    after = F.col("s") + F.col("bit")
    gone = lambda m: F.get(m, F.col("s")) - F.get(m, after)
    return steps.select(
        "part",
        "filter_order",
        "step",
        F.get("m", after).alias("kept"),
        gone("m").alias("removed"),
        (F.get("m", F.lit(0)) - F.get("m", F.col("bit")) - gone("m")).alias("redundant"),
        (F.get("m", full - F.col("bit")) - F.get("m", F.lit(full))).alias("unique_fails"),
        *(gone(f"m{k}").alias(f"{x}_lost") for k, x in enumerate(labels)),
        F.get("shapley", F.col("k")).alias("shapley"),
    )


def sql() -> str:
    """mask_counts() and audit() for the filters A to E, step by step over documents as DuckDB SQL."""
    words = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
    return f"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS body, {words} AS w FROM documents),
f AS (
  SELECT doc_id, part, len(w) < 200 AS a, 100 * len(list_distinct(w)) < 50 * len(w) AS b,
    100 * (length(body) - length(regexp_replace(body, '[A-Z]+', '', 'g'))) > 3 * length(body) AS c,
    regexp_matches(body, '[#$%&*|]') AS d,
    coalesce(doc_id > min(doc_id) OVER (PARTITION BY body), false) AS e
  FROM d),
l AS (SELECT doc_id, coalesce(max(quality = 1), false) AS good, coalesce(max(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id),
m AS (
  SELECT part, a::INT + 2 * b::INT + 4 * c::INT + 8 * d::INT + 16 * e::INT AS mask, count(*) AS n,
    count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic
  FROM f LEFT JOIN l USING (doc_id) GROUP BY 1, 2),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (
  SELECT p.x || q.x || r.x || s.x || t.x AS filter_order FROM x p, x q, x r, x s, x t
  WHERE len(list_distinct([p.x, q.x, r.x, s.x, t.x])) = 5),
steps AS (
  SELECT filter_order, step, ascii(filter_order[step]) - 65 AS k,
    list_sum(list_transform(range(1, step), lambda i: 1 << (ascii(filter_order[i]) - 65)))::INT AS ahead
  FROM o, (SELECT unnest(range(1, 6))::INT AS step)),
g AS (
  SELECT part, filter_order, step, k,
    coalesce(sum(n) FILTER (WHERE mask & (coalesce(ahead, 0) | (1 << k)) = 0), 0)::BIGINT AS kept,
    coalesce(sum(n) FILTER (WHERE mask & coalesce(ahead, 0) = 0 AND mask & (1 << k) > 0), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (WHERE mask & coalesce(ahead, 0) > 0 AND mask & (1 << k) > 0), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (WHERE mask = (1 << k)), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (WHERE mask & coalesce(ahead, 0) = 0 AND mask & (1 << k) > 0), 0)::BIGINT AS good_lost,
    coalesce(sum(toxic) FILTER (WHERE mask & coalesce(ahead, 0) = 0 AND mask & (1 << k) > 0), 0)::BIGINT AS toxic_lost
  FROM m, steps GROUP BY ALL)
SELECT * EXCLUDE (k), sum(removed) OVER (PARTITION BY part, k)::BIGINT AS shapley FROM g
"""
