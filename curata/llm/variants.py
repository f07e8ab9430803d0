"""Groups of spelling variants: words one edit apart, found by the segments that an edit leaves alone.

A word is cut into two even segments. One inserted, deleted or replaced code point touches one of them, so of two near
words the longer or equal one holds the other segment of its neighbour, at its start or at its end: index both segments
of each word under its length, and probe with the first and last code points of equal or one longer words. Words that
share a segment which many words have are cut again in what is left, by the same rule, until few enough share all that is fixed;
then candidates are compared. Nothing is dropped: every pair of near words agrees on one segment at each cut.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

LETTERS = r"[A-Za-zÀ-ÿ]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Indexed words times probing words that may share a key before it is cut further.
BUCKET = 1024


def runs(docs: DataFrame) -> DataFrame:
    """word: each run of letters of the texts, A-Z in lower case, and of every 97th (by document and run) one letter gone.

    Null texts have none; a null doc_id counts as the empty string; repeated rows count each time; whole texts are split.
    """
    lower = F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER)
    split = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"), F.explode(F.split(lower, LETTERS.replace("[", "[^") + "+")).alias("run"))
    split = split.where("run != ''").withColumn("h", F.crc32(F.concat("doc", F.lit(":"), "run")))
    at = (F.col("h") % F.length("run")).cast("int")
    shorter = F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2))
    return split.select(F.when(F.col("h") % 97 == 0, shorter).otherwise(F.col("run")).alias("word"))


def counted(words: DataFrame, least_length: int = 5, least_n: int = 3) -> DataFrame:
    """word and n, its number of rows, for words of at least least_length code points and least_n rows; null is none."""
    return words.where(F.length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_n)


#: What a row stands for: a word in the index, or a probe for indexed words of its length or one shorter.
INDEX, EQUAL, LONGER = 0, 1, 2


def _cuts(rest: str, role: int) -> list[Column]:
    """Both ways to fix a segment of rest: which one of what length of indexed word, its text, and what is left."""
    whole, length = F.col(rest), F.length(rest)
    indexed = length - 1 if role == LONGER else length
    first = F.floor(indexed / 2).cast("int")
    last = indexed - first
    ways = [(F.substr(whole, F.lit(1), first), F.substr(whole, first + 1)), (F.substr(whole, length - last + 1), F.substr(whole, F.lit(1), length - last))]
    return [F.struct(F.lit(role).alias("role"), F.concat_ws(":", indexed, F.lit(k), same).alias("same"), left.alias("left")) for k, (same, left) in enumerate(ways)]


def _entries(rows: DataFrame, roles: Column) -> DataFrame:
    """One row per word, role of roles and way to cut rest: key names all segments that were fixed so far."""
    ways = F.concat(*(F.when(F.array_contains(roles, role), F.array(*_cuts("rest", role))).otherwise(F.array().cast("array<struct<role:int,same:string,left:string>>")) for role in (INDEX, EQUAL, LONGER)))
    cut = rows.withColumn("c", F.explode(ways))
    return cut.select(F.xxhash64("key", "c.same").alias("key"), F.col("c.role").alias("role"), "word", "n", F.col("c.left").alias("rest"))


def near_pairs(words: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """word, n, other, other_n: all words one edit from each other, each pair once a direction.

    words: distinct word and n. A key of over bucket possible pairs is cut again, which ends where at most one code point
    is left of the indexed words: what shares such a key differs there alone, so its pairs are near but for a few. Keys
    are 64-bit hashes; two that collide bring up candidates, which the comparison of whole words rules out.
    """
    start = words.select(F.lit(0).cast("long").alias("key"), "word", "n", F.col("word").alias("rest"))
    level, found = _entries(start, F.array(*map(F.lit, (INDEX, EQUAL, LONGER)))), []
    indexed = F.col("role") == INDEX
    while True:
        level = written(level, "segments")
        sizes = level.groupBy("key").agg(F.count_if(indexed).alias("ni"), F.count_if(~indexed).alias("np"), F.max(F.when(indexed, F.length("rest"))).alias("left"))
        shared = written(sizes.where("ni > 0 AND np > 0").select("key", ((F.col("ni") * F.col("np") > bucket) & (F.col("left") > 1)).alias("again")), "keys")
        few = level.join(shared.where("NOT again"), "key")
        index, probe = few.where(indexed).select("key", "word", "n"), few.where(~indexed).select("key", F.col("word").alias("other"), F.col("n").alias("other_n"))
        candidates = index.join(probe, "key").where("word != other").select("word", "n", "other", "other_n")
        found.append(written(candidates.where(F.levenshtein("word", "other", 1) == 1), "near"))
        if shared.where("again").isEmpty():
            break
        level = _entries(level.join(shared.where("again"), "key"), F.array("role"))
    pairs = reduce(DataFrame.union, found)
    turned = pairs.select(F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n"))
    return pairs.union(turned).distinct()


def group(words: DataFrame, ratio: int = 2, bucket: int = BUCKET) -> DataFrame:
    """words (distinct word and n) with form, root, n_near and form_n.

    form: the near word of largest n (ties: the smallest in code-point order), if its n is at least ratio times the
    word's; root: the last word that forms lead to, the word itself without any. n grows by ratio from form to form, so
    chains are short, and pointers that double reach the end in few rounds. An empty table stays empty.
    """
    words = written(words.select("word", "n"), "words")
    near = near_pairs(words, bucket).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("minus"), "other")).alias("best"))
    judged = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.col("best.other").alias("other"), (-F.col("best.minus")).alias("other_n"))
    takes = F.col("other_n") >= ratio * F.col("n")
    judged = judged.withColumns({"form": F.when(takes, F.col("other")), "form_n": F.when(takes, F.col("other_n"))}).drop("other", "other_n")
    judged = written(judged, "forms")
    links = judged.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:
        ahead = links.select(F.col("word").alias("at"), F.col("root").alias("next"))
        links = written(links.join(ahead, F.col("root") == F.col("at"), "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if links.where("moved").isEmpty():
            break
    out = judged.join(links.select("word", "root"), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def sql() -> str:
    """runs(), counted() and group() over documents as DuckDB SQL; pairs by the code point that one of them lacks."""
    return r"""
WITH RECURSIVE r AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{C0}-\x{FF}]+')) AS run
  FROM documents),
k AS (SELECT run, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS raw, count(*) AS n FROM r GROUP BY ALL),
h AS (
  SELECT run, n, xor(list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(range(0, 4 * length(raw)), lambda j: (('0x' || substr(raw, 2 * (j // 8)::BIGINT + 1, 2))::BIGINT >> (j % 8)) & 1)),
    lambda c, b: xor(c >> 1, 3988292384 * (xor(c, b) & 1))), 4294967295) AS h
  FROM k),
w AS (
  SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word, sum(n)::BIGINT AS n
  FROM h GROUP BY 1 HAVING length(word) >= 5 AND sum(n) >= 3),
v AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS less FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)),
p AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM v a JOIN v b ON a.i = b.i AND a.less = b.less AND a.word <> b.word
  UNION SELECT v.word, w.word, w.n FROM v JOIN w ON v.less = w.word
  UNION SELECT w.word, v.word, v.n FROM v JOIN w ON v.less = w.word),
best AS (
  SELECT word, count(*) AS n_near, first(other ORDER BY other_n DESC, other) AS other, max(other_n) AS other_n FROM p GROUP BY word),
f AS (
  SELECT word, n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN other_n >= 2 * n THEN other END AS form, CASE WHEN other_n >= 2 * n THEN other_n END AS form_n
  FROM w LEFT JOIN best USING (word)),
chain AS (
  SELECT word, word AS here, 0 AS step FROM f
  UNION ALL SELECT chain.word, f.form, step + 1 FROM chain JOIN f ON chain.here = f.word WHERE f.form IS NOT NULL)
SELECT word, form, root, n, n_near, form_n FROM f JOIN (SELECT word, last(here ORDER BY step) AS root FROM chain GROUP BY word) USING (word)
"""
