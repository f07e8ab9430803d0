"""Benchmark decontamination by spaced seeds. DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: Benchmark seeds, 24 bytes each, that may be sent to all tasks; more are joined by a shuffle.
BROADCAST_SEEDS = 500_000
#: Hits, 32 bytes each, whose documents may be sent to all tasks; more are joined by a shuffle of the texts.
BROADCAST_HITS = 500_000


@dataclass(frozen=True)
class Settings:
    """masks: 1 compares a token, 0 ignores it; around: tokens that a verified overlap spans (shorter items: the whole
    item); alike: share of them that must be equal; lead: how many of them come before the seed."""

    masks: tuple[str, ...] = ("1111011", "1011001101")
    around: int = 16
    alike: float = 0.8
    lead: int = 4


def word_hashes(text: Column) -> Column:
    """The hashes of the words (letters and digits, lower case) of text, in order; null for null."""
    spaced = F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))
    return F.when(spaced == "", F.array().cast("array<bigint>")).otherwise(F.transform(F.split(spaced, " "), lambda w: F.xxhash64(w)))


def seeds(rows: DataFrame, key: str, masks: tuple[str, ...], lengths: list[int], whole: bool) -> DataFrame:
    """key, pos and seed for each place of each mask on the rows' words (array column h), and of the windows of each of
    lengths, or of the rows that are exactly as long (whole). All come from one pass over the words."""
    none = F.array().cast("array<struct<pos:int,seed:bigint>>")

    def of(number: int, size: int, own: list[int], exactly: bool) -> Column:
        last = F.when(F.size("h") == size, 0) if exactly else F.when(F.size("h") >= size, F.size("h") - size)
        places = F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(i.alias("pos"), F.xxhash64(F.lit(number), *(F.get("h", i + k) for k in own)).alias("seed")))
        return F.coalesce(places, none)

    parts = [of(k, len(m), [i for i, x in enumerate(m) if x == "1"], False) for k, m in enumerate(masks)]
    parts += [of(-n, n, list(range(n)), whole) for n in lengths]
    return rows.select(key, F.inline(F.concat(*parts)))


def overlaps(docs: DataFrame, benchmark: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Where docs (doc_id, text) repeat items of benchmark (item_id, text), substitutions allowed.

    Seeds under the masks are equal for a place in a document and one in an item even if the ignored words differ; each
    such hit fixes an alignment. Around it a stretch of `around` words of the item (all of a shorter item) is compared
    word by word and counts if at least `alike` of them are equal. Returns one row per document and item:
    doc_id, item_id, n_equal, n_compared (of the best stretch), doc_start (the document's word where it begins; negative
    if the item's stretch begins before the text), n_places (alignments that counted).

    Seeds of an item that several items share are compared for each. Items with fewer words than the shortest mask are
    met by all of their words and found where these stand in a row. Null and empty texts match nothing; a null doc_id is a
    document of its own and rows that repeat a doc_id count together; texts of any length are searched whole; further
    columns are ignored, whatever their names; an empty table on either side gives no rows.
    """
    s = settings
    items = written(benchmark.select("item_id", word_hashes(F.col("text")).alias("h")).where(F.size("h") > 0), "items")
    shortest = min(map(len, s.masks))
    lengths = sorted(r.n for r in items.select(F.size("h").alias("n")).where(F.col("n") < shortest).distinct().collect())

    probes = seeds(items, "item_id", s.masks, lengths, True).select("item_id", F.col("pos").alias("item_pos"), "seed")
    small = probes.count() <= BROADCAST_SEEDS
    hashed = docs.select("doc_id", word_hashes(F.col("text")).alias("h"))
    sought = probes.select("seed").distinct()
    # The distinct seeds are met first, so that a seed of many items multiplies only what it has hit.
    hit = seeds(hashed, "doc_id", s.masks, lengths, False).join(F.broadcast(sought) if small else sought, "seed", "left_semi")
    hit = hit.join(F.broadcast(probes) if small else probes, "seed")
    places = hit.groupBy("doc_id", "item_id", (F.col("pos") - F.col("item_pos")).alias("shift"), F.greatest(F.lit(0), F.col("item_pos") - s.lead).alias("begin")).count().drop("count")
    places = written(places, "hits")

    few = F.broadcast if places.count() <= BROADCAST_HITS else (lambda rows: rows)
    wanted = places.groupBy(F.col("doc_id").alias("w_doc"), "item_id").agg(F.collect_list(F.struct("shift", "begin")).alias("places"))
    theirs = items.select("item_id", F.col("h").alias("item_h"))
    ids = places.select(F.col("doc_id").alias("w_doc")).distinct()
    texts = docs.select("doc_id", "text").join(few(ids), F.col("doc_id").eqNullSafe(F.col("w_doc"))).select("doc_id", word_hashes(F.col("text")).alias("h"))
    both = texts.join(few(wanted), F.col("doc_id").eqNullSafe(F.col("w_doc"))).join(F.broadcast(theirs) if small else theirs, "item_id")
    both = both.select("doc_id", "item_id", "h", "item_h", F.explode("places").alias("place"))
    size = F.least(F.lit(s.around), F.size("item_h"))
    begin = F.greatest(F.lit(0), F.least(F.col("place.begin"), F.size("item_h") - size))
    both = both.select("doc_id", "item_id", (F.col("place.shift") + begin).alias("doc_start"), size.alias("n_compared"), F.aggregate(F.sequence(F.lit(0), size - 1), F.lit(0), lambda n, i: n + F.when((F.col("place.shift") + begin + i >= 0) & (F.get("h", F.greatest(F.lit(0), F.col("place.shift") + begin + i)) == F.get("item_h", begin + i)), 1).otherwise(0)).alias("n_equal"))
    best = F.max(F.struct("n_equal", (-F.col("doc_start")).alias("at"), "n_compared"))
    found = both.where(F.col("n_equal") >= s.alike * F.col("n_compared")).groupBy("doc_id", "item_id").agg(best.alias("best"), F.countDistinct("doc_start").alias("n_places"))
    return found.select("doc_id", "item_id", F.col("best.n_equal").cast("long").alias("n_equal"), F.col("best.n_compared").cast("long").alias("n_compared"), (-F.col("best.at")).cast("long").alias("doc_start"), "n_places")


def sql(settings: Settings = Settings()) -> str:
    """overlaps() of documents and benchmark as DuckDB SQL."""
    s = settings
    seed = lambda k, m: f"'{k} ' || " + " || ' ' || ".join(f"w[p + {i}]" for i, x in enumerate(m) if x == "1")
    places = lambda own: " UNION ALL ".join(f"SELECT {own}, p - 1 AS pos, {seed(k, m)} AS seed FROM (SELECT {own}, w, unnest(generate_series(1, len(w) - {len(m) - 1})) AS p FROM {own}_words)" for k, m in enumerate(s.masks))
    words = lambda own, of, key: f"SELECT {key} AS {own}, string_split(trim(regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' ') AS w FROM {of} WHERE trim(regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) <> ''"
    return f"""
WITH item_words AS MATERIALIZED ({words("item", "benchmark", "item_id")}),
doc_words AS MATERIALIZED ({words("doc", "documents", "doc_id")}),
probes AS MATERIALIZED ({places("item")}),
hits AS MATERIALIZED (
  SELECT DISTINCT doc, item, d.pos - p.pos AS shift, greatest(0, p.pos - {s.lead}) AS begin0 FROM ({places("doc")}) d JOIN probes p USING (seed)
), placed AS (
  SELECT h.doc, h.item, shift, least({s.around}, len(i.w)) AS n_compared, greatest(0, least(begin0, len(i.w) - least({s.around}, len(i.w)))) AS b, i.w AS iw, d.w AS dw
  FROM hits h JOIN item_words i USING (item) JOIN doc_words d USING (doc)
), compared AS (
  SELECT doc, item, shift + b AS doc_start, n_compared,
    len(list_filter(generate_series(0, n_compared - 1), lambda k: shift + b + k >= 0 AND shift + b + k < len(dw) AND dw[CAST(shift + b + k + 1 AS BIGINT)] = iw[CAST(b + k + 1 AS BIGINT)])) AS n_equal
  FROM placed
), best AS (
  SELECT doc, item, max((n_equal, -doc_start, n_compared)) AS m, count(DISTINCT doc_start) AS n_places
  FROM compared WHERE n_equal >= {s.alike} * n_compared GROUP BY doc, item)
SELECT doc AS doc_id, item AS item_id, CAST(m[1] AS BIGINT) AS n_equal, CAST(m[3] AS BIGINT) AS n_compared, CAST(-m[2] AS BIGINT) AS doc_start, n_places FROM best
"""
