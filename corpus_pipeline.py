"""From raw documents to packed training sequences: stages that each work on all that the one before has kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
one's docs. All but the last return the columns of docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curata.llm import decontam, langid, packing, templates, triejoin
from curata.llm.common import fresh, table, written
from curata.llm.queries import vocabulary

#: A language named with less certainty than this counts as not recognised.
LEAST_SCORE = 0.4


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a recognisable language (no text, no letter, or no language certain enough). Null or
    repeated doc_ids are judged row by row; columns keep their values whatever their names; an empty table stays empty."""
    named, score = fresh(docs.columns, "lang", "score")
    found = langid.predict(docs, langid.fit(docs), names=(named, score))
    return found.where((F.col(named) != langid.UNDETERMINED) & (F.col(score) >= LEAST_SCORE)).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines whose templates recur in other documents, and the documents that consist of nothing else. The lowest
    doc_id keeps a template (null is the highest); rows that repeat a doc_id and text lose the same lines; null and empty
    texts stay; text and n_chars change, all other columns keep their values; an empty table stays empty."""
    n_lines, n_dropped = fresh(docs.columns, "n_lines", "n_dropped")
    rest = templates.drop_lines(docs, names=(n_lines, n_dropped))
    rest = rest.where((F.col(n_dropped) == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return rest.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs and a column that names each row: doc_id where no two rows share one and none lacks it, else a number that is
    written down with the rows."""
    if docs.groupBy("doc_id").agg(F.count("*").alias("times")).where("times > 1 OR doc_id IS NULL").isEmpty():
        return docs, "doc_id"
    (row,) = fresh(docs.columns, "row")
    return written(docs.withColumn(row, F.monotonically_increasing_id()), "rows"), row


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies, that with the lowest doc_id (null is the highest; of rows that
    repeat it, one). Rows are judged one by one, so that unlike texts under one doc_id and rows without one are kept or
    dropped each by its own text; texts without words are like no other and stay. Columns keep their values whatever their
    names; an empty table stays empty."""
    rows, key = numbered(docs)
    found = triejoin.near_duplicates(rows.select(F.col(key).alias("doc_id"), "text"))
    if key == "doc_id":
        kept = found.where(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias("kept"))
    else:
        ids = rows.select(F.col(key).alias("kept"), F.col("doc_id").alias("own"))
        met = found.join(ids, F.col("doc_id") == F.col("kept"))
        first = F.min(F.struct(F.col("own").isNull(), "own", "kept")).alias("first")
        kept = met.groupBy("component_id").agg(first).select("first.kept")
    (mark,) = fresh(rows.columns, "kept")
    kept = written(kept.select(F.col("kept").alias(mark)), "kept")
    return rows.join(kept, F.col(key) == F.col(mark), "left_semi").select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that overlap an item of the benchmark, row by row, also where rows share a doc_id or lack it.
    Null and empty texts overlap nothing; columns keep their values whatever their names; an empty table stays empty."""
    rows, key = numbered(docs)
    (leaked,) = fresh(rows.columns, "leaked")
    found = decontam.overlaps(rows.select(F.col(key).alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    return rows.join(found.select(F.col("doc_id").alias(leaked)).distinct(), F.col(key) == F.col(leaked), "left_anti").select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents' tokens into sequences of 2048: one row per piece, with its ids. Every row is packed, null and
    empty texts as their end id; further columns are left out; an empty table gives no rows."""
    return packing.pack(docs, vocabulary("word_bpe_49k.json"))


STAGES = [("language", language), ("lines", lines), ("near copies", near_copies), ("decontaminate", decontaminate), ("pack", pack)]

#: The models and tokens of the first and last stage are beyond SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages, applied to documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
