"""The subpackage's queries over the tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import attention, chat, decontam, divergence, langid, packing, rans, ring, templates, tokencount, triejoin, variants, zeta
from .common import shared_folder, table, written


def vocabulary(name: str) -> str:
    """Where a public vocabulary file lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one whose texts show control strings, digested from the windows' own output."""
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    return chat.digests(written(chat.windows(turns), "chat"))


OP1_SQL = """
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), g AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
    coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '') AS loss
  FROM t GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256 FROM g
"""


def op2_attention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents scored for quality by a model of the labels that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    model = attention.fit(docs, labels.where(~attention.held_out()))
    scored = attention.predict(docs, model)
    return scored.select("doc_id", attention.held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op3_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents on 40 shards under the law of rows: counts at most one apart."""
    dealt = ring.assign_shards(table(spark, sf_dir, "documents"), 40)
    return dealt.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_triejoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the size of their shingle sets and the component of near copies that they belong to."""
    return triejoin.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 ids; the ids of each piece as their crc32."""
    packed = packing.pack(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op6_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the lines whose templates recur."""
    return templates.drop_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of all documents, by a model of those that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(docs.where(~langid.held_out()))
    return langid.predict(docs.drop("lang"), model).select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op8_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and benchmark item that overlap."""
    return decontam.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_rans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of all documents, written to files and read back from them."""
    path = shared_folder(spark, "rans")
    rans.write(table(spark, sf_dir, "documents"), path, vocabulary("byte_bpe_50k.json"))
    return rans.read(spark, path).select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def op10_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents judged by counts and by their histograms' distance from those of the languages."""
    judged = divergence.judge(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return judged.drop("text", "lang")


def op11_wholetoken(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tokens of all documents, counted by the table of strings that are one token."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return tokencount.count_tokens(docs, vocabulary("byte_bpe_50k.json")).select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op12_zeta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each of five filters removes from each language at each step of every order."""
    counts = zeta.mask_counts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return zeta.audit(counts, "ABCDE")


def op13_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of all documents with the form that each is a variant of."""
    return variants.group(variants.counted(variants.runs(table(spark, sf_dir, "documents"))))


QUERIES = {
    "op1_chat": op1_chat,
    "op2_attention": op2_attention,
    "op3_ring": op3_ring,
    "op4_triejoin": op4_triejoin,
    "op5_packing": op5_packing,
    "op6_templates": op6_templates,
    "op7_langid": op7_langid,
    "op8_decontam": op8_decontam,
    "op9_rans": op9_rans,
    "op10_divergence": op10_divergence,
    "op11_wholetoken": op11_wholetoken,
    "op12_zeta": op12_zeta,
    "op13_variants": op13_variants,
}
ORACLE_SQL: dict[str, str] = {
    "op4_triejoin": triejoin.sql(),
    "op6_templates": templates.sql(),
    "op8_decontam": decontam.sql(),
    "op12_zeta": zeta.sql(),
    "op13_variants": variants.sql(),
}
