"""Line deduplication with a log-template tree of fixed depth. DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import bound
from .common import fresh, written

#: Rows of up to 24 bytes that may be sent to all tasks; larger tables are joined by a shuffle.
BROADCAST_ROWS = 200_000
SPACE = r"[ \t\x0B\f\r]+"


@dataclass(frozen=True)
class Settings:
    """least_tokens: shorter lines stay; least_docs: documents that a template must recur in; long_tokens: a line of more
    tokens must recur word for word in long_docs only; depth: leading tokens that lead to a leaf; alike: share of a line's
    tokens that must be constant; constant: how often a token must stand at its place of the leaf, as a share of how often
    the rarest of the line's alike most frequent tokens does, to be constant."""

    least_tokens: int = 5
    least_docs: int = 3
    long_tokens: int = 50
    long_docs: int = 2
    depth: int = 3
    constant: float = 0.5
    alike: float = 0.75


def normal(line: Column) -> Column:
    """line with single spaces, none at its ends, and every token that holds a digit as <*>."""
    # Most lines need no change, and looking for fixed strings is far cheaper than a pattern.
    odd = F.startswith(line, F.lit(" ")) | F.endswith(line, F.lit(" "))
    for x in ("  ", "\t", "\x0b", "\f", "\r"):
        odd = odd | F.contains(line, F.lit(x))
    spaced = F.when(odd, F.regexp_replace(F.regexp_replace(line, SPACE, " "), "^ | $", "")).otherwise(line)
    return F.when(line.rlike("[0-9]"), F.regexp_replace(spaced, "[^ ]*[0-9][^ ]*", "<*>")).otherwise(spaced)


def _tokens(line: Column) -> Column:
    return F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit(""))) + 1


def _doc(doc_id: str = "doc_id") -> Column:
    """The document a line counts for; null comes after all others."""
    return F.coalesce(F.col(doc_id), F.lit(2**63 - 1))


def lines(docs: DataFrame, s: Settings) -> DataFrame:
    """The lines of docs: doc, text_hash, line_no, leaf (null below least_tokens), template (a hash), n (tokens), line."""
    split = docs.select(_doc().alias("doc"), F.xxhash64("text").alias("text_hash"), F.posexplode(F.split("text", "\n", -1)).alias("line_no", "raw"))
    told = split.select("doc", "text_hash", "line_no", normal(F.col("raw")).alias("line")).withColumn("n", _tokens(F.col("line")))
    leaf = F.when((F.col("n") >= s.least_tokens) & (F.col("line") != ""), F.xxhash64("n", F.substring_index("line", " ", s.depth)))
    return told.select("doc", "text_hash", "line_no", leaf.alias("leaf"), F.xxhash64("line").alias("template"), "n", "line")


def _few(rows: DataFrame) -> DataFrame:
    """rows, marked for broadcast if they are few enough; else left to a shuffle."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def recurring(docs: DataFrame, s: Settings = Settings()) -> tuple[DataFrame, DataFrame]:
    """The lines of docs (without their texts), and the templates that recur: template, first_doc."""
    # Lines without a leaf go behind the written table: a filter before it would normalise every line twice.
    found = written(lines(docs, s).drop("line"), "lines").where(F.col("leaf").isNotNull())
    by_doc = found.groupBy("leaf", "template", "doc").agg(F.min("n").alias("n"))
    exact = by_doc.groupBy("leaf", "template").agg(F.count("*").alias("docs"), F.min("doc").alias("first_doc"), F.min("n").alias("n"))
    exact = written(exact, "templates")

    # Leaves where several lines may generalise: at least two that differ, in enough documents together.
    live = exact.groupBy("leaf").agg(F.count("*").alias("lines"), F.sum("docs").alias("docs")).where((F.col("lines") > 1) & (F.col("docs") >= s.least_docs)).select("leaf")
    wanted = written(exact.join(_few(written(live, "live")), "leaf"), "wanted")
    # The words of a template come from the first document that has it, so few texts are split again.
    homes = written(wanted.select(F.col("first_doc").alias("home")).distinct(), "homes")
    said = lines(docs.join(_few(homes), _doc() == F.col("home"), "left_semi"), s).select("leaf", "template", "line")
    said = said.join(_few(wanted.select("leaf", "template", "docs")), ["leaf", "template"]).dropDuplicates(["leaf", "template"])
    said = written(said.select("leaf", "template", "line", "docs"), "leaves")
    places = said.select("leaf", "template", "docs", F.posexplode(F.split("line", " ")).alias("at", "token"))
    votes = places.groupBy("leaf", "at", "token").agg(F.sum("docs").alias("n"))
    # A line's own template: its tokens that the leaf has about as often as most of the line's tokens; others are variable.
    heard = places.drop("docs").join(votes, ["leaf", "at", "token"]).groupBy("leaf", "template").agg(F.array_sort(F.collect_list(F.struct("at", "token", "n"))).alias("heard"))
    least = F.get(F.sort_array(F.col("heard.n"), asc=False), (F.ceil(s.alike * F.size("heard")) - 1).cast("int"))
    pattern = F.transform("heard", lambda x: F.when(x["n"] >= s.constant * F.col("least"), x["token"]))
    members = heard.withColumn("least", least).where(F.col("least") >= s.least_docs).select("leaf", "template", F.xxhash64("leaf", F.transform(pattern, lambda x: F.coalesce(x, F.lit(" ")))).alias("pattern"))
    members = written(members, "members")
    general = by_doc.join(_few(members), ["leaf", "template"]).groupBy("pattern", "doc").count().groupBy("pattern").agg(F.count("*").alias("docs"), F.min("doc").alias("first_doc")).where(F.col("docs") >= s.least_docs)
    wide = members.join(general, "pattern").select("template", "first_doc")
    narrow = exact.where((F.col("docs") >= s.least_docs) | ((F.col("n") > s.long_tokens) & (F.col("docs") >= s.long_docs))).select("template", "first_doc")
    return found, narrow.unionByName(wide).groupBy("template").agg(F.min("first_doc").alias("first_doc"))


def drop_lines(docs: DataFrame, settings: Settings = Settings(), names: tuple[str, str] = ("n_lines", "n_dropped")) -> DataFrame:
    """docs (doc_id, text, any further columns) without the lines whose templates recur across documents.

    A line goes down a tree: token count, then its leading tokens, tokens with digits as <*>. A leaf keeps as many
    templates as its lines show: in each line the tokens that stand at their place as often as most of the line's tokens
    do are constant and the others variable, and lines with the same constants at the same places share a template. A
    template, general or exact, that occurs in least_docs documents (exact ones of over long_tokens tokens: long_docs) is
    dropped from all of them but the one with the lowest doc_id (a null one is the highest), where the text stays whole.

    Adds n_lines (of the text, null: 0) and n_dropped, under these names. Repeated rows count as one document and get one result; lines
    below least_tokens, and null or empty texts, stay as they are; very long texts are split once; an empty table gives
    no rows. Columns named as the added ones are replaced; other names can't clash.
    """
    s = settings
    found, templates = recurring(docs.select("doc_id", "text"), s)
    out = found.join(_few(written(templates, "recurring")), "template").where(F.col("doc") != F.col("first_doc"))
    kept = [c for c in docs.columns if c not in names]
    doc, text_hash, gone = fresh(kept, "doc", "text_hash", "dropped_lines")
    out = out.groupBy(F.col("doc").alias(f"{doc}_of"), F.col("text_hash").alias(f"{text_hash}_of")).agg(F.collect_set("line_no").alias(gone))
    d = docs.select(*kept, _doc().alias(doc), F.xxhash64("text").alias(text_hash))
    d = d.join(out, (F.col(doc) == F.col(f"{doc}_of")) & (F.col(text_hash) == F.col(f"{text_hash}_of")), "left")
    split = F.split("text", "\n", -1)
    left = F.array_except(F.sequence(F.lit(0), F.size(split) - 1), gone)
    rest = bound(split, lambda own: F.array_join(F.transform(left, lambda i: F.get(own, i)), "\n"))
    whole = F.col(gone).isNull()
    columns = [F.when(whole, F.col("text")).otherwise(rest).alias("text") if c == "text" else F.col(c) for c in kept]
    return d.select(*columns, F.when(F.col("text").isNull(), 0).otherwise(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).cast("long").alias(names[0]), F.when(whole, 0).otherwise(F.size(gone)).cast("long").alias(names[1]))


def sql(s: Settings = Settings()) -> str:
    """drop_lines() over documents as DuckDB SQL: doc_id, n_lines, n_dropped, text."""
    return rf"""
WITH l AS (
  SELECT doc_id AS doc, text, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents
), n AS (
  SELECT doc, text, line_no, regexp_replace(regexp_replace(regexp_replace(raw, '[ \t\x0B\f\r]+', ' ', 'g'), '^ | $', '', 'g'), '[^ ]*[0-9][^ ]*', '<*>', 'g') AS line FROM l
), t AS MATERIALIZED (
  SELECT doc, text, line_no, line, len(string_split(line, ' ')) AS n, (len(string_split(line, ' ')), array_to_string(string_split(line, ' ')[1:{s.depth}], ' ')) AS leaf
  FROM n WHERE line <> '' AND len(string_split(line, ' ')) >= {s.least_tokens}
), e AS MATERIALIZED (
  SELECT leaf, line, any_value(n) AS n, count(DISTINCT doc) AS docs, min(doc) AS first_doc FROM t GROUP BY leaf, line
), live AS (
  SELECT leaf FROM e GROUP BY leaf HAVING count(*) > 1 AND sum(docs) >= {s.least_docs}
), p AS MATERIALIZED (
  SELECT leaf, line, n, docs, unnest(string_split(line, ' ')) AS token, generate_subscripts(string_split(line, ' '), 1) AS pos FROM e JOIN live USING (leaf)
), v AS (
  SELECT leaf, pos, token, sum(docs) AS votes FROM p GROUP BY leaf, pos, token
), o AS (
  SELECT leaf, line, n, list(votes ORDER BY votes DESC)[CAST(ceil({s.alike}::DOUBLE * n) AS BIGINT)] AS least FROM p JOIN v USING (leaf, pos, token) GROUP BY leaf, line, n
), m AS (
  SELECT leaf, line, list(CASE WHEN votes >= {s.constant} * least THEN token END ORDER BY pos) AS pattern
  FROM p JOIN v USING (leaf, pos, token) JOIN o USING (leaf, line) WHERE least >= {s.least_docs} GROUP BY leaf, line
), g AS (
  SELECT leaf, pattern, min(doc) AS first_doc FROM t JOIN m USING (leaf, line) GROUP BY leaf, pattern HAVING count(DISTINCT doc) >= {s.least_docs}
), r AS (
  SELECT line, min(first_doc) AS first_doc FROM (
    SELECT line, first_doc FROM e WHERE docs >= {s.least_docs} OR (n > {s.long_tokens} AND docs >= {s.long_docs})
    UNION ALL SELECT line, g.first_doc FROM m JOIN g USING (leaf, pattern)) GROUP BY line
), gone AS (
  SELECT doc, text, list(DISTINCT line_no) AS dropped FROM t JOIN r USING (line) WHERE doc <> first_doc GROUP BY doc, text
)
SELECT doc_id, CAST(coalesce(len(string_split(d.text, chr(10))), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(dropped), 0) AS BIGINT) AS n_dropped,
  CASE WHEN dropped IS NULL THEN d.text ELSE coalesce(array_to_string(list_transform(list_filter(list_zip(string_split(d.text, chr(10)), generate_series(1, len(string_split(d.text, chr(10))))), lambda x: NOT list_contains(dropped, x[2])), lambda x: x[1]), chr(10)), '') END AS text
FROM documents d LEFT JOIN gone ON gone.doc = d.doc_id AND gone.text = d.text
"""
