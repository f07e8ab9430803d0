"""Queries of the curation and evaluation operators over the tables, each with the same result as DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hashing, landmarks, sqlnames, text, vectors
from ..operators import dedup, metrics, ranking, sampling, score, selection, splits, validate
from ..sources.scratch import settled
from .embedding_split import CLASSES, SQL, scored, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function as a query under its name, with its SQL."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """df with its doubles rounded, so that the order of a sum doesn't show."""
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").withColumn("sha", hashing.digest("text"))


# --- evaluation of the centroid classifier -------------------------------------------------------------------------


@query(f"""WITH {SQL} SELECT d.t::INT AS truth, e.t::INT AS prediction, count(s.vec_id) AS n FROM range(10) d(t) CROSS JOIN range(10) e(t)
LEFT JOIN scored s ON s.label = d.t AND s.prediction = e.t GROUP BY d.t, e.t""")
def confusion_matrix(spark, sf_dir):
    return metrics.confusion(scored(spark, sf_dir), "label", "prediction", CLASSES)


REPORT = f"""WITH {SQL}, r AS (SELECT CAST(k.t AS INT) AS class, count(*) FILTER (WHERE label = k.t) AS support, count(*) FILTER (WHERE prediction = k.t) AS predicted,
  count(*) FILTER (WHERE label = k.t AND prediction = k.t) AS correct FROM range(10) k(t) CROSS JOIN scored GROUP BY k.t
), report AS (SELECT *, coalesce(correct / nullif(predicted, 0), 0.0::DOUBLE) AS precision, coalesce(correct / nullif(support, 0), 0.0::DOUBLE) AS recall, coalesce(2 * correct / nullif(support + predicted, 0), 0.0::DOUBLE) AS f1 FROM r)"""


@query(f"{REPORT} SELECT class, support, predicted, correct, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM report")
def classification_report(spark, sf_dir):
    return rounded(metrics.report(scored(spark, sf_dir), "label", "prediction", CLASSES))


@query(f"{REPORT} SELECT round(sum(correct) / sum(support), 6) AS accuracy, round(avg(f1), 6) AS macro_f1, CAST(sum(support) AS BIGINT) AS n, CAST(sum(correct) AS BIGINT) AS correct FROM report")
def accuracy_macro_f1(spark, sf_dir):
    return rounded(metrics.summary(scored(spark, sf_dir), "label", "prediction", CLASSES)).drop("macro_f1_supported")


@query(f"{REPORT} SELECT round(avg(f1) FILTER (WHERE support > 0), 6) AS macro_f1_supported FROM report")
def macro_f1_supported_only(spark, sf_dir):
    return rounded(metrics.summary(scored(spark, sf_dir), "label", "prediction", [*CLASSES, 99])).select("macro_f1_supported")


@query(f"{REPORT} SELECT class FROM report WHERE support > 0 AND correct = 0")
def zero_recall_classes(spark, sf_dir):
    return metrics.zero_recall(metrics.report(scored(spark, sf_dir), "label", "prediction", CLASSES))


@query(f"{REPORT} SELECT arg_max(class, (recall, -class)) AS best, arg_min(class, (recall, class)) AS worst FROM report WHERE support > 0")
def best_and_worst_class(spark, sf_dir):
    return metrics.extremes(metrics.report(scored(spark, sf_dir), "label", "prediction", CLASSES))


@query(f"""WITH {SQL}, b AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY probability DESC, cls) AS rank FROM p)
SELECT vec_id, CAST(rank AS INT) AS rank, cls AS class, round(probability, 6) AS probability FROM b WHERE rank <= 3""")
def top_k_classes(spark, sf_dir):
    return rounded(score.top_classes(scored(spark, sf_dir), 3, CLASSES).select("vec_id", "rank", "class", "probability"))


@query(f"WITH {SQL} SELECT vec_id, prediction, round(confidence, 6) AS confidence, round(confidence, 9) < 0.2 AS low_confidence, CASE WHEN round(confidence, 9) < 0.2 THEN 'Low confidence: treat this prediction as uncertain.' END AS warning FROM scored")
def low_confidence(spark, sf_dir):
    rows = scored(spark, sf_dir).withColumn("confidence", F.round("confidence", 9))
    return rounded(score.flag_low_confidence(rows, 0.2).select("vec_id", "prediction", "confidence", "low_confidence", "warning"))


@query(f"WITH {SQL} SELECT round(avg(-ln(probability)), 6) AS loss, round(avg((prediction = s.label)::INT), 6) AS accuracy, count(*) AS n FROM scored s JOIN p ON p.vec_id = s.vec_id AND p.cls = s.label")
def mean_cross_entropy(spark, sf_dir):
    return rounded(metrics.mean_loss(scored(spark, sf_dir), vectors.cross_entropy(F.col("probabilities"), F.col("label")), F.col("prediction") == F.col("label")))


CORRUPTED = f"""WITH {SQL}, s AS (SELECT *, list_value({", ".join(f"'{c}'" for c in sampling.CORRUPTIONS)})[CAST((row_number() OVER (ORDER BY vec_id) - 1) % 8 + 1 AS INT)] AS corruption FROM scored)"""


@query(f"{CORRUPTED} SELECT corruption, round(avg((prediction = label)::INT), 6) AS accuracy, count(*) FILTER (WHERE prediction = label) AS correct, count(*) AS total FROM s GROUP BY corruption")
def per_corruption_accuracy(spark, sf_dir):
    rows = sampling.with_corruption(scored(spark, sf_dir), "vec_id")
    return rounded(metrics.accuracy_by(rows, "corruption", F.col("prediction") == F.col("label")))


@query(f"{CORRUPTED} SELECT count(*) FILTER (WHERE prediction = label) AS correct, count(*) AS total, round(avg((prediction = label)::INT), 6) AS accuracy FROM s WHERE corruption IN ('jpeg_q25', 'hue_shift', 'letterbox', 'downscale')")
def independent_accuracy(spark, sf_dir):
    rows = sampling.with_corruption(scored(spark, sf_dir), "vec_id")
    return rounded(metrics.pooled_accuracy(rows, "corruption", ["jpeg_q25", "hue_shift", "letterbox", "downscale"], F.col("prediction") == F.col("label")))


# --- counts, splits and samples --------------------------------------------------------------------------------------


@query("""WITH k AS (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY sha256('42:' || label || ':' || vec_id), vec_id) AS rn, count(*) OVER (PARTITION BY label) AS n FROM embeddings
), q AS (SELECT DISTINCT label, n FROM k), t AS (SELECT label, n, i, n * r AS want, floor(n * r) AS low FROM q CROSS JOIN (VALUES (0, 0.7::DOUBLE), (1, 0.15::DOUBLE), (2, 0.15::DOUBLE)) x(i, r)
), u AS (SELECT label, i, low + (row_number() OVER (PARTITION BY label ORDER BY low - want, i) <= n - sum(low) OVER (PARTITION BY label))::INT AS target FROM t
), slots AS (SELECT label, i, row_number() OVER (PARTITION BY label ORDER BY level DESC, i) AS rn FROM (SELECT label, i, unnest(generate_series(1, target::INT)) AS level FROM u))
SELECT k.label, vec_id, list_value('train', 'validation', 'test')[i + 1] AS split FROM k JOIN slots USING (label, rn)""")
def singleton_split(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("label", "vec_id")
    return splits.singleton_split(rows, "label", "vec_id", ["train", "validation", "test"], [0.7, 0.15, 0.15])


GROUPED = """WITH RECURSIVE g AS (SELECT lang, sha256(text) AS sha, count(*) AS size FROM documents GROUP BY ALL
), k AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY sha256('42:' || lang || ':' || sha), sha) AS rn, count(*) OVER (PARTITION BY lang) AS groups, sum(size) OVER (PARTITION BY lang) AS n FROM g
), q AS (SELECT DISTINCT lang, n FROM k), t AS (SELECT lang, n, i, n * r AS want, floor(n * r) AS low FROM q CROSS JOIN (VALUES (0, 0.7::DOUBLE), (1, 0.15::DOUBLE), (2, 0.15::DOUBLE)) x(i, r)
), u AS (SELECT lang, i, CAST(low + (row_number() OVER (PARTITION BY lang ORDER BY low - want, i) <= n - sum(low) OVER (PARTITION BY lang))::INT AS BIGINT) AS target FROM t
), y AS (SELECT lang, max(target) FILTER (WHERE i = 0) AS t0, max(target) FILTER (WHERE i = 1) AS t1, max(target) FILTER (WHERE i = 2) AS t2 FROM u GROUP BY lang
), w AS (SELECT lang, 0::BIGINT AS rn, NULL::VARCHAR AS sha, 0::BIGINT AS size, 0::BIGINT AS a0, 0::BIGINT AS a1, 0::BIGINT AS a2, -1 AS pick FROM y
  UNION ALL SELECT lang, rn, sha, size, a0 + (pick = 0)::INT * size, a1 + (pick = 1)::INT * size, a2 + (pick = 2)::INT * size, pick FROM (
    SELECT w.lang, k.rn, k.sha, k.size::BIGINT AS size, a0, a1, a2, list_sort(list_filter([
      (2 * k.size * (a0 - t0) + k.size * k.size, a0 - t0, 0, a0 = 0), (2 * k.size * (a1 - t1) + k.size * k.size, a1 - t1, 1, a1 = 0), (2 * k.size * (a2 - t2) + k.size * k.size, a2 - t2, 2, a2 = 0)],
      lambda x: x[4] OR (a0 = 0)::INT + (a1 = 0)::INT + (a2 = 0)::INT <> k.groups - k.rn + 1))[1][3] AS pick
    FROM w JOIN y USING (lang) JOIN k ON k.lang = w.lang AND k.rn = w.rn + 1)
), placed AS (SELECT lang, sha, size, list_value('train', 'validation', 'test')[pick + 1] AS split FROM w WHERE rn > 0)"""


def _grouped(spark, sf_dir):
    return splits.grouped_split(docs(spark, sf_dir).select("doc_id", "lang", "sha"), "lang", "sha", ["train", "validation", "test"], [0.7, 0.15, 0.15])


@query(f"{GROUPED} SELECT doc_id, split FROM documents d JOIN placed p ON p.lang = d.lang AND p.sha = sha256(d.text)")
def grouped_split(spark, sf_dir):
    return _grouped(spark, sf_dir).select("doc_id", "split")


@query(f"{GROUPED} SELECT split, lang, CAST(sum(size) AS BIGINT) AS n FROM placed GROUP BY ROLLUP (split, lang)")
def class_counts_by_split(spark, sf_dir):
    return metrics.counts_by_split(_grouped(spark, sf_dir), "split", "lang")


@query(f"{GROUPED} SELECT split, CAST(sum(size) AS BIGINT) AS n, round(sum(size) / (SELECT count(*) FROM documents), 6) AS ratio FROM placed GROUP BY split")
def split_ratios(spark, sf_dir):
    return rounded(metrics.split_ratios(_grouped(spark, sf_dir), "split"))


@query("""WITH k AS (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY sha256('42:' || label || ':' || vec_id), vec_id) AS rn, count(*) OVER (PARTITION BY label) AS n FROM embeddings)
SELECT label, vec_id, CASE WHEN rn <= n // 2 THEN 'dev' ELSE 'final' END AS split FROM k""")
def holdout_halves(spark, sf_dir):
    return splits.halves(table(spark, sf_dir, "embeddings").select("label", "vec_id"), "label", "vec_id")


@query("""WITH k AS (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rn, count(*) OVER (PARTITION BY label) AS n FROM embeddings)
SELECT label, vec_id, CASE WHEN rn <= floor(0.8::DOUBLE * n) THEN 'train' ELSE 'test' END AS split FROM k""")
def positional_80_20(spark, sf_dir):
    return splits.leading_share(table(spark, sf_dir, "embeddings").select("label", "vec_id"), "label", "vec_id")


@query("""WITH k AS (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS pos, count(*) OVER (PARTITION BY label) AS n FROM embeddings
), t AS (SELECT DISTINCT label, n, least(7, n) AS take FROM k), s AS (SELECT label, least(CAST(floor(p * (n / take)) AS BIGINT), n - 1) AS pos FROM (SELECT *, unnest(generate_series(0, take - 1)) AS p FROM t))
SELECT DISTINCT k.label, vec_id FROM k JOIN s USING (label, pos)""")
def stratified_even_sample(spark, sf_dir):
    return sampling.even_sample(table(spark, sf_dir, "embeddings").select("label", "vec_id"), "label", "vec_id", 7)


@query("""SELECT o_orderpriority, o_orderkey FROM (SELECT o_orderpriority, o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS r FROM orders) ORDER BY r, o_orderpriority LIMIT 523""")
def round_robin_limit(spark, sf_dir):
    return sampling.round_robin(table(spark, sf_dir, "orders").select("o_orderpriority", "o_orderkey"), "o_orderpriority", "o_orderkey", 523)


@query("SELECT event_id FROM (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS pos FROM events) WHERE pos % 20 = 0")
def every_20th(spark, sf_dir):
    return sampling.every_nth(table(spark, sf_dir, "events").select("event_id"), [], "event_id", 20)


@query("SELECT label, min(vec_id) AS vec_id FROM embeddings GROUP BY label")
def first_per_class(spark, sf_dir):
    return sampling.first_per_class(table(spark, sf_dir, "embeddings").select("label", "vec_id"), "label", "vec_id")


@query("SELECT doc_id FROM documents ORDER BY sha256('42:' || doc_id), doc_id LIMIT 9")
def seeded_pick(spark, sf_dir):
    return sampling.seeded_pick(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 9)


@query(f"""SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS position, list_value({", ".join(f"'{c}'" for c in sampling.CORRUPTIONS)})[CAST((row_number() OVER (ORDER BY vec_id) - 1) % 8 + 1 AS INT)] AS corruption FROM embeddings""")
def corruption_assignment(spark, sf_dir):
    return sampling.with_corruption(table(spark, sf_dir, "embeddings").select("vec_id"), "vec_id")


@query("SELECT sha256(string_agg(n_nationkey || chr(9) || n_name || chr(10), '' ORDER BY n_nationkey)) AS digest, count(*) AS n_rows FROM nation")
def row_set_digest(spark, sf_dir):
    return sampling.ordered_digest(table(spark, sf_dir, "nation"), ["n_nationkey"], F.concat(F.col("n_nationkey").cast("string"), F.lit("\t"), "n_name", F.lit("\n")))


@query("""SELECT lang, count(*) AS n, round(sum(is_extra) / count(*), 6) AS share FROM (SELECT lang, 0 AS is_extra FROM documents UNION ALL SELECT lang, 1 FROM documents, range(7) WHERE source = 'src3') GROUP BY lang""")
def repeat_union(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("lang", "source")
    pool = sampling.repeated_union(rows.select("lang", F.lit(0).alias("is_extra")), rows.where("source = 'src3'").select("lang", F.lit(1).alias("is_extra")), 7)
    return rounded(pool.groupBy("lang").agg(F.count("*").alias("n"), (F.sum("is_extra") / F.count("*")).alias("share")))


# --- copies, conflicts, leaks ----------------------------------------------------------------------------------------


@query("SELECT sha256(text) AS sha, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
def exact_duplicate_groups(spark, sf_dir):
    return dedup.exact_groups(docs(spark, sf_dir), "sha")


@query("SELECT count(*) AS n_groups, CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS n_extra FROM (SELECT count(*) AS n FROM documents GROUP BY sha256(text) HAVING count(*) > 1)")
def duplicate_summary(spark, sf_dir):
    return dedup.duplicate_summary(docs(spark, sf_dir), "sha")


@query("SELECT first, doc_id AS later FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY md5(text)) AS first FROM documents) WHERE doc_id <> first")
def duplicate_pairs_first_seen(spark, sf_dir):
    return dedup.first_seen_pairs(table(spark, sf_dir, "documents").withColumn("md5", F.md5("text")), "md5", "doc_id")


@query("SELECT count(*) AS n_rows, CAST(coalesce(sum((k > 1)::INT), 0) AS BIGINT) AS n_violations FROM (SELECT count(DISTINCT quality) AS k FROM documents JOIN labels USING (doc_id) GROUP BY sha256(text))")
def label_conflicts(spark, sf_dir):
    rows = docs(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id")
    kinds = rows.groupBy("sha").agg(F.countDistinct("quality").alias("k"))
    return kinds.agg(F.count("*").alias("n_rows"), F.count_if(F.col("k") > 1).alias("n_violations"))


@query("SELECT sha256(text) AS sha, count(DISTINCT source) AS n_partitions, count(*) AS n_rows FROM documents GROUP BY 1 HAVING count(DISTINCT source) > 1")
def cross_partition_duplicates(spark, sf_dir):
    return dedup.spanning(docs(spark, sf_dir), "sha", "source")


@query("SELECT sha256(d.text) AS sha FROM documents d JOIN labels USING (doc_id) INTERSECT SELECT sha256(text) FROM documents d WHERE NOT EXISTS (FROM labels l WHERE l.doc_id = d.doc_id)")
def train_test_overlap(spark, sf_dir):
    d, known = docs(spark, sf_dir), table(spark, sf_dir, "labels").select("doc_id")
    return dedup.overlap(d.join(known, "doc_id", "left_semi"), d.join(known, "doc_id", "left_anti"), "sha")


@query("SELECT doc_id, item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)")
def contamination_containment(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("needle"))
    return dedup.contained(table(spark, sf_dir, "documents").select("doc_id", "text"), items, "text", "needle").select("doc_id", "item_id")


@query("""WITH k AS (SELECT sha256(text) AS sha FROM documents JOIN labels USING (doc_id)), f AS (SELECT min(doc_id) AS doc_id FROM documents WHERE sha256(text) NOT IN (SELECT sha FROM k) GROUP BY sha256(text)) SELECT doc_id FROM f""")
def clean_supplement_anti(spark, sf_dir):
    d, known = docs(spark, sf_dir).select("doc_id", "sha"), table(spark, sf_dir, "labels").select("doc_id")
    return dedup.clean_supplement(d.join(known, "doc_id", "left_anti"), d.join(known, "doc_id", "left_semi"), "sha", "doc_id").select("doc_id")


@query("""WITH k AS (SELECT sha256(text) AS sha, max(source) AS source FROM documents JOIN labels USING (doc_id) GROUP BY 1)
SELECT k.source, count(*) AS n FROM documents d JOIN k ON k.sha = sha256(d.text) WHERE d.doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY k.source""")
def overlap_counts_by_split(spark, sf_dir):
    d, known = docs(spark, sf_dir), table(spark, sf_dir, "labels").select("doc_id")
    return dedup.overlap_counts(d.join(known, "doc_id", "left_anti").select("sha"), d.join(known, "doc_id", "left_semi"), "sha", "source")


GRID = """WITH w AS (SELECT doc_id, source, unnest(string_split_regex(lower(text), '\\s+')) AS w FROM documents
), g AS (SELECT doc_id, source, CAST(('0x' || md5(w)[1:4])::INT % 72 AS INT) AS cell FROM w WHERE w <> ''
), h AS (SELECT d.doc_id, d.source, c.t AS cell, count(g.cell) AS n FROM documents d CROSS JOIN range(72) c(t) LEFT JOIN g ON g.doc_id = d.doc_id AND g.cell = c.t GROUP BY ALL
), b AS (SELECT a.doc_id, a.source, sum(CASE WHEN a.n > z.n THEN 1::HUGEINT << CAST(63 - ((a.cell // 9) * 8 + a.cell % 9) AS INT) ELSE 0 END) AS u FROM h a JOIN h z ON z.doc_id = a.doc_id AND z.cell = a.cell + 1 WHERE a.cell % 9 < 8 GROUP BY ALL
), f AS MATERIALIZED (SELECT doc_id, source, CAST(CASE WHEN u >= 9223372036854775808::HUGEINT THEN u - 18446744073709551616::HUGEINT ELSE u END AS BIGINT) AS bits FROM b)"""


def _grid(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "source", hashing.gradient_bits(hashing.token_grid(F.col("text"))).alias("bits"))


@query(f"{GRID} SELECT doc_id, lower(lpad(to_hex(u), 16, '0')) AS dhash FROM b")
def token_grid_hash(spark, sf_dir):
    return _grid(spark, sf_dir).select("doc_id", hashing.hex16(F.col("bits")).alias("dhash"))


@query(f"{GRID}, k AS (SELECT bits, count(*) AS n FROM f GROUP BY bits) SELECT x.bits AS a, y.bits AS b, CAST(bit_count(xor(x.bits, y.bits)) AS INT) AS distance, CASE WHEN x.bits = y.bits THEN x.n * (x.n - 1) // 2 ELSE x.n * y.n END AS n_pairs FROM k x JOIN k y ON x.bits <= y.bits AND bit_count(xor(x.bits, y.bits)) <= 5 WHERE x.bits <> y.bits OR x.n > 1")
def near_duplicate_pairs(spark, sf_dir):
    return dedup.hamming_pairs(_grid(spark, sf_dir), "bits", 5)


@query(f"{GRID} SELECT x.source AS side_a, y.source AS side_b, count(*) AS n FROM f x JOIN f y ON x.source < y.source AND bit_count(xor(x.bits, y.bits)) <= 5 GROUP BY ALL")
def near_duplicate_candidate_count(spark, sf_dir):
    pairs = dedup.hamming_pairs(_grid(spark, sf_dir), "bits", 5, side="source")
    return pairs.groupBy("side_a", "side_b").agg(F.sum("n_pairs").alias("n"))


# --- the row contract ------------------------------------------------------------------------------------------------


def _manifest(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    path = F.regexp_replace("url", "^https?://", "")
    return p.select(F.col("page_id").alias("line"), path.alias("path"), F.when(F.col("page_id") % 7 == 0, "").otherwise(F.char(65 + F.col("page_id") % 28)).alias("label"), F.when(F.col("page_id") % 11 == 0, "dev").otherwise("train").alias("split"), hashing.digest("html").alias("sha256"), F.substring(F.md5("html"), 1, 16).alias("dhash"))


@query("""WITH m AS (SELECT page_id AS line, regexp_replace(url, '^https?://', '') AS path, CASE WHEN page_id % 7 = 0 THEN '' ELSE chr(CAST(65 + page_id % 28 AS INT)) END AS label, CASE WHEN page_id % 11 = 0 THEN 'dev' ELSE 'train' END AS split FROM pages
), k AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY line) AS again FROM m)
SELECT * FROM (SELECT line, CASE WHEN path = '' OR label = '' THEN 'empty_field'
  WHEN starts_with(path, '/') OR contains(path, '\\') OR len(list_filter(string_split(path, '/'), lambda x: x IN ('', '.', '..'))) > 0 THEN 'unsafe_path'
  WHEN NOT (label BETWEEN 'A' AND 'Z' AND length(label) = 1) THEN 'unknown_label' WHEN split NOT IN ('train', 'validation', 'test', 'external') THEN 'unknown_split' WHEN again > 1 THEN 'repeated_path' END AS rule FROM k) WHERE rule IS NOT NULL""")
def manifest_violations(spark, sf_dir):
    return validate.violations(_manifest(spark, sf_dir))


@query("SELECT page_id FROM (SELECT page_id, row_number() OVER (PARTITION BY regexp_extract(url, '^https?://[^/]+') ORDER BY page_id) AS n FROM pages) WHERE n > 1")
def duplicate_path_rows(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "^https?://[^/]+", 0).alias("host"))
    return validate.repeated_paths(rows, "host", "page_id").select("page_id")


@query("SELECT url AS path, CASE WHEN page_id % 5 = 0 THEN 'missing' ELSE 'changed' END AS status FROM pages WHERE page_id % 5 = 0 OR page_id % 3 = 0")
def bytes_changed(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    manifest = p.select("page_id", F.col("url").alias("path"), hashing.digest("html").alias("sha256"))
    files = p.where("page_id % 5 <> 0").select("page_id", hashing.digest(F.when(F.col("page_id") % 3 == 0, F.concat("html", F.lit(" "))).otherwise(F.col("html"))).alias("actual"))
    return validate.changed_content(manifest, files, key="page_id")  # several pages share a URL


@query("SELECT CAST(t AS INT) AS label FROM range(26) r(t) WHERE t NOT IN (SELECT label FROM embeddings)")
def empty_class_check(spark, sf_dir):
    return validate.empty_classes(table(spark, sf_dir, "embeddings"), "label", spark.range(26).select(F.col("id").cast("int").alias("label")))


@query("""WITH p AS (SELECT doc_id, list_value('data/Train/x', 'Valid/test-set/x', 'a/TESTING/b/x', 'val/train/x', 'none/x', 'train')[CAST(doc_id % 6 + 1 AS INT)] AS path FROM documents)
SELECT doc_id, list_value('train', 'validation', 'test', 'train', NULL, NULL)[CAST(doc_id % 6 + 1 AS INT)] AS role FROM p""")
def role_inference(spark, sf_dir):
    paths = F.array(*map(F.lit, ("data/Train/x", "Valid/test-set/x", "a/TESTING/b/x", "val/train/x", "none/x", "train")))
    d = table(spark, sf_dir, "documents").select("doc_id", F.get(paths, (F.col("doc_id") % 6).cast("int")).alias("path"))
    return d.select("doc_id", validate.role_of(F.col("path")).alias("role"))


@query("SELECT count(*) AS n_rows, count(*) FILTER (WHERE event_type <> 'click') AS n_violations FROM events")
def wrong_split_count(spark, sf_dir):
    return validate.wrong_split(table(spark, sf_dir, "events").select(F.col("event_type").alias("split")), "click")


# --- detection, latency, selection ------------------------------------------------------------------------------------


@query("""WITH d AS (SELECT quality IS NOT NULL AS seen, coalesce(quality = 1, FALSE) AS ok FROM documents LEFT JOIN labels USING (doc_id))
SELECT count(*) AS considered, count(*) FILTER (WHERE seen) AS detected, round(avg(seen::INT), 6) AS detection_rate, round(count(*) FILTER (WHERE ok) / count(*) FILTER (WHERE seen), 6) AS accuracy_detected, round(avg(ok::INT), 6) AS accuracy_over_all FROM d""")
def detection_aware_accuracy(spark, sf_dir):
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return rounded(metrics.detection_aware(d, F.col("quality").isNotNull(), F.coalesce(F.col("quality") == 1, F.lit(False))))


@query("SELECT lang AS class, count(*) AS n_missed FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY lang")
def missed_per_class(spark, sf_dir):
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return metrics.missed_per_class(d, "lang", F.col("quality").isNotNull())


@query("SELECT round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, count(value) AS n FROM events")
def latency_percentiles(spark, sf_dir):
    return rounded(metrics.percentiles(table(spark, sf_dir, "events"), "value", {"p50": 0.5, "p95": 0.95}))


HISTORY = "h AS (SELECT o_orderpriority AS run, CAST(year(o_orderdate) * 12 + month(o_orderdate) AS INT) AS epoch, round(avg(o_totalprice), 2) AS loss FROM orders GROUP BY ALL)"


def _history(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.groupBy(F.col("o_orderpriority").alias("run"), (F.year("o_orderdate") * 12 + F.month("o_orderdate")).alias("epoch")).agg(F.round(F.avg("o_totalprice"), 2).alias("loss"))


@query(f"WITH {HISTORY} SELECT run, arg_min(epoch, (loss, epoch)) AS best_epoch, min(loss) AS best_loss FROM h GROUP BY run")
def best_epoch(spark, sf_dir):
    return selection.best_epoch(_history(spark, sf_dir), ["run"], "epoch", "loss")


@query(f"""WITH {HISTORY}, a AS (SELECT *, row_number() OVER w AS n, min(loss) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS low FROM h WINDOW w AS (PARTITION BY run ORDER BY epoch)
), b AS (SELECT *, coalesce(loss < low, TRUE) AS improved FROM a), c AS (SELECT *, n - max(CASE WHEN improved THEN n END) OVER (PARTITION BY run ORDER BY epoch ROWS UNBOUNDED PRECEDING) AS stale FROM b
), s AS (SELECT run, min(n) AS stop FROM c WHERE stale >= 5 GROUP BY run)
SELECT run, epoch, loss, improved, CAST(stale AS INT) AS stale FROM c LEFT JOIN s USING (run) WHERE stop IS NULL OR n <= stop""")
def early_stopping(spark, sf_dir):
    return selection.early_stopping(_history(spark, sf_dir), ["run"], "epoch", "loss", 5)


@query("""WITH r AS (SELECT l_returnflag || l_linestatus AS run, round(avg(l_discount), 6) AS score, count(*) AS parameters FROM lineitem GROUP BY 1)
SELECT run, score, parameters, CAST(row_number() OVER (ORDER BY score DESC, parameters, run) AS INT) AS rank, printf('%.2f%%', score * 100) AS text FROM r""")
def rank_runs(spark, sf_dir):
    runs = table(spark, sf_dir, "lineitem").groupBy(F.concat("l_returnflag", "l_linestatus").alias("run")).agg(F.round(F.avg("l_discount"), 6).alias("score"), F.count("*").alias("parameters"))
    return selection.rank_runs(runs, "score", [F.col("parameters"), F.col("run")]).withColumn("text", selection.percent(F.col("score")))


# --- geometry, layers, registries -------------------------------------------------------------------------------------

POINTS = """n AS (SELECT vec_id, list_transform(range(21), lambda i: [embedding[3 * i + 1]::DOUBLE * CASE WHEN label % 2 = 0 THEN -1 ELSE 1 END, embedding[3 * i + 2]::DOUBLE, embedding[3 * i + 3]::DOUBLE]) AS s FROM embeddings
), m AS (SELECT vec_id, list_transform(s, lambda p: [p[1] - s[1][1], p[2] - s[1][2], p[3] - s[1][3]]) AS m FROM n
), d AS (SELECT vec_id, m, list_max(list_transform(m, lambda p: sqrt(p[1] * p[1] + p[2] * p[2] + p[3] * p[3]))) AS span FROM m
), e AS (SELECT vec_id, list_transform(m, lambda p: [p[1] / span, p[2] / span, p[3] / span]) AS e FROM d
), r AS (SELECT vec_id, e, e[10][1] AS x, e[10][2] AS y, sqrt(e[10][1] ** 2 + e[10][2] ** 2) AS g FROM e
), c AS (SELECT vec_id, list_transform(e, lambda p: [-y / g * p[1] + x / g * p[2], -x / g * p[1] - y / g * p[2], p[3]]) AS c FROM r)"""
_d = lambda a, b: f"sqrt((c[{a + 1}][1] - c[{b + 1}][1]) ** 2 + (c[{a + 1}][2] - c[{b + 1}][2]) ** 2 + (c[{a + 1}][3] - c[{b + 1}][3]) ** 2)"
_pairs = [(4, 0), (8, 0), (12, 0), (16, 0), (20, 0), (8, 4), (12, 4), (16, 4), (20, 4), (8, 12), (12, 16), (16, 20), (8, 5), (12, 9), (16, 13), (20, 17)]


@query(f"WITH {POINTS}, f AS (SELECT vec_id, list_concat(flatten(c), [{', '.join(_d(a, b) for a, b in _pairs)}]) AS f FROM c) SELECT vec_id, CAST(generate_subscripts(f, 1) - 1 AS INT) AS pos, round(unnest(f), 6) + 0.0 AS value FROM f")
def landmark_features(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", landmarks.features(landmarks.points_of(F.col("embedding")), F.when(F.col("label") % 2 == 0, " Left").otherwise("Right")).alias("f"))
    return rows.select("vec_id", F.posexplode("f").alias("pos", "value")).select("vec_id", "pos", (F.round("value", 6) + 0.0).alias("value"))


@query("""WITH n AS (SELECT vec_id, list_transform(range(21), lambda i: [embedding[3 * i + 1]::DOUBLE, embedding[3 * i + 2]::DOUBLE]) AS p FROM embeddings
), f AS (SELECT vec_id, p, list_transform(p, lambda q: q[1]) AS x, list_transform(p, lambda q: q[2]) AS y, list_transform([5, 9, 13, 17, 21], lambda i: sqrt((p[i][1] - p[1][1]) ** 2 + (p[i][2] - p[1][2]) ** 2)) AS l FROM n)
SELECT vec_id, round(list_max(x) - list_min(x), 6) AS width, round(list_max(y) - list_min(y), 6) AS height, round(l[1], 6) AS thumb,
  round(degrees(acos(greatest(-1.0::DOUBLE, least(1.0::DOUBLE, ((p[5][1] - p[1][1]) * (p[9][1] - p[1][1]) + (p[5][2] - p[1][2]) * (p[9][2] - p[1][2])) / (l[1] * l[2]))))), 5) AS angle FROM f""")
def hand_box_features(spark, sf_dir):
    f = F.col("f")
    rows = table(spark, sf_dir, "embeddings").select("vec_id", landmarks.minimal_features(landmarks.points_of(F.col("embedding"))).alias("f"))
    return rows.select("vec_id", F.round(f[0], 6).alias("width"), F.round(f[1], 6).alias("height"), F.round(f[2], 6).alias("thumb"), F.round(f[7], 5).alias("angle"))


@query("""WITH n AS (SELECT vec_id, list_transform(range(21), lambda i: (embedding[3 * i + 1]::DOUBLE + 4) / 8 * 640) AS x, list_transform(range(21), lambda i: (embedding[3 * i + 2]::DOUBLE + 4) / 8 * 480) AS y FROM embeddings
), b AS (SELECT vec_id, (list_max(x) + list_min(x)) / 2 AS cx, (list_max(y) + list_min(y)) / 2 AS cy, greatest(list_max(x) - list_min(x), list_max(y) - list_min(y)) * 1.25::DOUBLE / 2 AS h FROM n)
SELECT vec_id, greatest(0, trunc(cx - h)::INT) AS "left", greatest(0, trunc(cy - h)::INT) AS top, least(640, trunc(cx + h)::INT) AS "right", least(480, trunc(cy + h)::INT) AS bottom FROM b""")
def crop_box(spark, sf_dir):
    shares = F.transform(landmarks.points_of(F.col("embedding")), lambda p: F.transform(p, lambda v: (v + 4) / 8))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", landmarks.crop_box(shares, F.lit(640), F.lit(480), 0.25).alias("box"))
    return rows.select("vec_id", "box.*")


@query("""WITH p AS (SELECT vec_id, list_transform(range(21), lambda i: [embedding[3 * i + 1]::DOUBLE, embedding[3 * i + 2]::DOUBLE]) AS p FROM embeddings
), f AS (SELECT vec_id, list_concat(flatten(p), list_transform([9, 13, 17, 21], lambda i: sqrt((p[i][1] - p[1][1]) ** 2 + (p[i][2] - p[1][2]) ** 2))) AS f FROM p)
SELECT vec_id, CAST(generate_subscripts(f, 1) - 1 AS INT) AS pos, round(unnest(f), 6) + 0.0 AS value FROM f""")
def plane_features(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.concat(landmarks.plane_points(F.col("embedding")), landmarks.wrist_to_tips(F.col("embedding"))).alias("f"))
    return rows.select("vec_id", F.posexplode("f").alias("pos", "value")).select("vec_id", "pos", (F.round("value", 6) + 0.0).alias("value"))


@query("SELECT doc_id FROM documents ORDER BY doc_id LIMIT 200")
def first_200(spark, sf_dir):
    return sampling.first_rows(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 200)


@query("SELECT doc_id, lang FROM documents WHERE lang IN ('en', 'de')")
def known_classes(spark, sf_dir):
    return validate.known_classes(table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", ["en", "de"])


@query("""SELECT n_name, CAST(CASE WHEN n_name[1] IN ('A', 'B', 'C', 'E', 'H', 'M', 'N', 'O', 'S', 'T') THEN 0 WHEN n_name[1] IN ('D', 'I', 'J', 'X', 'Z') THEN 1
  WHEN n_name[1] IN ('G', 'K', 'L', 'P', 'Q', 'R', 'U', 'V', 'Y') THEN 2 WHEN n_name[1] IN ('F', 'W') THEN 3 END AS INT) AS shape_group FROM nation""")
def shape_groups(spark, sf_dir):
    return table(spark, sf_dir, "nation").select("n_name", landmarks.shape_group(F.left("n_name", F.lit(1))).alias("shape_group"))


@query("SELECT p_partkey, CAST(k AS INT) AS k, CAST(round_even(k * (p_size + 7 - 1) / 7.0, 0) AS INT) AS channel FROM part CROSS JOIN range(8) r(k)")
def even_channels(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.posexplode(vectors.even_channels(F.col("p_size") + 7)).alias("k", "channel"))


@query("SELECT o_orderpriority AS run, max(o_totalprice) FILTER (WHERE o_orderstatus <> 'P') AS peak FROM orders WHERE o_orderpriority = (SELECT min(o_orderpriority) FROM orders) GROUP BY 1")
def peak_memory(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    first = o.join(o.agg(F.min("o_orderpriority").alias("o_orderpriority")), "o_orderpriority")
    run = first.agg(F.min("o_orderpriority").alias("run"))
    return run.join(metrics.peak(first.withColumn("seen", F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice"))), "seen"))


@query("""SELECT l_linenumber, count(*) FILTER (WHERE l_quantity > 10) AS scored, count(*) FILTER (WHERE l_quantity > 10 AND l_returnflag = 'N') AS correct,
  round(count(*) FILTER (WHERE l_quantity > 10 AND l_returnflag = 'N') / (SELECT count(*) FROM orders), 9) AS accuracy_over_all_images,
  round(count(*) FILTER (WHERE l_quantity > 10 AND l_returnflag = 'N') / nullif(count(*) FILTER (WHERE l_quantity > 10), 0), 9) AS accuracy_where_detected FROM lineitem GROUP BY l_linenumber""")
def accuracy_by_padding(spark, sf_dir):
    images = table(spark, sf_dir, "orders").count()
    return rounded(metrics.by_padding(table(spark, sf_dir, "lineitem"), "l_linenumber", F.col("l_quantity") > 10, F.col("l_returnflag") == "N", images), 9)


@query(f"WITH {SQL} SELECT vec_id, CASE WHEN label = prediction THEN 'correct' ELSE 'incorrect' END AS verdict FROM scored")
def verdicts(spark, sf_dir):
    return metrics.verdicts(scored(spark, sf_dir), "label", "prediction").select("vec_id", "verdict")


@query("""WITH k AS (SELECT DISTINCT lang, sha256(text) AS sha, CASE WHEN left(sha256(text), 1) < '3' THEN 'test' WHEN left(sha256(text), 1) < '6' THEN 'validation' ELSE 'train' END AS split FROM documents)
SELECT doc_id, k.split FROM documents d JOIN k ON k.lang = d.lang AND k.sha = sha256(d.text)""")
def source_partitions_split(spark, sf_dir):
    first = F.left("sha", F.lit(1))
    rows = docs(spark, sf_dir).withColumn("role", F.when(first < "3", "test").when(first < "6", "validation").otherwise("train"))
    return splits.layout_split(rows, ["train", "validation", "test"], "lang", "sha", [0.7, 0.15, 0.15], shared=True).select("doc_id", "split")


@query("""WITH g AS (SELECT lang, sha256(text) AS sha, count(*) AS size FROM documents GROUP BY 1, 2), t AS (SELECT * FROM g WHERE left(sha, 1) >= '3'
), k AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY sha256('42:' || lang || ':' || sha), sha) AS rn, count(*) OVER (PARTITION BY lang) AS groups, sum(size) OVER (PARTITION BY lang) AS n FROM t
), q AS (SELECT DISTINCT lang, n FROM k), a AS (SELECT lang, n, i, n * r AS want, floor(n * r) AS low FROM q CROSS JOIN (VALUES (0, 0.7::DOUBLE / (0.7::DOUBLE + 0.15::DOUBLE)), (1, 0.15::DOUBLE / (0.7::DOUBLE + 0.15::DOUBLE))) x(i, r)
), u AS (SELECT lang, i, CAST(low + (row_number() OVER (PARTITION BY lang ORDER BY low - want, i) <= n - sum(low) OVER (PARTITION BY lang))::INT AS BIGINT) AS target FROM a
), y AS (SELECT lang, max(target) FILTER (WHERE i = 0) AS t0, max(target) FILTER (WHERE i = 1) AS t1 FROM u GROUP BY lang
), w AS (SELECT lang, 0::BIGINT AS rn, NULL::VARCHAR AS sha, 0::BIGINT AS a0, 0::BIGINT AS a1, -1 AS pick FROM y
  UNION ALL SELECT lang, rn, sha, a0 + (pick = 0)::INT * size, a1 + (pick = 1)::INT * size, pick FROM (
    SELECT w.lang, k.rn, k.sha, k.size::BIGINT AS size, a0, a1, list_sort(list_filter([
      (2 * k.size * (a0 - t0) + k.size * k.size, a0 - t0, 0, a0 = 0), (2 * k.size * (a1 - t1) + k.size * k.size, a1 - t1, 1, a1 = 0)],
      lambda x: x[4] OR (a0 = 0)::INT + (a1 = 0)::INT <> k.groups - k.rn + 1))[1][3] AS pick
    FROM w JOIN y USING (lang) JOIN k ON k.lang = w.lang AND k.rn = w.rn + 1)
), placed AS (SELECT lang, sha, list_value('train', 'validation')[pick + 1] AS split FROM w WHERE rn > 0 UNION ALL SELECT lang, sha, 'test' FROM g WHERE left(sha, 1) < '3')
SELECT doc_id, split FROM documents d JOIN placed p ON p.lang = d.lang AND p.sha = sha256(d.text)""".replace("WITH g", "WITH RECURSIVE g", 1))
def renormalised_split(spark, sf_dir):
    rows = docs(spark, sf_dir).withColumn("role", F.when(F.left("sha", F.lit(1)) < "3", "test").otherwise("train"))
    return splits.layout_split(rows, ["train", "test"], "lang", "sha", [0.7, 0.15, 0.15], shared=True).select("doc_id", "split")


@query(f"""{GRID}, k AS (SELECT DISTINCT source AS side, bits FROM f), p AS (SELECT x.side AS side_a, y.side AS side_b, CAST(bit_count(xor(x.bits, y.bits)) AS INT) AS distance, x.bits AS a, y.bits AS b FROM k x JOIN k y ON x.side < y.side AND bit_count(xor(x.bits, y.bits)) <= 5)
SELECT side_a, side_b, distance, a, b, m.doc_id AS "left", n.doc_id AS "right" FROM p JOIN f m ON m.source = side_a AND m.bits = a JOIN f n ON n.source = side_b AND n.bits = b ORDER BY ALL LIMIT 100""")
def candidate_samples(spark, sf_dir):
    rows = settled(_grid(spark, sf_dir))
    return dedup.candidate_samples(rows, dedup.hamming_pairs(rows, "bits", 5, side="source"), "bits", "source", "doc_id")


@query("SELECT doc_id, trim(regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g')) AS text, '{\"a\":' || doc_id || ',\"b\":\"' || lang || '\"}' AS said FROM documents")
def flat_text(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", text.flat(F.col("text")).alias("text"), text.sorted_json(b=F.col("lang"), a=F.col("doc_id")).alias("said"))


@query("""SELECT p_partkey AS name, p_size AS length, CAST(coalesce(sum(p_size) OVER (ORDER BY p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM part""")
def tensor_offsets(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("name"), F.col("p_size").alias("length"))
    return running_offsets(p, "name", "length")


def running_offsets(rows: DataFrame, key: str, length: str, width: int = 4096) -> DataFrame:
    """Adds offset: the sum of length over all lower keys, first over ranges of keys and then within each. Ranges are as
    wide as it takes for there to be ranking.CHUNKS of them at most."""
    from pyspark.sql import Window

    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    low, high = rows.agg(F.min(key), F.max(key)).first()
    if low is not None:
        width = max(width, -(-(int(high) - int(low) + 1) // ranking.CHUNKS))
    rows = rows.withColumn("__chunk", F.floor((F.col(key) - F.lit(low)) / width))
    sums = rows.groupBy("__chunk").agg(F.sum(length).alias("__in"))
    sums = sums.select("__chunk", F.coalesce(F.sum("__in").over(before(Window.partitionBy(F.lit(0)).orderBy("__chunk"))), F.lit(0)).alias("__ahead"))
    own = F.coalesce(F.sum(length).over(before(Window.partitionBy("__chunk").orderBy(key))), F.lit(0))
    return rows.withColumn("__own", own).join(sums, "__chunk").withColumn("offset", F.col("__ahead") + F.col("__own")).drop("__chunk", "__own", "__ahead")


@query("SELECT CAST(sum(p_size * 3) AS BIGINT) AS n_parameters FROM part")
def parameter_count(spark, sf_dir):
    shapes = table(spark, sf_dir, "part").select(F.array("p_size", F.lit(3)).alias("shape"))
    return shapes.agg(F.sum(F.aggregate("shape", F.lit(1).cast("long"), lambda a, n: a * n)).alias("n_parameters"))


@query("SELECT DISTINCT p_size, p_brand FROM part")
def distinct_dimensions(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_size", "p_brand").distinct()


@query("SELECT lang, count(*) AS n FROM documents GROUP BY lang")
def class_distribution(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n")).orderBy("lang")


@query("SELECT doc_id, CAST(dense_rank() OVER (ORDER BY lang) - 1 AS INT) AS place FROM documents")
def string_index(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang")
    names = F.broadcast(d.agg(F.array_sort(F.collect_set("lang")).alias("names")))  # a label domain, not rows
    return d.join(names).select("doc_id", (F.array_position("names", F.col("lang")) - 1).cast("int").alias("place"))


_weights = [[((3 * i + 7 * j) % 11 - 5) / 10 for j in range(64)] for i in range(4)]


@query(f"""WITH l AS (SELECT vec_id, list_transform([{", ".join(f"list_dot_product(embedding::DOUBLE[], {w}::DOUBLE[]) + {0.1 * i}" for i, w in enumerate(_weights))}], lambda v, i: greatest(0.0::DOUBLE, (v - 0.05 * i) * ((1 + 0.1 * i) / sqrt(0.5 + i + 1e-5::DOUBLE)) + 0.2)) AS y FROM embeddings)
SELECT vec_id, round(y[1], 5) AS y0, round(y[2], 5) AS y1, round(y[3], 5) AS y2, round(y[4], 5) AS y3 FROM l""")
def linear_bn_relu(spark, sf_dir):
    at = [1, 2, 3, 4]
    x = vectors.linear(F.col("embedding"), _weights, [0.1 * i for i in range(4)])
    y = vectors.batch_norm_relu(x, vectors.vector([1 + 0.1 * i for i in at]), vectors.vector([0.2] * 4), vectors.vector([0.05 * i for i in at]), vectors.vector([0.5 + i for i in at]))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", y.alias("y"))
    return rows.select("vec_id", *(F.round(F.col("y")[i], 5).alias(f"y{i}") for i in range(4)))


_unit = lambda salt: f"((('0x' || md5('42:{salt}:' || vec_id || ':' || (k - 1))[1:10])::BIGINT + 1) / 1099511627777.0::DOUBLE)"


@query(f"""WITH e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS k FROM embeddings)
SELECT vec_id, CAST(k - 1 AS INT) AS pos, round(v + 0.01 * sqrt(-2 * ln({_unit(1)})) * cos(2 * pi() * {_unit(2)}), 6) + 0.0 AS value FROM e""")
def jitter(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", vectors.jitter(F.col("embedding").cast("array<double>"), 0.01, 42, F.col("vec_id")).alias("features"))
    return rows.select("vec_id", F.posexplode("features").alias("pos", "value")).select("vec_id", "pos", (F.round("value", 6) + 0.0).alias("value"))


@query("SELECT l_orderkey, l_linenumber, row_number() OVER (ORDER BY l_orderkey, l_linenumber) - 1 AS position FROM lineitem")
def row_positions(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    return ranking.by_range(rows, [], ["l_orderkey", "l_linenumber"], "position")


@query("SELECT o_orderpriority AS run, max(o_totalprice) FILTER (WHERE o_orderstatus <> 'P') AS peak FROM orders GROUP BY 1")
def peak_memory_by_run(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("run"), F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("seen"))
    return metrics.peaks(o, "run", "seen")


@query()
def halves_by_shuffle(spark, sf_dir):
    """Halves by Python's own shuffle; tests hold them against the shuffle itself."""
    rows = table(spark, sf_dir, "embeddings").select("label", F.format_string("v/%09d", "vec_id").alias("path"))
    return splits.shuffled_halves(rows, "label", "path")


# --- pictures: each embedding as 8 x 8 grey values ----------------------------------------------------------------------

PIXELS = "px AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS ij, CAST(greatest(0, least(255, floor(128.5 + 300 * unnest(embedding)::DOUBLE))) AS INT) AS v FROM embeddings)"


def _grey_pictures(spark, sf_dir):
    bytes_of = F.transform("embedding", lambda e: F.lpad(F.hex(F.greatest(F.lit(0), F.least(F.lit(255), F.floor(128.5 + 300 * e.cast("double")))).cast("long")), 2, "0"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.lit(8).alias("height"), F.lit(8).alias("width"), F.lit(1).alias("channels"), F.unhex(F.array_join(bytes_of, "")).alias("data"))
    return rows


def _grey_rows(rows, make):
    from ..operators import pictures

    made = pictures.map_pictures(rows, lambda x, r: make(x, r)[..., 0].ravel().astype(int).tolist(), "grey", "array<int>")
    return made.select("vec_id", F.posexplode("grey").alias("pos", "value"))


_brightness = "16 11 10 16 24 40 51 61 12 12 14 19 26 58 60 55 14 13 16 24 40 57 69 56 14 17 22 29 51 87 80 62 18 22 37 56 68 109 103 77 24 35 55 64 81 104 113 92 49 64 78 87 103 121 120 101 72 92 95 98 112 100 103 99"


@query(f"""WITH {PIXELS}, basis AS (
  SELECT u.t * 8 + v.t AS uv, i.t * 8 + j.t AS ij, (CASE WHEN u.t = 0 THEN sqrt(0.125::DOUBLE) ELSE 0.5::DOUBLE END) * cos((2 * i.t + 1) * u.t * pi() / 16) * (CASE WHEN v.t = 0 THEN sqrt(0.125::DOUBLE) ELSE 0.5::DOUBLE END) * cos((2 * j.t + 1) * v.t * pi() / 16) AS w
  FROM range(8) u(t), range(8) v(t), range(8) i(t), range(8) j(t)
), q AS (SELECT unnest(range(64)) AS uv, least(255, 2 * unnest([{_brightness.replace(" ", ", ")}])) AS q
), f AS (SELECT vec_id, uv, round(round(sum((v - 128) * w), 9) / any_value(q), 9) AS f, any_value(q) AS q FROM px JOIN basis USING (ij) JOIN q USING (uv) GROUP BY vec_id, uv
), k AS (SELECT vec_id, uv, sign(f) * floor(abs(f) + 0.5) * q AS k FROM f)
SELECT vec_id, CAST(ij AS INT) AS pos, CAST(greatest(0, least(255, round(sum(k * w) + 128))) AS INT) AS value FROM k JOIN basis USING (uv) GROUP BY vec_id, ij""")
def jpeg_blocks(spark, sf_dir):
    from ..functions import pixels

    return _grey_rows(_grey_pictures(spark, sf_dir), lambda x, _: pixels.corrupt(x, "jpeg_q25", 0))


@query(f"""WITH {PIXELS}, t AS (SELECT vec_id, (vec_id % 8 + 1)::INT AS how, ij // 8 AS i, ij % 8 AS j, v FROM px)
SELECT vec_id, CAST(CASE how WHEN 1 THEN i * 8 + j WHEN 2 THEN i * 8 + 7 - j WHEN 3 THEN (7 - i) * 8 + 7 - j WHEN 4 THEN (7 - i) * 8 + j
  WHEN 5 THEN j * 8 + i WHEN 6 THEN j * 8 + 7 - i WHEN 7 THEN (7 - j) * 8 + 7 - i ELSE (7 - j) * 8 + i END AS INT) AS pos, v AS value FROM t""")
def upright_pictures(spark, sf_dir):
    from ..functions import jpeg

    return _grey_rows(_grey_pictures(spark, sf_dir), lambda x, r: jpeg.turned(x, int(r.vec_id) % 8 + 1))


@query(f"""WITH {PIXELS}, g AS (SELECT vec_id, ij // 8 AS i, ij % 8 AS j, v FROM px
), s AS (SELECT vec_id, i, j, CASE WHEN vec_id % 2 = 0 THEN j ELSE 7 - j END AS x, i AS y FROM g
), m AS (SELECT s.vec_id, s.i, s.j, coalesce(a.v, 0) AS v FROM s LEFT JOIN g a ON a.vec_id = s.vec_id AND a.i = s.y - 1 AND a.j = CASE WHEN s.vec_id % 2 = 0 THEN s.j - 2 ELSE 7 - (s.j - 2) END AND s.j >= 2)
SELECT vec_id, CAST(i * 8 + j AS INT) AS pos, CAST(greatest(0, least(255, round_even(v * 1.25, 0))) AS INT) AS value FROM m""")
def augmented_pictures(spark, sf_dir):
    """Every second picture mirrored, then all moved by two places right and one down, and a quarter brighter."""
    from ..functions import augment

    return _grey_rows(_grey_pictures(spark, sf_dir), lambda x, r: augment.applied(x, ([("flip",)] if r.vec_id % 2 else []) + [("affine", 0, 2, 1, 1, 0, 0), ("brightness", 1.25)]))


# --- learners ---------------------------------------------------------------------------------------------------------

_fourier = vectors.fourier_plan(64, 6, 0.5)


@query(f"""WITH z AS (SELECT vec_id, [{", ".join(f"cos(list_dot_product(embedding::DOUBLE[], {p['w']}::DOUBLE[]) + {p['b']!r}::DOUBLE)" for p in _fourier)}] AS z FROM embeddings)
SELECT vec_id, CAST(generate_subscripts(z, 1) - 1 AS INT) AS pos, round(unnest(z) * sqrt(2 / 6.0::DOUBLE), 6) + 0.0 AS value FROM z""")
def fourier_features(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(vectors.fourier_features(F.col("embedding"), _fourier)).alias("pos", "value"))
    return rows.select("vec_id", "pos", (F.round("value", 6) + 0.0).alias("value"))


@query("""SELECT learner, count(*) FILTER (WHERE NOT held_out) AS n_train, count(*) FILTER (WHERE held_out) AS n_held_out, true AS beats_centroid
FROM (SELECT left(sha256('held:' || vec_id), 1) < '5' AS held_out FROM embeddings), (VALUES ('kernel machine'), ('network')) l(learner) GROUP BY learner""")
def learners_held_out(spark, sf_dir):
    """Whether two values have the same sign, which no straight line tells: the kernel machine and the network against the
    nearest centroid, each judged on the rows that none of them has seen."""
    from ..operators import network, training
    from ..sources.scratch import settled

    x = F.transform(F.slice("embedding", 1, 2), lambda v: v.cast("double") * 8)
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("id"), x.alias("x"))
    rows = rows.withColumn("label", (F.col("x")[0] * F.col("x")[1] > 0).cast("int")).withColumn("held_out", F.left(F.sha2(F.concat(F.lit("held:"), "id"), 256), F.lit(1)) < "5")
    rows = settled(rows)
    train, held = rows.where("NOT held_out"), rows.where("held_out")
    machine = training.rbf_svc(train, "x", "label", n=64, rounds=10)
    settings = network.Settings(epochs=50, batch=64, rate=5e-2, hidden=(16, 8), dropout=0.0, jitter=0.0, patience=50)
    fitted = network.fit(train, train, "id", "x", "label", settings)
    places = [F.avg(F.col("x")[k]) for k in range(2)]
    centres = {r.label: (r.a, r.b) for r in train.groupBy("label").agg(places[0].alias("a"), places[1].alias("b")).collect()}  # two rows
    away = {c: F.pow(F.col("x")[0] - a, 2) + F.pow(F.col("x")[1] - b, 2) for c, (a, b) in centres.items()}
    nearest = held.withColumn("prediction", F.when(away[0] <= away[1], 0).otherwise(1))
    right = lambda df: df.select(F.avg((F.col("prediction") == F.col("label")).cast("double")))
    told = {"kernel machine": machine.apply(held, "x"), "network": network.predict(held, fitted, "x")}
    low = right(nearest).first()[0]
    found = [(name, right(df).first()[0] > low) for name, df in told.items()]
    counts = rows.agg(F.count_if("held_out").alias("n_held_out"), F.count_if(~F.col("held_out")).alias("n_train"))
    return counts.withColumn("l", F.explode(F.array(*(F.struct(F.lit(n).alias("learner"), F.lit(b).alias("beats_centroid")) for n, b in found)))).select("l.learner", "n_train", "n_held_out", "l.beats_centroid")


# --- sets ---------------------------------------------------------------------------------------------------------------


@query("SELECT count(*) AS n FROM (SELECT sha256(text) AS sha FROM documents WHERE text IS NOT NULL UNION SELECT sha256(html) FROM pages WHERE html IS NOT NULL)")
def digest_union(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select(hashing.digest("html").alias("sha"))
    return docs(spark, sf_dir).select("sha").union(pages).where("sha IS NOT NULL").distinct().agg(F.count("*").alias("n"))


@query("SELECT array_to_string(list_sort(list(DISTINCT event_type)), ',') AS kinds, bool_and(event_type IN ('click', 'view', 'purchase', 'signup', 'error')) AS all_known FROM events")
def distinct_values(spark, sf_dir):
    kinds = F.sort_array(F.collect_set("event_type"))
    known = F.array(*map(F.lit, ("click", "view", "purchase", "signup", "error")))
    return table(spark, sf_dir, "events").agg(F.array_join(kinds, ",").alias("kinds"), (F.size(F.array_except(kinds, known)) == 0).alias("all_known"))


# --- written in SQL alone -------------------------------------------------------------------------------------------------


@query(ORACLE_SQL["token_grid_hash"])
def sql_token_grid(spark, sf_dir):
    sqlnames.register(spark)
    return spark.sql(f"SELECT doc_id, hex16(gradient_bits(token_grid(text))) AS dhash FROM parquet.`{sf_dir}/documents.parquet`")


@query(ORACLE_SQL["landmark_features"])
def sql_landmark_features(spark, sf_dir):
    sqlnames.register(spark)
    features = "landmark_features(points_of(embedding), if(label % 2 = 0, ' Left', 'Right'))"
    return spark.sql(f"""
        WITH f AS (SELECT vec_id, {features} AS f FROM parquet.`{sf_dir}/embeddings.parquet`), v AS (SELECT vec_id, posexplode(f) AS (pos, value) FROM f)
        SELECT vec_id, pos, round(value, 6) + 0D AS value FROM v""")


@query("""SELECT vec_id, CAST(rank AS INT) AS rank, CAST(place AS INT) AS place, round(value, 6) AS value FROM (
  SELECT vec_id, place, value, row_number() OVER (PARTITION BY vec_id ORDER BY value DESC, place) AS rank
  FROM (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS place, unnest(embedding)::DOUBLE AS value FROM embeddings)) WHERE rank <= 3""")
def sql_top_k(spark, sf_dir):
    sqlnames.register(spark)
    return spark.sql(f"SELECT vec_id, t.rank, t.place, round(t.value, 6) AS value FROM parquet.`{sf_dir}/embeddings.parquet`, LATERAL top_k(cast(embedding AS ARRAY<DOUBLE>), 3) AS t")


@query()
def ml_random_forest(spark, sf_dir):
    from ..operators import training

    rows = table(spark, sf_dir, "embeddings")
    return training.apply(training.forest(rows, "embedding", "label"), rows, "embedding").select("vec_id", "label", "prediction")


_mlp = [[[((3 * i + 7 * j + n) % 11 - 5) / 10 for j in range(a)] for i in range(b)] for n, (a, b) in enumerate(((64, 12), (12, 8), (8, 10)))]
_layer = lambda n, x: f"[{', '.join(f'list_dot_product({x}, {w}::DOUBLE[]) + {0.1 * i}' for i, w in enumerate(_mlp[n]))}]"
_positive = lambda x: f"list_transform({x}, lambda v, i: greatest(0.0::DOUBLE, (v - 0.05 * i) / sqrt(0.5 + i + 1e-5::DOUBLE) * (1 + 0.1 * i) + 0.2))"


@query(f"""WITH a AS (SELECT vec_id, {_positive(_layer(0, 'embedding::DOUBLE[]'))} AS x FROM embeddings), b AS (SELECT vec_id, {_positive(_layer(1, 'x'))} AS x FROM a), c AS (SELECT vec_id, {_layer(2, 'x')} AS x FROM b)
SELECT vec_id, CAST(generate_subscripts(x, 1) - 1 AS INT) AS pos, round(unnest(x), 5) + 0.0 AS logit FROM c""")
def mlp_forward(spark, sf_dir):
    import numpy as np

    from ..operators import pictures

    model = pictures.Mlp((64, 12, 8, 10))
    model.layers = [(np.array(w), 0.1 * np.arange(len(w))) for w in _mlp]
    at = [np.arange(1, len(w) + 1) for w in _mlp[:2]]
    model.norms = [(1 + 0.1 * i, np.full(len(i), 0.2), 0.05 * i, 0.5 + i) for i in at]
    out = pictures.feature_logits(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "embedding", model)
    return out.select("vec_id", F.posexplode("logits").alias("pos", "logit")).select("vec_id", "pos", (F.round("logit", 5) + 0.0).alias("logit"))

