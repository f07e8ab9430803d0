"""Preparation of manifests from folders of pictures, and of what supplements them."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions import hashing
from ..operators import dedup, metrics, pictures, ranking, splits, validate
from . import manifest
from .scratch import settled

SPLITS = ("train", "validation", "test")


def records(spark: SparkSession, root: str, found: DataFrame) -> DataFrame:
    """path, label, role, sha256, bits (of the picture's difference hash) and dhash of the pictures of found below root.
    A picture that can't be decoded is an error, as are files that are not there."""
    printed = manifest.fingerprinted(spark, found, root)
    name = lambda c: F.regexp_replace(c, "^file:/+", "file:/")
    hashed = pictures.with_dhash(pictures.read(spark, root)).select(name("path").alias("__path"), F.col("dhash").alias("bits"))
    rows = printed.join(hashed, name("full_path") == F.col("__path"), "left")
    bad = rows.where(F.col("bits").isNull()).agg(F.min("path")).first()[0]
    if bad is not None:
        raise manifest.LayoutError(f"no picture: {bad}")
    return rows.select("path", "label", "role", "sha256", "bits", hashing.hex16(F.col("bits")).alias("dhash"))


def duplicate_report(rows: DataFrame, threshold: int = 5, samples: int = 100) -> dict:
    """What is alike in rows (path, label, split, sha256, bits): contents that stand in two splits are an error; copies,
    and pairs of fingerprints across splits within the threshold, are counted, and samples of the latter listed."""
    dedup.refuse_spanning(rows, "sha256", "split", "one content in two splits")
    copies = dedup.duplicate_summary(rows, "sha256").first()
    pairs = dedup.hamming_pairs(rows, "bits", threshold, side="split")
    listed = dedup.candidate_samples(rows, pairs, "bits", "split", "path", samples)
    labels = rows.select(F.col("path"), F.col("label"))
    listed = listed.join(labels.toDF("left", "left_label"), "left").join(labels.toDF("right", "right_label"), "right")
    listed = listed.orderBy("side_a", "side_b", "distance", "left", "right").collect()  # samples rows at most
    #: The names of the report's fields.
    return {
        "exact_cross_split_duplicates": 0,
        "exact_duplicate_group_count": copies.n_groups,
        "exact_duplicate_extra_image_count": copies.n_extra,
        "near_duplicate_threshold": threshold,
        "perceptual_cross_split_candidate_count": pairs.agg(F.coalesce(F.sum("n_pairs"), F.lit(0))).first()[0],
        "perceptual_candidate_samples": [{"left_path": r.left, "left_split": r.side_a, "left_label": r.left_label, "right_path": r.right, "right_split": r.side_b, "right_label": r.right_label, "hamming_distance": r.distance} for r in listed],
    }


def _counted(cells: dict) -> dict:
    """counts() from {(split, label): n}."""
    per_class: dict = {}
    for (split, label), n in sorted(cells.items()):
        if n:
            per_class.setdefault(split, {})[label] = n
    per_split = {split: sum(own.values()) for split, own in per_class.items()}
    total = sum(per_split.values())
    return {"counts": {"total": total, "per_split": per_split, "per_class_by_split": per_class}, "actual_ratios": {s: n / total for s, n in per_split.items()}}


def counts(rows: DataFrame) -> dict:
    """How many rows each split and each class of it has, and each split's share."""
    cells = metrics.counts_by_split(rows, "split", "label").collect()  # one row for each split and class
    return _counted({(r.split, r.label): r.n for r in cells if r.split is not None and r.label is not None})


def counting(rows: DataFrame, labels: Sequence[str], names: Sequence[str] = SPLITS) -> tuple[DataFrame, Callable[[], dict]]:
    """rows, and what gives counts() of them once they have been written: they are counted while they pass, so that no
    further reading is needed. labels and names are all classes and splits there can be."""
    seen, cells = Observation(), [(s, c) for s in names for c in labels]
    watched = rows.observe(seen, *(F.count_if((F.col("split") == s) & (F.col("label") == c)).alias(f"n{k}") for k, (s, c) in enumerate(cells)))
    return watched, lambda: _counted({cell: seen.get[f"n{k}"] for k, cell in enumerate(cells)})


def manifests(spark: SparkSession, root: str, out: str, seed: int = 42, ratios: Sequence[float] = (0.7, 0.15, 0.15), threshold: int = 5, labels: Sequence[str] = validate.LABELS) -> dict:
    """Finds the pictures below root, splits them by the layout of their folders, and writes below out one manifest for
    each split, the report of duplicates and the metadata. Returns the metadata."""
    ratios = splits.check_ratios(ratios)
    if isinstance(seed, bool) or not isinstance(seed, int) or seed < 0:
        raise ValueError("seed must be a whole number, not negative")
    if isinstance(threshold, bool) or not isinstance(threshold, int) or not 0 <= threshold <= 5:
        raise ValueError("threshold must be a whole number from 0 to 5")
    found = manifest.images(manifest.files(spark, root), labels)
    roots = manifest.choose_roots(manifest.class_roots(found, labels))
    own = F.broadcast(spark.createDataFrame([(r, role) for role, r in roots.items()], "class_root string, chosen string"))  # three at most
    rows = records(spark, root, found.join(own, "class_root").withColumn("role", F.col("chosen")).drop("chosen"))
    # Pictures are read and decoded once; all that follows reads the table.
    rows.write.mode("errorifexists").parquet(f"{out}/records.parquet")
    rows = spark.read.parquet(f"{out}/records.parquet")
    dealt, counted = counting(splits.layout_split(rows, list(roots), "label", "sha256", ratios, seed), labels)
    dealt.write.mode("errorifexists").parquet(f"{out}/splits.parquet")
    dealt = spark.read.parquet(f"{out}/splits.parquet")
    report = duplicate_report(dealt, threshold)
    for name in SPLITS:
        manifest.write_manifest(dealt.where(F.col("split") == name), f"{out}/{name}.csv")
    manifest.write_json(spark, f"{out}/duplicate_report.json", report)
    digest = lambda name: manifest_digest(dealt.where(F.col("split") == name))
    metadata = {"schema_version": 1, "source_root": root, "layout": "pooled" if "pooled" in roots else "source_partitions", "class_names": list(labels), "seed": seed}
    metadata |= {"ratios": dict(zip(SPLITS, ratios, strict=True)), "source_class_roots": {role: r or "." for role, r in roots.items()}, "manifest_digest": {s: digest(s) for s in SPLITS}} | counted()
    manifest.write_json(spark, f"{out}/metadata.json", metadata)
    return metadata


def manifest_digest(rows: DataFrame) -> str:
    """A digest of a manifest's rows, whatever their order and number."""
    from ..operators.sampling import tree_digest

    return tree_digest(rows, F.concat_ws(",", *validate.FIELDS)).first().digest


def external_manifest(spark: SparkSession, root: str, out: str, labels: Sequence[str] = validate.LABELS) -> DataFrame:
    """Writes the manifest of an outside dataset, all of whose rows are of the split external."""
    found = manifest.images(manifest.files(spark, root), labels)
    chosen = manifest.choose_external_root(manifest.class_roots(found, labels))
    rows = records(spark, root, found.where(F.col("class_root") == chosen)).withColumn("split", F.lit("external"))
    manifest.write_manifest(rows, out)
    return manifest.read_manifest(spark, out, labels=labels)


def supplement(listed: DataFrame, known: DataFrame, labels: Sequence[str] = validate.LABELS, allow_overlap: bool = False) -> DataFrame:
    """path, label, sha256, new_path of the files that a supplement takes over.

    listed: path (below the source), sha256. A class's folder is found whatever its case, the first by name; only files
    that lie in it directly count. Contents of known (sha256) are left out unless allow_overlap, later files of a content
    too (classes in their order, then by path); the others are numbered within their class by name. A class without a
    folder or without files is an error."""
    places = listed.withColumn("__parts", F.split("path", "/")).where((F.size("__parts") == 2) & validate.has_image_extension(F.col("path")))
    kinds = F.broadcast(listed.sparkSession.createDataFrame([(x, x.lower(), k) for k, x in enumerate(labels)], "label string, __lower string, __class int"))
    named = places.withColumn("__folder", F.get("__parts", F.lit(0))).join(kinds, F.lower("__folder") == F.col("__lower"))
    first = named.groupBy("label").agg(F.min("__folder").alias("__folder"))
    own = named.join(F.broadcast(first), ["label", "__folder"])  # one row a class
    fresh = own if allow_overlap else own.join(known.select("sha256").distinct(), "sha256", "left_anti")
    low = fresh.groupBy("sha256").agg(F.min(F.struct("__class", "path")).alias("__low"))
    kept = fresh.join(low, "sha256").where((F.col("__class") == F.col("__low.__class")) & (F.col("path") == F.col("__low.path")))
    empty = validate.empty_classes(kept, "label", metrics.classes(kept, list(labels)).withColumnRenamed("class", "label")).agg(F.min("label")).first()[0]
    if empty is not None:
        raise manifest.LayoutError(f"class {empty} keeps no pictures")
    name = F.get("__parts", F.lit(1))
    kept = ranking.positions(kept.withColumn("__name", name), ["label"], ["__name"], F.left("__name", F.lit(4)), "__kept")
    suffix = F.lower(F.regexp_extract("__name", r"(\.[^.]+)$", 1))
    number = F.when(F.col("__kept") < 10_000, F.lpad(F.col("__kept").cast("string"), 4, "0")).otherwise(F.col("__kept").cast("string"))
    return kept.select("path", "label", "sha256", F.concat("label", F.lit("/"), "label", F.lit("_"), number, suffix).alias("new_path"))


def fixture(spark: SparkSession, labels: Sequence[str] = validate.LABELS, per_class: int = 8, size: int = 80, seed: int = 42) -> DataFrame:
    """path and content (PNG) of a small picture set of all classes: on a dark ground a disc, whose hue tells the class,
    at a place that is drawn for each picture, and a little noise, so that no two pictures are equal."""
    import numpy as np

    from ..functions import pixels

    names = list(labels)

    def draw(batches):
        import pyarrow as pa

        down, across = np.mgrid[0:size, 0:size] / size
        for batch in batches:
            paths, made = [], []
            for k in batch.column(0).to_pylist():
                which, own = names[k // per_class], np.random.default_rng([seed, k])
                y, x, radius = own.uniform(0.35, 0.65, 2).tolist() + [own.uniform(0.2, 0.3)]
                hue = 255 * (k // per_class) // len(names)
                hsv = np.full((size, size, 3), (hue, 60, 50), np.uint8)
                hsv[np.hypot(down - y, across - x) < radius] = (hue, 230, 220)
                noisy = pixels.from_hsv(hsv).astype(int) + own.integers(-6, 7, (size, size, 3))
                paths.append(f"{which}/{k % per_class:04d}.png")
                made.append(pixels.png(noisy.clip(0, 255).astype(np.uint8)))
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(made, pa.binary())], ["path", "content"])

    return spark.range(len(names) * per_class).mapInArrow(draw, "path string, content binary")


def class_folders(spark: SparkSession, root: str, held: float = 0.2, seed: int = 123, names: tuple[str, str] = ("training", "validation")) -> tuple[DataFrame, list[str]]:
    """path, label, place and split of the pictures that lie in the folders of root, whatever their names, and those names
    in order (place is a label's number there). Of each class the share held is validation, in the order of a seeded digest,
    so that neither partitions nor other classes matter. A class of one picture, or root without any, is an error."""
    listed = manifest.files(spark, root).withColumn("label", F.regexp_extract("path", "^([^/]+)/[^/]+$", 1))
    listed = listed.where((F.col("label") != "") & validate.has_image_extension(F.col("path"))).select("path", "label")
    classes = [r.label for r in listed.select("label").distinct().orderBy("label").collect()]  # one row a class
    if not classes:
        raise manifest.LayoutError(f"no pictures in folders of {root}")
    places = F.broadcast(spark.createDataFrame(list(enumerate(classes)), "place int, label string"))
    return splits.singleton_split(listed.join(places, "label"), "label", "path", names, (1 - held, held), seed), classes


def written_halves(spark: SparkSession, path: str, out: str, seed: int = 42) -> dict:
    """Splits the manifest at path into halves by splits.shuffled_halves(), writes dev.csv, final.csv and record.json below
    out, and returns the record: seed, source, and count and digest of the rows of each half. A content in both halves is
    an error."""
    rows = manifest.read_manifest(spark, path).withColumn("split_was", F.col("split"))
    dealt = settled(splits.shuffled_halves(rows.drop("split"), "label", "path", seed))
    dedup.refuse_spanning(dealt, "sha256", "split", "one content in both halves")
    record: dict = {"seed": seed, "source_manifest": path}
    for half in ("dev", "final"):
        own = dealt.where(F.col("split") == half).withColumn("split", F.col("split_was")).drop("split_was")
        manifest.write_manifest(own, f"{out}/{half}.csv")
        record[half] = {"count": own.count(), "row_digest": manifest_digest(own)}
    manifest.write_json(spark, f"{out}/record.json", record)
    return record
