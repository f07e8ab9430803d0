"""Manifests: discovery of class folders, reading and writing of row tables, feature tables, run documents."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import validate


class LayoutError(ValueError):
    """Folders are not laid out as a dataset."""


def files(spark: SparkSession, root: str) -> DataFrame:
    """path (below root), full path and length of all files below root; contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select(F.col("path").alias("full_path"), "length")
    return found.withColumn("path", F.regexp_replace("full_path", rf"^.*?{_quoted(root)}/", ""))


def _quoted(root: str) -> str:
    import re

    return re.escape(root.rstrip("/").removeprefix("file:"))


def images(listed: DataFrame, labels: Sequence[str] = validate.LABELS, deepest: int = 3) -> DataFrame:
    """Adds class_root (the folder above the label's, at most `deepest` levels down), label and role to listed image files."""
    parts = F.split("path", "/")
    depth = F.array_position(F.transform(parts, lambda p: p.isin(*labels)), True).cast("int")
    named = listed.where(validate.has_image_extension(F.col("path"))).withColumn("__at", depth).where((F.col("__at") > 0) & (F.col("__at") <= deepest + 1))
    named = named.withColumn("class_root", F.array_join(F.slice(parts, 1, F.col("__at") - 1), "/")).withColumn("label", F.get(parts, F.col("__at") - 1))
    return named.withColumn("role", validate.role_of(F.concat(F.col("class_root"), F.lit("/x")))).drop("__at")


def class_roots(found: DataFrame, labels: Sequence[str] = validate.LABELS) -> DataFrame:
    """class_root and role of folders that hold all classes. Below such a folder there are no others: copies of a dataset
    inside one of its classes are not looked at."""
    whole = found.groupBy("class_root", "role").agg(F.countDistinct("label").alias("n")).where(F.col("n") == len(labels)).select("class_root", "role")
    parts = F.split("class_root", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    inside = whole.select("class_root", F.explode(F.filter(F.array_distinct(above), lambda a: a != F.col("class_root"))).alias("outer"))
    inside = inside.join(whole.select(F.col("class_root").alias("outer")), "outer", "left_semi").select("class_root").distinct()
    return whole.join(inside, "class_root", "left_anti")


def choose_roots(roots: DataFrame) -> dict[str, str]:
    """{'pooled': root} for a single root, else one root each for train, test and, if there is one, validation."""
    by = {r.role: r for r in roots.groupBy("role").agg(F.count("*").alias("n"), F.min("class_root").alias("root")).collect()}  # one row for each role
    n = {role: r.n for role, r in by.items()}
    if sum(n.values()) == 1:
        return {"pooled": next(iter(by.values())).root}
    if n.get("train") != 1 or n.get("test") != 1 or n.get("validation", 0) > 1:
        raise LayoutError(f"cannot tell the splits of these roots: {n}")
    return {role: by[role].root for role in ("train", "validation", "test") if role in by}


def choose_external_root(roots: DataFrame) -> str:
    """The root of an outside dataset: the only one, or the only one that is a test root."""
    by = {r.role: r for r in roots.groupBy("role").agg(F.count("*").alias("n"), F.min("class_root").alias("root")).collect()}
    if sum(r.n for r in by.values()) == 1:
        return next(iter(by.values())).root
    if "test" in by and by["test"].n == 1:
        return by["test"].root
    raise LayoutError(f"cannot tell which of these roots to take: { {k: r.n for k, r in by.items()} }")


def fingerprinted(spark: SparkSession, listed: DataFrame, root: str) -> DataFrame:
    """listed with sha256 of each file's bytes, which are read here and only here."""
    content = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    digests = content.select(F.col("path").alias("full_path"), F.sha2("content", 256).alias("sha256"))
    return listed.join(digests, "full_path")


def read_manifest(spark: SparkSession, path: str, **options) -> DataFrame:
    """The rows of a manifest (CSV with exactly the contract's columns), all checked against the contract."""
    header = spark.read.option("header", "true").csv(path).columns
    if tuple(header) != validate.FIELDS:
        raise validate.ContractError(f"header {header}")
    rows = spark.read.schema(validate.MANIFEST).option("header", "true").option("mode", "FAILFAST").option("emptyValue", "").csv(path)
    return validate.require(with_lines(rows), **options).drop("line")


def with_lines(rows: DataFrame) -> DataFrame:
    """rows, just read from files with a header, with line: the number of their line in its file, the header being 1.

    Rows are counted by the stretch of a file that a task reads; stretches then stand behind each other. A row is a line:
    fields with line breaks are no part of the contract, and reading refuses them."""
    own = rows.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__from"), F.monotonically_increasing_id().alias("__id"))
    sizes = own.groupBy("__file", "__from").agg(F.count("*").alias("__n"))
    before = Window.partitionBy("__file").orderBy("__from").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("__file", "__from", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__ahead"))
    place = F.row_number().over(Window.partitionBy("__file", "__from").orderBy("__id"))
    return own.withColumn("__place", place).join(sizes, ["__file", "__from"]).withColumn("line", F.col("__ahead") + F.col("__place") + 1).drop("__file", "__from", "__id", "__place", "__ahead")


def resolve(spark: SparkSession, folder: str, split: str) -> str:
    """The manifest of a split in a folder: the first of its usual names that is there."""
    names = [f"{split}.csv", f"manifest_{split}.csv", f"{split}_manifest.csv"]
    for name in names:
        try:
            spark.read.text(f"{folder}/{name}").schema  # noqa: B018  resolving the path is the test
            return f"{folder}/{name}"
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
    raise FileNotFoundError(f"no {split} manifest in {folder}; expected {', '.join(names)}")


def read_split(spark: SparkSession, path: str, split: str, labels: Sequence[str] = validate.LABELS) -> DataFrame:
    """read_manifest(), and all rows must be of one split with known labels, and there must be some."""
    rows = read_manifest(spark, path, labels=labels)
    found = validate.wrong_split(rows, split).first()
    if not found.n_rows:
        raise validate.ContractError(f"no rows in {path}")
    if found.n_violations:
        raise validate.ContractError(f"{found.n_violations} rows of {path} are of another split than {split}")
    return rows


def verified(spark: SparkSession, path: str, root: str, split: str | None = None) -> DataFrame:
    """The rows of a manifest, if the files below root are there and still have the recorded bytes."""
    rows = read_split(spark, path, split) if split else read_manifest(spark, path)
    listed = files(spark, root)
    actual = fingerprinted(spark, listed, root).select("path", F.col("sha256").alias("actual"))
    first = validate.changed_content(rows, actual).agg(F.min(F.struct("path", "status")).alias("v")).first()["v"]
    if first:
        raise validate.ContractError(f"{first['path']}: {first['status']}")
    return rows


def write_json(spark: SparkSession, path: str, value) -> None:
    """A small document as JSON with sorted keys, by Spark's own commit: a folder with one text file."""
    said = json.dumps(value, indent=2, sort_keys=True)
    spark.createDataFrame([(said,)], "value string").coalesce(1).write.mode("errorifexists").option("lineSep", "\n").text(path)


def read_json(spark: SparkSession, path: str):
    """What write_json() wrote."""
    return json.loads("\n".join(r.value for r in spark.read.option("wholetext", "true").text(path).collect()))


def write_manifest(rows: DataFrame, path: str) -> None:
    """Writes rows in the contract's columns and order, in sorted parts."""
    ordered = rows.select(*validate.FIELDS).repartitionByRange("label", "path").sortWithinPartitions("label", F.lower("path"), "path")
    ordered.write.mode("errorifexists").option("header", "true").csv(path)


def read_features(spark: SparkSession, paths: Sequence[str], size: int = 79, contract: str = "landmark-v1") -> DataFrame:
    """Feature tables (path, label, features, contract), joined end to end; a wrong size or contract is an error."""
    rows = spark.read.parquet(*paths)
    bad = rows.where(F.col("features").isNotNull() & ((F.size("features") != size) | ~F.col("contract").eqNullSafe(F.lit(contract))))
    if not bad.isEmpty():
        raise validate.ContractError("features of another size or contract")
    if rows.isEmpty():
        raise validate.ContractError("no features")
    return rows


def write_features(rows: DataFrame, path: str, contract: str = "landmark-v1") -> DataFrame:
    """Writes (path, label, features) with the contract; null features are misses and stay. The misses of each
    class go to path.missed.json. Returns considered, extracted and detection_rate in one row."""
    rows.withColumn("contract", F.lit(contract)).write.mode("errorifexists").parquet(path)
    write_json(rows.sparkSession, f"{path.rstrip('/')}.missed.json", {str(r.label): r.n for r in rows.where(F.col("features").isNull()).groupBy("label").agg(F.count("*").alias("n")).collect()})  # one row a class
    return rows.agg(F.count("*").alias("considered"), F.count("features").alias("extracted"), F.coalesce(F.try_divide(F.count("features").cast("double"), F.count("*")), F.lit(0.0)).alias("detection_rate"))


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """One row per complete run below path: its best epoch's record from history.json joined with run_metadata.json."""
    run = F.regexp_extract(F.input_file_name(), r"([^/]+)/[^/]+$", 1)
    load = lambda name: spark.read.option("multiLine", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", name).json(path).withColumn("run", run)
    epochs = load("history.json").select("run", F.explode("epochs").alias("record")).select("run", "record.*")
    metadata = load("run_metadata.json")
    return epochs.join(metadata.select("run", *(c for c in metadata.columns if c not in epochs.columns)), "run").where("epoch = best_epoch")
