"""The row contract of a manifest, as columns and violation tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The manifest's fields in order, its labels and splits, the formats of its digests.
FIELDS = ("path", "label", "split", "sha256", "dhash")
LABELS = tuple("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
SPLITS = ("train", "validation", "test", "external")
SHA256, DHASH = "^[0-9a-f]{64}$", "^[0-9a-f]{16}$"
#: Folder names that tell a split.
ROLES = {"train": ("train", "training", "asl_alphabet_train"), "validation": ("validation", "valid", "val", "asl_alphabet_validation"), "test": ("test", "testing", "asl_alphabet_test")}
EXTENSIONS = (".jpg", ".jpeg", ".png")
MANIFEST = T.StructType([T.StructField(f, T.StringType(), False) for f in FIELDS])


class ContractError(ValueError):
    """Rows break the contract."""


def unsafe_path(path: Column) -> Column:
    """Whether a path is absolute, has a backslash, climbs, or is not in canonical form."""
    parts = F.split(path, "/")
    odd = F.exists(parts, lambda p: p.isin("", ".", ".."))
    return F.startswith(path, F.lit("/")) | F.contains(path, F.lit("\\")) | odd


def blank(column: Column) -> Column:
    return column.isNull() | (column == "")


def first_violation(labels: Sequence[str] = LABELS, splits: Sequence[str] | None = SPLITS, repeated: Column | None = None) -> Column:
    """The name of the first rule that a row breaks, or null. splits None: their names are not checked, as for rows that
    never were a file; repeated: whether the row's path came before."""
    rules = [
        ("empty_field", F.coalesce(*(F.when(blank(F.col(f)), True) for f in FIELDS), F.lit(False))),
        ("unsafe_path", unsafe_path(F.col("path"))),
        ("unknown_label", ~F.col("label").isin(*labels)),
        ("unknown_split", ~F.col("split").isin(*splits) if splits else F.lit(False)),
        ("bad_sha256", ~F.col("sha256").rlike(SHA256)),
        ("bad_dhash", ~F.col("dhash").rlike(DHASH)),
        ("repeated_path", repeated if repeated is not None else F.lit(False)),
    ]
    return F.coalesce(*(F.when(broken, F.lit(name)) for name, broken in rules))


def violations(rows: DataFrame, line: str = "line", **options) -> DataFrame:
    """line and rule of each row that breaks the contract; later rows of one path count as repeated."""
    before = F.row_number().over(Window.partitionBy("path").orderBy(line)) > 1
    checked = rows.withColumn("__again", before).withColumn("rule", first_violation(repeated=F.col("__again"), **options))
    return checked.where(F.col("rule").isNotNull()).select(line, "rule")


def require(rows: DataFrame, line: str = "line", **options) -> DataFrame:
    """rows, or an error that names the first line that breaks the contract."""
    first = violations(rows, line, **options).agg(F.min(F.struct(line, "rule")).alias("v")).first()["v"]
    if first:
        raise ContractError(f"line {first[0]}: {first[1]}")
    return rows


def repeated_paths(rows: DataFrame, path: str, order: str) -> DataFrame:
    """Rows whose path came before, in the given order."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(path).orderBy(order))).where("__n > 1").drop("__n")


def changed_content(manifest: DataFrame, files: DataFrame, path: str = "path", recorded: str = "sha256", actual: str = "actual", key: str | None = None) -> DataFrame:
    """path and status (missing, changed) of manifest rows whose file is not there or has other bytes. key: the column of
    both that tells files apart where paths don't, path without it; files has one row for each."""
    key = key or path
    theirs = files.select(F.col(key).alias("__key"), F.col(actual).alias("__actual"))
    joined = manifest.join(theirs, F.col(key) == F.col("__key"), "left")
    status = F.when(F.col("__key").isNull(), "missing").when(~F.col("__actual").eqNullSafe(F.col(recorded)), "changed")
    return joined.withColumn("status", status).where(F.col("status").isNotNull()).select(path, "status")


def empty_classes(rows: DataFrame, label: str, expected: DataFrame) -> DataFrame:
    """Classes of expected (one column, label) without rows."""
    return expected.join(rows.select(label).distinct(), label, "left_anti")


def known_classes(rows: DataFrame, label: str, names: Sequence[str]) -> DataFrame:
    """rows of the named classes; others, and rows without a class, are left out."""
    return rows.where(F.col(label).isin(*names))


def role_of(path: Column, roles: dict[str, Sequence[str]] = ROLES) -> Column:
    """The split that the nearest telling folder above a file names, whatever its case and dashes; else null."""
    folders = F.reverse(F.slice(F.split(F.replace(F.lower(path), F.lit("-"), F.lit("_")), "/"), 1, F.greatest(F.lit(0), F.size(F.split(path, "/")) - 1)))
    told = F.transform(folders, lambda p: F.coalesce(*(F.when(p.isin(*names), F.lit(role)) for role, names in roles.items())))
    return F.get(F.filter(told, lambda r: r.isNotNull()), F.lit(0))


def has_image_extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1)).isin(*EXTENSIONS)


def wrong_split(rows: DataFrame, expected: str) -> DataFrame:
    """One row: rows, and rows of another split."""
    return rows.agg(F.count("*").alias("n_rows"), F.count_if(~F.col("split").eqNullSafe(F.lit(expected))).alias("n_violations"))
