"""A classifier's evaluation as one document, and a run of everything on generated pictures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import manifest, prepare
from ..sources.scratch import settled
from . import metrics, network, pictures
from .sampling import row_set_digest


def evaluation(scored: DataFrame, truth: str, prediction: str, classes: Sequence[str], scope: str, line: Sequence[str] = ()) -> dict:
    """scope, accuracy, macro_f1 (over all classes), rows and how many of them were right, per_class (precision, recall,
    f1, support), confusion_matrix (rows: truth, in the order of classes), class_names, and a digest of the rows' columns
    line, so that a score names what it was measured on. A missing prediction is wrong; no rows are an error."""
    if not scope.strip():
        raise ValueError("an evaluation needs a scope")
    rows = settled(scored.select(*dict.fromkeys([truth, prediction, *line])))
    report = {r["class"]: r for r in metrics.report(rows, truth, prediction, classes).collect()}  # one row a class
    cells = {(r.truth, r.prediction): r.n for r in metrics.confusion(rows, truth, prediction, classes).collect()}
    total = rows.count()
    if not total:
        raise ValueError("an evaluation needs rows")
    right = sum(r.correct for r in report.values())
    said = {
        "scope": scope.strip(),
        "accuracy": right / total,
        "macro_f1": sum(r.f1 for r in report.values()) / len(report),
        "n_rows": total,
        "n_correct": right,
        "class_names": list(classes),
        "per_class": {str(c): {"precision": report[c].precision, "recall": report[c].recall, "f1": report[c].f1, "support": report[c].support} for c in classes},
        "confusion_matrix": [[cells.get((t, p), 0) for p in classes] for t in classes],
    }
    if line:
        said["rows_digest"] = row_set_digest(rows, F.concat_ws("\t", *(F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in line))).first().digest
    return said


def colour_features(rows: DataFrame, cells: int = 3) -> DataFrame:
    """Pictures (path, height, width, channels, data) with features: mean red, green and blue, from 0 to 1, of cells x cells areas."""
    def make(x, _):
        import numpy as np

        areas = [part.reshape(-1, 3).mean(0) / 255 for band in np.array_split(x, cells) for part in np.array_split(band, cells, axis=1)]
        return np.concatenate(areas).tolist()

    return pictures.map_pictures(rows, make, "features", "array<double>")


def smoke(spark: SparkSession, out: str, classes: Sequence[str] = ("A", "B", "C", "D"), per_class: int = 12, seed: int = 42) -> dict:
    """Generates pictures, prepares their manifests, trains a small network, evaluates it on the test split and predicts one
    picture; writes all that below out, and returns a summary (status, preparation, training, evaluation, prediction)."""
    root = f"{out}/pictures"
    put_files(prepare.fixture(spark, classes, per_class, 64, seed), root)
    prepared = prepare.manifests(spark, root, f"{out}/manifests", seed, (0.625, 0.125, 0.25), 0, classes)
    found = settled(colour_features(pictures.read_upright(spark, root)).withColumn("path", F.regexp_extract("path", r"([^/]+/[^/]+)$", 1)))
    of = lambda split: manifest.read_split(spark, manifest.resolve(spark, f"{out}/manifests", split), split, classes).join(found.select("path", "features"), "path")
    settings = network.Settings(epochs=40, batch=16, rate=3e-2, hidden=(16,), dropout=0.0, patience=10, seed=seed)
    fitted = network.fit(of("train"), of("validation"), "path", "features", "label", settings)
    trained = network.save(fitted, spark, f"{out}/network", {"feature_contract": "colour-areas-v1"})
    scored = settled(network.predict(of("test"), fitted, "features"))
    judged = evaluation(scored, "label", "prediction", classes, "generated pictures", ["path", "sha256"])
    manifest.write_json(spark, f"{out}/evaluation.json", judged)
    first = scored.orderBy("path").select("path", "label", "prediction").first()
    said = {"status": "ok", "preparation": prepared, "training": trained, "evaluation": judged, "prediction": first.asDict()}
    manifest.write_json(spark, f"{out}/summary.json", said)
    return said


def put_files(files: DataFrame, root: str) -> None:
    """Writes each row's content to its path below root, by tasks, through pyarrow's file systems. A repeated task writes
    the same bytes again."""
    def put(batches):
        from pyarrow import fs

        system, inner = (fs.LocalFileSystem(), root) if "://" not in root else fs.FileSystem.from_uri(root)
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                system.create_dir(f"{inner}/{path}".rsplit("/", 1)[0], recursive=True)
                with system.open_output_stream(f"{inner}/{path}") as f:
                    f.write(content)
            yield batch.select(["path"])

    files.select("path", "content").mapInArrow(put, "path string").write.format("noop").mode("overwrite").save()
