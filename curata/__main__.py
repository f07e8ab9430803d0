"""What a user does from a shell: python -m curata <verb>, or spark-submit with this file. Results are printed as JSON."""

from __future__ import annotations

import argparse
import json
import platform
import sys
from collections.abc import Sequence

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curata.functions import augment, vectors
from curata.operators import evaluation, exchange, network, picture_network, pictures, training, validate
from curata.operators.score import LOW_CONFIDENCE
from curata.sources import manifest, prepare


def pictures_of(spark: SparkSession, rows: DataFrame, root: str) -> DataFrame:
    """The rows of a manifest with their pictures below root, upright; a file that is missing or can't be decoded is an error."""
    plain = lambda c: F.regexp_replace(c, "^file:/+", "file:/")
    places = manifest.files(spark, root).select("path", plain("full_path").alias("at"))
    found = pictures.read_upright(spark, root).select(plain("path").alias("at"), "height", "width", "channels", "data")
    whole = rows.join(places, "path", "left").join(found, "at", "left").drop("at")
    missing = whole.where(F.col("data").isNull()).agg(F.min("path")).first()[0]
    if missing is not None:
        raise manifest.LayoutError(f"no picture: {missing}")
    return whole


def doctor(spark: SparkSession, _: argparse.Namespace) -> dict:
    import numpy
    import pyarrow

    jvm = spark.sparkContext._jvm.java.lang.System
    return {"python": platform.python_version(), "platform": platform.platform(), "spark": spark.version, "java": jvm.getProperty("java.version"), "pyarrow": pyarrow.__version__, "numpy": numpy.__version__, "master": spark.sparkContext.master, "shared_folder": spark.conf.get("spark.checkpoint.dir", None)}


def do_prepare(spark: SparkSession, said: argparse.Namespace) -> dict:
    return prepare.manifests(spark, said.source, said.out, said.seed, said.ratios, said.threshold, said.classes)


def do_external(spark: SparkSession, said: argparse.Namespace) -> dict:
    return {"rows": prepare.external_manifest(spark, said.source, said.out, said.classes).count(), "manifest": said.out}


def do_halves(spark: SparkSession, said: argparse.Namespace) -> dict:
    return prepare.written_halves(spark, said.manifest, said.out, said.seed)


def do_train(spark: SparkSession, said: argparse.Namespace) -> dict:
    training.check_training({"epochs": said.epochs, "batch": said.batch, "rate": said.rate, "size": said.size, "patience": said.patience, "profile": said.profile})
    own = {s: pictures_of(spark, manifest.read_split(spark, manifest.resolve(spark, said.manifests, s), s, said.classes), said.source) for s in ("train", "validation")}
    settings = network.Settings(epochs=said.epochs, batch=said.batch, batches_a_step=said.batches_a_step, rate=said.rate, dropout=said.dropout, patience=said.patience, seed=said.seed)
    fitted = picture_network.fit(own["train"], own["validation"], "label", said.size, tuple(said.channels), said.profile, settings)
    run = {"best_epoch": fitted.best_epoch, "best_validation_loss": fitted.best_loss, "history": fitted.history, "profile": said.profile, "seed": said.seed}
    registry = exchange.export(fitted.model, said.out, fitted.classes, said.size, **run)
    return {k: registry[k] for k in ("best_epoch", "best_validation_loss", "history", "float_count", "weight_sha256")} | {"network": said.out}


def do_evaluate(spark: SparkSession, said: argparse.Namespace) -> dict:
    model, registry = exchange.load(spark, said.network)
    rows = pictures_of(spark, manifest.read_manifest(spark, said.manifest, labels=registry["class_names"]), said.source)
    scored = picture_network.predict(rows, network.Fitted(model, 0, 0.0, classes=registry["class_names"]), registry["image_size"])
    found = evaluation.evaluation(scored, "label", "prediction", registry["class_names"], said.scope, ["path", "sha256"])
    found["network"] = {"path": said.network, "sha256": registry["weight_sha256"], "best_epoch": registry.get("best_epoch")}
    if said.out:
        manifest.write_json(spark, said.out, found)
    return found


def do_predict(spark: SparkSession, said: argparse.Namespace) -> dict:
    if not 0 <= said.threshold <= 1 or said.top < 1:
        raise ValueError("threshold must lie between 0 and 1, and top be positive")
    model, registry = exchange.load(spark, said.network)
    shared, size, names = spark.sparkContext.broadcast(model), registry["image_size"], registry["class_names"]
    rows = pictures.map_pictures(pictures.read_upright(spark, said.images), lambda x, _: shared.value.forward(augment.normalised(x, size).astype(float)).tolist(), "logits", "array<double>")
    ranked = rows.select("path", vectors.top_k(vectors.softmax(F.col("logits")), said.top).alias("top")).orderBy("path")
    out = []
    for r in ranked.toLocalIterator():
        best = [{"label": names[t.place], "probability": t.value} for t in r.top]
        out.append({"path": r.path, "predictions": best, "warning": LOW_CONFIDENCE if best[0]["probability"] < said.threshold else None})
    if not out:
        raise FileNotFoundError(f"no picture in {said.images}")
    return {"pictures": out}


def do_smoke(spark: SparkSession, said: argparse.Namespace) -> dict:
    return evaluation.smoke(spark, said.out, seed=said.seed)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="curata", description=__doc__)
    verbs = top.add_subparsers(dest="verb", required=True)

    def verb(name: str, run, what: str, *needed: str, **more) -> argparse.ArgumentParser:
        own = verbs.add_parser(name, help=what)
        for n in needed:
            own.add_argument(f"--{n}", required=True)
        for n, (kind, value) in more.items():
            listed = isinstance(value, (list, tuple))
            own.add_argument(f"--{n.replace('_', '-')}", type=kind, default=value, **({"nargs": "+"} if listed else {}))
        own.set_defaults(run=run)
        return own

    classes, seed = (str, list(validate.LABELS)), (int, 42)
    verb("doctor", doctor, "versions of what is installed")
    verb("prepare", do_prepare, "manifests of a folder of pictures", "source", "out", seed=seed, ratios=(float, [0.7, 0.15, 0.15]), threshold=(int, 5), classes=classes)
    verb("prepare-external", do_external, "the manifest of an outside dataset", "source", "out", classes=classes)
    verb("split-external", do_halves, "halves of a manifest, with their record", "manifest", "out", seed=seed)
    verb("train", do_train, "train the picture network", "manifests", "source", "out", size=(int, 96), epochs=(int, 12), batch=(int, 64), batches_a_step=(int, 1), rate=(float, 1e-3), dropout=(float, 0.2), patience=(int, 3), channels=(int, [24, 48, 96]), profile=(str, augment.DEFAULT), seed=seed, classes=classes)
    verb("evaluate", do_evaluate, "judge a network on a manifest", "network", "manifest", "source", "scope", out=(str, None))
    verb("predict", do_predict, "the likeliest labels of pictures", "network", "images", top=(int, 3), threshold=(float, 0.6))
    verb("smoke", do_smoke, "everything on generated pictures", "out", seed=seed)
    return top


def main(said: Sequence[str] | None = None) -> int:
    """Runs a verb and prints its result; what a user can mend (wrong values, missing files, broken contracts) gives one line
    on stderr and the exit code 2."""
    chosen = parser().parse_args(said)
    spark = SparkSession.builder.appName("curata").getOrCreate()
    try:
        print(json.dumps(chosen.run(spark, chosen), indent=2, sort_keys=True))
    except (ValueError, OSError, RuntimeError, PySparkException) as error:
        print(f"curata {chosen.verb}: {str(error).splitlines()[0]}", file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
