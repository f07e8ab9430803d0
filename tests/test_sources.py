import numpy as np
import pytest
from pyspark.sql import functions as F

from curata.functions import pixels
from curata.operators import pictures, selection, validate
from curata.sources import manifest
from curata.streaming import ingest


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("pictures")
    rng = np.random.default_rng(3)
    for label in "AB":
        (root / "wrap" / label).mkdir(parents=True)
        for k in range(2):
            (root / "wrap" / label / f"{label.lower()}_{k}.PNG").write_bytes(pixels.png(rng.integers(0, 256, (60, 50, 3), dtype=np.uint8)))
    (root / "wrap" / "A" / "broken.png").write_bytes(b"no picture")
    return root


def test_discovery_and_fingerprints(spark, folder):
    found = manifest.images(manifest.files(spark, str(folder)), ["A", "B"])
    assert {(r.class_root, r.label) for r in found.collect()} == {("wrap", "A"), ("wrap", "B")}
    assert manifest.choose_roots(manifest.class_roots(found, ["A", "B"])) == {"pooled": "wrap"}
    assert manifest.fingerprinted(spark, found, str(folder)).select("sha256").distinct().count() == 5


def test_pictures_are_decoded_or_reported(spark, folder):
    rows = pictures.read(spark, str(folder))
    assert rows.count() == 4 and pictures.undecodable(spark, str(folder)).count() == 1
    assert pictures.with_dhash(rows).select("dhash").distinct().count() == 4
    assert {r.refused for r in pictures.with_quality(rows).collect()} == {None}
    named = rows.withColumn("corruption", F.lit("letterbox")).withColumn("seed", F.lit(1))
    assert all(len(r.pixels) == 60 * 50 * 3 for r in pictures.corrupted(named).collect())
    logits = pictures.with_logits(rows.limit(1), pictures.Cnn(), 16).first().logits
    assert len(logits) == 26


def test_networks_have_the_contracts_parameters():
    assert pictures.Cnn().parameters() == 164_546 and pictures.Mlp().parameters() == 57_498


@pytest.mark.parametrize("name", ["gaussian_noise", "gamma_low", "gamma_high", "hue_shift", "contrast_crush", "letterbox", "downscale"])
def test_corruptions_change_the_picture_the_same_way_each_time(name):
    image = np.random.default_rng(1).integers(0, 256, (96, 96, 3), dtype=np.uint8)
    out = pixels.corrupt(image, name, 5)
    assert out.shape == image.shape and out.dtype == np.uint8 and (out != image).any()
    assert (out == pixels.corrupt(image, name, 5)).all()
    with pytest.raises(ValueError):
        pixels.corrupt(image, "none", 1)


def test_manifest_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(f"{x}/1.png", x, "train", "a" * 64, "b" * 16) for x in "BAC"], validate.MANIFEST)
    manifest.write_manifest(rows, str(tmp_path / "m"))
    assert sorted(map(tuple, manifest.read_manifest(spark, str(tmp_path / "m")).collect())) == sorted(map(tuple, rows.collect()))
    rows.drop("dhash").write.option("header", "true").csv(str(tmp_path / "n"))
    with pytest.raises(validate.ContractError):
        manifest.read_manifest(spark, str(tmp_path / "n"))


def test_features_keep_misses(spark, tmp_path):
    rows = spark.createDataFrame([("a", 0, [0.0] * 79), ("b", 1, None)], "path string, label int, features array<double>")
    assert manifest.write_features(rows, str(tmp_path / "f")).first().detection_rate == 0.5
    assert manifest.read_features(spark, [str(tmp_path / "f")]).count() == 2
    with pytest.raises(validate.ContractError):
        manifest.read_features(spark, [str(tmp_path / "f")], size=78)


def test_stream_drops_copies_and_resumes(spark, tmp_path):
    schema = "sha string, ts timestamp"
    for part, values in enumerate((["a", "b", "a"], ["b", "c"])):
        spark.createDataFrame([(v,) for v in values], "sha string").withColumn("ts", F.lit("2024-01-01 00:00:00").cast("timestamp")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        ingest.append_to(ingest.fresh(stream, "sha", "ts"), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    assert sorted(r.sha for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b", "c"]


def test_roots_behind_the_first_hundred_count(spark):
    roots = [(f"a{k:03}", None) for k in range(150)] + [("x/train", "train"), ("y/test", "test")]
    frame = lambda rows: spark.createDataFrame(rows, "class_root string, role string")
    assert manifest.choose_roots(frame(roots)) == {"train": "x/train", "test": "y/test"}
    with pytest.raises(manifest.LayoutError):
        manifest.choose_roots(frame([("a/train", "train"), ("b/test", "test"), *roots]))
    with pytest.raises(manifest.LayoutError):
        manifest.choose_roots(frame([]))


def test_markdown_refuses_what_it_would_cut(spark):
    assert selection.markdown(spark.range(1000), ["id"]).count("\n") == 1001
    with pytest.raises(ValueError):
        selection.markdown(spark.range(1001), ["id"])
