import itertools
import math
import pathlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from curata.functions import blobs, landmarks, pixels, text
from curata.operators import dedup, metrics, splits, training, validate
from curata.sources import manifest, prepare

LABELS = ["A", "B", "C"]


def put(spark, root, per_class, seed, below="", labels=LABELS):
    for r in prepare.fixture(spark, labels, per_class, 64, seed).collect():
        path = pathlib.Path(root, below, r.path)
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(r.content)


def test_pooled_folders_become_three_manifests(spark, tmp_path):
    put(spark, tmp_path / "in", 8, 17, "fixture")
    out = str(tmp_path / "out")
    said = prepare.manifests(spark, str(tmp_path / "in"), out, ratios=(0.5, 0.25, 0.25), threshold=0, labels=LABELS)
    assert said["layout"] == "pooled" and said["counts"]["per_split"] == {"train": 12, "validation": 6, "test": 6}
    assert said == manifest.read_json(spark, f"{out}/metadata.json") and list(said["counts"]["per_class_by_split"]["test"].values()) == [2, 2, 2]
    report = manifest.read_json(spark, f"{out}/duplicate_report.json")
    assert report["exact_duplicate_group_count"] == 0 and report["exact_cross_split_duplicates"] == 0
    for split, n in said["counts"]["per_split"].items():
        path = manifest.resolve(spark, out, split)
        assert manifest.verified(spark, path, str(tmp_path / "in"), split).count() == n
    again = prepare.manifests(spark, str(tmp_path / "in"), str(tmp_path / "again"), ratios=(0.5, 0.25, 0.25), threshold=0, labels=LABELS)
    assert again["manifest_digest"] == said["manifest_digest"]
    changed = next(pathlib.Path(tmp_path, "in", "fixture", "A").iterdir())
    changed.write_bytes(changed.read_bytes() + b"x")
    with pytest.raises(validate.ContractError):
        for split in said["counts"]["per_split"]:
            manifest.verified(spark, f"{out}/{split}.csv", str(tmp_path / "in"))


def test_source_partitions_keep_their_test_rows(spark, tmp_path):
    put(spark, tmp_path / "in", 6, 31, "wrapper/train")
    put(spark, tmp_path / "in", 2, 73, "wrapper/test")
    said = prepare.manifests(spark, str(tmp_path / "in"), str(tmp_path / "out"), labels=LABELS)
    assert said["layout"] == "source_partitions" and said["counts"]["per_split"] == {"train": 15, "validation": 3, "test": 6}
    assert prepare.external_manifest(spark, str(tmp_path / "in"), str(tmp_path / "external.csv"), LABELS).select("split").distinct().collect() == [("external",)]
    (tmp_path / "in/wrapper/test/A/copy.png").write_bytes((tmp_path / "in/wrapper/train/A/0000.png").read_bytes())
    with pytest.raises(dedup.LeakError):
        prepare.manifests(spark, str(tmp_path / "in"), str(tmp_path / "other"), labels=LABELS)
    (tmp_path / "in/wrapper/test/A/copy.png").rename(tmp_path / "in/wrapper/train/B/copy.png")
    with pytest.raises(splits.SplitError):
        prepare.manifests(spark, str(tmp_path / "in"), str(tmp_path / "third"), labels=LABELS)


def test_copies_below_a_class_root_are_no_roots(spark):
    rows = [(root, None, x) for root in ("", "A/copy", "deep/er", "deep/er/B/x", "half") for x in (LABELS if root != "half" else LABELS[:2])]
    roots = manifest.class_roots(spark.createDataFrame(rows, "class_root string, role string, label string"), LABELS)
    assert [r.class_root for r in roots.collect()] == [""]
    roots = manifest.class_roots(spark.createDataFrame(rows[6:], "class_root string, role string, label string"), LABELS)
    assert [r.class_root for r in roots.collect()] == ["deep/er"]


def test_external_roots(spark):
    frame = lambda rows: spark.createDataFrame(rows, "class_root string, role string")
    assert manifest.choose_external_root(frame([("x", None)])) == "x"
    assert manifest.choose_external_root(frame([("x", None), ("y", "train"), ("z", "test")])) == "z"
    for rows in ([("x", None), ("y", None)], [("x", "test"), ("y", "test")], []):
        with pytest.raises(manifest.LayoutError):
            manifest.choose_external_root(frame(rows))


def test_manifest_names_lines_and_splits(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        manifest.resolve(spark, str(tmp_path), "train")
    good = "path,label,split,sha256,dhash\n" + "".join(f"A/{k}.png,A,train,{'a' * 64},{'b' * 16}\n" for k in range(4000))
    (tmp_path / "train_manifest.csv").write_text(good)
    assert manifest.resolve(spark, str(tmp_path), "train").endswith("train_manifest.csv")
    assert manifest.read_split(spark, str(tmp_path / "train_manifest.csv"), "train").count() == 4000
    with pytest.raises(validate.ContractError):
        manifest.read_split(spark, str(tmp_path / "train_manifest.csv"), "test")
    (tmp_path / "none.csv").write_text("path,label,split,sha256,dhash\n")
    with pytest.raises(validate.ContractError, match="no rows"):
        manifest.read_split(spark, str(tmp_path / "none.csv"), "test")
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40000")
    try:
        (tmp_path / "bad.csv").write_text(good + f"../x.png,A,train,{'a' * 64},{'b' * 16}\n")
        with pytest.raises(validate.ContractError, match="line 4002: unsafe_path"):
            manifest.read_manifest(spark, str(tmp_path / "bad.csv"))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)


def test_supplement_names_what_it_keeps(spark):
    names = ["a/2.JPG", "a/1.png", "a/3.png", "A2/9.png", "b/1.png", "B/5.png", "b/x/1.png", "b/2.jpeg", "b/3.txt"]
    listed = spark.createDataFrame([(n, {"a/3.png": "s1", "b/2.jpeg": "s0", "b/1.png": "dup"}.get(n, n)) for n in names] + [("a/0.png", "dup")], "path string, sha256 string")
    known = spark.createDataFrame([("s1",)], "sha256 string")
    got = {r.path: r.new_path for r in prepare.supplement(listed, known, ["A", "B"]).collect()}
    assert got == {"a/0.png": "A/A_0000.png", "a/1.png": "A/A_0001.png", "a/2.JPG": "A/A_0002.jpg", "B/5.png": "B/B_0000.png"}
    assert "a/3.png" in {r.path for r in prepare.supplement(listed, known, ["A", "B"], allow_overlap=True).collect()}
    with pytest.raises(manifest.LayoutError):
        prepare.supplement(listed, known, ["A", "B", "C"])


def test_shares_are_whole_and_not_empty():
    assert splits.apportion(3, [0.98, 0.01, 0.01]) == [1, 1, 1] and splits.apportion(2, [0.98, 0.01, 0.01]) == [2, 0, 0]
    assert splits.apportion(7, [0.98, 0.01, 0.01]) == [5, 1, 1] and splits.apportion(10, [0.7, 0.15, 0.15]) == [7, 2, 1]
    for total, a, b in itertools.product(range(1, 40), range(1, 10), range(1, 10)):
        ratios = [a / 20, b / 20, 1 - a / 20 - b / 20]
        if min(ratios) <= 0:
            continue
        got = splits.apportion(total, ratios)
        assert sum(got) == total and (total < 3 or min(got) >= 1)
        assert all(abs(n - total * r) < 1 for n, r in zip(got, ratios, strict=True)) or 1 in got


def test_texts_that_contain_needles(spark):
    texts = ["the quick brown fox", "xthe quick brownx", "ab", "", None, "one  two\nthree four", "Ünïcode wörd here"]
    needles = ["the quick brown", "he quick brow", "quick", "a", "two\nthree", "e  two\nth", "", None, "ïcode wö", "nothing at all"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    sought = spark.createDataFrame(list(enumerate(needles)), "no long, needle string")
    want = sorted((i, k) for i, t in enumerate(texts) for k, n in enumerate(needles) if t is not None and n and n in t)
    for own in (sought, sought.where("no in (0, 9)"), sought.where("no in (2, 3)")):
        kept = {r.no for r in own.collect()}
        assert sorted((r.id, r.no) for r in dedup.contained(rows, own, "text", "needle").select("id", "no").collect()) == [p for p in want if p[1] in kept]


@pytest.mark.parametrize("values", [[5.0], [1.0, 2.0], [3.0] * 50 + [1.0] * 50, [float(k * 7919 % 1000) for k in range(3000)]])
def test_percentiles_are_exact(spark, values):
    rows = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
    got = metrics.percentiles(rows, "v", {"p50": 0.5, "p95": 0.95, "p0": 0.0, "p100": 1.0}).first()
    assert got.n == len(values) and [got.p50, got.p95, got.p0, got.p100] == pytest.approx([float(np.percentile(values, q)) for q in (50, 95, 0, 100)])
    assert metrics.percentiles(rows.limit(0), "v", {"p50": 0.5}).collect() == [(None, 0)]


def test_blobs_round_trip():
    tensors = {"a.weight": np.arange(6, dtype=np.float32).reshape(2, 3), "b": np.array([1.5], np.float32)}
    registry, blob = blobs.pack(tensors, contract="v1")
    got = blobs.unpack(registry, blob, contract="v1")
    assert all((got[k] == tensors[k]).all() for k in tensors) and registry["float_count"] == 7 and registry["tensors"][1]["offset"] == 6
    for args, kind in (((registry, blob[:-4]), {}), ((registry, blob), {"contract": "v2"}), (({**registry, "format": "x"}, blob), {})):
        with pytest.raises(blobs.BlobError):
            blobs.unpack(*args, **kind)


def test_models_load_by_their_contract(spark, tmp_path):
    rows = spark.createDataFrame([([float(k % 2), 1.0], k % 2) for k in range(40)], "features array<double>, label int")
    model = training.forest(rows, "features", "label", trees=3)
    training.save(model, str(tmp_path / "m"), {"features": 2, "classes": [0, 1]}, {"note": "x"})
    got, said = training.load(spark, str(tmp_path / "m"), ["features", "classes"], {"features": 2})
    assert said["note"] == "x" and training.apply(got, rows, "features").where("prediction <> label").count() == 0
    with pytest.raises(training.ModelError):
        training.load(spark, str(tmp_path / "m"), ["seed"], {})
    with pytest.raises(training.ModelError):
        training.load(spark, str(tmp_path / "m"), [], {"features": 3})
    with pytest.raises(training.ModelError):
        training.save(model, str(tmp_path / "n"), {"features": 2}, {"features": 3})


def test_training_values():
    good = {"epochs": 10, "batch": 8, "rate": 0.1, "size": 64, "patience": 3, "per_class": None, "profile": "robust"}
    training.check_training(good)
    for bad in ({"epochs": 0}, {"epochs": 101}, {"epochs": True}, {"rate": 0}, {"patience": 0}, {"per_class": 0}, {"per_class": 1, "per_split": 1}, {"repeat": 0}, {"select_on": "x"}, {"profile": "none"}, {"colour": 1}):
        with pytest.raises(ValueError):
            training.check_training(good | bad)


def test_lanczos_and_hsv():
    flat = np.full((50, 40), 77, np.uint8)
    assert (pixels.lanczos(flat, 8, 9) == 77).all()
    x = np.random.default_rng(1).integers(0, 256, (30, 20), dtype=np.uint8)
    assert (pixels.lanczos(x, 30, 20) == x).all()
    weights = pixels.lanczos_weights(100, 9)
    assert (abs(weights.sum(1) - (1 << 22)) <= 100).all() and (weights == weights[::-1, ::-1]).all() and (weights < 0).any()
    ramp = np.repeat(np.arange(0, 180, 2, dtype=np.uint8)[None, ::-1, None], 90, 0).repeat(3, 2)
    assert pixels.dhash(ramp) == -1 and pixels.dhash(ramp[:, ::-1]) == 0
    red = np.array([[[255, 0, 0], [0, 255, 0], [0, 0, 255], [9, 9, 9], [255, 255, 0]]], np.uint8)
    assert pixels.to_hsv(red).tolist() == [[[0, 255, 255], [85, 255, 255], [170, 255, 255], [0, 0, 9], [42, 255, 255]]]
    assert abs(pixels.from_hsv(pixels.to_hsv(red)).astype(int) - red).max() <= 3
    assert (pixels.corrupt(np.full((9, 9, 3), 255, np.uint8), "gaussian_noise", 1) <= 255).all()


def test_small_columns(spark):
    row = spark.range(1).select(
        text.flat(F.lit("  a \n b\t")).alias("flat"), text.sorted_json(b=F.lit(1), a=F.lit("x")).alias("json"),
        text.utc_stamp(F.timestamp_seconds(F.lit(0))).alias("at"), landmarks.shape_group(F.lit("é")).alias("none"),
        text.seeded_uniform(4, F.lit("k")).alias("u"),
    ).first()
    assert (row.flat, row.json, row.at, row.none) == ("a b", '{"a":"x","b":1}', "1970-01-01T00:00:00+00:00", None)
    assert 0 <= row.u < 1 and row.u == spark.range(3).repartition(3).select(text.seeded_uniform(4, F.lit("k")).alias("u")).first().u
    assert math.isclose(metrics.peak(spark.createDataFrame([(1.0,), (None,), (3.0,)], "v double"), "v").first().peak, 3.0)
