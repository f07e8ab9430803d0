import pathlib

import pytest
from pyspark.sql import functions as F

from curata.functions import hashing, landmarks, pixels, sqlnames
from curata.operators import dedup, evaluation, splits
from curata.sources import manifest, prepare

LABELS = ["A", "B", "C"]


def test_a_document_of_an_evaluation(spark):
    rows = spark.createDataFrame([("a", "A", "A"), ("b", "A", "B"), ("c", "B", "B"), ("d", "B", None), ("e", "A", "A")], "id string, truth string, said string")
    got = evaluation.evaluation(rows, "truth", "said", LABELS, " small ", ["id"])
    assert (got["scope"], got["n_rows"], got["n_correct"], got["accuracy"]) == ("small", 5, 3, 0.6)
    assert got["confusion_matrix"] == [[2, 1, 0], [0, 1, 0], [0, 0, 0]]
    assert got["per_class"]["A"] == {"precision": 1.0, "recall": 2 / 3, "f1": 0.8, "support": 3}
    assert got["per_class"]["B"] == {"precision": 0.5, "recall": 0.5, "f1": 0.5, "support": 2} and got["per_class"]["C"]["f1"] == 0
    assert got["macro_f1"] == pytest.approx((0.8 + 0.5) / 3)
    again = evaluation.evaluation(rows.repartition(3), "truth", "said", LABELS, "small", ["id"])
    assert again == got and evaluation.evaluation(rows.where("id <> 'e'"), "truth", "said", LABELS, "small", ["id"])["rows_digest"] != got["rows_digest"]
    for bad in (lambda: evaluation.evaluation(rows, "truth", "said", LABELS, " "), lambda: evaluation.evaluation(rows.limit(0), "truth", "said", LABELS, "x")):
        with pytest.raises(ValueError):
            bad()


def test_from_pictures_to_a_prediction(spark, tmp_path):
    said = evaluation.smoke(spark, str(tmp_path / "run"))
    assert said["status"] == "ok" and said == manifest.read_json(spark, str(tmp_path / "run" / "summary.json"))
    assert said["evaluation"]["n_rows"] == said["preparation"]["counts"]["per_split"]["test"] == 12
    assert said["evaluation"]["accuracy"] >= 0.9 and said["prediction"]["label"] in "ABCD"
    assert said["training"]["epochs_completed"] == len(said["training"]["history"])


def test_counts_come_from_the_pass_that_writes(spark, tmp_path, monkeypatch):
    """The same metadata as by reading again, and no reading again."""
    evaluation.put_files(prepare.fixture(spark, LABELS, 8, 64, 3), str(tmp_path / "in"))
    monkeypatch.setattr(prepare, "counts", lambda rows: pytest.fail("the table is read again"))
    said = prepare.manifests(spark, str(tmp_path / "in"), str(tmp_path / "out"), threshold=0, labels=LABELS)
    monkeypatch.undo()
    again = prepare.counts(spark.read.parquet(str(tmp_path / "out" / "splits.parquet")))
    assert {k: said[k] for k in again} == again
    rows = spark.read.parquet(str(tmp_path / "out" / "splits.parquet"))
    watched, counted = prepare.counting(rows, LABELS)
    assert "CollectMetrics" in watched._jdf.queryExecution().toString()
    watched.write.format("noop").mode("overwrite").save()
    assert counted() == again


def test_halves_are_written_with_a_record(spark, tmp_path):
    evaluation.put_files(prepare.fixture(spark, LABELS, 5, 64, 9), str(tmp_path / "in"))
    prepare.external_manifest(spark, str(tmp_path / "in"), str(tmp_path / "external.csv"), LABELS)
    record = prepare.written_halves(spark, str(tmp_path / "external.csv"), str(tmp_path / "halves"))
    assert record == manifest.read_json(spark, str(tmp_path / "halves" / "record.json"))
    assert (record["dev"]["count"], record["final"]["count"]) == (6, 9)
    dev, final = (manifest.read_split(spark, str(tmp_path / "halves" / f"{h}.csv"), "external", LABELS) for h in ("dev", "final"))
    assert prepare.manifest_digest(dev) == record["dev"]["row_digest"] and prepare.manifest_digest(final) == record["final"]["row_digest"]
    assert dev.join(final, "sha256").count() == 0
    dealt = splits.shuffled_halves(dev.drop("split").unionByName(final.drop("split")), "label", "path")
    assert {r.path for r in dealt.where("split = 'dev'").collect()} == {r.path for r in dev.collect()}
    copied = pathlib.Path(tmp_path, "in", "A", "copy.png")
    for k in range(5):  # copies of one picture on either side
        copied.with_name(f"copy{k}.png").write_bytes((tmp_path / "in" / "A" / "0000.png").read_bytes())
    prepare.external_manifest(spark, str(tmp_path / "in"), str(tmp_path / "more.csv"), LABELS)
    with pytest.raises(dedup.LeakError):
        prepare.written_halves(spark, str(tmp_path / "more.csv"), str(tmp_path / "other"))


def test_generated_pictures_are_usable_and_differ(spark):
    rows = prepare.fixture(spark, LABELS, 4, 64, 1).collect()
    again = prepare.fixture(spark, LABELS, 4, 64, 1).repartition(3).collect()
    assert len({r.content for r in rows}) == 12 and {r.path: r.content for r in rows} == {r.path: r.content for r in again}
    assert sorted(r.path for r in rows)[:2] == ["A/0000.png", "A/0001.png"] and pixels.png is not None


def test_functions_by_name(spark):
    sqlnames.register(spark)
    sqlnames.register(spark)  # again, in place of the first
    spark.createDataFrame([(1, "a b  B c " * 9, [0.1 * k * (-1) ** k for k in range(63)], " Left"), (2, None, [0.0] * 63, None), (3, "", None, "right")], "id int, said string, v array<double>, hand string").createOrReplaceTempView("named")
    got = spark.sql("SELECT id, token_grid(said) AS g, gradient_bits(token_grid(said)) AS b, hex16(gradient_bits(token_grid(said))) AS h, landmark_features(points_of(v), hand) AS f, split_key(42, 'x', 'y') AS k, hamming(7, 8) AS d FROM named ORDER BY id").collect()
    want = spark.table("named").select("id", hashing.token_grid(F.col("said")).alias("g"), hashing.gradient_bits(hashing.token_grid(F.col("said"))).alias("b"), landmarks.features(landmarks.points_of(F.col("v")), F.col("hand")).alias("f"), hashing.split_key(42, F.lit("x"), F.lit("y")).alias("k")).orderBy("id").collect()
    for a, b in zip(got, want, strict=True):
        assert (a.g, a.b, a.k, a.d) == (b.g, b.b, b.k, 4) and a.h == f"{b.b % (1 << 64):016x}"
        assert (a.f is None) == (b.f is None) and (a.f is None or max(abs(x - y) for x, y in zip(a.f, b.f, strict=True)) < 1e-12)
    ranked = spark.sql("SELECT t.* FROM VALUES (array(1D, 3D, 3D, -1D)) AS d(z), LATERAL top_k(z, 3) AS t").collect()
    assert sorted(map(tuple, ranked)) == [(1, 1, 3.0), (2, 2, 3.0), (3, 0, 1.0)]
    soft = spark.sql("SELECT softmax(array(1D, 2D)) AS p, argmax(array(1D, 5D, 5D)) AS a").first()
    assert soft.p == pytest.approx([1 / (1 + 2.718281828459045), 1 - 1 / (1 + 2.718281828459045)]) and soft.a == 1


def test_folders_of_any_classes(spark, tmp_path):
    evaluation.put_files(prepare.fixture(spark, ["cat", "a dog"], 10, 64, 2), str(tmp_path / "in"))
    (tmp_path / "in" / "notes.txt").write_text("no picture")
    (tmp_path / "in" / "cat" / "inner").mkdir()
    (tmp_path / "in" / "cat" / "inner" / "deep.png").write_bytes(b"not looked at")
    rows, names = prepare.class_folders(spark, str(tmp_path / "in"))
    got = rows.collect()
    assert names == ["a dog", "cat"] and len(got) == 20 and {(r.label, r.place) for r in got} == {("a dog", 0), ("cat", 1)}
    assert sorted((r.label, r.split) for r in got).count(("cat", "validation")) == 2
    again, _ = prepare.class_folders(spark, str(tmp_path / "in"))
    assert {r.path: r.split for r in again.repartition(4).collect()} == {r.path: r.split for r in got}
    other, _ = prepare.class_folders(spark, str(tmp_path / "in"), seed=7)
    assert {r.path for r in other.where("split = 'validation'").collect()} != {r.path for r in got if r.split == "validation"}
    with pytest.raises(manifest.LayoutError):
        prepare.class_folders(spark, str(tmp_path / "in" / "a dog"))


def test_grey_vectors(spark, tmp_path):
    from curata.operators import pictures

    evaluation.put_files(prepare.fixture(spark, ["A"], 3, 32, 5), str(tmp_path / "in"))
    rows = pictures.read(spark, str(tmp_path / "in"))
    for size in (32, 8):
        for r, own in zip(pictures.grey_vectors(rows, size).orderBy("path").collect(), rows.orderBy("path").collect(), strict=True):
            grey = pixels.grey_bytes(pictures.array_of(own.data, 32, 32, 3))
            assert len(r.features) == size * size and max(r.features) <= 1
            if size == 32:
                assert [round(v * 255) for v in r.features] == grey.ravel().tolist()
            else:
                assert abs(sum(r.features) / 64 * 255 - grey.mean()) < 2
