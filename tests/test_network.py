import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from curata.functions import vectors
from curata.operators import network, pictures, training

SMALL = network.Settings(epochs=12, batch=32, rate=1e-2, hidden=(16, 8), patience=4, batches_a_step=2)


def rings(n, seed=0, noise=0.15):
    """Three rings around each other: no straight line parts them."""
    draw, rows = np.random.default_rng(seed), []
    for k in range(n):
        radius, angle = 1 + k % 3 + draw.normal(0, noise), draw.uniform(0, 2 * math.pi)
        rows.append((f"r{k}", [radius * math.cos(angle), radius * math.sin(angle)], k % 3 + 5))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "id string, x array<double>, label int")


def test_gradients_against_differences():
    draw = np.random.default_rng(3)
    model = pictures.Mlp((4, 6, 5, 3), 1)
    model.norms = [(draw.normal(1, 0.2, len(g)), draw.normal(0, 0.2, len(g)), m, v) for g, _, m, v in model.norms]
    x, y = draw.normal(0, 1, (9, 4)), draw.integers(0, 3, 9)
    keep = [(draw.random((9, h)) >= 0.3) / 0.7 for h in (6, 5)]
    loss, grad, seen = network.gradients(model, x, y, keep)
    values = network.flat(model)
    assert grad.shape == values.shape and len(seen) == 2 * (6 + 5)
    for k in range(len(values)):
        sides = []
        for step in (1e-6, -1e-6):
            moved = values.copy()
            moved[k] += step
            network.filled(model, moved)
            sides.append(network.gradients(model, x, y, keep)[0])
        assert abs((sides[0] - sides[1]) / 2e-6 - grad[k]) < 1e-4 * max(1, abs(grad[k])), k
    network.filled(model, values)
    first = x @ model.layers[0][0].T + model.layers[0][1]
    assert np.allclose(seen[:6], first.mean(0)) and np.allclose(seen[6:12], first.var(0, ddof=1))
    assert np.allclose(network.flat(model), values) and loss > 0


def test_the_loss_is_the_smoothed_cross_entropy(spark):
    """Without hidden layers' help: one linear layer, against the library's own Column expressions."""
    model = pictures.Mlp((2, 3), 0)
    x, y = np.array([[1.0, 2.0], [-1.0, 0.5]]), np.array([2, 0])
    loss, _, _ = network.gradients(model, x, y, [])
    z = spark.createDataFrame([(r.tolist(), int(k)) for r, k in zip(model.forward(x), y, strict=True)], "z array<double>, y int")
    want = z.select(F.sum(vectors.cross_entropy(vectors.softmax(F.col("z")), F.col("y"), 0.05))).first()[0]
    assert abs(loss - want) < 1e-9


def test_weights_do_not_depend_on_partitions(spark):
    rows = rings(240)
    fits = []
    for n in (1, 4, 7):
        df = frame(spark, random.Random(n).sample(rows, len(rows))).repartition(n)
        fits.append(network.fit(df.where("id < 'r8'"), df.where("id >= 'r8'"), "id", "x", "label", SMALL))
    for other in fits[1:]:
        assert np.abs(network.flat(other.model) - network.flat(fits[0].model)).max() < 1e-9
        assert [h["epoch"] for h in other.history] == [h["epoch"] for h in fits[0].history]
        assert all(np.allclose(a, b) for p, q in zip(other.model.norms, fits[0].model.norms, strict=True) for a, b in zip(p, q, strict=True))


def test_training_learns_and_stops(spark):
    train, held = frame(spark, rings(400)), frame(spark, rings(150, 1))
    settings = network.Settings(epochs=40, batch=64, batches_a_step=2, rate=2e-2, hidden=(24, 12), dropout=0.1, patience=6)
    fitted = network.fit(train, held, "id", "x", "label", settings)
    assert fitted.classes == [5, 6, 7] and len(fitted.history) <= 40
    best = min(fitted.history, key=lambda h: h["validation_loss"])
    assert fitted.best_epoch == best["epoch"] and fitted.best_loss == best["validation_loss"]
    assert len(fitted.history) in (40, fitted.best_epoch + 6) and best["accuracy"] > 0.85
    assert [h["rate"] for h in fitted.history][:2] == [2e-2, 1e-2 * (1 + math.cos(math.pi / 40))]
    scored = network.predict(held.withColumn("logits", F.lit("own")), fitted, "x", "named")
    right = scored.where("named = label").count() / 150
    assert right == pytest.approx(best["accuracy"]) and scored.where("logits != 'own'").count() == 0
    assert network.predict(frame(spark, [("a", None, 5)]), fitted, "x", "named").first().named is None


def test_networks_are_saved_with_their_contract(spark, tmp_path):
    df = frame(spark, rings(60))
    fitted = network.fit(df, df, "id", "x", "label", network.Settings(epochs=2, batch=30, hidden=(4,), patience=2))
    said = network.save(fitted, spark, str(tmp_path / "net"), {"feature_contract": "plane-2"})
    model, back = network.load(spark, str(tmp_path / "net"), {"feature_contract": "plane-2"})
    assert back == said and back["parameter_count"] == fitted.model.parameters() and back["best_epoch"] == fitted.best_epoch
    x = np.random.default_rng(0).normal(0, 1, (5, 2))
    assert np.array_equal(model.forward(x), fitted.model.forward(x))
    with pytest.raises(training.ModelError):
        network.load(spark, str(tmp_path / "net"), {"feature_contract": "other"})
    with pytest.raises(training.ModelError):
        network.save(fitted, spark, str(tmp_path / "net2"), {"classes": []})


def test_what_no_run_takes(spark):
    for bad in ({"epochs": 0}, {"batch": 1}, {"rate": 0}, {"dropout": 1}, {"jitter": -1}, {"patience": 0}, {"hidden": (0,)}):
        with pytest.raises(network.TrainingError):
            network.Settings(**bad)
    df = frame(spark, rings(30))
    one = frame(spark, [("a", [1.0, 2.0], 1), ("b", [1.0], 2), ("c", None, 2), ("d", [0.0, 1.0], None)])
    for train, held in [(df.limit(0), df), (df, df.limit(0)), (df.where("label = 5"), df), (one, one), (df.where("id IN ('r1', 'r2')"), one)]:
        with pytest.raises(network.TrainingError):
            network.fit(train, held, "id", "x", "label", SMALL)


def test_sums_in_a_tree(spark):
    def each(batches):
        import pyarrow as pa

        for b in batches:
            total = np.array([sum(b.column(0).to_pylist()), b.num_rows], "<f8")
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sum"])

    parts = spark.range(400, numPartitions=150).mapInArrow(each, "sum binary")
    found = network._sum_tree(parts)
    assert len(found) <= network.FAN_IN and np.allclose(np.sum(found, 0), [400 * 399 / 2, 400])


def test_fourier_features_come_close_to_the_kernel(spark):
    draw, gamma, n = np.random.default_rng(5), 0.3, 2000
    x = draw.normal(0, 1, (12, 5))
    plan = vectors.fourier_plan(5, n, gamma)
    df = spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(x)], "k int, x array<double>")
    got = {r.k: np.array(r.z) for r in df.select("k", vectors.fourier_features(F.col("x"), plan).alias("z")).collect()}
    for i in range(12):
        for j in range(12):
            assert abs(got[i] @ got[j] - math.exp(-gamma * ((x[i] - x[j]) ** 2).sum())) < 5 / math.sqrt(n)
    assert df.select(vectors.fourier_features(F.lit(None).cast("array<double>"), plan).alias("z")).first().z is None


def test_kernel_machine_parts_what_no_line_parts(spark, tmp_path):
    train, held = frame(spark, rings(400)).withColumn("label", F.col("label") - 5), frame(spark, rings(150, 1)).withColumn("label", F.col("label") - 5)
    machine = training.rbf_svc(train.withColumn("fourier", F.lit("own")), "x", "label", n=64, gamma=0.5)
    scored = machine.apply(held.withColumn("fourier", F.lit("own")), "x")
    assert set(scored.columns) == {"id", "x", "label", "fourier", "prediction"}
    right = scored.where("prediction = label").count() / 150
    line = training.apply(training.linear_svc(train, "x", "label"), held, "x").where("prediction = label").count() / 150
    assert right > 0.85 and line < 0.6
    size, scale = training.kernel_scale(train, "x")
    values = np.concatenate([r[1] for r in rings(400)])
    assert size == 2 and scale == pytest.approx(1 / (2 * values.var()))
    machine.save(str(tmp_path / "m"), {"kind": "rbf"})
    back = training.load_kernel_machine(spark, str(tmp_path / "m"), {"kind": "rbf"})
    assert sorted(map(tuple, back.apply(held, "x").select("id", "prediction").collect())) == sorted(map(tuple, scored.select("id", "prediction").collect()))
    for bad in (train.limit(0), frame(spark, [("a", [1.0], 0), ("b", [1.0, 2.0], 1)])):
        with pytest.raises(ValueError):
            training.rbf_svc(bad, "x", "label")
