import json

import numpy as np
import pytest
from pyspark.errors import PySparkException

from curata.functions import blobs, vectors
from curata.operators import exchange, pictures
from curata.sources import arrays, manifest


@pytest.fixture(scope="module")
def sources(spark):
    arrays.register(spark)
    return spark


@pytest.mark.parametrize("save", [np.savez, np.savez_compressed])
def test_npz_files_come_back_row_by_row(sources, tmp_path, save):
    draw = np.random.default_rng(1)
    kinds = {"features": draw.normal(0, 1, (1000, 7)).astype("f4"), "labels": draw.integers(0, 26, 1000), "flags": draw.random(1000) < 0.5, "small": draw.integers(0, 255, (1000, 2)).astype("u1"), "big_endian": draw.normal(0, 1, 1000).astype(">f8")}
    save(tmp_path / "x.npz", **kinds)
    df = sources.read.format("npz").option("size", 7).option("rows", 300).load(str(tmp_path / "x.npz"))
    assert df.dtypes == [("big_endian", "double"), ("features", "array<float>"), ("flags", "boolean"), ("labels", "bigint"), ("small", "array<smallint>")]
    assert df.rdd.getNumPartitions() == 4
    rows = df.collect()
    for name, x in kinds.items():
        assert np.array_equal(np.array([r[name] for r in rows]), x), name
    table = str(tmp_path / "features")
    numbered = df.selectExpr("concat('p', labels) AS path", "concat('c', labels % 3) AS label", "features")
    assert manifest.write_features(numbered, table).first().considered == 1000
    assert manifest.read_features(sources, [table], size=7).count() == 1000
    assert sources.read.format("npz").load(f"file://{tmp_path}/x.npz").count() == 1000


def test_npz_files_that_are_not_as_expected_are_refused(sources, tmp_path):
    np.savez(tmp_path / "unlike.npz", features=np.zeros((3, 2)), labels=np.zeros(4))
    np.savez(tmp_path / "empty.npz", features=np.zeros((0, 2)))
    np.savez(tmp_path / "deep.npz", features=np.zeros((3, 2, 2)))
    np.savez(tmp_path / "words.npz", features=np.array(["a", "b"]))
    np.savez(tmp_path / "columns.npz", features=np.asfortranarray(np.arange(6.0).reshape(3, 2)))
    np.savez(tmp_path / "good.npz", features=np.zeros((3, 2)))
    (tmp_path / "text.npz").write_bytes(b"no archive")
    for name, said in [("unlike", "unlike length"), ("empty", "no rows"), ("deep", "rows of numbers"), ("words", "rows of numbers"), ("columns", "rows of numbers"), ("text", "no .npz")]:
        with pytest.raises(PySparkException, match=said):
            sources.read.format("npz").load(str(tmp_path / f"{name}.npz"))
    with pytest.raises(PySparkException, match="not 79"):
        sources.read.format("npz").option("size", 79).load(str(tmp_path / "good.npz"))


def blob(tmp_path, parts, **more):
    registry, raw = blobs.pack(parts)
    (tmp_path / "b.f32").write_bytes(raw)
    (tmp_path / "b.json").write_text(json.dumps(registry | more))
    return registry, raw


def test_blobs_come_back_tensor_by_tensor(sources, tmp_path):
    parts = {"a": np.arange(10.0).reshape(2, 5), "long": np.arange(5000.0) / 7, "none": np.zeros((0, 3)), "one": np.array(3.5)}
    blob(tmp_path, parts)
    read = lambda **o: sources.read.format("float_blob").options(registry=str(tmp_path / "b.json"), **o).load(str(tmp_path / "b.f32"))
    df = read(values=1024, format=blobs.PICTURES)
    assert df.rdd.getNumPartitions() == 1 + 5 + 1 + 1
    for name, x in parts.items():
        own = sorted(df.where(df.name == name).collect(), key=lambda r: r.start)
        assert own[0].shape == list(x.shape) and np.allclose([v for r in own for v in r.data], x.ravel().astype("f4"))
    with pytest.raises(PySparkException, match="not 'other'"):
        read(format="other")
    registry, raw = blob(tmp_path, parts, float_count=9)
    with pytest.raises(PySparkException, match="values in the registry"):
        read()
    registry["tensors"][0]["shape"] = [3, 5]
    (tmp_path / "b.json").write_text(json.dumps(registry))
    with pytest.raises(PySparkException, match="does not lie in the blob"):
        read()


def test_networks_travel_with_digest_and_outputs(spark, tmp_path):
    model = pictures.Cnn((4, 6), 3, seed=5)
    path, names = str(tmp_path / "out" / "net"), ["x", "y", "z"]
    registry = exchange.export(model, path, names, size=16, source="test")
    assert registry["source"] == "test" and len(registry["parity"]["expected"]) == 3
    back, said = exchange.load(spark, path, names)
    assert said == registry
    x = np.random.default_rng(2).normal(0, 1, (3, 16, 16))
    assert np.allclose(back.forward(x), model.forward(x), atol=1e-4)
    assert np.allclose(exchange.parity_input(16).ravel(), spark.range(1).select(vectors.lcg(768)).first()[0], atol=1e-7)
    with pytest.raises(blobs.BlobError, match="other classes"):
        exchange.load(spark, path, ["a"])

    raw = (tmp_path / "out" / "net.f32").read_bytes()
    spoiled = bytearray(raw)
    spoiled[103] ^= 0x40
    (tmp_path / "out" / "net.f32").write_bytes(bytes(spoiled))
    with pytest.raises(blobs.BlobError, match="bytes"):
        exchange.load(spark, path)
    (tmp_path / "out" / "net.f32").write_bytes(raw[:-4])
    with pytest.raises(PySparkException, match="values in the registry"):
        exchange.load(spark, path)
    (tmp_path / "out" / "net.f32").write_bytes(raw)
    changed = json.loads((tmp_path / "out" / "net.json").read_text())
    changed["parity"]["expected"][0] += 1e-4
    (tmp_path / "out" / "net.json").write_text(json.dumps(changed))
    with pytest.raises(blobs.BlobError, match="outputs"):
        exchange.load(spark, path)
    changed["tensors"] = changed["tensors"][1:]
    (tmp_path / "out" / "net.json").write_text(json.dumps(changed))
    with pytest.raises(blobs.BlobError, match="missing"):
        exchange.load(spark, path)
