import time

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from curata.operators import network
from curata.streaming import scoring


def test_files_are_digested_once_over_restarts(spark, tmp_path):
    import hashlib

    folder, out = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()
    for k in range(5):
        (folder / f"a{k}.bin").write_bytes(bytes([k]) * 10)
    run = lambda: scoring.into(scoring.arriving_files(spark, str(folder), "*.bin", at_once=2), out, str(tmp_path / "state")).awaitTermination()
    run()
    assert spark.read.parquet(out).count() == 5
    (folder / "late.bin").write_bytes(b"late")
    (folder / "other.txt").write_bytes(b"not asked for")
    run()
    run()
    got = spark.read.parquet(out).collect()
    want = [bytes([k]) * 10 for k in range(5)] + [b"late"]
    assert sorted(r.sha256 for r in got) == sorted(hashlib.sha256(x).hexdigest() for x in want)
    assert spark.read.parquet(out).select("batch").distinct().count() == 4


def test_a_stream_is_scored_once_though_it_fails_midway(spark, tmp_path):
    rows = [(f"r{k}", [float(k % 2), 1.0 - k % 2], k % 2) for k in range(60)]
    train = spark.createDataFrame(rows, "id string, x array<double>, label int")
    fitted = network.fit(train, train, "id", "x", "label", network.Settings(epochs=40, batch=20, batches_a_step=1, hidden=(8,), rate=5e-2, dropout=0, patience=40))
    source, out, state = str(tmp_path / "rows"), str(tmp_path / "scored"), str(tmp_path / "state")
    train.repartition(6).write.parquet(source)
    stream = lambda: spark.readStream.schema(train.schema).option("maxFilesPerTrigger", 1).parquet(source)
    tries, told = [], []

    def score(batch):
        tries.append(batch.count())
        scored = network.predict(batch, fitted, "x")
        if len(tries) == 3:  # part of the batch is written when the query is lost
            scored.limit(2).write.mode("overwrite").parquet(f"{out}/batch=2")
            raise RuntimeError("lost")
        return scored

    listener = scoring.Progress(told.append)
    spark.streams.addListener(listener)
    with pytest.raises(StreamingQueryException):
        scoring.into(stream(), out, state, score).awaitTermination()
    scoring.into(stream(), out, state, score).awaitTermination()
    got = spark.read.parquet(out)
    assert got.count() == 60 and got.select("id").distinct().count() == 60
    assert got.where(F.col("prediction") == F.col("label")).count() == 60
    assert len(tries) == 7
    for _ in range(50):
        if sum(t["rows"] for t in told) >= 60:
            break
        time.sleep(0.2)
    spark.streams.removeListener(listener)
    assert {t["batch"] for t in told if t["rows"]} >= {0, 1, 2, 3, 4, 5}
