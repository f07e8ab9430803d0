import random

import pytest
from pyspark.sql import functions as F

from curata.functions import hashing, landmarks
from curata.operators import pictures, ranking, sampling, selection, splits, validate


@pytest.mark.parametrize("bad", [[0.5, 0.6], [1.0, 0.0], [True, 0.0], ["a", 0.5], [float("nan"), 0.5]])
def test_ratios_that_are_none(bad):
    with pytest.raises(ValueError):
        splits.check_ratios(bad)
    assert splits.check_ratios([0.5, 0.25, 0.25]) == [0.5, 0.25, 0.25]


def test_shuffled_halves_follow_the_shuffle_of_sorted_paths(spark):
    paths = {x: [f"{x}/{k}.png" for k in range(n)] for x, n in (("A", 7), ("B", 10), ("C", 1))}
    rows = spark.createDataFrame([(p, x) for x, own in paths.items() for p in own], "path string, label string").repartition(3)
    got = {r.path: r.split for r in splits.shuffled_halves(rows, "label", "path", 42).collect()}
    for x, own in paths.items():
        order = list(range(len(own)))
        random.Random(f"42:{x}").shuffle(order)
        first = {sorted(own)[k] for k in order[: len(own) // 2]}
        assert {p for p in own if got[p] == "dev"} == first


def test_runs_are_comparable_and_complete(spark):
    runs = spark.createDataFrame([("a", 1, "x"), ("b", 1, "y")], "run string, size int, kind string")
    assert selection.require_comparable(runs, ["size"]).count() == 2
    with pytest.raises(ValueError, match="kind"):
        selection.require_comparable(runs, ["size", "kind"])
    history = spark.createDataFrame([("a", 1, 0.5), ("a", 2, 0.4), ("c", 1, 0.1)], "run string, epoch int, loss double")
    metadata = spark.createDataFrame([("a", 2), ("b", 1)], "run string, best_epoch int")
    assert [(r.run, r.loss) for r in selection.complete_runs(history, metadata, "run").collect()] == [("a", 0.4)]
    row = spark.createDataFrame([(0.12345,), (None,)], "v double").select(selection.percent(F.col("v")).alias("p")).collect()
    assert [r.p for r in row] == ["12.35%", "n/a"]


def test_spread_numbers_make_few_chunks(spark, monkeypatch):
    monkeypatch.setattr(ranking, "CHUNKS", 8)
    keys = [k * 10**12 + k % 7 for k in range(-50, 50)]
    rows = spark.createDataFrame([(k,) for k in keys], "k long").repartition(4)
    got = {r.k: r.pos for r in ranking.by_number(rows, [], "k").collect()}
    assert got == {k: i for i, k in enumerate(sorted(keys))}
    assert ranking.by_number(rows.limit(0), [], "k").collect() == []


def test_digests_of_row_sets_ignore_their_order(spark, monkeypatch):
    rows = spark.createDataFrame([(k, f"line {k}\n") for k in range(50)], "k int, said string")
    digest = lambda r: sampling.row_set_digest(r, F.col("said")).first()
    one = digest(rows)
    assert one == digest(rows.repartition(5)) and one.n_rows == 50 and one != digest(rows.where("k > 0"))
    monkeypatch.setattr(sampling, "ORDERED_ROWS", 10)
    assert digest(rows) == one
    with pytest.raises(ValueError):
        sampling.ordered_digest(rows, ["k"], F.col("said"))


def test_points_as_structs(spark):
    values = [0.1 * k * (-1) ** k for k in range(63)]
    rows = spark.createDataFrame([(values, [tuple(values[3 * i : 3 * i + 3]) for i in range(21)])], "v array<double>, p array<struct<x:double,y:double,z:double>>")
    both = rows.select(landmarks.features(landmarks.points_of(F.col("v")), F.lit("right")).alias("a"), landmarks.features(landmarks.points_from_structs(F.col("p")), F.lit("right")).alias("b")).first()
    assert both.a == both.b and len(both.a) == 79


@pytest.mark.parametrize("sizes", [{"A": 1, "B": 2, "C": 7, "D": 500, None: 40}])
def test_halves_by_pointers_equal_the_shuffle(spark, sizes):
    """Every place of every class, and the halves, against Python's own shuffle."""
    import random

    from curata.operators import shuffling

    counts = spark.createDataFrame(list(sizes.items()), "label string, n long")
    got = {}
    for r in shuffling.order(counts, 42).collect():
        got.setdefault(r.label, {})[r.at] = r.place
    for label, n in sizes.items():
        order = list(range(n))
        random.Random(f"42:{label}").shuffle(order)
        assert [got[label][k] for k in range(n)] == order
    paths = {label: sorted(f"{label}/{(k * 7919) % 1000:03d}é{k}" for k in range(n)) for label, n in sizes.items()}
    rows = spark.createDataFrame([(label, p) for label, own in paths.items() for p in own], "label string, path string").repartition(5)
    dealt = {(r.label, r.path): r.split for r in splits.shuffled_halves(rows, "label", "path").collect()}
    for label, own in paths.items():
        order = list(own)
        random.Random(f"42:{label}").shuffle(order)
        assert {p for p in own if dealt[label, p] == "dev"} == set(order[: len(own) // 2])
    assert shuffling.order(counts.limit(0), 42).collect() == [] and splits.shuffled_halves(rows.limit(0), "label", "path").collect() == []


def test_cells_of_words_against_loops(spark):
    import hashlib

    words = ["a", "b b", "  Mixed case\nlines\t", "", None, "same " * 500, "é 漢字 x" * 9]
    rows = spark.createDataFrame([(k, w) for k, w in enumerate(words)], "k int, w string")
    for r in rows.withColumn("g", hashing.token_grid(F.col("w"))).collect():
        want = [0] * 72
        for w in (r.w or "").lower().split():
            want[int(hashlib.md5(w.encode()).hexdigest()[:4], 16) % 72] += 1
        assert r.g == want


def test_networks_have_a_limit():
    with pytest.raises(ValueError):
        pictures.Cnn((96, 192, 384))


def test_known_classes(spark):
    rows = spark.createDataFrame([("A",), ("del",), (None,)], "label string")
    assert validate.known_classes(rows, "label", validate.LABELS).collect() == [("A",)]
