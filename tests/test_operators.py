import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from curata.functions import hashing, landmarks, vectors
from curata.operators import dedup, metrics, ranking, sampling, selection, splits, validate


def test_apportion_by_hand():
    assert splits.apportion(10, [0.7, 0.15, 0.15]) == [7, 2, 1]
    assert splits.apportion(3, [0.98, 0.01, 0.01]) == [1, 1, 1]
    assert splits.apportion(7, [0.98, 0.01, 0.01]) == [5, 1, 1]
    for bad in ([0.5, 0.6], [1.0], [True, 0.0], [float("nan"), 0.5]):
        with pytest.raises(ValueError):
            splits.check_ratios(bad)


def test_grouped_split_keeps_copies_together_whatever_the_partitions(spark):
    rng = random.Random(1)
    rows = [(label, f"c{label}{g}") for label in "AB" for g in range(9) for _ in range(rng.choice([1, 1, 3, 5]))]
    df = spark.createDataFrame(rows, "label string, sha string")
    names, ratios = ["train", "validation", "test"], [0.6, 0.2, 0.2]
    a = sorted(map(tuple, splits.grouped_split(df, "label", "sha", names, ratios).collect()))
    b = sorted(map(tuple, splits.grouped_split(df.orderBy(F.rand(3)).repartition(7), "label", "sha", names, ratios).collect()))
    assert a == b and len(a) == len(rows)
    by = {}
    for label, sha, split in a:
        by.setdefault((label, sha), set()).add(split)
    assert all(len(x) == 1 for x in by.values())
    assert {(label, s) for label, _, s in a} == {(label, s) for label in "AB" for s in names}
    with pytest.raises(splits.SplitError):
        splits.grouped_split(df.where("sha IN ('cA0', 'cA1')"), "label", "sha", names, ratios)


def test_closed_form_equals_the_sequential_split(spark):
    rows = spark.createDataFrame([(c, f"{c}{i}") for c, n in (("A", 3), ("B", 17), ("C", 40)) for i in range(n)], "label string, sha string")
    args = ("label", "sha", ["train", "validation", "test"], [0.7, 0.15, 0.15])
    assert sorted(map(tuple, splits.singleton_split(rows, *args).select("sha", "split").collect())) == sorted(map(tuple, splits.grouped_split(rows, *args).select("sha", "split").collect()))


def test_positions_match_a_plain_count(spark):
    ids = random.Random(2).sample(range(100_000), 500)
    rows = spark.createDataFrame([(i % 3, i) for i in ids], "g int, id long").repartition(5)
    got = {r.id: (r.pos, r.n) for r in ranking.by_number(rows, ["g"], "id", "pos", "n", width=1000).collect()}
    for g in range(3):
        own = sorted(i for i in ids if i % 3 == g)
        assert [got[i] for i in own] == [(k, len(own)) for k in range(len(own))]


@pytest.mark.parametrize("n,take", [(5, 7), (10, 3), (97, 10), (23, 22)])
def test_even_sample_is_the_spread_sample(spark, n, take):
    rows = spark.createDataFrame([("a", i) for i in range(n)], "label string, id long")
    k = min(n, take)
    want = sorted({min(int(p * (n / k)), n - 1) for p in range(k)})
    assert sorted(r.id for r in sampling.even_sample(rows, "label", "id", take).collect()) == want


def test_round_robin_and_corruptions(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("a", 3), ("b", 4), ("c", 5), ("c", 6)], "label string, id long")
    assert {r.id for r in sampling.round_robin(rows, "label", "id", 5).collect()} == {1, 4, 5, 2, 6}
    with pytest.raises(ValueError):
        sampling.with_corruption(rows, "id")
    with pytest.raises(ValueError):
        sampling.even_sample(rows, "label", "id", 0)
    assert sampling.repeated_union(rows, rows, 3).count() == 24


def test_digests_ignore_partitions(spark):
    rows = spark.range(300).withColumn("s", F.concat(F.lit("x"), "id"))
    for f in (lambda d: sampling.ordered_digest(d, ["id"], F.col("s")), lambda d: sampling.tree_digest(d, F.col("s"), 16)):
        assert f(rows).first() == f(rows.orderBy(F.rand(1)).repartition(9)).first()
        assert f(rows).first() != f(rows.where("id <> 7")).first()


@pytest.mark.parametrize("most", [0, 1, 3, 5])
def test_hamming_pairs_against_all_pairs(spark, most):
    rng = random.Random(most)
    base = [rng.getrandbits(64) for _ in range(6)] + [0, 2**64 - 1, 2**63]
    words = [b ^ sum(1 << k for k in rng.sample(range(64), rng.randrange(9))) for b in base for _ in range(8)] + [0, 0]
    signed = [w - 2**64 if w >> 63 else w for w in words]
    rows = spark.createDataFrame([(w, "ab"[k % 2]) for k, w in enumerate(signed)] + [(None, "a")], "bits long, side string")
    want = {}
    for i, x in enumerate(signed):
        for y in signed[:i]:
            d = (x ^ y).bit_count() if x >= 0 and y >= 0 else bin((x ^ y) & (2**64 - 1)).count("1")
            if d <= most:
                want[min(x, y), max(x, y)] = want.get((min(x, y), max(x, y)), 0) + 1
    got = {(r.a, r.b): r.n_pairs for r in dedup.hamming_pairs(rows, "bits", most).collect()}
    assert got == want
    across = sum(bin((x ^ y) & (2**64 - 1)).count("1") <= most for x in signed[::2] for y in signed[1::2])
    assert sum(r.n_pairs for r in dedup.hamming_pairs(rows, "bits", most, "side").collect()) == across


def test_guards_name_the_lowest_offender(spark):
    rows = spark.createDataFrame([("b", "x"), ("b", "y"), ("a", "x"), ("a", "z"), ("c", "x")], "sha string, label string")
    with pytest.raises(dedup.LeakError, match="a$"):
        dedup.refuse_spanning(rows, "sha", "label", "conflict")
    assert dedup.refuse_spanning(rows.where("sha = 'c'"), "sha", "label", "conflict").count() == 1


def test_hex_words_keep_their_sign(spark):
    for text in ("ffffffffffffffff", "8000000000000000", "0" * 16, "00000000000000ff"):
        r = spark.range(1).select(hashing.from_hex16(F.lit(text)).alias("x")).select("x", hashing.hex16(F.col("x")).alias("h")).first()
        assert r.h == text
    assert spark.range(1).select(hashing.hamming(F.lit(-1), F.lit(0))).first()[0] == 64


GOOD = ("a/b.png", "A", "train", "0" * 64, "0" * 16)


def test_row_contract(spark):
    bad = [("", "empty_field"), (None, "empty_field"), ("/a", "unsafe_path"), ("a/../b", "unsafe_path"), ("a\\b", "unsafe_path"), ("a/./b", "unsafe_path"), ("a//b", "unsafe_path")]
    rows = [(0, *GOOD)] + [(k + 1, p, *GOOD[1:]) for k, (p, _) in enumerate(bad)]
    rows += [(20, "q", "a", *GOOD[2:]), (21, "r", "A", "dev", *GOOD[3:]), (22, "s", "A", "train", "0" * 63, GOOD[4]), (23, "t", "A", "train", GOOD[3], "F" * 16), (24, *GOOD)]
    df = spark.createDataFrame(rows, "line long, path string, label string, split string, sha256 string, dhash string")
    got = {r.line: r.rule for r in validate.violations(df).collect()}
    assert got == {k + 1: rule for k, (_, rule) in enumerate(bad)} | {20: "unknown_label", 21: "unknown_split", 22: "bad_sha256", 23: "bad_dhash", 24: "repeated_path"}
    with pytest.raises(validate.ContractError, match="line 1: empty_field"):
        validate.require(df)
    assert 21 not in {r.line for r in validate.violations(df, splits=None).collect()}


def test_two_macro_f1_stay_apart(spark):
    rows = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (1, 3)], "t int, p int")
    s = metrics.summary(rows, "t", "p", [0, 1, 2, 3]).first()
    assert s.macro_f1 == pytest.approx((2 / 3 + 1 / 2) / 4) and s.macro_f1_supported == pytest.approx((2 / 3 + 1 / 2) / 2)
    assert metrics.confusion(rows, "t", "p", [0, 1, 2, 3]).count() == 16
    assert metrics.summary(rows.limit(0), "t", "p", [0, 1]).first().accuracy == 0


def test_early_stopping_by_hand(spark):
    losses = [5.0, 4.0, 4.0, 4.5, 3.9, 4, 4, 4, 1]
    rows = spark.createDataFrame([("r", i, float(v)) for i, v in enumerate(losses)], "run string, epoch int, loss double")
    got = selection.early_stopping(rows, ["run"], "epoch", "loss", 3).orderBy("epoch").collect()
    assert [r.epoch for r in got] == list(range(8)) and [r.stale for r in got] == [0, 0, 1, 2, 0, 1, 2, 3]
    assert selection.best_epoch(rows, ["run"], "epoch", "loss").first().best_epoch == 8
    with pytest.raises(ValueError, match="epoch"):
        selection.require_comparable(rows, ["run", "epoch"])


def hand(seed=0):
    rng = np.random.default_rng(seed)
    return np.column_stack([rng.uniform(0.1, 0.9, (21, 2)), rng.uniform(-0.1, 0.1, 21)])


def features(spark, *hands, sides=None):
    rows = [(k, [[float(v) for v in p] for p in h], s) for k, (h, s) in enumerate(zip(hands, sides or ["Right"] * len(hands), strict=True))]
    df = spark.createDataFrame(rows, "id int, p array<array<double>>, side string")
    return [r.f and np.array(r.f) for r in df.select("id", landmarks.features(F.col("p"), F.col("side")).alias("f")).orderBy("id").collect()]


def test_landmark_features_do_not_change_with_place_size_turn_or_side(spark):
    h = hand()
    a = 0.7
    turn = np.array([[np.cos(a), -np.sin(a), 0], [np.sin(a), np.cos(a), 0], [0, 0, 1]])
    base, moved, larger, turned, left, flat, few = features(spark, h, h + [0.3, -1, 2], h * 3.5, h @ turn.T, h * [-1, 1, 1], np.ones((21, 3)), h[:10], sides=["Right", None, "right", "R", "  LEFT hand", "Right", "Right"])
    assert len(base) == 79 and flat is None and few is None
    for other in (moved, larger, turned, left):
        assert np.allclose(base, other, atol=1e-9)
    points = base[:63].reshape(21, 3)
    assert np.allclose(points[0], 0) and np.linalg.norm(points, axis=1).max() == pytest.approx(1) and points[9][0] == pytest.approx(0) and points[9][1] < 0


def test_vectors(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    x = vectors.vector([1.0, 3.0, 3.0])
    assert one(vectors.argmax(x)) == 1
    assert [r.place for r in one(vectors.top_k(x, 2))] == [1, 2]
    assert sum(one(vectors.softmax(vectors.vector([1000.0, 999.0])))) == pytest.approx(1)
    values = one(vectors.lcg(3))
    state, want = 42, []
    for _ in range(3):
        state = (state * 1664525 + 1013904223) % 2**32
        want.append(state / 2**32 * 2 - 1)
    assert values == pytest.approx(want)


@pytest.mark.parametrize("side", [None, "side"])
def test_keys_of_fingerprints_are_never_broadcast(spark, side):
    rows = spark.range(300).select((F.col("id") * 3).alias("bits"), F.concat(F.lit("s"), F.col("id") % 2).alias("side"))
    plan = dedup.hamming_pairs(rows, "bits", 5, side)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


@pytest.mark.parametrize("side", [None, "side"])
def test_fingerprints_are_computed_once(spark, side, monkeypatch):
    plans = []
    monkeypatch.setattr(dedup, "settled", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or df)
    rows = spark.range(50).select(F.crc32(F.when(F.col("id") % 7 > 0, (F.col("id") % 30).cast("string"))).alias("bits"), F.concat(F.lit("s"), F.col("id") % 2).alias("side"))
    pairs = dedup.hamming_pairs(rows, "bits", 5, side)
    assert [p.count("crc32") for p in plans] == [1]
    assert pairs.where("a IS NULL OR b IS NULL").count() == 0
