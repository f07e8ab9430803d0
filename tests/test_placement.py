import random

import pytest
from pyspark.sql import functions as F

from curata.operators import placement, splits

NAMES, RATIOS = ["train", "validation", "test"], [0.7, 0.15, 0.15]


def plain(groups, ratios, names):
    """{(class, key): split}: one group after the other, the split whose squared distances grow least, by their sums."""
    out = {}
    for cls in {c for c, *_ in groups}:
        own = sorted((k, n) for c, k, n in groups if c == cls)
        targets, done = splits.apportion(sum(n for _, n in own), ratios), [0] * len(names)
        for at, (key, size) in enumerate(own):
            empty = [k for k in range(len(names)) if not done[k]]
            open_to = empty if len(own) - at == len(empty) else range(len(names))

            def error(k, size=size):
                now = [d + size * (j == k) for j, d in enumerate(done)]
                return sum((a - t) ** 2 for a, t in zip(now, targets, strict=True)), done[k] - targets[k], k

            best = min(open_to, key=error)
            done[best] += size
            out[cls, key] = names[best]
    return out


def test_pour_equals_a_walk():
    draw = random.Random(1)
    for _ in range(2000):
        room, unit, amount = [draw.randint(-20, 60) for _ in range(draw.randint(1, 4))], draw.randint(1, 5), draw.randint(0, 100)
        sizes = [unit] * (amount // unit) + ([amount % unit] if amount % unit else [])
        assert placement.pour(room, amount, unit) == placement.walk(room, [None] * len(room), sizes, 10**9)[1]


def sizes_of(kind, n, draw):
    return {
        "ones": lambda: [1] * n,
        "twos": lambda: [2] * n,
        "threes": lambda: [3] * (n - 1) + [4],
        "copies": lambda: [draw.choice([1] * 8 + [2, 5]) for _ in range(n)],
        "large": lambda: [1 if draw.random() < 0.98 else draw.randint(50, 200) for _ in range(n)],
        "giant": lambda: [1] * (n // 3) + [2 * n] + [1] * (n - n // 3 - 1),
        "tail": lambda: [4 * n] + [1] * (n - 1),
    }[kind]()


@pytest.mark.parametrize("chunk", [9, 1000])
def test_chunks_give_what_a_walk_gives(spark, chunk):
    """Classes of all kinds of sizes at once, one of them 90 % of all rows, in many chunks."""
    draw, groups = random.Random(chunk), []
    for kind, n in [("ones", 40), ("twos", 150), ("threes", 60), ("copies", 1500), ("large", 120), ("giant", 90), ("tail", 30), ("ones", 3), ("copies", 4)]:
        cls = f"{kind}{n}"
        groups += [(cls, f"{draw.getrandbits(256):064x}", size) for size in sizes_of(kind, n, draw)]
    df = spark.createDataFrame([(c, k, True, s) for c, k, s in groups], "class string, key string, known boolean, size long")
    for ratios, names in [(RATIOS, NAMES), ([0.5, 0.5], ["a", "b"]), ([0.1, 0.2, 0.3, 0.4], list("wxyz"))]:
        few = {c for c in {g[0] for g in groups} if sum(g[0] == c for g in groups) < len(names)}
        got = placement.place(df.where(~F.col("class").isin(*few, "")), lambda total, r=ratios: splits.apportion(total, r), names, chunk).collect()
        assert {(r["class"], r["key"]): r["split"] for r in got} == plain([g for g in groups if g[0] not in few], ratios, names)
        assert len(got) == sum(g[0] not in few for g in groups)


def test_rows_of_any_kind(spark):
    """Nulls are a class and a content of their own, clashing columns stay, one content may hold most rows."""
    draw = random.Random(4)
    rows = [(draw.choice(["a", "b", None, ""]), draw.choice([None, "", *(f"c{k}" for k in range(60))]), f"n{k}", "old") for k in range(900)] + [("a", "hot", f"h{k}", "old") for k in range(800)]
    df = spark.createDataFrame(rows, "label string, sha string, class string, split string").withColumn("key", F.lit("mine"))
    got = splits.grouped_split(df, "label", "sha", NAMES, RATIOS, chunk_groups=7)
    assert got.columns == ["label", "sha", "class", "key", "split"]
    got = got.collect()
    assert sorted(r["class"] for r in got) == sorted(r[2] for r in rows) and all(r["key"] == "mine" for r in got)
    where = {}
    for r in got:
        assert where.setdefault((r.label, r.sha), r.split) == r.split
    whole = {r["class"]: r.split for r in splits.grouped_split(df.repartition(7), "label", "sha", NAMES, RATIOS).collect()}
    assert whole == {r["class"]: r.split for r in got}
    assert {s for (label, _), s in where.items() if label == "a"} == set(NAMES)
    assert splits.grouped_split(df.limit(0), "label", "sha", NAMES, RATIOS).collect() == []
