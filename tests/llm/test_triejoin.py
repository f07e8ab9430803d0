import random
import re

import numpy as np
import pytest

from curata.llm import shingles as sh
from curata.llm import triejoin as tj

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_set(text):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def plain_components(rows):
    sets = [plain_set(t) for _, t in rows]
    label = list(range(len(rows)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            o = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * o >= 80 * (len(sets[i]) + len(sets[j]) - o):
                label[find(i)] = find(j)
    lowest = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            lowest[find(i)] = min(d, lowest.get(find(i), d))
    return sorted(((d, len(sets[i]), d if not sets[i] else lowest.get(find(i))) for i, (d, _) in enumerate(rows)), key=str)


def near(rng, words, changes):
    out = list(words)
    for _ in range(changes):
        out[rng.randrange(len(out))] = f"z{rng.randrange(10**6)}"
    return " ".join(out)


def corpus(seed):
    rng = random.Random(seed)
    rows = []
    shared = [f"common{k}" for k in range(30)]
    for g in range(12):
        base = [f"w{rng.randrange(300)}" for _ in range(rng.choice([3, 5, 8, 40, 90]))]
        for c in range(rng.choice([1, 2, 6, 20])):
            text = near(rng, base, c % 4)
            rows.append(text.upper() if c % 5 == 4 else text + (" " + " ".join(shared) if g % 3 == 0 else ""))
    rows += ["", None, " \n\t", "one", "one", "ONE", "a b c d", "é É", "x\x00y z"] + ["long " + " ".join(f"v{k}" for k in range(20_000))] * 2
    rng.shuffle(rows)
    return list(enumerate(rows)) + [(None, rows[0]), (None, "only me without a number here"), (3, rows[3])]


@pytest.mark.parametrize("seed,block", [(1, 512), (2, 4)])
def test_components_against_all_pairs(spark, seed, block):
    rows = corpus(seed)
    docs = spark.createDataFrame([(*r, "x", "x") for r in rows], "doc_id long, text string, node string, n string")
    got = tj.near_duplicates(docs, tj.Settings(block=block, gathered=block * 4, bucket_bytes=block * 200)).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == plain_components(rows)


def test_tries_alone_find_all(spark, monkeypatch):
    """Without any star, the tries must bring up every link."""
    rows = corpus(3)
    whole = tj.first_meetings
    monkeypatch.setattr(tj, "first_meetings", lambda heads, elements, s: whole(heads, elements, s).limit(0))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = tj.near_duplicates(docs, tj.Settings(block=4, few=6, gathered=100, bucket_bytes=3000)).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == plain_components(rows)


def test_one_large_group_of_near_copies(spark):
    """A third of all rows share most of their words, and one passage is in every text."""
    rng = random.Random(8)
    base, passage = [f"b{k}" for k in range(60)], " ".join(f"p{k}" for k in range(12))
    rows = [near(rng, base, k % 5) + " " + passage for k in range(90)] + [" ".join(f"u{rng.randrange(10**6)}" for _ in range(40)) + " " + passage for _ in range(180)]
    rows = list(enumerate(rows))
    got = tj.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), tj.Settings(block=16, few=12, gathered=2000, bucket_bytes=20_000)).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == plain_components(rows)


def test_empty_table(spark):
    assert tj.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    assert tj.near_duplicates(spark.createDataFrame([(1, None)], "doc_id long, text string")).collect() == [(1, 0, 1)]


def test_chain_of_links_is_one_component(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 99), (5, 5)], "a long, b long")
    got = {r.node: r.label for r in tj.components(links).collect()}
    assert all(got[k] == 0 for k in range(41)) and got[100] == got[99] == 99


def similar_pairs(sets):
    return {(a, b) for a in range(len(sets)) for b in range(a) if sh.alike(len(np.intersect1d(sets[a], sets[b])), len(sets[a]), len(sets[b]), 80)}


def brought_up(sets, sides=None, whole=False):
    """What the tries of all elements bring up, all elements counting as shared."""
    heads = [x[: len(x) - sh.least_partner(len(x), 80) + 1] for x in sets]
    rows = [(k.to_bytes(4, "big"), k.to_bytes(4, "big"), len(x), len(x), h) for k, (x, h) in enumerate(zip(sets, heads, strict=True))]
    found = set()
    for element in np.unique(np.concatenate(heads)).tolist():
        own = [k for k, h in enumerate(heads) if element in h]
        pairs = tj.candidates_of_group(element, [rows[k] for k in own], sides and [sides[k] for k in own], 80, [sets[k] for k in own] if whole else None)
        pairs = [(int.from_bytes(b, "big"), int.from_bytes(a, "big")) for a, b in pairs]
        assert not found & set(pairs) and len(set(pairs)) == len(pairs)
        found |= set(pairs)
    return found


def test_tries_lose_no_pair():
    rng = np.random.default_rng(4)
    base = np.unique(rng.integers(0, 10**6, 60))
    sets = [np.unique(np.concatenate([rng.choice(base, 50, replace=False), rng.integers(0, 10**6, k % 12)])) for k in range(40)] + [base, base[:1]]
    want = similar_pairs(sets)
    assert want and want <= brought_up(sets)
    sides = [k % 2 for k in range(len(sets))]
    found = brought_up(sets, sides)
    assert {p for p in want if sides[p[0]] != sides[p[1]]} <= found and all(sides[a] != sides[b] for a, b in found)


def test_tries_with_whole_sets_yield_links_only():
    rng = np.random.default_rng(9)
    base = np.unique(rng.integers(0, 10**6, 60))
    sets = [np.unique(np.concatenate([rng.choice(base, 48, replace=False), rng.integers(0, 10**6, k % 16)])) for k in range(60)]
    want, got = similar_pairs(sets), brought_up(sets, whole=True)
    assert got <= want

    def groups(pairs):
        label = list(range(len(sets)))
        for a, b in pairs:
            label = [label[a] if x == label[b] else x for x in label]
        return label

    same = lambda x: {frozenset(k for k, v in enumerate(x) if v == w) for w in x}
    assert same(groups(want)) == same(groups(got))


def test_tries_leave_sets_with_one_passage_apart():
    rng = np.random.default_rng(5)
    sets = [np.unique(np.concatenate([np.arange(8), rng.integers(10**3, 10**6, 122)])) for _ in range(50)]
    assert not brought_up(sets)


@pytest.mark.parametrize("seed", range(6))
def test_lengthened_copies_are_brought_up(seed):
    """A set with 8 to 25 % rare elements put first, beside a group of near copies."""
    rng = np.random.default_rng(seed)
    for n in [10, 11, 16, 20, 40, 100, 101, 250]:
        base = np.unique(rng.integers(10**6, 2 * 10**6, n))
        near = [base] + [np.unique(np.append(np.delete(base, k), 10**7 + k)) for k in range(int(rng.integers(3, 6)))]
        longer = [np.unique(np.append(rng.integers(0, 10**6, max(1, len(base) * share // 100)), base)) for share in (8, 10, 15, 20, 25)]
        assert similar_pairs(near + longer) <= brought_up(near + longer), n


def test_similar_sets_share_enough_of_what_they_send():
    rng, s = np.random.default_rng(6), tj.Settings()
    for n in [*range(1, 30), 57, 100, 333]:
        for _ in range(20):
            a = np.unique(rng.integers(0, 2**62, n))
            b = np.unique(np.append(rng.permutation(a)[: len(a) - int(rng.integers(0, n // 5 + 1))], rng.integers(0, 2**62, int(rng.integers(0, n // 5 + 1)))))
            if sh.alike(len(np.intersect1d(a, b)), len(a), len(b), 80):
                both = len(np.intersect1d(a[: s.sent(len(a))], b[: s.sent(len(b))]))
                assert both >= s.answered(len(a)) and both >= s.answered(len(b))


def test_shingles_follow_the_words():
    for text in ["A b\tc d e F", "a", "", None, "a b c d", "x y x y x y x y", "é è ü word"]:
        assert len(sh.shingles(text)) == len(plain_set(text))
    assert set(sh.shingles("A B C d e f")) == set(sh.shingles("a  b c\nd E f "))


def test_first_tries_give_each_set_its_lowest_partner():
    """Against all pairs: one row a set at most, its hub never higher and always one that may be similar."""
    rng = np.random.default_rng(8)
    base = np.unique(rng.integers(0, 10**6, 60))
    sets = [np.unique(np.concatenate([rng.choice(base, 55, replace=False), [10**7 + k]])) for k in range(30)] + [np.unique(np.append(rng.integers(10**6, 10**8, 55), base[:5])) for _ in range(10)]
    heads = [x[: len(x) - sh.least_partner(len(x), 80) + 1] for x in sets]
    similar = similar_pairs(sets) | {(b, a) for a, b in similar_pairs(sets)}
    for element in base[:12].tolist():
        own = [k for k, h in enumerate(heads) if element in h]
        if len(own) < 2:
            continue
        got = tj.lowest_partners([(k.to_bytes(4, "big"), len(sets[k]), len(sets[k]), heads[k]) for k in own], 80)
        found = {int.from_bytes(n, "big"): int.from_bytes(h, "big") for h, n in got}
        assert len(found) == len(got) and all(h < n for n, h in found.items())
        for n in own:
            low = min((k for k in own if (k, n) in similar), default=n)
            if low < n:
                assert found[n] <= low


def test_most_links_of_copies_come_from_the_tries(spark, monkeypatch):
    """What the first tries find on a table of near copies, and what the others have left to do."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    seen = {}
    first, apart = tj.first_meetings, tj.still_apart
    monkeypatch.setattr(tj, "first_meetings", lambda *a: seen.setdefault("first", first(*a)))
    monkeypatch.setattr(tj, "still_apart", lambda *a: seen.setdefault("apart", apart(*a)))
    got = tj.near_duplicates(docs).collect()
    linked = sum(r.component_id != r.doc_id for r in got)
    assert linked and seen["first"].count() > 0 and not hasattr(tj, "stars")
