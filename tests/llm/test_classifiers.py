import collections
import math
import re

import numpy as np
import pytest

from curata.llm import attention, charcodes, divergence, langid, sampling
from curata.llm.queries import op2_attention, op7_langid

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, score string, kept string, n_words string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "x", "x") for r in rows], SCHEMA)


def test_language_of_held_out_documents(spark):
    got = op7_langid(spark, SF).toPandas()
    want = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").toPandas()
    both = got.merge(want, on="doc_id")
    assert len(both) == len(want)
    apart = both[both.held_out]
    assert len(apart) > 150 and (apart.lang == apart.lang_pred).mean() > 0.97
    assert got.score.between(0, 1).all()


def test_language_edges(spark):
    rows = [(i, w * 20, lang) for i, (w, lang) in enumerate([("the of and ", "en"), ("der die und ", "de")] * 30)]
    model = langid.fit(frame(spark, [*rows, (None, None, "en"), (99, "x", None)]))
    got = {r.doc_id: r for r in langid.predict(frame(spark, [(1, None, None), (2, "", "en"), (3, "12 !", "en"), (4, "the and of", None), (None, "und die der", "x"), (6, "a", "x")]), model).collect()}
    assert [got[k].lang_pred for k in (1, 2, 3)] == ["und"] * 3 and got[1].score == 0
    assert got[4].lang_pred == "en" and got[None].lang_pred == "de" and got[6].kept == "x"
    assert langid.predict(frame(spark, []), model).collect() == []
    none = langid.fit(frame(spark, []))
    assert [r.lang_pred for r in langid.predict(frame(spark, [(1, "abc", "en")]), none).collect()] == ["und"]


def test_rare_language_and_repeated_ids_are_sampled(spark):
    """60 texts of a language among 6,000 others, and a doc_id of most rows: the sample loses neither."""
    rows = [(i, f"the of and to in it {i}", "en") for i in range(6000)] + [(10_000 + i, f"der die und das ist ein {i}", "de") for i in range(60)]
    rows += [(-1, f"the of and for {i}", "en") for i in range(12_000)]
    docs = frame(spark, rows)
    s = langid.Settings(sample=200)
    assert langid.fit(docs, s).labels == ["de", "en"]
    taken = sampling.bounded_by(docs, "doc_id", "lang", 200, s.seed).groupBy("lang").count().collect()
    taken = {r["lang"]: r["count"] for r in taken}
    assert 30 <= taken["de"] <= 60 and 100 <= taken["en"] <= 190
    assert sampling.quotas([10, 5], 20) == [10, 5] and sum(sampling.quotas([10**6, 40, 10**5], 600)) == pytest.approx(600) and sampling.quotas([10**6, 40, 10**5], 600)[1] == 40


def test_proximal_update_is_sparse_and_temperature_calibrates():
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 400)
    rows = [(np.array([k, 2 + rng.integers(0, 14)]), np.array([3, 1])) for k in y]
    s = langid.Settings(features=16, l1=0.5)
    w = langid.ftrl(rows, y, 2, np.ones(16), s)
    logits = langid.dense(rows, range(400), np.ones(16), 16) @ w
    assert (logits.argmax(1) == y).all() and (w == 0).mean() > 0.2
    noisy = np.where(rng.random(400) < 0.2, 1 - y, y)
    heat = langid.temperature(logits, noisy)
    p = langid.softmax(logits / heat).max(1)
    assert abs(p.mean() - (logits.argmax(1) == noisy).mean()) < 0.05


def test_quality_of_held_out_documents(spark):
    got = op2_attention(spark, SF).toPandas()
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas()
    both = got[got.held_out].merge(labels, on="doc_id")
    assert len(got) == 1000 and (both.predicted == both.quality).mean() > 0.9


def test_attention_gradients():
    s = attention.Settings(hidden=5, gate=3)
    rng = np.random.default_rng(1)
    x, bag, y, p = rng.normal(0, 1, (7, attention.width(s))), np.array([0, 0, 0, 1, 2, 2, 2]), np.array([1.0, 0.0, 1.0]), attention.start(s)
    loss = lambda: -np.mean(np.where(y == 1, np.log((o := attention.forward(p, x, bag, 3)["y"])), np.log(1 - o)))
    g = attention.gradients(p, x, bag, attention.forward(p, x, bag, 3), y)
    for k in "VUwobW":
        at = tuple(0 for _ in p[k].shape)
        kept = p[k][at]
        p[k][at] = kept + 1e-5
        up = loss()
        p[k][at] = kept - 1e-5
        assert (up - loss()) / 2e-5 == pytest.approx(g[k][at], abs=1e-6)
        p[k][at] = kept


def test_attention_edges(spark):
    docs = frame(spark, [(i, ("clean words " if i % 2 else "### $$$ ") * 30, "en") for i in range(40)] + [(None, None, None), (50, "", None), (51, "x", None), (52, "ab😀" * 2000, None)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(3, 1), (4, None)], "doc_id long, quality int")
    model = attention.fit(docs, labels, attention.Settings(epochs=20, batch=8))
    got = {r.doc_id: r for r in attention.predict(docs, model).collect()}
    assert len(got) == 44 and got[1].score > 0.5 > got[2].score and all(0 <= r.score <= 1 for r in got.values())
    assert attention.predict(frame(spark, []), attention.fit(docs, labels.limit(0))).collect() == []


def slow_repeats(words, width=5):
    seen = {}
    for i in range(len(words) - width + 1):
        seen.setdefault(tuple(words[i : i + width]), []).append(i)
    return len({j for at in seen.values() if len(at) > 1 for i in at for j in range(i, i + width)})


def test_repeated_words_against_plain_search():
    rng = np.random.default_rng(2)
    for n in (0, 3, 5, 6, 40, 200):
        for k in (1, 2, 3, 50):
            words = [f"w{x}" for x in rng.integers(0, k, n)]
            # Beside other texts, before and behind it.
            found = divergence.counted(["w1 w1 w1 w1 w1 w1", " ".join(words), "", "w1 w2"])
            assert found.counts[:, 4].tolist() == [6, slow_repeats(words), 0, 0]


def test_base_counts():
    found = divergence.counted(["", "a b\n\na b\n \n \r\nc # <x>\na\xa0b", "é\x00 😀"])
    assert found.counts.tolist() == [[0, 0, 0, 0, 0], [8, 12, 3, 1, 0], [2, 3, 0, 0, 0]]
    assert found.classes.sum(1).tolist() == [0, 25, 4] and found.classes[2, charcodes.CLASSES.index("symbol")] == 1


def test_letters_are_letters_by_category_on_all_planes():
    has = lambda x: charcodes.has_letter(charcodes.codes(x))
    assert not any(map(has, ["", "😀😁", "❤️", "\u0301\u0302", "12 ³ Ⅷ", "_-!", "\U000e0001"]))
    assert all(map(has, ["a", "ª", "日", "𝐀", "𐍈", "\U00030000", "ǅ", "ʰ"]))
    assert charcodes.CLASSES[charcodes.classes(charcodes.codes("😀"))[0]] == "symbol"


def plain_judge(docs, rules):
    """kept of each (doc_id, text, lang) by loops over characters and words."""
    split = lambda x: re.findall(r"[^\x20\x09-\x0D]+", x)

    def distance(p, q):
        a, b, out = sum(p.values()) or 1, sum(q.values()) or 1, 0.0
        for k in set(p) | set(q):
            x, y = p.get(k, 0) / a, q.get(k, 0) / b
            out += sum(v * math.log2(2 * v / (x + y)) for v in (x, y) if v) / 2
        return math.sqrt(max(0.0, out))

    of_class = lambda x: collections.Counter(charcodes._class(c) for c in x)
    letters, said = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter)
    for _, text, lang in docs:
        if lang is not None and text is not None:
            letters[lang] += of_class(text)
            said[lang].update(split(text.lower()))
    common = {}
    for lang, n in said.items():
        hashed = lambda w: int(divergence.counted([w]).lowered.view(np.int64)[0])
        common[lang] = sorted(n, key=lambda w: (-n[w], hashed(w) if n[w] < 50 else 0))[: rules.common]
    out = {}
    for doc, text, _ in docs:
        words = split(text or "")
        failed = len(words) < rules.least_words or 100 * slow_repeats(words) > rules.repeat_percent * len(words)
        far = (0.0, 0.0)
        if len(words) >= rules.min_words:
            each = []
            for lang in sorted(said):
                fold = lambda ws, lang=lang: collections.Counter(w if w in common[lang] else None for w in ws)
                theirs = collections.Counter({w: said[lang][w] for w in common[lang]})
                theirs[None] = sum(said[lang].values()) - sum(theirs.values())
                each.append((distance(of_class(text), letters[lang]), distance(fold(split(text.lower())), theirs)))
            far = min(each, key=lambda e: e[0] ** 2 + e[1] ** 2)
        out[doc] = (failed, not failed and far[0] <= rules.most_class_distance and far[1] <= rules.most_word_distance, *far)
    return out


def test_kept_against_loops(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text, r.lang) for r in docs.collect()]
    want = plain_judge(rows, divergence.Rules())
    got = {r.doc_id: r for r in divergence.judge(docs).collect()}
    assert len(got) == len(want) and {r.kept for r in got.values()} == {True, False}
    for k, (failed, kept, *far) in want.items():
        assert (got[k].base_failed, got[k].kept) == (failed, kept), k
        assert [got[k].class_distance, got[k].word_distance] == pytest.approx(far, abs=1e-6), k


def test_distance_bounds():
    a, b = np.array([1.0, 0]), np.array([0.0, 5])
    assert divergence.jensen_shannon(a, 3 * a) == 0 and divergence.jensen_shannon(a, b) == 1
    assert divergence.jensen_shannon(np.array([1.0, 1]), a) == pytest.approx(math.sqrt(0.5 * (math.log2(4 / 3) + 0.5 * math.log2(2 / 3) + 0.5)))


def test_judge_edges(spark):
    prose = [(i, " ".join(f"the w{(i * 31 + j) % 97} of" for j in range(40)), "en") for i in range(30)]
    odd = [(100, "| $ " * 100 + "x", "en"), (101, None, None), (102, "", "en"), (103, "short but fine text of ten words or a few", None), (None, "same words here again " * 20, "en"), (105, "Q%%% Z### " * 5 + " ".join(f"U{i}%%% I{i}!!" for i in range(60)), None)]
    got = {r.doc_id: r for r in divergence.judge(frame(spark, prose + odd)).collect()}
    assert all(got[i].kept for i in range(30)) and got[103].kept
    assert not any(got[k].kept for k in (100, 101, 102, None, 105)) and got[None].base_failed and not got[105].base_failed
    assert got[101].n_words == 0 and got[103].score == "x"
    assert divergence.judge(frame(spark, [])).collect() == []


def test_references_count_everything(spark):
    docs = frame(spark, [(1, "a a b", "x"), (2, "A c", "x"), (3, "d", "y"), (4, "e", None)])
    r = divergence.references(docs, divergence.Rules(common=1))
    assert set(r) == {"x", "y"} and r["x"].words.tolist() == divergence.counted(["a"]).lowered.tolist() and r["x"].counts.tolist() == [3, 2]
    assert r["x"].classes[charcodes.CLASSES.index("upper")] == 1 and r["x"].classes.sum() == 8


def test_attention_scores_against_loops(spark):
    """Scores of a fitted model by loops over passages and units, without numpy's products."""
    s = attention.Settings(passage=40, hashed=8, hidden=4, gate=3, epochs=3, batch=4)
    docs = [(i, ("clean words here " if i % 2 else "### $$$ x ") * (1 + i % 9), None) for i in range(30)] + [(40, "", None), (41, None, None)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)], "doc_id long, quality int")
    model = attention.fit(frame(spark, docs), labels, s)
    got = {r.doc_id: r.score for r in attention.predict(frame(spark, docs), model).collect()}
    p = {k: v.tolist() for k, v in model.weights.items()}
    sigmoid = lambda x: 1 / (1 + math.exp(-x))
    for doc, text, _ in docs:
        encoded, gates = [], []
        for row in attention.passage_features(text or "", s).tolist():
            x = [(v - m) * c for v, m, c in zip(row, model.mean, model.scale, strict=True)]
            h = [math.tanh(sum(v * p["W"][i][j] for i, v in enumerate(x)) + p["b"][j]) for j in range(4)]
            gates.append(sum(math.tanh(sum(h[i] * p["V"][i][j] for i in range(4))) * sigmoid(sum(h[i] * p["U"][i][j] for i in range(4))) * p["w"][j] for j in range(3)))
            encoded.append(h)
        weights = [math.exp(g - max(gates)) for g in gates]
        z = [sum(w * h[j] for w, h in zip(weights, encoded, strict=True)) / sum(weights) for j in range(4)]
        assert got[doc] == pytest.approx(sigmoid(sum(a * b for a, b in zip(z, p["o"], strict=True)) + p["c"]), abs=1e-5), doc


def test_language_scores_against_loops(spark):
    """n-gram counts, TF-IDF, weights and temperature by loops over dictionaries."""
    s = langid.Settings(features=256, least_steps=20)
    docs = [(i, ("the cat sat here " if i % 2 else "der hund lief dort ") * (1 + i % 5), ("en", "de")[i % 2 == 0]) for i in range(40)] + [(50, "", None), (51, "é1 ß", None), (52, None, None)]
    model = langid.fit(frame(spark, docs), s)
    got = {r.doc_id: r for r in langid.predict(frame(spark, docs).drop("lang", "score"), model).collect()}
    word = (1 << 64) - 1

    def slots(text):
        c = [ord(x) for x in text.lower()]
        one = [x * 0x9E3779B97F4A7C15 & word for x in c]
        two = [(a * 0xC2B2AE3D27D4EB4F + b) & word for a, b in zip(one, one[1:], strict=False)]
        three = [(a * 0x165667B19E3779F9 + b) & word for a, b in zip(two, one[2:], strict=False)]
        return collections.Counter((((x ^ (x >> 29)) * 0xBF58476D1CE4E5B9) & word) >> 56 for x in one + two + three)

    known = [slots(t) for _, t, lang in docs if lang]
    for k in range(256):
        assert model.idf[k] == pytest.approx(math.log((1 + len(known)) / (1 + sum(k in x for x in known))) + 0.05, abs=1e-5)
    for doc, text, _ in docs:
        own = {k: math.sqrt(n) * model.idf[k] for k, n in slots(text or "").items()}
        size = math.sqrt(sum(v * v for v in own.values())) or 1.0
        logits = [(sum(v / size * model.weights[k][j] for k, v in own.items()) + model.weights[256][j]) / model.heat for j in range(2)]
        share = [1 / sum(math.exp(b - a) for b in logits) for a in logits]
        if any(c.isalpha() for c in text or ""):
            assert got[doc].score == pytest.approx(max(share), abs=1e-4) and got[doc].lang_pred == model.labels[share.index(max(share))]
        else:
            assert (got[doc].lang_pred, got[doc].score) == ("und", 0.0)


def test_very_long_texts(spark):
    long = "the and of a text " * 60_000
    docs = frame(spark, [(1, long, "en"), (2, long[: len(long) // 2], "en"), (3, "kurz und gut ist der text", "de")])
    model = langid.fit(docs, langid.Settings(features=256, least_steps=5))
    assert langid.predict(docs.drop("score"), model).where("lang_pred = 'en'").count() == 2
    (n,) = [r.n_words for r in divergence.judge(docs.drop("n_words")).collect() if r.doc_id == 1]
    assert n == 300_000


def test_what_the_attention_fit_takes_is_bounded(spark):
    """Of a very long text some passages are learned from, from all over it; of rows of one doc_id the lowest text."""
    s = attention.Settings(passage=16, passages=4, epochs=1)
    docs = spark.createDataFrame([(1, "b" * 1000), (1, "a short text"), (2, None), (2, "z"), (3, "x " * 400)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1)], "doc_id long, quality int")
    seen = []
    plain = attention.train
    try:
        attention.train = lambda bags, y, own: seen.append(([b.copy() for b in bags], list(y))) or plain(bags, y, own)
        attention.fit(docs, labels, s)
    finally:
        attention.train = plain
    bags, y = seen[0]
    assert len(bags) == 3 and max(map(len, bags)) == 4 and sum(y) == 2
    sides = {b.tobytes() for b in bags}
    whole = attention.passage_features("x " * 400, s)
    assert {attention.passage_features("a short text", s).tobytes(), attention.passage_features("", s).tobytes()} <= sides
    assert whole[[0, 16, 33, 49]].tobytes() in sides or whole[[0, 17, 33, 49]].tobytes() in sides
