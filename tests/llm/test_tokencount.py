import random

import pytest

from curata.llm import tokencount as tc
from curata.llm.queries import vocabulary

ODD = " \n\t'sdtrevlm  aBé1²½,.!<|>　​\x1c\x85中文ʼ́🎉\U000107bb՘ßñ\x00"
SAID = ["<|endoftext|>", "<|startoftext|>", " the", "'ll", "  ", " 2024", "\r\n"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_counts_equal_the_library(name):
    path = vocabulary(name)
    proof = tc.prove(path)
    assert len(proof.whole) > 30_000 and proof.by_pattern == name.startswith("byte")
    counter, plain, draw = tc.TextCounter(proof), tc._load(path), random.Random(7)
    texts = ["".join(draw.choice([*ODD, *SAID]) for _ in range(draw.randint(0, 80))) for _ in range(3000)]
    texts += [" ".join(draw.choice(["tokens", "of", "unbelievablywordy", "x1", "don't"]) for _ in range(90_000)), "a" * 30_000, " " * 5000 + "end", "\n" * 999]
    want = [len(e.ids) for e in plain.encode_batch(texts, add_special_tokens=False)]
    assert [counter.count(t) for t in texts] == want


def test_every_proven_string_is_one_token():
    proof = tc.prove(vocabulary("byte_bpe_50k.json"))
    plain = tc._load(proof.path)
    assert all(len(e.ids) == 1 for e in plain.encode_batch(list(proof.whole), add_special_tokens=False))
    assert "<|endoftext|>" not in proof.whole


def test_the_memory_of_merged_pieces_is_bounded(monkeypatch):
    monkeypatch.setattr(tc, "REMEMBERED", 10)
    proof = tc.prove(vocabulary("byte_bpe_50k.json"))
    counter, plain = tc.TextCounter(proof), tc._load(proof.path)
    for k in range(100):
        text = f"qzx{chr(97 + k % 26)}{chr(97 + k // 26)}vw more"
        assert counter.count(text) == len(plain.encode(text, add_special_tokens=False).ids)
        assert len(counter.sizes) <= counter.sizes.proven + 10


def test_tables(spark):
    rows = [(1, None, "a"), (1, None, "a"), (2, "", "b"), (None, "é" * 600, "c"), (4, "one <|endoftext|>two", "d"), (5, "word " * 100_000, "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string").withColumn("count", docs_col())
    got = tc.count_tokens(docs, vocabulary("byte_bpe_50k.json")).collect()
    plain = tc._load(vocabulary("byte_bpe_50k.json"))
    assert len(got) == len(rows)
    for r in got:
        n = len(plain.encode(r.text or "", add_special_tokens=False).ids)
        assert (r.n_tokens, r.n_bytes, r.over_limit, r["count"]) == (n, len((r.text or "").encode()), n > 512, "own")
    assert tc.count_tokens(docs.limit(0), vocabulary("byte_bpe_50k.json")).collect() == []
    assert {r.n for r in tc.count_tokens(docs, vocabulary("byte_bpe_50k.json"), limit=0, names=("b", "n", "o")).where("o").collect()} == {4, 600, 100_001}


def docs_col():
    from pyspark.sql import functions as F

    return F.lit("own")
