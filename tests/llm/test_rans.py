import random
import sys
import zlib
from collections import Counter

import numpy as np
import pytest

from curata.llm import rans, tokens
from curata.llm.queries import vocabulary

BYTES = vocabulary("byte_bpe_50k.json")


@pytest.mark.parametrize("n,kinds", [(0, 5), (1, 1), (7, 1), (100, 3), (5000, 400), (20_000, 30_000)])
def test_block_round_trip(n, kinds):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.zipf(1.3, n), kinds) * 3
    table = rans.Table.of(*np.unique(np.append(ids, 3 * kinds), return_counts=True))
    assert int(table.frequencies.sum()) == 1 << rans.PRECISION and table.frequencies.min() >= 1
    symbols = table.place[ids]
    for lanes in (1, 8, 256):
        state, words = rans.encode_block(symbols, table, lanes)
        assert (rans.decode_block(state, words, n, table) == symbols).all()


def test_segment_blocks_are_independent_and_checked():
    rng = np.random.default_rng(1)
    ids = rng.integers(0, 50, 1000)
    table = rans.Table.of(*np.unique(ids, return_counts=True))
    data = rans.write_segment(ids, [None, 4, 4, 9], [100, 400, 400, 100], table, rans.Layout(lanes=8, block=16))
    got, docs, lengths = rans.read_segment(data, table)
    assert (got == ids).all() and docs == [None, 4, 4, 9] and lengths.tolist() == [100, 400, 400, 100]
    head, _, _, base = rans.read_header(data)
    block = head["blocks"][3]
    assert (rans.read_block(data, block, base, table) == ids[block[0] : block[0] + block[1]]).all()
    spoiled = bytearray(data)
    spoiled[base + block[3] + 8 * block[2]] ^= 1
    with pytest.raises(ValueError):
        rans.read_block(bytes(spoiled), block, base, table)


def test_files_round_trip(spark, tmp_path):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(BYTES)
    plain.encode_special_tokens = True
    rows = [(i * 7 % 101, f"document {i}  with\nlines, and words " * (i % 9)) for i in range(101)] + [(None, "no id"), (None, None), (500, ""), (3, "again"), (600, "long one " * 20_000)]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, part string, start int")
    rans.write(docs, str(tmp_path / "a"), BYTES, layout=rans.Layout(lanes=16, block=32, segment_ids=400), partition_bytes=5000)
    got = rans.read(spark, str(tmp_path / "a")).collect()
    want = sorted(((d is not None, d or 0, t or "") for d, t in rows))
    assert len(got) == len(rows)
    got.sort(key=lambda r: r.start)
    at = 0
    for r, (known, doc, text) in zip(got, want, strict=True):
        ids = [*plain.encode(text, add_special_tokens=False).ids, 2]
        assert (r.doc_id, r.start) == (doc if known else None, at)
        assert zlib.crc32(r.ids) == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)


@pytest.mark.parametrize("rows", [[], [(1, None)]])
def test_tiny_tables(spark, tmp_path, rows):
    rans.write(spark.createDataFrame(rows, "doc_id long, text string"), str(tmp_path / "a"), BYTES)
    assert [(r.doc_id, r.start, len(r.ids)) for r in rans.read(spark, str(tmp_path / "a")).collect()] == [(1, 0, 4) for _ in rows]


def test_one_id_on_all_rows_fills_many_parts(spark, tmp_path):
    texts = [f"{k * 7919 % 400:03d} text of its own" for k in range(400)]
    rans.write(spark.createDataFrame([(4, t) for t in texts], "doc_id long, text string"), str(tmp_path / "a"), BYTES, partition_bytes=2000)
    segments = spark.read.parquet(str(tmp_path / "a" / "segments"))
    assert segments.select("part").distinct().count() > 5
    got = sorted(rans.read(spark, str(tmp_path / "a")).collect(), key=lambda r: r.start)
    assert len(got) == 400 and [r.start for r in got] == [sum(len(x.ids) // 4 for x in got[:k]) for k in range(400)]


@pytest.mark.parametrize(("name", "spaced"), [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_new_words_cost_no_python_calls_each(name, spaced):
    own = tokens.WordEncoder(vocabulary(name), spaced)
    rng = random.Random(3)
    made = ["".join(rng.choices("abdeilmnorstuéñ", k=rng.randrange(2, 9))) for _ in range(3000)]
    plain = [" ".join(made[k : k + 50]) for k in range(0, 3000, 50)]
    odd = ["", "a\nb\n\nc", "a \x00 b\x00", "中 文 \U0001f4a9 x", "￾ a ͸ b", "x.y,z ... 5.0,"] * 2
    want = [[*own.tokenizer.encode(t, add_special_tokens=False).ids, 2] for t in plain + odd]
    calls = Counter()
    sys.setprofile(lambda frame, event, arg: calls.update([event]))
    try:
        got = list(own.encode(plain, 2))
    finally:
        sys.setprofile(None)
    got += own.encode(odd, 2)
    assert [np.frombuffer(x, own.dtype).tolist() for x in got] == want
    assert len(set(made)) > 2500 and calls["c_call"] < 2500


def test_words_of_letters_skip_the_steps_ahead_of_the_model():
    own, rng, reached = tokens.WordEncoder(BYTES, True), random.Random(5), []
    plain = own.tokenizer

    class Counted:
        def encode_batch_fast(self, texts, **more):
            reached.extend(texts)
            return plain.encode_batch_fast(texts, **more)

    own.tokenizer = Counted()
    made = ["".join(rng.choices("abdeilmnorstuéñÿÀ", k=rng.randrange(2, 9))) for _ in range(4000)]
    texts = [" ".join(w + rng.choice(["", "", ".", ",", "&&&", "!!", "'s"]) for w in made[k : k + 50]) for k in range(0, 4000, 50)]
    assert [np.frombuffer(x, own.dtype).tolist() for x in own.encode(texts, 2)] == [[*plain.encode(t, add_special_tokens=False).ids, 2] for t in texts]
    assert sum(map(len, reached)) < sum(map(len, texts)) // 100


def test_parts_of_texts_keep_the_ids_of_whole_ones():
    own, rng = tokens.WordEncoder(BYTES, True), random.Random(6)
    kinds = ["a", "Zq", "é", "×", "÷", "Ã", "·", "ß", "9", "'", "'s", ".", ",", "-", "<|endoftext|>", "_", " ", " ", "  ", "\n", "\n\n", "\t", "中", "́", "\x00", "\x7f", "\u00a0", "\x1e", "\U0001f4a9", "²", "ª"]
    texts = ["", ".", "a.", "é", "é.", ".é", None, ",", " ", "\n"] + ["".join(rng.choices(kinds, k=rng.randrange(0, 14))) for _ in range(4000)]
    got = [np.frombuffer(x, own.dtype).tolist() for x in own.encode(texts, 2, at_once=3000)]
    assert got == [[*own.tokenizer.encode(t or "", add_special_tokens=False).ids, 2] for t in texts]
