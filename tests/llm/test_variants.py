import random
import re
import zlib
from collections import Counter

import duckdb
import pytest

from curata.llm import variants

DOCS = "doc_id long, text string, word string, key string"


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_words(rows):
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def plain_groups(n):
    """All words against all words."""
    close = {w: [o for o in n if near(w, o)] for w in n}
    form = {}
    for w, others in close.items():
        best = min(others, key=lambda o: (-n[o], o), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n[w], len(close[w]), n[form[w]] if form[w] is not None else None))
    return out


def rows_of(df):
    got = [(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()]
    assert len(got) == len(set(got))
    return set(got)


@pytest.mark.parametrize("bucket", [0, 8, variants.BUCKET])
def test_groups_equal_all_against_all(spark, bucket):
    """Few letters and shared beginnings, so that keys are hot and cut again and again."""
    draw = random.Random(bucket)
    words = {"".join(draw.choice("abéß") for _ in range(draw.randint(5, 9))) for _ in range(300)} | {"interna" + "".join(draw.choice("abcd") for _ in range(draw.randint(0, 4))) for _ in range(150)}
    n = {w: draw.choice([3, 4, 6, 7, 12, 25, 60, 1000]) for w in sorted(words)}
    got = rows_of(variants.group(spark.createDataFrame(list(n.items()), "word string, n long"), bucket=bucket))
    assert got == plain_groups(n)


def test_words_of_any_length(spark):
    """The operator itself takes words of one or no code point as well."""
    n = {w: 3 + k for k, w in enumerate(["", "a", "b", "é", "ab", "ba", "abc", "a" * 40, "a" * 39, "b" + "a" * 39])}
    for bucket in (0, 1000):
        assert rows_of(variants.group(spark.createDataFrame(list(n.items()), "word string, n long"), bucket=bucket)) == plain_groups(n)


def test_documents_against_loops_and_sql(spark):
    draw = random.Random(11)
    base = ["kitten", "kittens", "mitten", "Straße", "ÉCOLE", "école", "sitting", "naïve", "naive", "abcd", "x" * 5000]
    rows = [(draw.choice([None, *range(400)]), " 12,".join(draw.choice(base) for _ in range(draw.randint(0, 40)))) for _ in range(300)]
    rows += [(1, None), (2, ""), (3, "\n×÷×÷× Ābcdef 🎉"), *rows[:20], (7, "kitten " * 20_000)]
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows], DOCS)
    got = rows_of(variants.group(variants.counted(variants.runs(docs))))
    assert got == plain_groups(plain_words(rows))
    assert any(len(w) == 5 and w not in base for w, *_ in got)
    con = duckdb.connect()
    con.execute("CREATE TABLE documents(doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    said = con.execute(variants.sql())
    assert set(said.fetchall()) == got
    empty = variants.group(variants.counted(variants.runs(docs.limit(0))))
    assert empty.columns == ["word", "form", "root", "n", "n_near", "form_n"] and empty.collect() == []
