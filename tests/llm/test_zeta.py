import random
import re
from itertools import permutations

import duckdb

from curata.llm import zeta

DOCS, LABELS = "doc_id long, text string, lang string, mask string, n string", "doc_id long, quality int, toxic int, part string"


def fails(rows, i):
    doc, text, _ = rows[i]
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    copy = doc is not None and any(d is not None and d < doc and (t or "") == text for d, t, _ in rows)
    tests = [len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", text)) > 3 * len(text), bool(re.search(r"[#$%&*|]", text)), copy]
    return {x for x, t in zip("ABCDE", tests, strict=True) if t}


def plain(rows, labels):
    """Every order applied to every document, one filter after the other."""
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    out = {}
    for part in {r[2] or "" for r in rows}:
        docs = [(r[0], fails(rows, i)) for i, r in enumerate(rows) if (r[2] or "") == part]
        total = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = docs
            for step, x in enumerate(order, 1):
                gone = [d for d in left if x in d[1]]
                left = [d for d in left if x not in d[1]]
                total[x] += len(gone)
                out[part, "".join(order), step] = [
                    len(left), len(gone), sum(x in f for _, f in docs) - len(gone), sum(f == {x} for _, f in docs),
                    sum(d in good for d, _ in gone), sum(d in toxic for d, _ in gone),
                ]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(total[order[step - 1]])
    return out


def run(spark, rows, labels):
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows], DOCS)
    said = spark.createDataFrame([(*r, "z") for r in labels], LABELS)
    got = zeta.audit(zeta.mask_counts(docs, said), "ABCDE").collect()
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    out = {(r.part, r.filter_order, r.step): [r[n] for n in names] for r in got}
    assert len(out) == len(got)
    return out


def texts(draw):
    few, many = ["one", "two", "Three"], [f"w{k}" for k in range(400)]
    some = [" ".join(draw.choice(draw.choice([few, many])) for _ in range(draw.choice([3, 199, 200, 230]))) + draw.choice(["", " #", " ABCDEFGHIJKLMNOP" * 3]) for _ in range(12)]
    return [*some, None, "", " \n", "\x0b É"]


def test_audit_equals_filters_run_one_by_one(spark):
    draw = random.Random(3)
    pool = texts(draw)
    rows = [(draw.choice([None, *range(40)]), draw.choice(pool), draw.choice([None, "", "en", "de"])) for _ in range(120)]
    rows += rows[:6]
    labels = [(draw.choice([None, *range(50)]), draw.choice([None, 0, 1]), draw.choice([None, 0, 1])) for _ in range(60)]
    want = plain(rows, labels)
    assert run(spark, rows, labels) == want
    con = duckdb.connect()
    con.execute("CREATE TABLE documents(doc_id BIGINT, text VARCHAR, lang VARCHAR); CREATE TABLE labels(doc_id BIGINT, quality INT, toxic INT)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", rows)
    con.executemany("INSERT INTO labels VALUES (?, ?, ?)", labels)
    said = con.execute(zeta.sql())
    names = [c[0] for c in said.description]
    found = [dict(zip(names, r, strict=True)) for r in said.fetchall()]
    assert {(r["part"], r["filter_order"], r["step"]): [r[n] for n in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")] for r in found} == want


def test_one_text_on_all_rows_and_no_rows(spark):
    rows = [(k, "same", "en") for k in range(300)]
    assert run(spark, rows, []) == plain(rows, [])
    assert run(spark, [], [(1, 1, 1)]) == {}


def test_other_filters_and_labels(spark):
    """Three filters on counts of another source, a null part, null masks and labels named like the result's columns."""
    counts = spark.createDataFrame([("p", 5, 2, True), ("p", 0, 7, None), ("p", None, 9, True), (None, 4, 1, False)], "m string, bits int, kept long, part boolean")
    got = {(r.part, r.filter_order, r.step): r for r in zeta.audit(counts, "xyz", ["part"], "m", "bits", "kept").collect()}
    assert len(got) == 2 * 6 * 3
    first = got["p", "xyz", 1]
    assert (first.kept, first.removed, first.part_lost, first.unique_fails, first.shapley) == (7, 2, 2, 0, 6)
    assert got["p", "xyz", 3].redundant == 2 and got[None, "zxy", 1].removed == 1
