import corpus_pipeline as cp

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, rows = docs.columns, docs.collect()
    for name, stage in cp.STAGES[:-1]:
        docs = cp.written(stage(spark, docs, SF), "test")
        assert docs.columns == columns, name
        after = docs.collect()
        assert 0.5 * len(rows) < len(after) <= len(rows)
        rows = after
    assert len({r.doc_id for r in rows}) == len(rows)
    assert all(r.n_chars == len(r.text) for r in rows)
    last = cp.STAGES[-1][1](spark, docs, SF).collect()
    assert {r.doc_id for r in last} == {r.doc_id for r in rows}
    assert cp.run(spark, SF).count() == len(last)


def test_what_each_stage_drops(spark):
    from test_lines_leaks import ITEM

    text = " ".join(f"the w{k} of" for k in range(60))
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    make = lambda rows: spark.createDataFrame([(d, t, "en", "s", 0) for d, t in rows], schema)
    ids = lambda df: sorted(r.doc_id for r in df.where("doc_id is not null").collect())
    assert ids(cp.language(spark, make([(1, text), (2, None), (3, "12 %"), (4, "")]), SF)) == [1]
    line = "one and the same line of this kind in all\n"
    assert {r.doc_id: r.text for r in cp.lines(spark, make([(k, line + ("own words here" if k < 3 else "")) for k in range(6)]), SF).collect()} == {0: line + "own words here", 1: "own words here", 2: "own words here"}
    assert ids(cp.near_copies(spark, make([(5, text), (2, text), (3, text + " end"), (3, text + " end"), (9, "other"), (9, "other"), (None, text)]), SF)) == [2, 9]
    assert ids(cp.decontaminate(spark, make([(1, text)]), SF)) == [1]
    for stage in (s for _, s in cp.STAGES):
        assert stage(spark, make([]), SF).count() == 0
    assert ITEM


CLASHES = ("lang_pred", "score", "n_lines", "n_dropped", "leaked", "doc", "template", "dropped_lines", "node", "component_id", "token", "bucket", "start", "h", "item_id", "_lang", "_leaked")


def test_stages_leave_columns_with_clashing_names_alone(spark):
    text = " ".join(f"the w{k} of" for k in range(60))
    rows = [(k, f"shared line number one of this test\n{text} own{k}" if k % 2 else " ".join(f"a{k} b{j}" for j in range(50)), "en", "s", 0, *[f"{c}{k}" for c in CLASHES]) for k in range(8)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHES)
    for name, stage in cp.STAGES[:-1]:
        docs = spark.createDataFrame(rows, schema)
        got = stage(spark, docs, SF)
        assert got.columns == docs.columns, name
        got = got.collect()
        assert got, name
        assert all(r[c] == f"{c}{r.doc_id}" for r in got for c in CLASHES), name
    assert cp.pack(spark, spark.createDataFrame(rows, schema), SF).count() == 8


def test_stages_keep_what_a_plain_version_keeps(spark):
    """Near copies, leaks and lines by loops over all pairs; the language stage by its own contract."""
    import re

    from test_lines_leaks import ITEM
    from test_triejoin import plain_components

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = docs.collect()
    kept = {r.doc_id for r in cp.language(spark, docs, SF).collect()}
    assert all(any(c.isalpha() for c in r.text or "") for r in rows if r.doc_id in kept)
    clear = [r for r in rows if len(re.findall(r"[^\W\d_]+", r.text or "")) > 30 and r.lang]
    assert sum(r.doc_id in kept for r in clear) > 0.97 * len(clear)

    want = {d for d, n, c in plain_components([(r.doc_id, r.text) for r in rows]) if d == c}
    assert {r.doc_id for r in cp.near_copies(spark, docs, SF).collect()} == want

    items = [re.findall(r"[^\W_]+", r.text.lower()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    said = {r.doc_id: re.findall(r"[^\W_]+", (r.text or "").lower()) for r in rows}
    inside = {d for d, w in said.items() for i in items if i and any(w[k : k + len(i)] == i for k in range(len(w) - len(i) + 1))}
    left = {r.doc_id for r in cp.decontaminate(spark, docs, SF).collect()}
    assert inside and not inside & left and len(left) >= len(rows) - 2 * len(inside)

    before, after = {r.doc_id: (r.text or "").split("\n") for r in rows}, {r.doc_id: (r.text or "").split("\n") for r in cp.lines(spark, docs, SF).collect()}
    holders: dict[str, set] = {}
    for d, own in before.items():
        for x in own:
            holders.setdefault(x, set()).add(d)
    for d, own in after.items():
        rest = iter(before[d])
        assert all(x in rest for x in own), d  # lines go, none is changed or moved
        for x in own:
            if len(x.split()) >= 5 and len(holders[x]) >= 3:
                assert d == min(holders[x]) or re.search("[0-9]", x), (d, x)
    assert ITEM


def test_rows_that_share_or_lack_a_doc_id_are_judged_one_by_one(spark):
    """Unlike texts under one doc_id stay, copies go, whatever doc_ids they have; a clean row without doc_id stays."""
    from test_lines_leaks import ITEM  # noqa: F401

    a, b, c = (" ".join(f"{x}{k} the" for k in range(60)) for x in "abc")
    schema = "doc_id long, text string, lang string, source string, n_chars long, row string"
    make = lambda rows: spark.createDataFrame([(d, t, "en", "s", 0, "mine") for d, t in rows], schema)
    near = lambda rows: sorted([(r.doc_id, r.text[:2]) for r in cp.near_copies(spark, make(rows), SF).collect()], key=str)
    assert near([(5, a), (5, b)]) == [(5, "a0"), (5, "b0")]
    assert near([(2, a), (5, b), (5, a)]) == [(2, "a0"), (5, "b0")]
    assert near([(None, a), (None, b), (None, a), (7, b)]) == [(7, "b0"), (None, "a0")]
    assert near([(3, a), (3, a), (4, c)]) == [(3, "a0"), (4, "c0")]
    assert cp.near_copies(spark, make([(1, ""), (1, ""), (None, None)]), SF).count() == 3
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    left = [(r.doc_id, r.text[:2], r.row) for r in cp.decontaminate(spark, make([(None, item), (None, a), (8, b), (8, f"{c} {item} {c}"), (9, c)]), SF).collect()]
    assert sorted(left, key=str) == [(8, "b0", "mine"), (9, "c0", "mine"), (None, "a0", "mine")]
