"""Layout of pages of one row: no shuffle of words, and pages whose words stand in one place or one line."""

import pytest

from quillmark.operators import layout
from quillmark.plans import catalog

BOX = "doc_id long, page int, word_ord int, x double, y double, text string"


def _words(spark, places):
    return spark.createDataFrame([(1, 1, i, x, y, f"w{i}") for i, (x, y) in enumerate(places)], BOX)


def _moves_words(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return any(x in plan for x in ("Exchange", "Join", "Window"))


def test_gutter_where_the_page_is(spark, sf):
    assert not _moves_words(catalog.queries()["column_gutter"](spark, sf))
    # words in one place have no width between the centres
    r = layout.gutter(_words(spark, [(50.0, 12.0 * i) for i in range(6)])).first()
    assert (r.threshold, r.n, r.n_left) == (50.0, 6, 5)
    assert layout.gutter(_words(spark, [(50.0, 1.0)])).count() == 0
    # every bin is full: the emptiest is the first of one word
    places = [(float(x), 1.0) for x in range(0, 200) for _ in range(1 + (x != 100))]
    r = layout.gutter(_words(spark, places)).first()
    assert 100 < r.threshold < 104 and r.n == 399


def test_global_gutter_where_the_document_is(spark, sf):
    assert not _moves_words(catalog.queries()["global_gutter"](spark, sf))
    columns = [(50.0 + c * 300 + k * 20, 12.0 * i) for c in range(2) for i in range(10) for k in range(3)]
    rows = [(1, p, i, x + p, y, "w") for p in (1, 2, 4) for i, (x, y) in enumerate(columns)] + [(1, 3, i, x, y, "w") for i, (x, y) in enumerate(columns[:20])]
    words = spark.createDataFrame(rows, BOX)
    each = {r.page: r.threshold for r in layout.gutter(words).collect()}
    r = layout.global_gutter(words).first()
    assert (r.threshold, r.n_pages) == (each[2], 3)


def test_page_text_where_the_document_is(spark, sf):
    assert not _moves_words(catalog.queries()["page_text"](spark, sf))
    columns = [(50.0 + c * 300 + k * 6, 12.0 * i) for c in range(2) for i in range(10) for k in range(3)]
    rows = [(1, 1, i, x, y, "RESULTS" if i // 3 == 30 // 3 else f"w{i}") for i, (x, y) in enumerate(columns)] + [(2, 1, i, 5.0 * i, 9.0, t) for i, t in enumerate("abc")]
    got = {(r.doc_id, r.page, r.column): r.text for r in layout.column_texts(spark.createDataFrame(rows, BOX)).collect()}
    assert set(got) == {(1, 1, 1), (1, 1, 2), (2, 1, 1)}
    assert got[(1, 1, 1)] == " ".join(f"w{i}" for i in range(30)) and got[(2, 1, 1)] == "a b c"
    assert got[(1, 1, 2)].startswith("RESULTS RESULTS RESULTS\n\nw33 w34 w35 w36")


def _documents(spark, path, rows):
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    return str(path)


def test_document_text_where_the_document_is(spark, sf, tmp_path):
    query = catalog.queries()["document_text"]
    assert not _moves_words(query(spark, sf))
    long = " ".join(f"w{i}" for i in range(900))
    d = _documents(spark, tmp_path / "a", [(1, long), (2, "short  one"), (3, " ")])
    got = {r.doc_id: r.text for r in query(spark, d).collect()}
    assert sorted(got[1].split()) == sorted(long.split()) and got[2] == "short  one" and got[3] == " "
    # rows that share an id are one document, as in SQL
    d = _documents(spark, tmp_path / "b", [(1, "one two"), (1, "three four"), (2, long)])
    got = sorted((r.doc_id, r.text[:10]) for r in query(spark, d).collect())
    assert got == [(1, "one two"), (1, "three four"), (2, "w0 w1 w2 w")]


def test_page_columns_where_the_page_is(spark, sf):
    assert not _moves_words(catalog.queries()["page_columns"](spark, sf))
    # one line on both sides has no height to overlap
    line = _words(spark, [(50.0 + 300 * (i // 6) + i % 6, 10.0) for i in range(12)])
    assert [r.two_columns for r in layout.page_columns(line).collect()] == [False]
    assert [r.two_columns for r in layout.valid_columns(line, layout.gutter(line)).collect()] == [False]
    block = _words(spark, [(50.0 + 300 * (i // 30) + i % 3, 12.0 * (i % 30 // 3)) for i in range(60)])
    assert [r.two_columns for r in layout.page_columns(block).collect()] == [True]
