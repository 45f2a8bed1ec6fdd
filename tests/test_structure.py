"""Sections, superscripts, tables, nested values, references, layout, moves."""

import json

from pyspark.sql import functions as F

from quillmark.operators import layout, moves, nested, references, sections


def _one(spark, text, column):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t")).alias("o")).first().o


def test_superscripts(spark):
    sup = sections.superscript_citations
    assert "[5]" in _one(spark, "shown before 5 and", sup)
    assert "[2]" not in _one(spark, "see table 2 for details", sup)
    assert "[1,2,3]" in _one(spark, "evidence 1, 2, 3 shows", sup)
    assert "[123]" in _one(spark, "text¹²³", sup)


def test_sections(spark):
    text = "x" * 120 + "\n\nIntroduction\nIt begins.\n\n2. Methods\nWe did.\n\nBibliography\nSmith, J. (2000). T."
    docs = spark.createDataFrame([(1, text), (2, "no heading here"), (3, "")], "doc_id long, text string")
    got = {(r.doc_id, r.section): r.text for r in sections.split_sections(docs).where("section_ord > 0").collect()}
    assert set(got) == {(1, "Preface"), (1, "Introduction"), (1, "Methods"), (1, "References")}
    assert got[(1, "Methods")] == "We did."
    assert {r.doc_id: r.text for r in sections.split_sections(docs).where("section_ord = 0").collect()} == {1: text, 2: "no heading here", 3: ""}
    assert {r.section for r in sections.analysed(sections.split_sections(docs)).collect()} == {"Preface", "Introduction", "Methods"}
    # the looser pattern, a table of contents, and a list of references in running text
    body = "A start.\nResults: it rose.\n\n3 Own heading\nText here. " + "Words. " * 40
    rows = [(1, body + "so. References Smith, J. (2000).", None), (2, body, ["1.1 Own heading", "x" * 90, "Own heading"]), (3, body, ["Not there"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toc array<string>")
    got = {}
    for r in sections.split_sections(docs, toc="toc").where("section_ord > 0").orderBy("section_ord").collect():
        got.setdefault(r.doc_id, []).append(r.section)
    assert got == {1: ["Results", "References"], 2: ["Own heading"], 3: ["Results"]}


def test_tables_and_captions(spark):
    text = "Before.\n| a | b |\n|---|---|\n| 1 | 2 |\n\nAfter one.\nFigure 2: a thing\nEnd."
    assert _one(spark, text, sections.without_tables) == "Before.\nAfter one.\nFigure 2: a thing\nEnd."
    assert _one(spark, "A.\nFigure 2: a thing\nEnd.", sections.without_figure_captions) == "A.\nEnd."


def test_reference_blocks_and_parse(spark):
    docs = spark.createDataFrame([(1, "Smith, J. (1983). First title. Journal A, 1.\n\nJones, K., & Brown, L. (2000). Second title. Journal B, 2.\n\ncontinued here\n\nGray, M. et al. (2001). Third title. Journal C. https://doi.org/10.1000/abc.")], "doc_id long, text string")
    blocks = sections.reference_blocks(docs).orderBy("ref_ord").collect()
    assert len(blocks) == 3 and blocks[1].ref_text.endswith("continued here")
    refs = sections.reference_blocks(docs).withColumnRenamed("ref_text", "ref_full_text")
    got = references.parse(refs).orderBy("ref_ord").collect()
    assert [r.ref_year for r in got] == ["1983", "2000", "2001"]
    assert [r.ref_first_author for r in got] == ["Smith", "Jones", "Gray"]
    assert (got[1].ref_second_author, got[1].n_authors, got[2].n_authors, got[2].ref_doi) == ("Brown", 2, 99, "10.1000/abc")
    assert got[0].ref_title == "First title"


def test_nested_values(spark):
    value = json.dumps([None, {"name": "A", "department": {"name": "D"}, "id": [{"id": "1"}, None, {"id": "2"}]}, "B"])
    rows = [(1, value), (2, json.dumps(json.dumps(["X"]))), (3, "plain text"), (4, "[]"), (5, None), (6, "  "), (7, '{"broken'), (1, value)]
    df = spark.createDataFrame(rows, "author_id long, affiliation string").withColumn("tag", F.lit("clash"))
    got = {(r.tag, r.root_id, r.ord1, r.ord2) for r in nested.emit(df, "author_id", "affiliation", nested.AFFILIATION).collect()}
    assert got == {
        ("affiliation", 1, 2, 0), ("affiliation", 1, 3, 0), ("affiliation_department", 1, 2, 1), ("affiliation_id", 1, 2, 1), ("affiliation_id", 1, 2, 3),
        ("affiliation", 2, 1, 0), ("affiliation", 3, 1, 0), ("affiliation", 7, 1, 0),
    }
    subjects = spark.createDataFrame([(1, "a; b;; c"), (2, json.dumps({"term": "t", "broader": [{"term": "u"}]}))], "paper_id long, subject string")
    got = {(r.tag, r.root_id, r.ord1, r.ord2) for r in nested.emit(subjects, "paper_id", "subject", nested.SUBJECT).collect()}
    assert got == {("subject", 1, 1, 0), ("subject", 1, 2, 0), ("subject", 1, 4, 0), ("subject", 2, 1, 0), ("subject_broader", 2, 1, 1)}
    assert nested.emit(df.limit(0), "author_id", "affiliation", nested.AFFILIATION).count() == 0


def test_nested_tables_written_by_tag(spark):
    value = json.dumps([{"name": "A", "place": {"city": "C"}, "department": [{"name": "D", "room": "1"}, "E"]}, "B"])
    df = spark.createDataFrame([(1, value), (2, None)], "author_id long, affiliation string")
    told = nested.flattened(nested.emit(df, "author_id", "affiliation", nested.AFFILIATION))
    top = {r.ord1: r for r in nested.child_table(told, "affiliation").collect()}
    assert (top[1].name, top[1].place.city, top[1].place.country, top[2].text) == ("A", "C", None, "B")
    below = sorted((r.parent_item_id, r.ord2, r.name or r.text, r.room) for r in nested.child_table(told, "affiliation_department").collect())
    assert below == [(top[1].item_id, 1, "D", "1"), (top[1].item_id, 2, "E", None)]
    assert nested.flattened(nested.emit(df.limit(0), "author_id", "affiliation", nested.AFFILIATION)).count() == 0


def test_columns(spark):
    rows = [(1, 1, i, 50.0 + (i // 30) * 300 + (i % 3) * 6, 50.0 + (i % 30) // 3 * 12, 20.0, 10.0, f"w{i}") for i in range(60)]
    words = spark.createDataFrame(rows, "doc_id long, page int, word_ord int, x double, y double, width double, height double, text string")
    t = layout.gutter(words).first().threshold
    assert 62 < t < 350
    assert layout.valid_columns(words, layout.gutter(words)).first().two_columns
    lines = layout.column_lines(words, layout.global_gutter(words)).orderBy("column", "line_y").collect()
    assert lines[0].line == "w0 w1 w2" and lines[10].line == "w30 w31 w32"


def test_moves(spark):
    s = spark.createDataFrame([(1, "Introduction", "However, little is known about it.", 50.0), (2, "Methods", "However, little is known.", 50.0), (3, "Introduction", "Nothing here.", 0.0)], "sentence_id long, section string, text string, position_pct double")
    got = {r.sentence_id: r for r in moves.rule_based(s).collect()}
    assert got[1].step_rule == "Indicating a gap" and got[1].conf_rule == 1.0
    assert got[2].move_rule is None and got[3].conf_rule == 0.0
    runs = spark.createDataFrame([(1, "A", k, m, None, 0.5) for k, m in enumerate(["x", "x", "y", "x", None, None])], "d long, section string, o int, move string, step string, confidence double")
    assert moves.flow(runs, ["d", "section"], "o").first().flow_pattern == "x -> y -> x -> Unclassified"
    assert [r.n_sentences for r in moves.blocks(runs, ["d", "section"], "o").orderBy("block").collect()] == [2, 1, 1, 2]
    r = spark.createDataFrame([(1, 'x ```json\n[{"id": 1, "move": "M1", "step": "a", "confidence": 1.7}]```'), (2, "ERROR: no"), (3, "none")], "batch_id int, response string")
    assert [(x.id, x.confidence) for x in moves.parse_responses(r).collect()] == [(1, 1.0)]
