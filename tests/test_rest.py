"""Smaller operators: headers, sources, information, enrichment, network."""

import json

from pyspark.sql import functions as F

from quillmark.operators import citations, clusters, layout, network, references, sections, words
from quillmark.sources import index


def _one(spark, text, column):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t")).alias("o")).first().o


def test_headers(spark):
    assert _one(spark, "x\nR E S U L T S\ny", sections.spaced_headers) == "x\nRESULTS\ny"
    assert _one(spark, "eﬃcient ﬁle", sections.plain_ligatures) == "efficient file"
    head = "Annals of Applied Acoustics, volume two, "
    docs = spark.createDataFrame([(1, "".join(f"text {k} and\n{k}\n\n{head}then {k} " for k in range(10, 14)))], "doc_id long, text string")
    found = sections.running_headers(docs)
    assert found.first().header == head + "then 1" or found.first().header.startswith(head.strip()[:30])
    assert "Annals" not in sections.without_headers(docs, found).first().text


def test_markdown(spark):
    chunks = spark.createDataFrame([(1, 1, "Some words before it\n\n# Title\ntext"), (1, 2, "## Methods\nwe did\n## Methods\nagain")], "doc_id long, chunk_ord int, text string")
    assert {r.section: r.text for r in sections.markdown_sections(chunks).collect()} == {"Preamble": "Some words before it", "Title": "text", "Methods": "again"}


def test_index_messages(spark):
    m = {"DOI": "10.1/x", "title": ["T"], "container-title": ["J"], "issued": {"date-parts": [[2001, 2]]}, "author": [{"given": "A", "family": "B", "ORCID": "https://orcid.org/0000-1", "affiliation": [{"name": "X"}, {"name": "Y"}]}], "reference": [{"key": "k", "DOI": "10.1/y", "article-title": "R", "year": "1999", "first-page": "7"}]}
    parsed = index.messages(spark.createDataFrame([(1, json.dumps(m)), (2, "broken"), (3, None)], "doc_id long, message string"))
    assert index.message_metadata(parsed).where("doc_id = 1").first().publication_year == 2001
    a = index.message_authors(parsed).first()
    assert (a.orcid, a.affiliation) == ("0000-1", "X")
    r = index.message_references(parsed).first()
    assert (r.ref_key, r.article_title, r.first_page) == ("k", "R", "7")
    names = spark.createDataFrame([([("Anna van der Berg",), ("Smith",), ("John Q Smith",)],)], "a array<struct<display_name:string>>")
    assert names.select(index.authors_string(F.col("a")).alias("s")).first().s == "van der Berg, A., Smith, Smith, J.Q."


def test_document_information(spark):
    xmp = "<dc:creator><rdf:Seq><rdf:li>A B</rdf:li><rdf:li>C D</rdf:li></rdf:Seq></dc:creator><prism:coverDate>2019-03</prism:coverDate><prism:publicationName>J</prism:publicationName> doi:10.1234/meta.1"
    info = spark.createDataFrame([(1, {"Title": "T", "WPS-ARTICLEDOI": "10.1234/art.1", "JournalDOI": "10.1234/j", "ISSN": "10.1234/(ISSN)1"}, xmp, None, None), (2, {"Author": "X", "Creator": "Adobe"}, "", None, None)], "doc_id long, keys map<string,string>, metadata string, created timestamp, modified timestamp")
    got = {r.doc_id: r for r in index.info_fields(info).collect()}
    assert (got[1].doi, got[1].title, got[1].authors, got[1].journal, got[1].year) == ("10.1234/art.1", "T", "A B; C D", "J", "2019")
    assert (got[2].doi, got[2].authors) == (None, "X")
    assert {r.doc_id: r.dois for r in index.info_dois(info).collect()}[1] == ["10.1234/art.1", "10.1234/meta.1"]
    assert _one(spark, "a&amp;b “c” – d\u0007", index.clean_encoding) == 'a&b "c" - d'


def test_completion_and_conflict(spark):
    refs = spark.createDataFrame([(1, "a", "https://doi.org/10.1/X", "Smith", None, None, None), (1, "b", "10.1/x", "Brown", "1990", None, None), (1, "c", None, "Gray", "1991", None, None)], "doc_id long, ref_id string, doi string, ref_first_author string, ref_year string, ref_journal string, n_authors int")
    works = spark.createDataFrame([("10.1/x", 1, "T", 2001, "J", "Smith", 3), ("10.1/x", 2, "U", 2002, "K", "Smith", 4)], "doi string, work_id long, title string, publication_year int, source_display_name string, first_author string, n_authors int")
    got = {r.ref_id: r for r in references.complete_from_works(refs, works).collect()}
    assert (got["a"].ref_year, got["a"].n_authors, got["a"].completed_by) == ("2001", 3, "works")
    assert (got["b"].ref_year, got["b"].ref_journal, got["b"].completed_by) == ("1990", "J", "gaps")
    assert got["c"].completed_by == "none"


def test_labels_beyond_references(spark):
    c = spark.createDataFrame([(1, "numbered_simple", "[9]"), (1, "numbered_simple", "[2]"), (1, "narrative_single", "A (2001)"), (2, "numbered_simple", "[9]")], "doc_id long, citation_type string, citation_text string")
    n = spark.createDataFrame([(1, 3)], "doc_id long, n_references int")
    assert {(r.doc_id, r.citation_text) for r in citations.drop_beyond(c, n).collect()} == {(1, "[2]"), (1, "A (2001)"), (2, "[9]")}


def test_interleaving_and_first_page(spark):
    mixed = ". ".join(["this goes on in lower case words"] * 12)
    docs = spark.createDataFrame([(1, mixed), (2, ". ".join(["This goes on in many plain words"] * 12))], "doc_id long, text string")
    assert {r.doc_id: r.interleaved for r in layout.interleaved(docs).collect()} == {1: True, 2: False}
    lines = spark.createDataFrame([(1, 1, 10.0, "Journal of X"), (1, 1, 20.0, "Introduction"), (1, 1, 30.0, "text"), (1, 1, 100.0, "E-mail: a@b"), (1, 2, 10.0, "Journal of X")], "doc_id long, page int, line_y double, line string")
    assert {(r.page, r.line) for r in layout.without_first_page_footer(layout.without_first_page_header(lines)).collect()} == {(1, "Introduction"), (1, "text"), (2, "Journal of X")}


def test_network_and_titles(spark):
    pairs = spark.createDataFrame([(1, "a", "b", 100), (1, "b", "c", 500)], "doc_id long, citation1 string, citation2 string, distance int")
    cites = spark.createDataFrame([(1, "a", "I", 1), (1, "b", "I", 2), (1, "b", "II", 3)], "doc_id long, citation string, section string, ord int")
    kept = network.nodes(pairs, cites, 2)
    assert [(r.citation, r.sections, r.border) for r in kept.collect()] == [("b", "I, II", 3)]
    assert network.surviving(pairs, kept).count() == 0
    assert _one(spark, "Smith, J. (2001). A fine title. Journal.", clusters.title_of) == "A fine title"
    assert words.text_stats(spark.createDataFrame([(1, "One two. Three!")], "doc_id long, text string")).first().n_sentences == 3
