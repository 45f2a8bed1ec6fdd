"""Scan, sweep, expansion, contexts, co-occurrence, matching."""

from pyspark.sql import functions as F

from quillmark.operators import citations as ci
from quillmark.operators import matching as ma

SAMPLES = {
    "complex_multiple_citations": "(see Smith 2000; Jones 2001; Brown 2002)", "narrative_four_authors_and": "Ab, Cd, Ef, and Gh (2001)", "narrative_three_authors_and": "Ab, Cd, and Ef (2001)",
    "narrative_two_authors_and": "Smith and Jones (2001)", "narrative_etal": "Smith et al. (2001)", "narrative_multiple_authors": "Smith, Jones (2001)", "narrative_single": "Smith (2001)",
    "multiple_citations_semicolon": "(Smith, 2000; Jones, 2001)", "see_citations": "(see Smith et al 2001)", "author_year_etal": "(Smith et al., 2001)", "author_year_and": "(Smith and Jones, 2001)",
    "author_year_ampersand": "(Smith & Jones 2001)", "author_year_basic": "(Smith, 2001, p. 3-5)", "narrative_in_press": "Smith (in press)", "author_year_in_press": "(Smith, n.d.)",
    "numbered_simple": "[1]", "numbered_multiple": "[1, 3-5]", "superscript": "¹²", "doi_pattern": "https://doi.org/10.1000/x1",
}


def test_every_pattern_hits(spark):
    docs = spark.createDataFrame([(i, f"As in {t} it was") for i, t in enumerate(SAMPLES.values())], "doc_id long, text string")
    found = {(r.doc_id, r.citation_type): r for r in ci.scan(docs, sweep=False).collect()}
    for i, (name, text) in enumerate(SAMPLES.items()):
        assert found[(i, name)].citation_text == text
        assert found[(i, name)].start_pos == 7


def test_sweep_matches_brute_force(spark):
    docs = spark.createDataFrame([(1, " and ".join(SAMPLES.values())), (2, ""), (3, None)], "doc_id long, text string")
    every = sorted((r.start_pos, r.start_pos - r.end_pos, list(SAMPLES).index(r.citation_type), r.end_pos, r.citation_id) for r in ci.scan(docs, sweep=False).collect())
    last, kept = 0, []
    for s, _, _, e, i in every:
        if s >= last:
            kept.append(i)
            last = e
    assert [r.citation_id for r in ci.scan(docs).orderBy("citation_ord").collect()] == kept


def test_false_positives_and_expansion(spark):
    docs = spark.createDataFrame([(1, "In March (2001) and Table (2002) nothing. But (Smith, 2000; Jones, 2001) and Smith (2003).")], "doc_id long, text string")
    out = ci.standardize(ci.expand(ci.scan(docs))).orderBy("citation_ord", "part").collect()
    assert [r.citation_text for r in out] == ["(Smith, 2000)", "(Jones, 2001)", "Smith (2003)"]
    assert out[2].citation_text_clean == "(Smith, 2003)"
    assert out[0].original_complex_citation == "(Smith, 2000; Jones, 2001)"


def test_cooccurrence_matches_brute_force(spark):
    rows = [(1, k, f"c{k}", "t", 97 * k * k % 5000, 97 * k * k % 5000 + 20) for k in range(60)]
    rows.sort(key=lambda r: r[4])
    rows = [(d, k, c, t, s, e) for k, (d, _, c, t, s, e) in enumerate(rows)]
    df = spark.createDataFrame(rows, "doc_id long, ord int, citation string, citation_type string, start_pos int, end_pos int")
    got = {(r.ord1, r.ord2, r.distance) for r in ci.cooccurrence(df, 300).collect()}
    assert got == {(a[1], b[1], b[4] - a[5]) for a in rows for b in rows if a[1] < b[1] and b[4] - a[5] <= 300}


REFS = "doc_id long, ref_id string, ref_ord int, ref_year string, ref_first_author string, ref_second_author string, n_authors int"


def _match(spark, cite, refs):
    c = spark.createDataFrame([(1, "c1", "narrative_single", cite, cite)], "doc_id long, citation_id string, citation_type string, citation_text string, citation_text_clean string")
    r = spark.createDataFrame([(1, f"REF_{k}", k, *x) for k, x in enumerate(refs, 1)], REFS)
    row = ma.match_narrative(c, r).first()
    return row.match_confidence, row.matched_ref_id


def test_match_labels(spark):
    s = lambda y, n=1, second=None, name="Smith": (y, name, second, n)
    assert _match(spark, "(Smith, 2001)", [s("2001")]) == ("high", "REF_1")
    assert _match(spark, "(Smith et al., 2001)", [s("2001", 2)]) == ("medium_etal_inconsistent", "REF_1")
    assert _match(spark, "(Smith, 2001b)", [s("2001"), s("2001")]) == ("high_suffix_disambiguated", "REF_2")
    assert _match(spark, "(Smith, 2001d)", [s("2001"), s("2001")]) == ("medium_suffix_out_of_range", "REF_2")
    assert _match(spark, "(Smith and Jones, 2001)", [s("2001", 2, "jones"), s("2001", 2, "brown")]) == ("high_second_author", "REF_1")
    assert _match(spark, "(Smith and Jones, 2001)", [s("2001", 2, "jones"), s("2001", 2, "jones")]) == ("medium_multiple_with_second", "REF_1")
    assert _match(spark, "(Smith et al., 2001)", [s("2001", 2), s("2001", 4)]) == ("medium_etal_heuristic", "REF_2")
    assert _match(spark, "(Smith et al., 2001)", [s("2001", None), s("2001", None)]) == ("medium_crossref_etal", "REF_1")
    assert _match(spark, "(Smith, 2001)", [s("2001"), s("2001")]) == ("medium_multiple_matches", "REF_1")
    assert _match(spark, "(Smith, 1999)", [s("2001")]) == ("no_match_year", None)
    assert _match(spark, "(Brown, 2001)", [s("2001")]) == ("no_match_author", None)
    assert _match(spark, "(Smith)", [s("2001")]) == ("no_match_missing_info", None)
    # an exact year without the author blocks the year without its letter
    assert _match(spark, "(Smith, 2001a)", [s("2001a", name="Brown"), s("2001")]) == ("no_match_author", None)


def test_match_numbered(spark):
    c = spark.createDataFrame([(1, "c1", "numbered_multiple", "[1, 9]", "[1, 9]"), (1, "c2", "narrative_single", "Smith (2000)", "(Smith, 2000)")], "doc_id long, citation_id string, citation_type string, citation_text string, citation_text_clean string")
    r = spark.createDataFrame([(1, "REF_1", 1, "2000", "Smith", None, 1)], REFS)
    assert {(x.matched_ref_id, x.match_confidence) for x in ma.match_numbered(c, r).collect()} == {("REF_1", "high_numbered"), (None, "no_match_numbered")}


def test_contexts_match_brute_force(spark):
    import re

    text = "alpha beta Smith (2001) gamma delta Jones (2002), eps [3] zeta x" + " y" * 30 + "Brown (2003) end"
    docs = spark.createDataFrame([(1, text), (2, None), (3, "no citation")], "doc_id long, text string")
    found = ci.scan(docs)
    starts = sorted(r.start_pos for r in found.collect())
    for got in (ci.contexts(docs, found, 3).collect(), ci.scan_contexts(docs, 3).collect()):
        assert len(got) == 4
        for r in got:
            before = re.findall(r"\w+", text[: r.start_pos - 1])
            later = [s for s in starts if s > r.end_pos]
            after = re.findall(r"\w+", text[r.end_pos : later[0] - 1 if later else None])
            assert (r.words_before, r.words_after, r.context_word_count) == (" ".join(before[-3:]), " ".join(after[:3]), len(before) + len(after))


def test_contexts_with_matches_fan_out(spark):
    found = ci.scan_contexts(spark.createDataFrame([(1, "As in [1, 2] it was.")], "doc_id long, text string"))
    mapping = spark.createDataFrame([(1, "numbered_multiple_1", f"REF_{k}", f"text {k}", "high_numbered") for k in (1, 2)], "doc_id long, citation_id string, matched_ref_id string, ref_full_text string, match_confidence string")
    assert sorted(r.matched_ref_id for r in ci.with_matches(found, mapping).collect()) == ["REF_1", "REF_2"]
