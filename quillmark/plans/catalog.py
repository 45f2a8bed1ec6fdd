"""All queries of the core library and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmark.functions import names, text as tx
from quillmark.operators import citations as ci
from quillmark.operators import clusters as cl
from quillmark.operators import layout as la
from quillmark.operators import matching as ma
from quillmark.operators import moves as mo
from quillmark.operators import nested as ne
from quillmark.operators import network as nw
from quillmark.operators import references as re_
from quillmark.operators import sections as se
from quillmark.operators import words as wo
from quillmark.plans import inputs as inp
from quillmark.shared import load, written
from quillmark.sources import index as ix
from quillmark.sources.export import exported

SELECTED = ("museum", "valley", "market", "central valley", "second flood", "old bridge")


# Words --------------------------------------------------------------------------


def readability_indices(spark, d):
    return load(spark, d, "documents").select("doc_id", tx.readability(F.col("text")).alias("r")).select("doc_id", "r.*")


def syllable_counts(spark, d):
    w = load(spark, d, "documents").where(F.length("text") > 0).select(F.explode(F.array_distinct(tx.alpha_words(F.col("text")))).alias("word")).distinct()
    return w.select("word", tx.syllables(F.col("word")).alias("n_syllables"))


def text_stats(spark, d):
    return wo.text_stats(load(spark, d, "documents"))


def _paper_words(spark, d, **more):
    s = load(spark, d, "sentences").select("paper_id", "sentence_id", "text").distinct()
    return wo.word_rows(s, ["paper_id", "sentence_id"], **more)


def word_frequencies(spark, d):
    return wo.word_frequencies(_paper_words(spark, d, min_length=3), ["paper_id"])


def stopword_antijoin(spark, d):
    return _paper_words(spark, d, stopwords=wo.stopword_table(spark)).groupBy("paper_id").agg(F.count("*").alias("n_words"), F.countDistinct("word").alias("n_unique"))


def ngram_top15(spark, d):
    arrays = wo.word_arrays(_paper_words(spark, d, stopwords=wo.stopword_table(spark)), ["paper_id", "sentence_id"])
    return wo.top_ngrams(arrays, ["paper_id"])


def lexical_diversity(spark, d):
    return wo.lexical_diversity(_paper_words(spark, d), ["paper_id"])


def _selected(spark):
    return spark.createDataFrame([(w,) for w in SELECTED], "word string")


def word_distribution_segments(spark, d):
    parts = wo.segments(load(spark, d, "documents"), 10)
    return wo.word_distribution(parts, _selected(spark), ["doc_id", "segment"], wo.stopword_table(spark))


def word_distribution_sections(spark, d):
    return wo.word_distribution(inp.sections(spark, d), _selected(spark), ["doc_id", "section"], wo.stopword_table(spark))


def word_distribution_dense(spark, d):
    parts = inp.sections(spark, d)
    return wo.dense(wo.word_distribution(parts, _selected(spark), ["doc_id", "section"], wo.stopword_table(spark)), parts, list(SELECTED), ["doc_id", "section"])


def word_top20(spark, d):
    return wo.top_words(word_frequencies(spark, d))


def text_previews(spark, d):
    """Texts cut to the widths of labels, blocks and heat maps."""
    t = F.col("text")
    return load(spark, d, "sentences").where(t.isNotNull()).select("sentence_id", *[wo.truncated(t, k).alias(f"upto_{k}") for k in (25, 200, 20)]).distinct()


# Clusters -----------------------------------------------------------------------


def tfidf_by_section(spark, d):
    return cl.tf_idf(inp.terms(spark, d), ["paper_id"])


def tfidf_top_n(spark, d):
    return cl.top_terms(tfidf_by_section(spark, d), ["paper_id"]).select("paper_id", "section", "ngram", "n", "tf_idf", "rank")


def cluster_summary(spark, d):
    return cl.section_summary(cl.top_terms(tfidf_by_section(spark, d), ["paper_id"], k=5), ["paper_id"])


def tfidf_heatmap(spark, d):
    return cl.heatmap_terms(cl.top_terms(tfidf_by_section(spark, d), ["paper_id"]), ["paper_id"])


def _cited(spark, d):
    """(citations, mapping) of each paper: its citations in five parts by their order, and what they were matched to."""
    c = load(spark, d, "matched_citations").where(F.col("citation_text_clean").isNotNull()).select("paper_id", "mapping_id", "citation_text_clean", "ref_full_text").distinct()
    order = Window.partitionBy("paper_id").orderBy("mapping_id", "citation_text_clean", "ref_full_text")
    part = F.ntile(len(inp.PARTS)).over(order)
    placed = c.select("paper_id", "citation_text_clean", F.array(*[F.lit(n) for n in inp.PARTS])[part - 1].alias("section"))
    return placed, c


def cluster_terms(spark, d):
    return cl.describe(*_cited(spark, d), ["paper_id"], stopwords=wo.stopword_table(spark))[0]


def cluster_references(spark, d):
    return cl.describe(*_cited(spark, d), ["paper_id"], stopwords=wo.stopword_table(spark))[1]


def reference_titles(spark, d):
    return load(spark, d, "matched_citations").where(F.col("ref_full_text").isNotNull()).select("mapping_id", cl.title_of(F.col("ref_full_text")).alias("title")).distinct()


# Citations ----------------------------------------------------------------------


def citation_scan(spark, d):
    return ci.scan(inp.papers(spark, d), sweep=False).drop("citation_ord")


def citation_sweep(spark, d):
    return ci.scan(inp.papers(spark, d))


def citation_expand(spark, d):
    return ci.expand(citation_sweep(spark, d)).drop("part")


def _standard(spark, d):
    return ci.standardize(ci.expand(citation_sweep(spark, d)))


def citation_expand_groups(spark, d):
    """Citations grouped in one pair of brackets, one by one."""
    return ci.expand(ci.scan(inp.grouped_papers(spark, d))).drop("part")


def citation_standardize(spark, d):
    return _standard(spark, d).select("doc_id", "citation_id", "author_part", "year_part", "citation_text_clean")


def citation_types(spark, d):
    return ci.type_distribution(citation_sweep(spark, d))


def narrative_ratio(spark, d):
    return ci.narrative_ratio(citation_sweep(spark, d))


def citation_density(spark, d):
    return ci.density(inp.papers(spark, d), citation_sweep(spark, d))


def citation_segments(spark, d):
    return ci.map_to_segments(citation_sweep(spark, d)).select("doc_id", "citation_id", "start_pos", "segment")


def _five_parts(spark, d):
    """Each paper's text cut into five sections of equal length."""
    names_ = F.array(*[F.lit(n) for n in inp.PARTS])
    t = inp.papers(spark, d).select("doc_id", tx.squash(F.col("text")).alias("t"))
    size = F.ceil(F.length("t") / len(inp.PARTS)).cast("int")
    return t.select("doc_id", "t", F.posexplode(names_).alias("i", "section"), size.alias("s")).select("doc_id", (F.col("i") + 1).alias("section_ord"), "section", F.col("t").substr(F.col("i") * F.col("s") + 1, F.col("s")).alias("text"))


def citation_sections(spark, d):
    return ci.map_to_sections(citation_sweep(spark, d), _five_parts(spark, d)).select("doc_id", "citation_id", "section")


def section_distribution(spark, d):
    return ci.section_distribution(citation_sections(spark, d), _five_parts(spark, d))


def citation_contexts(spark, d):
    return ci.scan_contexts(inp.papers(spark, d))


def citation_subsets(spark, d):
    """Hits by type for the narrower subsets of patterns."""
    parts = [ci.scan(inp.papers(spark, d), citation_type=name, sweep=False).groupBy("doc_id", F.lit(name).alias("subset"), "citation_type").agg(F.count("*").alias("n")) for name in ci.SUBSETS if name != "all"]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def citation_complex(spark, d):
    return ci.complex_counts(ci.expand(ci.scan(inp.grouped_papers(spark, d))))


def citation_drop_beyond(spark, d):
    n = inp.references(spark, d).groupBy("doc_id").agg(F.count("*").alias("n_references"))
    return ci.drop_beyond(citation_sweep(spark, d), n).select("doc_id", "citation_id", "citation_text")


def _matched(spark, d):
    """(citations, mapping) of the papers' own texts."""
    cites = written(_standard(spark, d).drop("part"), "catalog-citations")
    return cites, _mapping(cites, inp.references(spark, d))


def _mapping(cites, refs):
    both = ma.match_numbered(cites, refs).select("doc_id", "citation_id", "matched_ref_id", "match_confidence").unionByName(ma.match_narrative(cites, refs).select("doc_id", "citation_id", "matched_ref_id", "match_confidence"))
    return both.join(refs.select("doc_id", F.col("ref_id").alias("matched_ref_id"), "ref_full_text"), ["doc_id", "matched_ref_id"], "left")


def contexts_matched(spark, d):
    cites, mapping = _matched(spark, d)
    return ci.with_matches(ci.contexts(inp.papers(spark, d), cites), mapping).select("doc_id", "citation_id", "words_before", "words_after", "context_word_count", "matched_ref_id", "ref_full_text", "match_confidence")


def _pairs(spark, d):
    c = citation_sweep(spark, d).withColumn("ord", F.col("citation_ord")).withColumn("citation", F.col("citation_text"))
    return ci.cooccurrence(c, 1000)


def citation_cooccurrence(spark, d):
    return _pairs(spark, d)


def network_edges(spark, d):
    return nw.edges(_pairs(spark, d), 600).drop("type1", "type2")


def _network(spark, d):
    """(nodes, edges) over citations that are scanned once."""
    c = written(citation_sweep(spark, d).withColumn("ord", F.col("citation_ord")).withColumn("citation", F.col("citation_text")), "catalog-citations")
    pairs = nw.edges(ci.cooccurrence(c, 1000), 600)
    return nw.nodes(pairs, ci.map_to_sections(c, _five_parts(spark, d)), 2), pairs


def network_nodes(spark, d):
    return _network(spark, d)[0]


def network_stats(spark, d):
    kept, pairs = _network(spark, d)
    kept = written(kept, "catalog-nodes")
    return nw.stats(kept, nw.surviving(pairs, kept))


def network_sections(spark, d):
    return nw.sections_of(network_nodes(spark, d))


# References and matching --------------------------------------------------------


def _page_refs(spark, d):
    """(doc_id, ref_ord, ref_full_text): reference strings of each paper."""
    r = load(spark, d, "matched_citations").where(F.length("ref_full_text") >= 15).select(F.col("paper_id").alias("doc_id"), tx.squash(F.col("ref_full_text")).alias("ref_full_text")).distinct()
    return r.withColumn("ref_ord", F.row_number().over(Window.partitionBy("doc_id").orderBy("ref_full_text")))


def reference_format(spark, d):
    return re_.reference_format(_page_refs(spark, d))


def reference_parse(spark, d):
    return re_.parse(_page_refs(spark, d))


def reference_years(spark, d):
    return reference_parse(spark, d).select("doc_id", "ref_ord", "ref_format", "ref_year")


def references_split(spark, d):
    """Reference sections as one text each, split into references."""
    r = _page_refs(spark, d).groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ref_ord", "ref_full_text"))), lambda x: x["ref_full_text"]), "\n \n").alias("references_text"))
    return re_.split_references(r)


def reference_from_index(spark, d):
    return re_.from_index(_index_refs(spark, d))


def _index_refs(spark, d):
    r = load(spark, d, "crossref_refs").groupBy("ref_row_id").agg(F.min(F.struct("paper_id", "author", "ref_year", "article_title", "journal", "doi", "ref_full")).alias("r")).select("ref_row_id", "r.*")
    return r.withColumn("ref_ord", F.row_number().over(Window.partitionBy("paper_id").orderBy("ref_row_id"))).withColumnRenamed("paper_id", "doc_id")


def name_letters(spark, d):
    c = load(spark, d, "matched_citations").where(F.col("ref_authors").isNotNull() & F.col("cite_author").isNotNull()).select("cite_author", F.regexp_extract("ref_authors", r"(\p{Lu}[\p{L}'-]{2,})", 1).alias("ref_name")).distinct()
    return c.select("cite_author", "ref_name", names.letters_shared(F.col("cite_author"), F.col("ref_name")).alias("share")).where(F.length("ref_name") > 0)


def works_citations(spark, d):
    return ix.works_citations(_works(spark, d)).select("doi", "work_id", "n_authors", "first_author", "ref_full_name")


def _works(spark, d):
    """Works as an open index holds them, with nested authors."""
    m = load(spark, d, "main_metadata").groupBy("paper_id").agg(F.max_by(F.struct("doi", "title", "publication_year", "journal_title"), F.struct("fetched_at", "doi", "title", "publication_year", "journal_title")).alias("m"))
    a = load(spark, d, "authors").where(F.col("family_name").isNotNull()).groupBy("author_id").agg(F.min(F.struct("paper_id", "author_ord", "given_name", "family_name")).alias("a")).select("author_id", "a.*")
    own = a.groupBy("paper_id").agg(F.array_sort(F.collect_list(F.struct("author_ord", "author_id", F.trim(F.concat_ws(" ", "given_name", "family_name")).alias("display_name")))).alias("a"))
    return m.join(own, "paper_id", "left").select(F.col("m.doi").alias("doi"), F.col("paper_id").alias("work_id"), F.col("m.title").alias("title"), F.col("m.publication_year").alias("publication_year"), F.col("m.journal_title").alias("source_display_name"), F.transform("a", lambda x: F.struct(x["display_name"].alias("display_name"))).alias("authorships"))


def author_normalize(spark, d):
    a = load(spark, d, "authors").where(F.col("family_name").isNotNull()).select("family_name").distinct()
    return a.select("family_name", names.normal_author(F.col("family_name")).alias("normal_name"))


def author_match(spark, d):
    c = load(spark, d, "matched_citations").where(F.col("ref_authors").isNotNull()).select("cite_author", F.regexp_extract("ref_authors", r"(\p{Lu}[\p{L}'-]{2,})", 1).alias("ref_name")).distinct()
    return c.select("cite_author", "ref_name", names.names_match(F.col("cite_author"), F.col("ref_name")).alias("same"))


def reference_enrich(spark, d):
    r = _index_refs(spark, d).withColumnRenamed("doc_id", "paper_id")
    index = r.select(F.col("paper_id").alias("doc_id"), F.col("ref_row_id").cast("string").alias("ref_id"), F.col("ref_full").alias("ref_full_text"), "ref_year", F.regexp_extract("author", r"(\p{Lu}[\p{L}'-]{2,})", 1).alias("ref_first_author"), F.lit(None).cast("string").alias("ref_second_author"), F.lit(None).cast("int").alias("n_authors"))
    return re_.enrich(index, inp.references(spark, d))


def works_completion(spark, d):
    r = _index_refs(spark, d).withColumnRenamed("doc_id", "paper_id").where(F.col("doi").isNotNull())
    author = F.regexp_extract("author", r"(\p{Lu}[\p{L}'-]{2,})", 1)
    refs = r.select(F.col("paper_id").alias("doc_id"), F.col("ref_row_id").alias("ref_id"), "doi", F.nullif(author, F.lit("")).alias("ref_first_author"), "ref_year", F.col("journal").alias("ref_journal"), F.lit(None).cast("int").alias("n_authors"))
    works = r.select("doi", F.col("ref_row_id").alias("work_id"), F.col("article_title").alias("title"), F.nullif(F.regexp_extract("ref_year", r"(\d{4})", 1), F.lit("")).cast("int").alias("publication_year"), F.col("journal").alias("source_display_name"), F.nullif(author, F.lit("")).alias("first_author"), F.lit(None).cast("int").alias("n_authors"))
    return re_.complete_from_works(refs, works)


def match_numbered(spark, d):
    return ma.match_numbered(inp.citations(spark, d), inp.references(spark, d))


def match_narrative(spark, d):
    return ma.match_narrative(inp.citations(spark, d), inp.references(spark, d))


def match_quality(spark, d):
    both = match_numbered(spark, d).select("match_confidence").unionByName(match_narrative(spark, d).select("match_confidence"))
    return ma.match_quality(both)


# Moves --------------------------------------------------------------------------


def sentence_segments(spark, d):
    return mo.segment(inp.sections(spark, d))


def move_rules(spark, d):
    s = load(spark, d, "sentences").where(F.length("text") > 0).select("sentence_id", "section", "text", "position_pct").distinct()
    return mo.rule_based(s.withColumn("section", F.coalesce("section", F.lit("")))).select("sentence_id", "taxonomy_type", "move_rule", "step_rule", "conf_rule")


def move_reconcile(spark, d):
    s = load(spark, d, "sentences").where(F.length("text") > 0).select("sentence_id", "section", "text", "position_pct", "move", "step", "confidence").distinct()
    ruled = mo.rule_based(s.withColumn("section", F.coalesce("section", F.lit("")))).withColumn("move_rule", F.substring("move_rule", 1, 2))
    return mo.reconcile(ruled.withColumnsRenamed({"move": "move_llm", "step": "step_llm", "confidence": "conf_llm"})).select("sentence_id", "move", "step", "confidence", "method")


def _stored_moves(spark, d):
    s = load(spark, d, "sentences").select("paper_id", F.coalesce(F.trim("section"), F.lit("Unnamed")).alias("section"), "sentence_id", "move", "step", "confidence", "method").distinct()
    return s


def move_pipeline(spark, d):
    return mo.classify(inp.sections(spark, d))["sentences"].select("doc_id", "sentence_id", "section", "position_pct", "move", "step", "confidence", "method")


def _batched(spark, d):
    s = load(spark, d, "sentences").where(F.length("text") > 0).groupBy("sentence_id").agg(F.min(F.struct("paper_id", "section", "text", "move", "step", "confidence")).alias("s")).select("sentence_id", "s.*")
    return mo.batches(s.withColumn("taxonomy_type", mo.taxonomy(F.coalesce("section", F.lit("")))), keys=["paper_id", "taxonomy_type"])


def move_prompts(spark, d):
    return mo.prompts(_batched(spark, d), ["paper_id", "taxonomy_type"])


def move_answers(spark, d):
    """A model's answers, fenced, as their batches' labels; parsed and joined back to the sentences."""
    keys = ["paper_id", "taxonomy_type", "batch"]
    b = _batched(spark, d)
    item = F.struct("id", F.regexp_extract("move", r"^(M\d)", 1).alias("move"), "step", (F.col("confidence") * 2).alias("confidence"))
    said = b.where(F.col("move").isNotNull()).groupBy(*keys).agg(F.concat(F.lit("Here:\n```json\n"), F.to_json(F.array_sort(F.collect_list(item))), F.lit("\n```")).alias("response"))
    out = mo.with_answers(b, mo.parse_responses(said, keys), ["paper_id", "taxonomy_type"])
    return out.select("sentence_id", "batch", "id", "move_llm", "step_llm", "conf_llm")


def move_blocks(spark, d):
    return mo.blocks(_stored_moves(spark, d), ["paper_id", "section"], "sentence_id")


def move_flow(spark, d):
    return mo.flow(_stored_moves(spark, d), ["paper_id", "section"], "sentence_id")


def move_distribution(spark, d):
    return mo.distribution(_stored_moves(spark, d), ["paper_id", "section"], ["move"])


def step_distribution(spark, d):
    return mo.distribution(_stored_moves(spark, d), ["paper_id", "section"], ["move", "step"])


def method_breakdown(spark, d):
    return _stored_moves(spark, d).groupBy("method").agg(F.count("*").alias("n"))


# Structure and layout -----------------------------------------------------------


def _as_papers(spark, d):
    """Documents with wiki headings as section headings of papers: of the second level
    after a blank line, of lower ones after a line break, and a reference list that
    half of them have only in running text."""
    t = F.regexp_replace(F.regexp_replace("text", r"(?m)^==([^=]+)==\s*$", "\n\n2. Results\n"), r"(?m)^===+([^=]+)===+\s*$", "\n3 Discussion: ")
    end = F.when(F.col("doc_id") % 2 == 0, "\n\nBibliography\n[1] Smith, J.").otherwise(" so it ends. References Smith, J. and others")
    return load(spark, d, "documents").where(F.length("text") > 0).select("doc_id", F.concat(t, F.lit("\n\nConclusions. It was."), end).alias("text"))


def section_split(spark, d):
    return se.split_sections(_as_papers(spark, d)).select("doc_id", "section_ord", "section", F.length("text").alias("n_chars"))


def section_split_toc(spark, d):
    """Sections by the document's own table of contents."""
    docs = load(spark, d, "documents").where(F.length("text") > 0)
    heads = F.regexp_extract_all("text", F.lit(r"(?m)^==+\s*([A-Za-z][A-Za-z ]*?)\s*==+\s*$"), F.lit(1))
    plain = F.regexp_replace("text", r"(?m)^==+\s*([A-Za-z][A-Za-z ]*?)\s*==+\s*$", "\n\n$1\n")
    return se.split_sections(docs.select("doc_id", plain.alias("text"), F.transform(heads, lambda h: F.concat(F.lit("1.2 "), h)).alias("toc")), toc="toc").select("doc_id", "section_ord", "section", F.length("text").alias("n_chars"))


def section_exclusion(spark, d):
    return se.analysed(section_split(spark, d))


def spaced_headings(spark, d):
    t = F.regexp_replace(F.regexp_replace("text", r"(?m)^==+.*$", "R E S U L T S"), r"\. ", ". 2 | METHODS of ")
    return load(spark, d, "documents").where(F.length("text") > 0).select("doc_id", se.spaced_headers(t).alias("text"))


def plain_ligatures(spark, d):
    return load(spark, d, "sentences").where(F.length("text") > 0).select("sentence_id", se.plain_ligatures(F.regexp_replace("text", "fi", "ﬁ")).alias("text")).distinct()


def code_fences(spark, d):
    t = F.regexp_replace("text", r"(?m)^==+.*$", "```python\nx = 1\n```")
    return load(spark, d, "documents").where(F.length("text") > 0).select("doc_id", se.without_fences(t).alias("text"))


def ai_text(spark, d):
    t = F.regexp_replace(F.regexp_replace("text", r"(?m)^==+\s*(.*?)\s*==+\s*$", "2.1. $1"), r" of ", " of\n")
    return load(spark, d, "documents").where(F.length("text") > 0).select("doc_id", se.tidy_ai_text(t).alias("text"))


def headers_removed(spark, d):
    docs = _with_headers(spark, d)
    return se.without_headers(docs, se.running_headers(docs))


def references_normalize(spark, d):
    r = _page_refs(spark, d).groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ref_ord", "ref_full_text"))), lambda x: x["ref_full_text"]), "\n\n").alias("text"))
    return se.reference_blocks(r)


def markdown_sections(spark, d):
    t = F.regexp_replace("text", r"(?m)^==+\s*(.*?)\s*==+\s*$", "## $1")
    return se.markdown_sections(load(spark, d, "documents").where(F.length("text") > 0).select("doc_id", F.lit(1).alias("chunk_ord"), t.alias("text"))).select("doc_id", "section", F.length("text").alias("n_chars"))


def table_removal(spark, d):
    return load(spark, d, "documents").where(F.length("text") > 0).select("doc_id", se.without_tables(F.col("text")).alias("text"))


def figure_caption_removal(spark, d):
    return load(spark, d, "documents").where(F.length("text") > 0).select("doc_id", se.without_figure_captions(F.regexp_replace("text", r"(?m)^\* ", "Figure 1: ")).alias("text"))


def superscript_convert(spark, d):
    return load(spark, d, "sentences").where(F.length("text") > 0).select("sentence_id", se.superscript_citations(F.col("text")).alias("text")).distinct()


def _with_headers(spark, d):
    return inp.papers(spark, d).select("doc_id", F.regexp_replace("text", r"\. ", "\n12\n\nAnnals of Applied Acoustics, the second volume of it\n").alias("text"))


def running_headers(spark, d):
    return se.running_headers(_with_headers(spark, d))


def line_binning(spark, d):
    return la.lines(inp.boxes(spark, d)).select("doc_id", "page", "line_y", "line", "n_words")


def column_gutter(spark, d):
    return la.gutter(inp.page_boxes(spark, d)).select("doc_id", "page", F.round("threshold", 4).alias("threshold"))


def global_gutter(spark, d):
    return la.global_gutter(inp.page_boxes(spark, d)).select("doc_id", F.round("threshold", 4).alias("threshold"), "n_pages")


def page_text(spark, d):
    return la.column_texts(inp.page_boxes(spark, d))


def document_text(spark, d):
    """Text of the laid out documents, the plain one where that is short."""
    b = inp.page_boxes(spark, d)
    return la.document_text(b, None if "plain" in b.columns else load(spark, d, "documents").where(F.length("text") > 0).select("doc_id", "text"))


def column_assign(spark, d):
    return la.assign_columns(inp.boxes(spark, d), 3).groupBy("doc_id", "page", "column").agg(F.count("*").alias("n_words"))


def page_columns(spark, d):
    """Which pages have two columns."""
    return la.page_columns(inp.page_boxes(spark, d))


def page_titles(spark, d):
    return inp.headed_lines(spark, d).select("doc_id", "page", "line_y", la.is_title(F.col("line")).alias("title"))


def page_headers(spark, d):
    return la.running_headers(inp.headed_lines(spark, d))


def page_headers_removed(spark, d):
    return la.without_running_headers(inp.headed_lines(spark, d)).groupBy("doc_id", "page").agg(F.count("*").alias("n_lines"))


def first_page_header(spark, d):
    return la.without_first_page_header(inp.headed_lines(spark, d)).groupBy("doc_id", "page").agg(F.count("*").alias("n_lines"))


def first_page_footer(spark, d):
    return la.without_first_page_footer(inp.headed_lines(spark, d)).groupBy("doc_id", "page").agg(F.count("*").alias("n_lines"))


def interleaved_pages(spark, d):
    return la.interleaved(load(spark, d, "documents").where(F.length("text") > 0).select("doc_id", "text"))


def page_chunks(spark, d):
    pages = inp.boxes(spark, d).select("doc_id", "page").distinct()
    return ix.page_chunks(pages).groupBy("doc_id", "chunk").agg(F.min("page").alias("first_page"), F.count("*").alias("n_pages"))


# Sources ------------------------------------------------------------------------


def _messages(spark, d):
    """Index messages as JSON, one per paper."""
    m = load(spark, d, "main_metadata").groupBy("paper_id").agg(F.max_by(F.struct("doi", "title", "journal_title", "publisher", "publication_year", "volume", "issue", "pages", "issn", "work_type", "url"), "fetched_at").alias("m"))
    a = load(spark, d, "authors").dropDuplicates(["author_id"]).groupBy("paper_id").agg(F.array_sort(F.collect_list(F.struct("author_ord", "author_id", "given_name", "family_name", "orcid"))).alias("a"))
    rows = m.join(a, "paper_id", "left")
    body = F.struct(
        F.col("m.doi").alias("DOI"), F.array("m.title").alias("title"), F.array("m.journal_title").alias("container-title"), F.col("m.publisher").alias("publisher"),
        F.struct(F.array(F.array("m.publication_year")).alias("date-parts")).alias("issued"), F.col("m.volume").alias("volume"), F.array("m.issn").alias("ISSN"), F.col("m.work_type").alias("type"),
        F.transform("a", lambda x: F.struct(x["given_name"].alias("given"), x["family_name"].alias("family"), F.concat(F.lit("https://orcid.org/"), x["orcid"]).alias("ORCID"))).alias("author"),
    )
    return ix.messages(rows.select(F.col("paper_id").alias("doc_id"), F.to_json(body).alias("message")))


def index_metadata(spark, d):
    return ix.message_metadata(_messages(spark, d)).select("doc_id", "doi", "title", "journal_title", "publisher", "publication_year", "volume", "issn", "work_type")


def index_authors(spark, d):
    return ix.message_authors(_messages(spark, d)).select("doc_id", "author_ord", "given_name", "family_name", "orcid")


def index_references(spark, d):
    """References of index messages."""
    r = load(spark, d, "crossref_refs").groupBy("ref_row_id").agg(F.min(F.struct("paper_id", "ref_key", "doi", "article_title", "ref_year", "journal", "volume", "first_page", "ref_full")).alias("r")).select("ref_row_id", "r.*")
    item = F.struct(F.col("ref_key").alias("key"), F.col("doi").alias("DOI"), F.col("article_title").alias("article-title"), F.col("ref_year").alias("year"), F.col("journal").alias("journal-title"), "volume", F.col("first_page").alias("first-page"), F.col("ref_full").alias("unstructured"))
    raw = r.groupBy("paper_id").agg(F.to_json(F.struct(F.transform(F.array_sort(F.collect_list(F.struct("ref_row_id", item.alias("x")))), lambda y: y["x"]).alias("reference"))).alias("message"))
    return ix.message_references(ix.messages(raw.withColumnRenamed("paper_id", "doc_id"))).drop("author")


def clean_encoding(spark, d):
    t = F.concat(F.lit("“Smart” &amp; ‘plain’… &lt;b&gt; "), F.col("text"))
    return load(spark, d, "sentences").where(F.length("text") > 0).select("sentence_id", ix.clean_encoding(t).alias("text")).distinct()


def _packets(spark, d):
    """Document information with a metadata packet in place of keys."""
    m = load(spark, d, "main_metadata").groupBy("paper_id").agg(F.max_by(F.struct("doi", "title", "journal_title", "publication_year"), F.struct("fetched_at", "doi", "title", "journal_title", "publication_year")).alias("m"))
    c = lambda x: F.translate(F.coalesce(F.col(f"m.{x}").cast("string"), F.lit("")), "<>", "")
    packet = F.concat(F.lit("<dc:title><rdf:Alt><rdf:li xml:lang='x'>"), c("title"), F.lit("</rdf:li></rdf:Alt></dc:title><dc:creator><rdf:Seq><rdf:li>A. One</rdf:li><rdf:li> B. Two </rdf:li></rdf:Seq></dc:creator><prism:publicationName>"), c("journal_title"), F.lit("</prism:publicationName><prism:coverDate>"), c("publication_year"), F.lit("-01</prism:coverDate><prism:doi>"), c("doi"), F.lit("</prism:doi> doi:10.5555/again.1 10.5555/again.1"))
    none = F.lit(None).cast("timestamp")
    return m.select(F.col("paper_id").alias("doc_id"), F.create_map(F.lit("WPS-JOURNALDOI"), F.lit("10.5555/journal")).alias("keys"), packet.alias("metadata"), none.alias("created"), none.alias("modified"))


def document_packets(spark, d):
    return ix.info_fields(_packets(spark, d))


def document_dois(spark, d):
    """Every DOI of a document's information."""
    return ix.info_dois(_packets(spark, d)).select("doc_id", F.array_join("dois", " ").alias("dois"))


def csv_export(spark, d):
    """A result written as CSV and read back."""
    df = move_distribution(spark, d)
    return exported(df, "csv")


def document_info(spark, d):
    m = load(spark, d, "main_metadata").groupBy("paper_id").agg(F.max_by(F.struct("doi", "title", "journal_title", "url", "fetched_at"), "fetched_at").alias("m"))
    keys = F.map_from_arrays(F.array(F.lit("Title"), F.lit("WPS-ARTICLEDOI"), F.lit("Subject"), F.lit("Creator")), F.array(F.coalesce("m.title", F.lit("")), F.coalesce("m.doi", F.lit("")), F.concat(F.coalesce("m.journal_title", F.lit("")), F.lit(", volume 1")), F.lit("pdfTeX")))
    info = m.select(F.col("paper_id").alias("doc_id"), keys.alias("keys"), F.lit("").alias("metadata"), F.col("m.fetched_at").alias("created"), F.col("m.fetched_at").alias("modified"))
    return ix.info_fields(info)


# Nested values ------------------------------------------------------------------


def p6_found(spark, d):
    return ne.child_items(load(spark, d, "authors"), load(spark, d, "crossref_refs"), load(spark, d, "main_metadata"))


def _child(spark, d, tag, *columns):
    """One child table: its source's nested column flattened in one pass, written by tag, the tag's schema applied."""
    table, key, column, level = {"affiliation": ("authors", "author_id", "affiliation", ne.AFFILIATION), "ref_author": ("crossref_refs", "ref_row_id", "author", ne.REF_AUTHOR), "subject": ("main_metadata", "paper_id", "subject", ne.SUBJECT)}[tag.split("_aff")[0] if tag.startswith("ref") else tag.split("_")[0]]
    emitted = ne.flattened(ne.emit(load(spark, d, table).select(key, column).distinct(), key, column, level), f"nested-{tag}")
    return ne.child_table(emitted, tag).select("item_id", "parent_item_id", "root_id", "ord1", "ord2", *columns)


def p6_affiliations(spark, d):
    return _child(spark, d, "affiliation", F.coalesce("name", "text").alias("name"), "place.city", "place.country")


def p6_departments(spark, d):
    return _child(spark, d, "affiliation_department", F.coalesce("name", "text").alias("name"), "room")


def p6_affiliation_ids(spark, d):
    return _child(spark, d, "affiliation_id", F.coalesce("id", "text").alias("id"), F.col("id-type").alias("id_type"))


def p6_ref_authors(spark, d):
    return _child(spark, d, "ref_author", "family", "given", F.coalesce("name", "text").alias("name"), "sequence")


def p6_ref_author_affiliations(spark, d):
    return _child(spark, d, "ref_author_affiliation", F.coalesce("name", "text").alias("name"))


def p6_subjects(spark, d):
    return _child(spark, d, "subject", F.coalesce("term", F.trim("text")).alias("term"), "scheme")


def p6_broader_subjects(spark, d):
    return _child(spark, d, "subject_broader", F.coalesce("term", "text").alias("term"), "code")


# Bundle -------------------------------------------------------------------------


def analysis_summary(spark, d):
    """One row per paper: the measures of its words, citations and matches."""
    from quillmark.plans.analysis import PaperAnalysis

    return PaperAnalysis(inp.papers(spark, d), inp.references(spark, d)).summary()


QUERIES = (
    readability_indices, syllable_counts, text_stats, word_frequencies, stopword_antijoin, ngram_top15, lexical_diversity, word_distribution_segments, word_distribution_sections, word_distribution_dense,
    tfidf_by_section, tfidf_top_n, cluster_summary, tfidf_heatmap, reference_titles,
    citation_scan, citation_sweep, citation_expand, citation_standardize, citation_types, narrative_ratio, citation_density, citation_segments, citation_sections, section_distribution, citation_contexts,
    citation_cooccurrence, network_edges, network_nodes, network_stats,
    reference_format, reference_parse, reference_years, author_normalize, author_match, reference_enrich, works_completion, match_numbered, match_narrative, match_quality,
    sentence_segments, move_rules, move_reconcile, move_blocks, move_flow, move_distribution, step_distribution, method_breakdown,
    section_split, references_normalize, markdown_sections, table_removal, figure_caption_removal, superscript_convert, running_headers, line_binning, column_gutter, global_gutter, page_text,
    word_top20, text_previews, cluster_terms, cluster_references, citation_subsets, citation_complex, citation_expand_groups, citation_drop_beyond, contexts_matched, network_sections, references_split, reference_from_index, name_letters, works_citations,
    section_split_toc, section_exclusion, spaced_headings, plain_ligatures, code_fences, ai_text, headers_removed, document_text, column_assign, page_columns, page_titles, page_headers, page_headers_removed, first_page_header, first_page_footer, interleaved_pages, page_chunks,
    move_pipeline, move_prompts, move_answers, index_references, clean_encoding, document_packets, document_dois, csv_export,
    index_metadata, index_authors, document_info, p6_found, p6_affiliations, p6_departments, p6_affiliation_ids, p6_ref_authors, p6_ref_author_affiliations, p6_subjects, p6_broader_subjects, analysis_summary,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    from quillmark.plans.oracle import SQL

    return dict(SQL)
