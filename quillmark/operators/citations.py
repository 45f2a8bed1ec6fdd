"""In-text citations: scan, sweep, expansion, standard form, context, statistics.

Every operator takes one row per document and keeps ``doc_id``. Extraction is
row-local, so it needs no shuffle: a text goes through each pattern once, and time
grows with its length and its hits.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.functions.text import squash

# The citation patterns, in the order that decides ties.
_A = r"[A-Z][A-Za-z'-]+"
_Y = r"\d{4}[a-z]?"
PATTERNS = {
    "complex_multiple_citations": r"\((?:see\s+)?(?:e\.g\.\s+)?[A-Z][^)]*(?:\d{4}[a-z]?[;,][^)]*){2,}\d{4}[a-z]?[^)]*\)",
    "narrative_four_authors_and": rf"{_A},\s*{_A},\s*{_A},\s*(?:and|&)\s*{_A}\s*\({_Y}\)",
    "narrative_three_authors_and": rf"{_A},\s*{_A},\s*(?:and|&)\s*{_A}\s*\({_Y}\)",
    "narrative_two_authors_and": rf"{_A}\s+(?:and|&)\s+{_A}\s*\({_Y}\)",
    "narrative_etal": rf"{_A}(?:\s*,\s*{_A})*(?:\s*,?\s*(?:and|&)?\s*et\s+al\.?)?\s*\({_Y}\)",
    "narrative_multiple_authors": rf"{_A}(?:\s*,\s*{_A})+(?:\s*,\s*&\s*{_A})?\s*\({_Y}\)",
    "narrative_single": rf"{_A}\s*\({_Y}\)",
    "multiple_citations_semicolon": rf"\({_A}[^)]*{_Y}(?:\s*;\s*[A-Z][^)]*{_Y})+[^)]*\)",
    "see_citations": rf"\((?:see|e\.g\.|cf\.|compare)\s+{_A}[^)]+{_Y}\)",
    "author_year_etal": rf"\({_A}\s+et\s+al\.?,\s*{_Y}\)",
    "author_year_and": rf"\({_A}(?:,\s*{_A})*,?\s+(?:and|&)\s+{_A},\s*{_Y}\)",
    "author_year_ampersand": rf"\({_A}[^)]*&[^)]*{_Y}\)",
    "author_year_basic": rf"\({_A}(?:\s+{_A})*,\s*{_Y}(?:,\s*pp?\.?\s*\d+(?:\s*[-–]\s*\d+)?)?\)",
    "narrative_in_press": rf"{_A}(?:\s+et\s+al\.?)?\s*\((?:in\s+press|forthcoming|n\.d\.)\)",
    "author_year_in_press": rf"\({_A}(?:\s+et\s+al\.?)?,\s*(?:in\s+press|forthcoming|n\.d\.)\)",
    "numbered_simple": r"\[\s*\d+\s*\]",
    "numbered_multiple": r"\[\s*\d+(?:\s*[-,;\s]+\s*\d+)*\s*\]",
    "superscript": "[¹²³⁴⁵⁶⁷⁸⁹⁰]+",
    "doi_pattern": r"https?://doi\.org/[\w\./\-]+",
}
# Capitalised words that start no citation.
NON_AUTHORS = [
    "January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December", "Table", "Figure", "Chapter", "Section", "Appendix", "Volume", "Issue", "Part", "Equation", "Model", "Phase", "Step",
    "Experiment", "Hypothesis", "Criterion", "Category", "Factor", "Panel", "Supplement", "Group", "Type", "Level", "Stage", "Version", "Component", "Dimension", "Cluster", "Wave", "Trial", "Sample", "Grade", "Item", "Number",
]
_NUMERIC = ("numbered_simple", "numbered_multiple", "superscript")
_IN_NUMERIC_TEXT = tuple(p for p in PATTERNS if p.startswith("narrative")) + ("author_year_in_press",)
SUBSETS = {
    "all": tuple(PATTERNS),
    "numeric_superscript": _NUMERIC + _IN_NUMERIC_TEXT,
    "numeric_bracketed": _NUMERIC[:2] + _IN_NUMERIC_TEXT,
    "author_year": tuple(p for p in PATTERNS if p not in _NUMERIC),
}
_NAME = re.compile(r"\(?([A-Z][A-Za-z'-]+)")
_COMPILED = {name: re.compile(p, re.ASCII) for name, p in PATTERNS.items()}


def is_author(hit: str, name: str) -> bool:
    """False for hits of author patterns that start with a word that is no author."""
    if not ("narrative" in name or "author_year" in name):
        return True
    m = _NAME.search(hit)
    return m is None or m[1] not in _NO_AUTHORS


_NO_AUTHORS = frozenset(NON_AUTHORS)
Hit = tuple[int, int, int, int, str, str, str]


def hits_of(text: str, names: tuple[str, ...], sweep: bool) -> list[Hit]:
    """(start, size negated, pattern's order, end, type, id, text) of the hits of a text, sorted.

    Ids number the hits of a pattern before false ones are dropped, so they may have
    gaps. Swept, a hit is kept where it starts at or after the last kept end: the
    longest of a start first, then in the patterns' order.
    """
    found: list[Hit] = []
    for order, name in enumerate(PATTERNS):
        if name in names:
            for k, m in enumerate(_COMPILED[name].finditer(text), 1):
                if is_author(m.group(), name):
                    found.append((m.start() + 1, m.start() + 1 - m.end(), order, m.end(), name, f"{name}_{k}", m.group()))
    found.sort()
    if not sweep:
        return found
    kept, last = [], 0
    for hit in found:
        if hit[0] >= last:
            kept.append(hit)
            last = hit[3]
    return kept


_FIELDS = {"citation_ord": pa.int32(), "citation_type": pa.string(), "citation_id": pa.string(), "citation_text": pa.string(), "start_pos": pa.int32(), "end_pos": pa.int32()}
_AROUND = {"words_before": pa.string(), "words_after": pa.string(), "n_before": pa.int32(), "n_after": pa.int32()}


def _ddl(fields: dict[str, pa.DataType]) -> str:
    return ", ".join(f"{f} {'int' if t == pa.int32() else 'string'}" for f, t in fields.items())


def _emitted(batch: pa.RecordBatch, rows: list[tuple], fields: dict[str, pa.DataType]) -> pa.RecordBatch:
    """Rows (place in the batch, fields...) with their document's id."""
    columns = list(zip(*rows)) if rows else [()] * (len(fields) + 1)
    return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(columns[0], pa.int32())), *(pa.array(c, t) for c, t in zip(columns[1:], fields.values()))], names=["doc_id", *fields])


def _listed(found: list[Hit]) -> list[tuple]:
    return [(k, h[4], h[5], h[6], h[0], h[3]) for k, h in enumerate(found, 1)]


def _source(docs: DataFrame, text: str) -> DataFrame:
    return docs.select("doc_id", squash(F.col(text)).alias("_t")).where(F.length("_t") > 0)


def scan(docs: DataFrame, text: str = "text", citation_type: str = "all", sweep: bool = True) -> DataFrame:
    """(doc_id, citation_ord, citation_type, citation_id, citation_text, start_pos, end_pos).

    Places are in the text with squashed white space. Null texts have none.
    """
    names = SUBSETS[citation_type]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, *x) for i, t in enumerate(batch.column(1).to_pylist()) for x in _listed(hits_of(t, names, sweep))]
            yield _emitted(batch, rows, _FIELDS)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return _source(docs, text).mapInArrow(run, f"doc_id {kind}, {_ddl(_FIELDS)}")


def expand(citations: DataFrame) -> DataFrame:
    """Multiple citations as one row per part that has a year; the rest as they are."""
    many = F.col("citation_type").isin("complex_multiple_citations", "multiple_citations_semicolon")
    inner = F.regexp_replace(F.regexp_replace("citation_text", r"^\((?:see\s+)?(?:e\.g\.\s+)?(?:cf\.\s+)?(?:compare\s+)?", ""), r"\)$", "")
    single = citations.where(~many).withColumn("original_complex_citation", F.lit(None).cast("string")).withColumn("part", F.lit(0))
    parts = citations.where(many).select("*", F.posexplode(F.split(inner, r"\s*;\s*", -1)).alias("j", "piece")).where(F.col("piece").rlike(r"\d{4}"))
    parts = parts.select(
        "doc_id", "citation_ord", F.lit("parsed_from_multiple").alias("citation_type"), F.concat(F.lit("parsed_multiple_"), F.col("citation_ord").cast("string"), F.lit("_"), (F.col("j") + 1).cast("string")).alias("citation_id"),
        F.concat(F.lit("("), F.trim("piece"), F.lit(")")).alias("citation_text"), "start_pos", "end_pos", F.col("citation_text").alias("original_complex_citation"), (F.col("j") + 1).alias("part"),
    )
    return single.unionByName(parts)


def standardize(citations: DataFrame) -> DataFrame:
    """author_part, year_part, standardized_citation and citation_text_clean; a
    narrative citation without a year keeps its own text."""
    narrative = F.col("citation_type").contains("narrative")
    author = F.regexp_extract("citation_text", r"^([^(]+)", 1)
    year = F.regexp_extract("citation_text", r"(\(\d{4}[a-z]?\))", 1)
    out = citations.withColumn("author_part", F.when(narrative, author)).withColumn("year_part", F.when(narrative & (F.length(year) > 0), year))
    standard = F.concat(F.lit("("), F.trim("author_part"), F.lit(", "), F.translate("year_part", "()", ""), F.lit(")"))
    return out.withColumn("standardized_citation", standard).withColumn("citation_text_clean", F.coalesce("standardized_citation", "citation_text"))


def _around(text: str, spans: list[tuple[int, int]], window: int) -> list[tuple[str, str, int, int]]:
    """(words before, words after, number of all words before, and after up to the next
    later start) of each (start, end), from one pass over the words of ``text``."""
    import regex

    words = [(m.start(), m.end()) for m in regex.finditer(r"[\p{L}\p{M}\p{N}_]+", text)]
    begins, ends = [w[0] for w in words], [w[1] for w in words]
    starts = sorted({s for s, _ in spans})
    out = []
    for s, e in spans:
        n_before = bisect_left(begins, s - 1)
        # a word that runs into the citation counts up to it
        before = [text[a : min(b, s - 1)] for a, b in words[max(n_before - window, 0) : n_before]]
        k = bisect_right(starts, e)
        limit = starts[k] - 1 if k < len(starts) else len(text)
        first, last = bisect_right(ends, e), bisect_left(begins, limit)
        after = [text[max(a, e) : min(b, limit)] for a, b in words[first : min(first + window, last)]]
        out.append((" ".join(before), " ".join(after), n_before, max(last - first, 0)))
    return out


def _with_kind(found: DataFrame, window: int) -> DataFrame:
    n = lambda c: F.least(F.col(c), F.lit(window))
    return found.select(
        "doc_id", "citation_id", "citation_type", "citation_text", "start_pos", "end_pos", "words_before", "words_after",
        F.trim(F.concat_ws(" ", "words_before", "citation_text", "words_after")).alias("full_context"), (F.col("n_before") + F.col("n_after")).alias("context_word_count"),
        (n("n_before") + n("n_after")).alias("window_word_count"),
        F.col("citation_type").contains("narrative").alias("is_narrative"), (F.col("citation_type") == "parsed_from_multiple").alias("is_parsed_multiple"),
    )


def scan_contexts(docs: DataFrame, window: int = 10, text: str = "text", citation_type: str = "all") -> DataFrame:
    """:func:`contexts` of the swept citations, found in the same pass: no join, no shuffle."""
    names = SUBSETS[citation_type]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, t in enumerate(batch.column(1).to_pylist()):
                found = hits_of(t, names, True)
                rows += [(i, *x, *y) for x, y in zip(_listed(found), _around(t, [(h[0], h[3]) for h in found], window))]
            yield _emitted(batch, rows, _FIELDS | _AROUND)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return _with_kind(_source(docs, text).mapInArrow(run, f"doc_id {kind}, {_ddl(_FIELDS | _AROUND)}"), window)


def contexts(docs: DataFrame, citations: DataFrame, window: int = 10, text: str = "text") -> DataFrame:
    """The ``window`` words before and after each citation; the words after stop at
    the next citation that starts later. Also the number of all words before and of
    the clipped words after, and of the words in the window.

    A document's citations meet its text in one row; its words are read once.
    """
    columns = ["citation_type", "citation_id", "citation_text", "start_pos", "end_pos"]
    own = citations.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start_pos", "citation_id", *[c for c in columns if c not in ("start_pos", "citation_id")]))).alias("cites"))
    joined = _source(docs, text).join(own, "doc_id")
    fields = {c: _FIELDS[c] for c in columns} | _AROUND

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, (t, cites) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                rows += [(i, *(c[f] for f in columns), *y) for c, y in zip(cites, _around(t, [(c["start_pos"], c["end_pos"]) for c in cites], window))]
            yield _emitted(batch, rows, fields)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return _with_kind(joined.mapInArrow(run, f"doc_id {kind}, {_ddl(fields)}"), window)


def with_matches(found: DataFrame, mapping: DataFrame) -> DataFrame:
    """Contexts with what their citations match; a citation with several numbers has a row for each."""
    told = mapping.select("doc_id", "citation_id", "matched_ref_id", "ref_full_text", "match_confidence")
    return found.join(told, ["doc_id", "citation_id"], "left")


def complex_counts(citations: DataFrame) -> DataFrame:
    """How many citations each multiple citation was parsed into."""
    return citations.where(F.col("citation_type") == "parsed_from_multiple").groupBy("doc_id", "original_complex_citation").agg(F.count("*").alias("individual_citations_extracted"))


def section_spans(sections: DataFrame) -> DataFrame:
    """(doc_id, section, first_pos, last_pos) of sections laid end to end with one blank between."""
    size = F.length(squash(F.col("text"))) + 1
    before = F.coalesce(F.sum(size).over(Window.partitionBy("doc_id").orderBy("section_ord").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return sections.select("doc_id", "section_ord", "section", (before + 1).alias("first_pos"), (before + size).alias("last_pos"))


def map_to_sections(citations: DataFrame, sections: DataFrame) -> DataFrame:
    """Each citation's section by its start; 'Unknown' outside of all."""
    s = section_spans(sections).withColumnRenamed("doc_id", "_d")
    hit = (F.col("doc_id") == F.col("_d")) & F.col("start_pos").between(F.col("first_pos"), F.col("last_pos"))
    return citations.join(s.drop("section_ord"), hit, "left").withColumn("section", F.coalesce("section", F.lit("Unknown"))).drop("_d", "first_pos", "last_pos")


def map_to_segments(citations: DataFrame, n_segments: int = 10) -> DataFrame:
    """Each citation's segment of equal width between the first and last start (1 where all are equal)."""
    w = Window.partitionBy("doc_id")
    low, high = F.min("start_pos").over(w), F.max("start_pos").over(w)
    width = (high - low) / n_segments
    segment = F.when(F.col("start_pos") == low, 1).otherwise(F.least(F.lit(n_segments), F.ceil((F.col("start_pos") - low) / width)).cast("int"))
    return citations.withColumn("segment", F.concat(F.lit("Segment "), segment.cast("string")))


def cooccurrence(citations: DataFrame, max_distance: int = 1000) -> DataFrame:
    """Ordered pairs of a document's citations whose gap is at most ``max_distance``.

    Places fall into bins of that length; a pair's ends lie in the same or in
    neighbouring bins, so the join is an equality on (document, bin) and its
    groups don't grow with the document.
    """
    c = citations.select("doc_id", "ord", "citation", "citation_type", "start_pos", "end_pos")
    left = c.select("doc_id", F.col("ord").alias("ord1"), F.col("citation").alias("citation1"), F.col("citation_type").alias("type1"), F.col("end_pos").alias("_e"), F.explode(F.sequence(F.floor(F.col("start_pos") / max_distance), F.floor((F.col("end_pos") + max_distance) / max_distance))).alias("bin"))
    right = c.select("doc_id", F.col("ord").alias("ord2"), F.col("citation").alias("citation2"), F.col("citation_type").alias("type2"), F.col("start_pos").alias("_s"), F.floor(F.col("start_pos") / max_distance).alias("bin"))
    pairs = left.join(right, ["doc_id", "bin"]).where((F.col("ord1") < F.col("ord2")) & (F.col("_s") - F.col("_e") <= max_distance))
    return pairs.select("doc_id", "ord1", "ord2", "citation1", "citation2", (F.col("_s") - F.col("_e")).alias("distance"), "type1", "type2")


def type_distribution(citations: DataFrame) -> DataFrame:
    """Citations by type within a document, with their percentage."""
    n = citations.groupBy("doc_id", "citation_type").agg(F.count("*").alias("n"))
    return n.withColumn("percentage", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("doc_id")) * 100, 2))


def section_distribution(citations: DataFrame, sections: DataFrame) -> DataFrame:
    """Citations by section, zero for declared sections without any; 'Unknown' is kept."""
    n = citations.groupBy("doc_id", "section").agg(F.count("*").alias("n"))
    spine = sections.select("doc_id", "section").distinct()
    every = spine.join(n, ["doc_id", "section"], "full").withColumn("n", F.coalesce("n", F.lit(0)))
    total = F.sum("n").over(Window.partitionBy("doc_id"))
    return every.withColumn("percentage", F.when(total > 0, F.round(F.col("n") / total * 100, 2)).otherwise(0.0))


def narrative_ratio(citations: DataFrame) -> DataFrame:
    """Total, narrative and parenthetical citations and the narrative percentage of each document."""
    narrative = F.sum(F.col("citation_type").contains("narrative").cast("int"))
    out = citations.groupBy("doc_id").agg(F.count("*").alias("total_citations"), narrative.alias("narrative_citations"))
    return out.withColumn("parenthetical_citations", F.col("total_citations") - F.col("narrative_citations")).withColumn("narrative_percentage", F.round(F.col("narrative_citations") / F.col("total_citations") * 100, 2))


def density(docs: DataFrame, citations: DataFrame, text: str = "text") -> DataFrame:
    """Words, citations, citations per 1000 words and words per citation of each document."""
    words = docs.select("doc_id", F.size(F.split(squash(F.col(text)), r"\s+", -1)).alias("total_words"))
    n = citations.groupBy("doc_id").agg(F.count("*").alias("n_citations"))
    out = words.join(n, "doc_id", "left").withColumn("n_citations", F.coalesce("n_citations", F.lit(0)))
    return out.withColumn("citations_per_1000_words", F.round(F.col("n_citations") / F.col("total_words") * 1000, 2)).withColumn("avg_words_between_citations", F.when(F.col("n_citations") > 0, F.round(F.col("total_words") / F.col("n_citations"), 2)))


def has_citation(text: Column) -> Column:
    """Whether a text holds an author-year or a numbered citation."""
    return text.rlike(r"\([A-Z][a-z]+.*?(19|20)\d{2}\)|[A-Z][a-z]+\s+(et\s+al\.?\s+)?\((19|20)\d{2}\)") | text.rlike(r"\[\d+[,;\-\d\s]*\]")


def drop_beyond(citations: DataFrame, n_references: DataFrame) -> DataFrame:
    """Without numbered citations that name a label above the document's number of references."""
    numbers = F.transform(F.regexp_extract_all("citation_text", F.lit(r"\d+"), F.lit(0)), lambda x: x.cast("int"))
    joined = citations.join(n_references.select("doc_id", "n_references"), "doc_id", "left")
    beyond = F.col("citation_type").startswith("numbered_") & F.exists(numbers, lambda x: x > F.col("n_references"))
    return joined.where(~F.coalesce(beyond, F.lit(False))).drop("n_references")
