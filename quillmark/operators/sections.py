"""Structure of a document's text: sections, reference blocks, headers, tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.functions.regexscan import located

# Section names looked for where a document brings none.
SECTION_NAMES = (
    "Abstract", "Introduction", "Related work", "Related Work", "Background", "Literature review", "Literature Review", "Methodology", "Methods", "Materials and methods", "Materials and Methods",
    "Experimental design", "Experimental Design", "Analysis", "Results", "Results and discussion", "Results and Discussion", "Discussion", "Comparison study", "Comparison Study",
    "Conclusion", "Conclusions", "Acknowledgment", "Acknowledgments", "Acknowledgement", "Acknowledgements", "References", "Bibliography", "Appendix",
)
# Nouns before a number that is no citation.
COUNTED = [
    "page", "pages", "table", "tables", "figure", "figures", "fig", "figs", "chapter", "chapters", "section", "sections", "step", "steps", "item", "items", "part", "parts", "equation", "equations", "eq", "eqs", "line", "lines", "row", "rows", "column", "columns", "volume", "vol", "issue", "number", "no", "sample", "group", "groups",
    "stage", "stages", "grade", "grades", "level", "levels", "type", "types", "model", "models", "trial", "trials", "wave", "waves", "phase", "phases", "version", "day", "days", "week", "weeks", "month", "months", "year", "years", "age", "aged", "appendix", "panel", "supplement", "experiment", "experiments", "criterion", "criteria",
    "factor", "factors", "dimension", "dimensions", "category", "categories", "cluster", "clusters", "component", "components", "participant", "participants", "subject", "subjects", "patient", "patients", "respondent", "respondents", "hypothesis", "hypotheses",
]
LIGATURES = (("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl"), (" ", " "))
_SUPER = "¹²³⁴⁵⁶⁷⁸⁹⁰"


def plain_ligatures(text: Column) -> Column:
    return reduce(lambda t, p: F.replace(t, F.lit(p[0]), F.lit(p[1])), LIGATURES, text)


def _stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


# Heading patterns around a name: after a blank line, and the looser one after any
# line break; both with a section number, the former also one on its own line.
_STRICT = (r"\n\n(?:[0-9]+(?:\.[0-9]+)*\.?\s*(?:\n\n|\|\s*))?", r"(?=[\s.:])")
_LOOSE = (r"\n\s*(?:[0-9]+(?:\.[0-9]+)*\.?\s*\|?\s+)?", r"(?=[\s.:])")
# Names and patterns of a reference list looked for last, from the strictest to the loosest, and what follows one.
REFERENCE_NAMES = ("References", "REFERENCES", "Bibliography", "BIBLIOGRAPHY")
REFERENCE_PATTERNS = (r"\n\n\s*{}\s*\n", r"\n\s*{}\s*\n", r"\n\n\s*{}\s", r"\n\s*{}\s", r"\s{}\s+(?=[A-Z][a-z])", r"\s{}\s*\n")
LIKE_REFERENCES = r"^\s*[A-Z][a-zÀ-ÿ]|^\s*\[?\d+\]?[.\s]|^\s*\d+\.\s"
_HEAD = "struct<start_pos:int,pass:int,i:int,size:int,name:string>"
_QUOTED = r"([.|?*+^$()\[\]{}\\])"


def _head(t: Column, name: Column, i: Column) -> Column:
    """First heading of a name, by the strict pattern or else by the looser one; null for none."""
    def at(number: int, around: tuple[str, str]) -> tuple[Column, Column]:
        quoted = F.concat(F.lit(around[0]), F.regexp_replace(name, _QUOTED, r"\\$1"), F.lit(around[1]))
        first = F.concat(F.lit(r"(?is)^(.*?)("), quoted, F.lit(")"))
        part = lambda k: F.length(F.call_function("regexp_extract", t, first, F.lit(k)))
        return part(2), F.struct((part(1) + 1).alias("start_pos"), F.lit(number).alias("pass"), i.alias("i"), part(2).alias("size"), name.alias("name"))

    (strict, first), (loose, second) = at(0, _STRICT), at(1, _LOOSE)
    return F.when(strict > 0, first).when(loose > 0, second).cast(_HEAD)


def _heads(t: Column, names: Column) -> Column:
    # most names don't stand in a text at all
    found = F.transform(names, lambda n, i: F.when(F.contains(F.lower(t), F.lower(n)), _head(t, n, i)))
    return F.filter(found, lambda h: h.isNotNull())


def _last_references(t: Column) -> Column:
    """The last place past the middle that looks like the start of a reference list."""
    tries = []
    for name in REFERENCE_NAMES:
        for pattern in REFERENCE_PATTERNS:
            hit = F.element_at(located(t, pattern.format(name)), -1)
            fits = F.substring(t, hit["end_pos"] + 1, F.lit(301)).rlike(LIKE_REFERENCES) & (hit["start_pos"] > F.length(t) * 0.5)
            one = F.struct(hit["start_pos"].alias("start_pos"), F.lit(2).alias("pass"), F.lit(0).alias("i"), (hit["end_pos"] - hit["start_pos"] + 1).alias("size"), F.lit("Bibliography" if "iblio" in name or "IBLIO" in name else "References").alias("name"))
            tries.append(F.when(F.contains(t, F.lit(name)) & t.rlike(pattern.format(name)) & fits, one).cast(_HEAD))
    return F.coalesce(*tries)


def toc_names(toc: Column) -> Column:
    """Section names of a table of contents: without numbers, of at most 80 characters, each once."""
    names = F.transform(toc, lambda n: plain_ligatures(F.regexp_replace(n, r"^[0-9]+(\.[0-9]+)*\s+", "")))
    return F.array_distinct(F.filter(names, lambda n: (F.length(n) > 0) & (F.length(n) <= 80)))


def normalised(docs: DataFrame, text: str = "text") -> DataFrame:
    """Ligatures plain, running headers out, letter-spaced headings put together."""
    plain = docs.withColumn(text, plain_ligatures(F.col(text)))
    return without_headers(plain, running_headers(plain, text), text).withColumn(text, spaced_headers(F.col(text)))


def split_sections(docs: DataFrame, text: str = "text", names=SECTION_NAMES, toc: str | None = None) -> DataFrame:
    """(doc_id, section_ord, section, text) of each document, Full_text first (section_ord 0).

    Names are those of the document's own table of contents (column ``toc``) where any
    of them is found, else ``names``; each by its first heading after a blank line,
    else by a looser pattern; a reference list is also looked for in the second half.
    Text of more than 50 characters before a first heading beyond character 100
    is the Preface; Bibliography is References where there is none; empty sections
    are dropped. Null texts give no rows. Texts are taken as they are (:func:`normalised`).
    """
    given = F.array(*[F.lit(n) for n in names])
    found = docs.where(F.col(text).isNotNull()).select("doc_id", F.col(text).alias("t"), *([toc_names(F.col(toc)).alias("own")] if toc else []))
    if toc:
        found = found.withColumn("h", _heads(F.col("t"), F.coalesce("own", F.array().cast("array<string>")))).withColumn("h", F.when(F.size("h") > 0, F.col("h")).otherwise(_heads(F.col("t"), given)))
    else:
        found = found.withColumn("h", _heads(F.col("t"), given))
    known = F.exists("h", lambda x: x["name"].isin(*REFERENCE_NAMES))
    found = found.withColumn("r", F.when(~known, _last_references(F.col("t"))))
    found = found.withColumn("h", F.array_sort(F.when(F.col("r").isNotNull(), F.array_append("h", F.col("r"))).otherwise(F.col("h"))))
    until = lambda i: F.coalesce(F.get("h", i + 1)["start_pos"], F.length("t") + 1)
    body = F.transform("h", lambda x, i: F.struct((i + 1).alias("k"), x["name"].alias("name"), _stripped(F.col("t").substr(x["start_pos"] + x["size"], F.greatest(until(i) - x["start_pos"] - x["size"], F.lit(0)))).alias("text")))
    first = F.get("h", F.lit(0))["start_pos"]
    preface = _stripped(F.col("t").substr(F.lit(1), first - 1))
    lead = F.when((first > 100) & (F.length(preface) > 50), F.array(F.struct(F.lit(0).alias("k"), F.lit("Preface").alias("name"), preface.alias("text")))).otherwise(F.slice(body, 1, 0))
    kept = found.select("doc_id", "t", F.filter(F.concat(lead, body), lambda x: F.length(x["text"]) > 0).alias("s"))
    renamed = F.exists("s", lambda x: x["name"] == "Bibliography") & ~F.exists("s", lambda x: x["name"] == "References")
    kept = kept.withColumn("s", F.when(renamed, F.concat(F.filter("s", lambda x: x["name"] != "Bibliography"), F.transform(F.filter("s", lambda x: x["name"] == "Bibliography"), lambda x: F.struct(x["k"].alias("k"), F.lit("References").alias("name"), x["text"].alias("text"))))).otherwise(F.col("s")))
    rows = kept.select("doc_id", F.posexplode(F.concat(F.array(F.struct(F.lit(-1).alias("k"), F.lit("Full_text").alias("name"), F.col("t").alias("text"))), "s")).alias("section_ord", "x"))
    return rows.select("doc_id", "section_ord", F.col("x.name").alias("section"), "x.text")


def analysed(sections: DataFrame) -> DataFrame:
    """Sections that are analysed: neither the full text again nor the reference list."""
    return sections.where(~F.col("section").isin("Full_text", "References"))


# Rewrites of a model's text, in their order.
AI_TIDY = (
    (r"([0-9]+(?:\.[0-9]+)*\.\s+[A-Za-z][A-Za-z\s]{3,50})", "\n\n$1\n\n"), (r"\n\s*\n", "\n\n"), (r"([.!?])\s*\n\s*([A-Z][a-z])", "$1\n\n$2"), (r"(?<![.!?\n])\n(?![A-Z0-9\n])", " "), (r"-\s", ""),
)


def tidy_ai_text(text: Column, citation_type: str = "author_year") -> Column:
    """Text from a model: numbered headings apart, sentences at line ends apart, other
    line breaks and hyphens at them away; superscript citations where they are of that type."""
    t = text
    for pattern, to in AI_TIDY:
        t = F.regexp_replace(t, pattern, to)
    return superscript_citations(t) if citation_type == "numeric_superscript" else t


def is_reference_start(block: Column) -> Column:
    """Whether a block starts a reference: bracketed or dotted number, surname with
    initials and a year or 80 characters, surname and initials of 40, an institution of 40."""
    surname = r"^[A-Z][a-zÀ-ÿ]+(?:[-'][A-Z][a-z]+)?,\s+[A-Z]\."
    long = F.length(block)
    return block.rlike(r"^\[\d+\]") | block.rlike(r"^\d+\.\s+[A-Z]") | (block.rlike(surname) & (block.rlike(r"\d{4}") | (long >= 40))) | (block.rlike(r"^[A-Z]{2,}[,.]") & (long >= 40))


def reference_blocks(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, ref_ord, ref_text): blocks of a reference section; a block that starts
    no reference continues the one before it."""
    t = F.col(text)
    for pattern, to in ((r"(\d+)\.\s*\n\n+\s*(?=[A-Z][a-zÀ-ÿ])", "$1. "), (r"(\[\d+\])\s*\n\n+\s*(?=[A-Z][a-zÀ-ÿ])", "$1 "), (r"(?<=[.;])\s+(?=\d+\.\s+[A-Z][a-z])", "\n\n"), (r"(?<=[.;])\s+(?=\[\d+\]\s*[A-Z])", "\n\n"), (r"(?<=\.)\s+(?=[A-Z][a-zÀ-ÿ]+(?:[-'][A-Z][a-z]+)?,\s+[A-Z]\.)", "\n\n")):
        t = F.regexp_replace(t, pattern, to)
    blocks = docs.select("doc_id", F.posexplode(F.split(t, r"\n\n+", -1)).alias("i", "b")).withColumn("b", F.trim(F.regexp_replace("b", r"\s+", " "))).where(F.length("b") > 0)
    w = Window.partitionBy("doc_id").orderBy("i")
    numbered = blocks.withColumn("new", (is_reference_start(F.col("b")) | (F.row_number().over(w) == 1)).cast("int")).withColumn("ref_ord", F.sum("new").over(w))
    return numbered.groupBy("doc_id", "ref_ord").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "b"))), lambda x: x["b"]), " ").alias("ref_text"))


def superscript_citations(text: Column) -> Column:
    """Numbers that stand for citations put into brackets; numbers after a counted
    noun ('table 2') are masked first and come back unchanged."""
    noun = "|".join(COUNTED)
    number = r"\d{1,3}(?:\s*[,\-]\s*\d{1,3})*"
    t = F.regexp_replace(text, f"([{_SUPER}]+)", "[$1]")
    t = F.translate(t, _SUPER, "1234567890")
    masked = lambda x, gap: F.regexp_replace(x, rf"(?i)(?<![\p{{L}}])({noun}){gap}(\d+(?:\s*[,;\-]\s*\d+)*)", "$1\u0001$2\u0002")
    t = F.regexp_replace(t, r"([.!?])\s+(\d{1,3})\s+([A-Z])", "$1[$2] $3")
    t = masked(t, r"\s+")
    t = F.regexp_replace(t, rf"([a-z)])\s+({number})(?=\s|[.,;!?]|$)", "$1[$2]")
    t = F.regexp_replace(t, r"([a-z])\s+(\d{1,3}e\d{1,3})(?=\s|[.,;!?]|$)", "$1[$2]")
    t = F.regexp_replace(t, r"(\n)(\d{1,3})\s+([A-Z])", "$1[$2] $3")
    t = F.regexp_replace(F.regexp_replace(t, r"\[\s+", "["), r"\s+\]", "]")
    t = F.regexp_replace(t, r"(?<=\d)\s*,\s*(?=\d[^\[\]]*\])", ",")
    t = F.regexp_replace(t, r"\[(\d+)e(\d+)\]", "[$1-$2]")
    t = F.regexp_replace(t, rf"(?i)(?<![\p{{L}}])({noun})(\d{{1,3}})(?!\d)", "$1\u0003$2")
    t = F.regexp_replace(t, r"([a-z]{3,})(\d{1,3})(?=\s|[.,;!?]|$)", "$1[$2]")
    return F.translate(F.replace(t, F.lit("\u0001"), F.lit(" ")), "\u0002\u0003", "")


def spaced_headers(text: Column) -> Column:
    """Lines of letter-spaced capitals put together ('R E S U L T S'): four groups or
    more of up to four letters, half of them of one or two, seven characters in all;
    headings with a bar that follow a sentence stand apart."""

    def line(x: Column) -> Column:
        groups = F.split(F.trim(x), " ")
        short = F.size(F.filter(groups, lambda g: F.length(g) <= 2))
        spaced = x.rlike(r"^\s*(?:[A-Z]{1,4} ){3,}[A-Z]{1,4}\s*$") & (short * 2 >= F.size(groups)) & (F.length(F.trim(x)) >= 7)
        return F.when(spaced, F.replace(x, F.lit(" "), F.lit(""))).otherwise(x)

    joined = F.array_join(F.transform(F.split(text, "\n", -1), line), "\n")
    # headings with a bar that follow a sentence ('... end. 2 | METHODS')
    return F.regexp_replace(joined, r"(?<=\.)\s+(?=[0-9]+(?:\.[0-9]+)*\s*\|\s*[A-Z])", "\n\n")


def running_headers(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, header, n): openings of 40 characters that follow a page number in at
    least three places of a document; the shared start is their header."""
    after = F.transform(F.split(text, r"\d+\n\n", -1), lambda s: F.substring(s, 1, 200))
    tails = docs.select("doc_id", F.posexplode(after).alias("i", "tail")).where("i > 0").withColumn("key", F.substring("tail", 1, 40))
    grouped = tails.groupBy("doc_id", "key").agg(F.count("*").alias("n"), F.min("tail").alias("a"), F.max("tail").alias("b")).where((F.col("n") >= 3) & (F.length("key") == 40))
    same = F.aggregate(F.sequence(F.lit(1), F.lit(200)), F.lit(0), lambda acc, k: F.when((acc == k - 1) & (F.col("a").substr(k, F.lit(1)) == F.col("b").substr(k, F.lit(1))) & (k <= F.length("a")), k).otherwise(acc))
    return grouped.select("doc_id", F.trim(F.col("a").substr(F.lit(1), same)).alias("header"), "n")


def without_headers(docs: DataFrame, headers: DataFrame, text: str = "text") -> DataFrame:
    """Documents with their running headers deleted."""
    per = headers.groupBy("doc_id").agg(F.array_sort(F.collect_set("header")).alias("hs"))
    cut = F.aggregate(F.coalesce("hs", F.array().cast("array<string>")), F.col(text), lambda t, h: F.replace(t, h, F.lit("")))
    return docs.join(per, "doc_id", "left").withColumn(text, cut).drop("hs")


def without_fences(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"(?s)```[a-zA-Z]*\n(.*?)```", "$1"), "```", "")


def _folded_lines(text: Column, step) -> Column:
    """Lines kept by a fold whose state is (mode, blanks, kept)."""
    start = F.struct(F.lit(0).alias("mode"), F.lit(0).alias("blanks"), F.array().cast("array<string>").alias("kept"))
    return F.array_join(F.aggregate(F.split(text, "\n", -1), start, step)["kept"], "\n")


def without_tables(text: Column) -> Column:
    """Lines of tables out: a caption or a line with pipes opens one; two blank lines
    or a line of prose close it."""

    def step(a: Column, line: Column) -> Column:
        opens = line.rlike(r"(?i)^\s*(\*\*)?Table\s+\d+") | line.contains("|") | line.rlike(r"^\s*[-|:]+\s*$")
        blank, aligned = F.length(F.trim(line)) == 0, line.rlike(r"\s{3,}|-{3,}")
        state = lambda m, b, k: F.struct(m.alias("mode"), b.alias("blanks"), k.alias("kept"))
        one, zero = F.lit(1), F.lit(0)
        inside = a["mode"] == 1
        return (
            F.when(opens, state(one, zero, a["kept"]))
            .when(inside & blank, state(F.when(a["blanks"] >= 1, 0).otherwise(1), F.when(a["blanks"] >= 1, 0).otherwise(a["blanks"] + 1), a["kept"]))
            .when(inside & aligned, state(one, zero, a["kept"]))
            .otherwise(state(zero, zero, F.array_append(a["kept"], line)))
        )

    return _folded_lines(text, step)


def without_figure_captions(text: Column) -> Column:
    """Figure captions out; a long one runs to the end of a sentence or a blank line."""

    def step(a: Column, line: Column) -> Column:
        opens = line.rlike(r"(?i)^\s*(\*\*)?(Fig\.|Figure)\s+\d+[:.\s]")
        ends, blank = line.rlike(r"[.!]\s*$"), F.length(F.trim(line)) == 0
        state = lambda m, k: F.struct(m.alias("mode"), F.lit(0).alias("blanks"), k.alias("kept"))
        return (
            F.when(opens, state(F.when(ends | (F.length(F.trim(line)) < 100), 0).otherwise(1), a["kept"]))
            .when(a["mode"] == 1, state(F.when(ends | blank, 0).otherwise(1), a["kept"]))
            .otherwise(state(F.lit(0), F.array_append(a["kept"], line)))
        )

    return _folded_lines(text, step)


def markdown_sections(chunks: DataFrame) -> DataFrame:
    """(doc_id, section, text) from markdown chunks in order: '##' headings, and '#'
    headings after a blank line; what comes before of more than 10 characters is the
    Preamble; of a repeated title the last text is kept."""
    whole = chunks.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_ord", "text"))), lambda x: x["text"]), "\n").alias("t"))
    lines = whole.select("doc_id", F.posexplode(F.split(without_fences(F.col("t")), "\n", -1)).alias("i", "line"))
    w = Window.partitionBy("doc_id").orderBy("i")
    free = F.coalesce(F.length(F.trim(F.lag("line").over(w))) == 0, F.lit(True))
    head = F.col("line").rlike(r"^##\s+[A-Z0-9]") | (F.col("line").rlike(r"^#\s+[A-Z]") & free)
    rows = lines.withColumn("head", head).withColumn("g", F.sum(F.col("head").cast("int")).over(w))
    parts = rows.groupBy("doc_id", "g").agg(F.max(F.when(F.col("head"), F.trim(F.regexp_replace("line", "^#+", "")))).alias("section"), _stripped(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("head"), F.struct("i", "line")))), lambda x: x["line"]), "\n")).alias("text"))
    parts = parts.withColumn("section", F.coalesce("section", F.lit("Preamble"))).where((F.col("g") > 0) | (F.length("text") > 10))
    return parts.groupBy("doc_id", "section").agg(F.max_by("text", "g").alias("text"), F.max("g").alias("section_ord"))
