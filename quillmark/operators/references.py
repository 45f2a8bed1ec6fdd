"""Reference strings: splitting, format, year, authors, title, DOI; enrichment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.functions.names import names_match, unaccented

_SURNAME = r"(?:(?:de|van|von|di|da|del|della|der|den|la|le|ten|du)\s+)*[A-ZÀ-ÞŠŽŁØ][\p{L}'-]+"


def split_references(docs: DataFrame, text: str = "references_text") -> DataFrame:
    """(doc_id, ref_ord, ref_full_text): blocks between blank lines, of 15 characters or more."""
    blocks = F.filter(F.transform(F.split(text, r"\n\s*\n", -1), lambda b: F.trim(F.regexp_replace(b, r"\s+", " "))), lambda b: F.length(b) >= 15)
    return docs.select("doc_id", F.posexplode(blocks).alias("i", "ref_full_text")).select("doc_id", (F.col("i") + 1).alias("ref_ord"), "ref_full_text")


def reference_format(refs: DataFrame) -> DataFrame:
    """(doc_id, ref_format) from each document's first ten references."""
    first = refs.where(F.col("ref_ord") <= 10)
    n = lambda regex: F.sum(F.col("ref_full_text").rlike(regex).cast("int"))
    counts = first.groupBy("doc_id").agg(n(r"\(\d{4}[a-z]?\)").alias("paren"), n(r",\s*\d{4}[a-z]?\.").alias("bare"), n(r"^\[?\d+\]?\.?\s").alias("numbered"))
    numbered = (F.col("numbered") >= F.col("paren")) & (F.col("numbered") >= F.col("bare")) & (F.col("numbered") >= 2)
    return counts.select("doc_id", F.when(numbered, "numbered").when(F.col("bare") > F.col("paren"), "author_year_bare").otherwise("author_year_paren").alias("ref_format"))


def _first(text: Column, *patterns: str) -> Column:
    out = None
    for p in patterns:
        hit = F.nullif(F.regexp_extract(text, p, 1), F.lit(""))
        out = hit if out is None else F.coalesce(out, hit)
    return out


_PAREN, _BARE, _ANY = r"\((\d{4}[a-z]?)\)", r",\s(\d{4}[a-z]?)\.", r"(?:^|[^\p{L}\p{N}_])((?:1[89]\d{2}|20[0-2]\d)[a-z]?)[.,;)\s]"


def year_of(text: Column, ref_format: Column, as_of_year: int) -> Column:
    """Year with its letter; null outside 1800 to ``as_of_year`` + 1."""
    year = F.when(ref_format == "author_year_bare", _first(text, _BARE, _PAREN, _ANY)).otherwise(_first(text, _PAREN, _BARE, _ANY))
    return F.when(F.regexp_extract(year, r"^(\d{4})", 1).cast("int").between(1800, as_of_year + 1), year)


def authors_of(text: Column, year: Column, ref_format: Column) -> Column:
    """Text before the year; without a year the text up to the first full stop."""
    bare = F.regexp_extract(year, r"^(\d{4})", 1)
    at_paren = F.position(F.concat(F.lit("("), bare), text)
    at_year = F.position(bare, text)
    before = F.when((ref_format == "author_year_paren") & (at_paren > 0), F.trim(text.substr(F.lit(1), at_paren - 1))).when(at_year > 0, F.trim(F.regexp_replace(text.substr(F.lit(1), at_year - 1), r"[,&\s(]+$", "")))
    return F.coalesce(before, F.trim(F.regexp_extract(text, r"^([^.]{0,200})", 1)))


def author_fields(authors: Column) -> dict[str, Column]:
    """First and second surname, their plain forms and the number of authors (99: et al.)."""
    s = F.trim(F.regexp_replace(authors, r"^\[?\d+\]?\.?\s*", ""))
    first = F.nullif(F.regexp_extract(s, rf"^({_SURNAME})", 1), F.lit(""))
    etal = s.rlike(r"et\s+al")
    initials = F.size(F.regexp_extract_all(s, F.lit(r"[A-ZÀ-Þ]\.(?:\s*-?[A-ZÀ-Þ]\.)*"), F.lit(0)))
    n = F.when(F.length(s) == 0, None).when(etal, 99).otherwise(F.greatest(initials, F.lit(1)))
    second = F.nullif(F.regexp_extract(s, rf"[A-ZÀ-Þ]\.(?:\s*[A-ZÀ-Þ]\.)*\s*[,&]\s*&?\s*({_SURNAME})", 1), F.lit(""))
    second = F.when(n >= 2, second)
    plain = lambda c: F.regexp_replace(unaccented(F.lower(c)), "[^a-z' -]", "")
    return {"ref_first_author": first, "ref_first_author_normalized": plain(first), "ref_second_author": second, "ref_second_author_normalized": plain(second), "n_authors": n.cast("int")}


def title_of(text: Column, year: Column) -> Column:
    """Text after the year up to the next full stop before a capital or 'volume(issue)'."""
    after = F.position(year, text)
    rest = F.regexp_replace(text.substr(after + F.length(year), F.length(text)), r"^\)?\.?\s*", "")
    end = F.nullif(F.regexp_extract(rest, r"^(.*?)(?:\.\s+[A-Z]|(?<!\d)\d+\s*\(\d+\))", 1), F.lit(""))
    return F.when(year.isNotNull() & (after > 0), F.trim(F.coalesce(end, F.regexp_extract(rest, r"^([^.]+)", 1))))


def doi_of(text: Column) -> Column:
    """DOI without prefix and trailing punctuation; null where there is none."""
    return F.nullif(F.regexp_replace(F.regexp_extract(text, r"(10\.\d{4,}/[^\s,]+)", 1), r"[.,;)]+$", ""), F.lit(""))


def parse(refs: DataFrame, as_of_year: int = 2026) -> DataFrame:
    """All fields of each reference of (doc_id, ref_ord, ref_full_text); ids are REF_k."""
    rows = refs.join(reference_format(refs), "doc_id")
    t = F.col("ref_full_text")
    rows = rows.withColumn("ref_year", year_of(t, F.col("ref_format"), as_of_year))
    rows = rows.withColumn("ref_authors", authors_of(t, F.col("ref_year"), F.col("ref_format")))
    fields = author_fields(F.col("ref_authors"))
    return rows.select(
        "doc_id", "ref_ord", F.concat(F.lit("REF_"), F.col("ref_ord").cast("string")).alias("ref_id"), "ref_full_text", "ref_format", "ref_authors", "ref_year",
        *[c.alias(k) for k, c in fields.items()], title_of(t, F.col("ref_year")).alias("ref_title"), doi_of(t).alias("ref_doi"),
    )


def enrich(index_refs: DataFrame, page_refs: DataFrame) -> DataFrame:
    """Index entries with a text of 60 characters or less take the longer text, second
    author and number of authors of the document's first own reference of the same
    year whose author is equal or contained; ties by reference order."""
    own = page_refs.select("doc_id", "ref_ord", F.regexp_extract("ref_year", r"^(\d{4})", 1).alias("y"), F.lower("ref_first_author").alias("pa"), F.col("ref_full_text").alias("page_text"), F.col("ref_second_author").alias("page_second"), F.col("n_authors").alias("page_n"))
    rows = index_refs.withColumn("y", F.regexp_extract("ref_year", r"^(\d{4})", 1)).withColumn("ia", F.lower("ref_first_author"))
    short = F.coalesce(F.length("ref_full_text"), F.lit(0)) <= 60
    fits = (F.col("ia") == F.col("pa")) | F.col("ia").contains(F.col("pa")) | F.col("pa").contains(F.col("ia"))
    hits = rows.where(short).join(own, ["doc_id", "y"]).where(fits)
    best = hits.withColumn("k", F.row_number().over(Window.partitionBy("doc_id", "ref_id").orderBy("ref_ord"))).where("k = 1").select("doc_id", "ref_id", "page_text", "page_second", "page_n")
    out = index_refs.join(best, ["doc_id", "ref_id"], "left")
    longer = F.length("page_text") > F.coalesce(F.length("ref_full_text"), F.lit(0))
    return out.select(
        "doc_id", "ref_id", F.when(longer, F.col("page_text")).otherwise(F.col("ref_full_text")).alias("ref_full_text"), "ref_first_author", "ref_year",
        F.coalesce("ref_second_author", "page_second").alias("ref_second_author"), F.coalesce("n_authors", "page_n").alias("n_authors"), F.col("page_text").isNotNull().alias("enriched"),
    )


def clean_doi(doi: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(doi, r"^(https?://(dx\.)?doi\.org/|doi:\s*)", "")))


def author_conflict(a: Column, b: Column) -> Column:
    """True where both names are there and differ."""
    return F.coalesce(a.isNotNull() & b.isNotNull() & (F.length(F.trim(a)) > 0) & (F.length(F.trim(b)) > 0) & ~names_match(a, b), F.lit(False))


def complete_from_works(refs: DataFrame, works: DataFrame) -> DataFrame:
    """References completed by DOI from a works table (doi, title, publication_year,
    source_display_name, first_author, n_authors): the first work of a DOI wins over
    the reference unless their authors differ; then only gaps are filled."""
    one = works.where(F.length(F.trim("doi")) > 0).groupBy(clean_doi(F.col("doi")).alias("k")).agg(F.min(F.struct("work_id", "title", "publication_year", "source_display_name", "first_author", "n_authors")).alias("w"))
    out = refs.withColumn("k", clean_doi(F.col("doi"))).join(one, "k", "left")
    differ = author_conflict(F.col("ref_first_author"), F.col("w.first_author"))
    wins = F.col("w").isNotNull() & ~differ
    pick = lambda own, theirs: F.when(wins, F.coalesce(theirs, own)).otherwise(F.coalesce(own, theirs))
    return out.select(
        "doc_id", "ref_id", "doi", F.when(wins, F.coalesce("w.first_author", "ref_first_author")).otherwise(F.col("ref_first_author")).alias("ref_first_author"),
        pick(F.col("ref_year"), F.col("w.publication_year").cast("string")).alias("ref_year"), pick(F.col("ref_journal"), F.col("w.source_display_name")).alias("ref_journal"),
        pick(F.col("n_authors"), F.col("w.n_authors")).alias("n_authors"), F.when(F.col("w").isNotNull(), F.concat_ws(". ", "w.first_author", "w.title", "w.source_display_name")).alias("ref_full_text2"),
        F.when(wins, "works").when(F.col("w").isNotNull(), "gaps").otherwise("none").alias("completed_by"),
    )


def from_index(refs: DataFrame) -> DataFrame:
    """References as the index holds them (doc_id, ref_ord, author, ref_year,
    article_title, journal, doi, ref_full) in the form of parsed ones: their text, a
    second text put together from the fields, the author without words in capitals,
    and the number of authors counted from the commas before the year's bracket."""
    part = lambda c, before, after: F.when(F.col(c).isNotNull(), F.concat(F.lit(before), F.col(c), F.lit(after))).otherwise("")
    whole = F.concat_ws(" ", part("author", "", ","), part("ref_year", "(", "),"), part("article_title", "", "."), part("journal", "", "."))
    first = F.initcap(F.trim(F.regexp_replace("author", r"(?<![\p{L}\p{N}_])[A-Z]+(?![\p{L}\p{N}_])\s*", "")))
    authors = F.regexp_extract("ref_full", r"^(.*?)\s*\(", 1)
    commas = F.length(authors) - F.length(F.replace(authors, F.lit(","), F.lit("")))
    n = F.when(F.col("ref_full").contains("("), ((commas + 1) / 2).cast("int"))
    return refs.select(
        "doc_id", "ref_ord", F.concat(F.lit("REF_"), F.col("ref_ord").cast("string")).alias("ref_id"), F.col("ref_full").alias("ref_full_text"), F.col("author").alias("ref_authors"), "ref_year", F.col("journal").alias("ref_journal"),
        first.alias("ref_first_author"), F.lower(first).alias("ref_first_author_normalized"), n.alias("n_authors"), "doi", F.trim(F.regexp_replace(whole, r"\s+", " ")).alias("ref_full_text2"), F.lit("crossref").alias("ref_source"),
    )
