"""Tables in place of remote services: index messages, works, document information."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MESSAGE = (
    "struct<DOI:string,title:array<string>,`container-title`:array<string>,publisher:string,issued:struct<`date-parts`:array<array<int>>>,volume:string,issue:string,page:string,ISSN:array<string>,subject:array<string>,type:string,URL:string,"
    "author:array<struct<given:string,family:string,ORCID:string,affiliation:array<struct<name:string>>>>,reference:array<struct<key:string,DOI:string,`article-title`:string,author:string,year:string,`journal-title`:string,`volume`:string,`first-page`:string,unstructured:string>>>"
)
# Document information keys by what their DOI names.
ARTICLE_KEYS = ("WPS-ARTICLEDOI", "ARTICLEDOI", "ArticleDOI", "doi", "DOI", "dc:identifier", "prism:doi", "pdfx:doi")
JOURNAL_KEYS = ("WPS-JOURNALDOI", "JOURNALDOI", "JournalDOI", "ISSN")
SOFTWARE = r"(?i)adobe|acrobat|latex|tex\b|word|distiller|ghostscript|quartz|indesign|microsoft"


def messages(raw: DataFrame, column: str = "message") -> DataFrame:
    """JSON messages parsed with a fixed schema; malformed ones are null."""
    return raw.withColumn("m", F.from_json(column, MESSAGE)).drop(column)


def message_metadata(parsed: DataFrame) -> DataFrame:
    first = lambda c: F.get(F.col(f"m.{c}"), F.lit(0))
    return parsed.select("doc_id", F.col("m.DOI").alias("doi"), first("title").alias("title"), first("container-title").alias("journal_title"), "m.publisher", F.get(F.get(F.col("m.issued.date-parts"), F.lit(0)), F.lit(0)).alias("publication_year"), "m.volume", "m.issue", F.col("m.page").alias("pages"), first("ISSN").alias("issn"), F.array_join("m.subject", "; ").alias("subject"), F.col("m.type").alias("work_type"), F.col("m.URL").alias("url"))


def message_authors(parsed: DataFrame) -> DataFrame:
    """Authors in order; the ORCID without its address, the first affiliation only."""
    rows = parsed.select("doc_id", F.posexplode("m.author").alias("i", "a"))
    return rows.select("doc_id", (F.col("i") + 1).alias("author_ord"), F.col("a.given").alias("given_name"), F.col("a.family").alias("family_name"), F.regexp_replace("a.ORCID", r"^https?://orcid\.org/", "").alias("orcid"), F.get("a.affiliation", F.lit(0))["name"].alias("affiliation"))


def message_references(parsed: DataFrame) -> DataFrame:
    rows = parsed.select("doc_id", F.posexplode("m.reference").alias("i", "r"))
    return rows.select("doc_id", (F.col("i") + 1).alias("ref_ord"), F.col("r.key").alias("ref_key"), F.col("r.DOI").alias("doi"), F.col("r.`article-title`").alias("article_title"), F.col("r.author").alias("author"), F.col("r.year").alias("ref_year"), F.col("r.`journal-title`").alias("journal"), F.col("r.volume").alias("volume"), F.col("r.`first-page`").alias("first_page"), F.col("r.unstructured").alias("ref_full"))


# Words that start a surname.
PARTICLES = ("van", "von", "de", "di", "da", "del", "della", "le", "la", "du", "des")


def _surname_words(name: Column) -> tuple[Column, Column]:
    """(words, place of the surname's first one): the first particle that is not the last word, else the last word."""
    words = F.split(F.trim(name), r"\s+")
    at = F.array_position(F.transform(F.slice(words, 1, F.size(words) - 1), lambda w: F.lower(w).isin(*PARTICLES)), True).cast("int")
    return words, F.when(at > 0, at).otherwise(F.size(words))


def surname(name: Column) -> Column:
    words, start = _surname_words(name)
    return F.array_join(F.slice(words, start, F.size(words)), " ")


def authors_string(authorships: Column) -> Column:
    """'Surname, I.J., Surname' of display names; 'Unknown' where there are none."""
    def one(a: Column) -> Column:
        words, start = _surname_words(a["display_name"])
        initials = F.array_join(F.transform(F.slice(words, 1, start - 1), lambda w: F.substring(w, 1, 1)), ".")
        return F.concat(F.array_join(F.slice(words, start, F.size(words)), " "), F.when(start > 1, F.concat(F.lit(", "), initials, F.lit("."))).otherwise(""))

    return F.when(F.size(authorships) > 0, F.array_join(F.transform(authorships, one), ", ")).otherwise("Unknown")


def works_citations(works: DataFrame) -> DataFrame:
    """Works (doi, title, publication_year, source_display_name, authorships) with their
    number of authors, first author and full citation."""
    none = lambda c, other: F.when(F.length(F.trim(c)) > 0, F.col(c)).otherwise(other)
    year = F.coalesce(F.col("publication_year").cast("string"), F.lit("n.d."))
    full = F.concat(authors_string(F.col("authorships")), F.lit(" ("), year, F.lit(") "), none("title", "Untitled"), F.lit(", "), none("source_display_name", "Unknown source"), F.lit("."))
    n = F.when(F.size("authorships") > 0, F.size("authorships")).otherwise(0)
    return works.withColumn("n_authors", n).withColumn("first_author", F.when(n > 0, surname(F.get("authorships", F.lit(0))["display_name"]))).withColumn("ref_full_name", full)


_DOI = r"10\.\d{4,9}/[-._;()/:A-Za-z0-9]+"


def info_dois(info: DataFrame) -> DataFrame:
    """(doc_id, dois): DOIs of the document information, article fields first, then
    other keys, then the metadata text; journal fields and ISSNs are left out."""
    rank = F.when(F.col("key").isin(*ARTICLE_KEYS), 0).when(F.col("key").isin(*JOURNAL_KEYS), 2).otherwise(1)
    keys = info.select("doc_id", F.explode("keys").alias("key", "value")).withColumn("rank", rank).where((F.col("rank") < 2) & ~F.col("value").rlike(r"(?i)\(ISSN\)"))
    text = info.select("doc_id", F.lit("").alias("key"), F.col("metadata").alias("value"), F.lit(1).alias("rank")).withColumn("key", F.lit("~"))
    every = keys.select("doc_id", "key", "value", "rank").unionByName(text)
    hits = every.select("doc_id", "rank", "key", F.posexplode(F.regexp_extract_all("value", F.lit(_DOI), F.lit(0))).alias("i", "doi")).where(~F.col("doi").rlike(r"(?i)\(ISSN\)"))
    return hits.groupBy("doc_id").agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("rank", "key", "i", "doi"))), lambda x: x["doi"])).alias("dois"))


def info_fields(info: DataFrame) -> DataFrame:
    """(doc_id, doi, title, authors, journal, year) of document information structs:
    keys, metadata text, created and modified times."""
    key = lambda *names: F.coalesce(*[F.nullif(F.trim(F.element_at("keys", F.lit(n))), F.lit("")) for n in names])
    tag = lambda p: F.nullif(F.trim(F.regexp_extract("metadata", p, 1)), F.lit(""))
    titled = F.regexp_extract("metadata", r"(?s)<dc:title>(.*?)</dc:title>", 1)
    title = F.nullif(F.trim(F.coalesce(F.nullif(F.regexp_extract(titled, r"<rdf:li[^>]*>([^<]+)</rdf:li>", 1), F.lit("")), F.regexp_replace(titled, "<[^>]*>", ""))), F.lit(""))
    creators = F.regexp_extract("metadata", r"(?s)<dc:creator>(.*?)</dc:creator>", 1)
    names = F.nullif(F.array_join(F.transform(F.regexp_extract_all(creators, F.lit(r"<rdf:li[^>]*>([^<]+)</rdf:li>"), F.lit(1)), lambda x: F.trim(x)), "; "), F.lit(""))
    creator = key("Creator")
    subject = key("Subject")
    from_subject = F.nullif(F.trim(F.regexp_extract(subject, r"^(.*?)(?:,|\s+doi)", 1)), F.lit(""))
    year = F.coalesce(F.nullif(F.regexp_extract("metadata", r"<prism:coverDate>\s*(\d{4})", 1), F.lit("")), F.nullif(F.regexp_extract(F.regexp_replace(subject, _DOI, ""), r"((?:19|20)\d{2})", 1), F.lit("")), F.year("created").cast("string"), F.year("modified").cast("string"))
    rows = info.select(
        "doc_id", F.coalesce(key("Title"), title, key("title", "TITLE")).alias("title"),
        F.coalesce(names, key("Author"), F.when(~creator.rlike(SOFTWARE), creator), key("author", "Authors")).alias("authors"),
        F.coalesce(tag(r"(?s)<prism:publicationName>([^<]+)<"), from_subject, key("Journal", "journal")).alias("journal"), year.alias("year"),
    )
    return rows.join(info_dois(info).select("doc_id", F.get("dois", F.lit(0)).alias("doi")), "doc_id", "left")


def clean_encoding(text: Column) -> Column:
    """Smart punctuation and entities to plain signs, unprintable ones out."""
    t = F.translate(text, "‘’“”–—…", "''\"\"--.")
    for a, b in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " ")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"\p{Cntrl}", " "), r"\s+", " "))


def page_chunks(pages: DataFrame, per_chunk: int = 4) -> DataFrame:
    """Pages numbered into chunks of ``per_chunk``."""
    return pages.withColumn("chunk", F.ceil(F.col("page") / per_chunk).cast("int"))
