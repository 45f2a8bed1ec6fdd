"""Terms of the works cited in each section: n-grams, TF-IDF, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.operators.words import ngrams, word_arrays, word_rows


def tf_idf(counted: DataFrame, doc: list[str], section: str = "section", term: str = "ngram", n: str = "n") -> DataFrame:
    """tf over all terms of a section, idf = ln(sections / sections with the term)
    within each ``doc`` group, and their product."""
    every = Window.partitionBy(*doc)
    sections = counted.groupBy(*doc, section).agg(F.sum(n).alias("section_total"))
    sections = sections.withColumn("n_sections", F.count("*").over(every))
    with_df = counted.withColumn("df", F.count("*").over(Window.partitionBy(*doc, term)))
    out = with_df.join(sections, [*doc, section])
    out = out.withColumn("tf", F.col(n) / F.col("section_total")).withColumn("idf", F.log(F.col("n_sections") / F.col("df")))
    return out.select(*doc, section, term, n, F.round("tf", 6).alias("tf"), F.round("idf", 6).alias("idf"), F.round(F.col("tf") * F.col("idf"), 6).alias("tf_idf"))


def top_terms(scored: DataFrame, doc: list[str], k: int = 10, section: str = "section", term: str = "ngram") -> DataFrame:
    """The ``k`` terms of highest tf_idf of each section; ties by term."""
    w = Window.partitionBy(*doc, section).orderBy(F.desc("tf_idf"), term)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def section_summary(top: DataFrame, doc: list[str], section: str = "section", term: str = "ngram") -> DataFrame:
    """The top terms of each section as one string, best first."""
    return top.groupBy(*doc, section).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.col(term).alias("t")))), lambda x: x["t"]), ", ").alias("top_terms"), F.count("*").alias("n_terms"))


def heatmap_terms(top: DataFrame, doc: list[str], most: int = 20, section: str = "section", term: str = "ngram") -> DataFrame:
    """At most ``most`` terms per group: an equal number of each section's best, then the best of the rest."""
    k = F.size(F.collect_set(section).over(Window.partitionBy(*doc)))
    share = F.greatest(F.lit(1), F.floor(F.lit(most) / k))
    best = top.withColumn("share", share).withColumn("first", F.col("rank") <= F.col("share"))
    terms = best.groupBy(*doc, term).agg(F.max("first").alias("first"), F.max("tf_idf").alias("score"))
    w = Window.partitionBy(*doc).orderBy(F.desc("first"), F.desc("score"), term)
    return terms.withColumn("term_rank", F.row_number().over(w)).where(F.col("term_rank") <= most).drop("first")


def title_of(reference: Column) -> Column:
    """Title of a reference: after '(year).' up to the next full stop, else the second piece between full stops."""
    after = F.regexp_extract(reference, r"\(\d{4}[a-z]?\)\.?\s*([^.]+)", 1)
    piece = F.get(F.split(reference, r"\.\s", -1), F.lit(1))
    return F.when(F.length(F.trim(after)) > 0, F.trim(after)).otherwise(F.trim(piece))


def references_per_section(cited: DataFrame, doc: list[str], section: str = "section", reference: str = "ref_full_text") -> DataFrame:
    """Distinct references cited in each section."""
    return cited.groupBy(*doc, section).agg(F.countDistinct(reference).alias("n_references"))


def cited_in_sections(citations: DataFrame, mapping: DataFrame, doc: list[str]) -> DataFrame:
    """(doc, section, ref_full_text): references matched to the citations of each
    section, joined on the citations' clean text; each once."""
    places = citations.select(*doc, "citation_text_clean", "section").where(F.col("section").isNotNull()).distinct()
    found = mapping.select(*doc, "citation_text_clean", "ref_full_text").where(F.col("ref_full_text").isNotNull()).distinct()
    return places.join(found, [*doc, "citation_text_clean"]).select(*doc, "section", "ref_full_text").distinct()


def title_terms(cited: DataFrame, doc: list[str], stopwords: DataFrame | None = None, min_word_length: int = 3, sizes: tuple[int, ...] = (1, 2)) -> DataFrame:
    """(doc, section, ngram, ngram_size, n): n-grams of the titles of the references of
    each section; stop words, short words and numbers leave before n-grams are built."""
    titled = cited.select(*doc, "section", "ref_full_text", title_of(F.col("ref_full_text")).alias("title")).where(F.length("title") > 0)
    keys = [*doc, "section", "ref_full_text"]
    arrays = word_arrays(word_rows(titled, keys, "title", min_word_length, stopwords=stopwords), keys)
    sized = lambda k: F.transform(ngrams(F.col("words"), k), lambda g: F.struct(g.alias("ngram"), F.lit(k).alias("ngram_size")))
    grams = arrays.select(*doc, "section", F.explode(F.concat(*[sized(k) for k in sizes])).alias("g"))
    return grams.groupBy(*doc, "section", "g.ngram", "g.ngram_size").agg(F.count("*").alias("n"))


def describe(citations: DataFrame, mapping: DataFrame, doc: list[str], k: int = 10, stopwords: DataFrame | None = None, min_word_length: int = 3, sizes: tuple[int, ...] = (1, 2)) -> tuple[DataFrame, DataFrame]:
    """(terms, summary): the ``k`` terms most characteristic of the titles cited in each
    section, and per section its number of references and its terms in one string."""
    cited = cited_in_sections(citations, mapping, doc)
    top = top_terms(tf_idf(title_terms(cited, doc, stopwords, min_word_length, sizes), doc), doc, k)
    summary = section_summary(top, doc).join(references_per_section(cited, doc), [*doc, "section"], "left")
    return top, summary.select(*doc, "section", "n_references", "top_terms")
