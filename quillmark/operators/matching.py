"""Matching in-text citations to a document's reference list.

The cascade year, author, disambiguation is one candidate join on (document,
year) and three windows; each citation gets exactly one label.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.functions.names import compound_surname, unaccented


def citation_info(text: Column) -> dict[str, Column]:
    """First author, second author, year and 'et al.' of a citation's clean text."""
    clean = F.regexp_replace(text, r"^\(|\)$", "")
    clean = F.trim(F.regexp_replace(clean, r"^\(?(see|e\.g\.|cf\.|i\.e\.|viz\.|compare)\s+", ""))
    year = F.regexp_extract(clean, r"(\d{4}[a-z]?)", 1)
    etal = clean.rlike(r"et\s+al\.")
    both = clean.rlike(r"\s+and\s+|\s+&\s+")
    after = F.trim(F.regexp_extract(clean, r"(?:and|&)\s+(\p{L}[\p{L}\s'-]+?)(?:,|\s+\()", 1))
    second = F.when(both & ~etal & (F.length(after) > 0), compound_surname(after))
    return {"cite_author": compound_surname(clean), "cite_second_author": F.lower(second), "cite_year": F.when(F.length(year) > 0, year), "cite_has_etal": etal}


def match_numbered(citations: DataFrame, references: DataFrame) -> DataFrame:
    """Numbered citations: one row per number, matched to the reference of that label."""
    own = citations.where(F.col("citation_type").startswith("numbered_"))
    numbers = F.regexp_extract_all("citation_text", F.lit(r"\d+"), F.lit(0))
    rows = own.select("doc_id", "citation_id", F.posexplode_outer(F.when(F.size(numbers) > 0, numbers)).alias("number_ord", "number")).withColumn("ref_id", F.concat(F.lit("REF_"), F.regexp_replace("number", "^0+(?=.)", "")))
    refs = references.select("doc_id", "ref_id").withColumn("n", F.count("*").over(Window.partitionBy("doc_id", "ref_id"))).where("n = 1").withColumn("hit", F.col("ref_id"))
    out = rows.join(refs.drop("n"), ["doc_id", "ref_id"], "left")
    label = F.when(F.col("number").isNull(), "no_match_missing_number").when(F.col("hit").isNull(), "no_match_numbered").otherwise("high_numbered")
    return out.select("doc_id", "citation_id", F.coalesce("number_ord", F.lit(0)).alias("number_ord"), F.col("hit").alias("matched_ref_id"), label.alias("match_confidence"))


def match_narrative(citations: DataFrame, references: DataFrame) -> DataFrame:
    """All other citations: (doc_id, citation_id, matched_ref_id, match_confidence).

    Exact year first, then the year without its letter; then equal surname, equal
    without accents, contained either way; then the letter as an index over the
    reference ids, the second author, 'et al.', the first candidate.
    """
    info = citation_info(F.col("citation_text_clean"))
    own = citations.where(~F.col("citation_type").startswith("numbered_")).select("doc_id", "citation_id", *[c.alias(k) for k, c in info.items()])
    author = F.lower(F.col("cite_author"))
    cites = own.withColumn("a", author).withColumn("bare", F.regexp_replace("cite_year", "[a-z]$", ""))
    usable = cites.where(F.col("a").isNotNull() & F.col("cite_year").isNotNull())
    refs = references.select("doc_id", "ref_id", "ref_ord", "ref_year", F.lower("ref_first_author").alias("r"), F.lower("ref_second_author").alias("r2"), "n_authors", F.regexp_replace("ref_year", "[a-z]$", "").alias("rbare"))
    # without its letter a year may only meet a bare year
    tier = F.when(F.col("ref_year") == F.col("cite_year"), 0).when(F.col("ref_year") == F.col("bare"), 1)
    pairs = usable.join(refs.withColumnRenamed("rbare", "bare"), ["doc_id", "bare"]).withColumn("year_tier", tier).where(F.col("year_tier").isNotNull())
    cite = Window.partitionBy("doc_id", "citation_id")
    pairs = pairs.withColumn("best_year", F.min("year_tier").over(cite)).where("year_tier = best_year")
    plain_a, plain_r = unaccented(F.col("a")), unaccented(F.col("r"))
    author_tier = F.when(F.col("a") == F.col("r"), 0).when(plain_a == plain_r, 1).when(plain_a.contains(plain_r) | plain_r.contains(plain_a), 2)
    pairs = pairs.withColumn("author_tier", author_tier).withColumn("best_author", F.min("author_tier").over(cite))
    years = pairs.select("doc_id", "citation_id").distinct().withColumn("has_year", F.lit(True))
    kept = pairs.where("author_tier = best_author").withColumn("n", F.count("*").over(cite))
    second = (F.col("r2") == F.col("cite_second_author")) & F.col("cite_second_author").isNotNull()
    many = F.col("n_authors") >= 3
    kept = kept.withColumn("by_id", F.row_number().over(cite.orderBy("ref_id"))).withColumn("by_ord", F.row_number().over(cite.orderBy("ref_ord"))).withColumn("n_second", F.sum(F.coalesce(second.cast("int"), F.lit(0))).over(cite)).withColumn("n_many", F.sum(F.coalesce(many.cast("int"), F.lit(0))).over(cite))
    suffix = F.regexp_extract("cite_year", "([a-z])$", 1)
    index = F.when(F.length(suffix) > 0, F.ascii(suffix) - 96)
    etal = F.col("cite_has_etal")
    label = (
        F.when((F.col("n") == 1) & etal & (F.col("n_authors") < 3), "medium_etal_inconsistent")
        .when(F.col("n") == 1, "high")
        .when(index.isNotNull() & (index <= F.col("n")), "high_suffix_disambiguated")
        .when(index.isNotNull(), "medium_suffix_out_of_range")
        .when(F.col("n_second") == 1, "high_second_author")
        .when(F.col("n_second") > 1, "medium_multiple_with_second")
        .when(etal & (F.col("n_many") > 0), "medium_etal_heuristic")
        .when(etal, "medium_crossref_etal")
        .otherwise("medium_multiple_matches")
    )
    # the row that each rule picks comes first
    order = (
        F.when(F.col("n") == 1, 0)
        .when(index.isNotNull(), F.when(F.col("by_id") == F.least(index, F.col("n")), 0).otherwise(1))
        .when(F.col("n_second") > 0, F.when(F.coalesce(second, F.lit(False)), F.col("by_ord")).otherwise(F.lit(1 << 30)))
        .when(etal & (F.col("n_many") > 0), F.lit(1 << 20) - F.coalesce("n_authors", F.lit(0)))
        .otherwise(F.col("by_ord"))
    )
    picked = kept.withColumn("label", label).withColumn("pick", F.row_number().over(cite.orderBy(order, "by_ord"))).where("pick = 1").select("doc_id", "citation_id", F.col("ref_id").alias("matched_ref_id"), "label")
    out = cites.join(picked, ["doc_id", "citation_id"], "left").join(years, ["doc_id", "citation_id"], "left")
    final = F.when(F.col("a").isNull() | F.col("cite_year").isNull(), "no_match_missing_info").when(F.col("has_year").isNull(), "no_match_year").when(F.col("label").isNull(), "no_match_author").otherwise(F.col("label"))
    return out.select("doc_id", "citation_id", "cite_author", "cite_second_author", "cite_year", "cite_has_etal", "matched_ref_id", final.alias("match_confidence"))


def match_quality(mapping: DataFrame) -> DataFrame:
    """Matches by label with their percentage of all."""
    return mapping.groupBy("match_confidence").agg(F.count("*").alias("n")).withColumn("percentage", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()) * 100, 1))
