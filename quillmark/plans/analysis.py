"""The whole analysis of a corpus as lazy tables over one text and reference input."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.operators import citations as ci
from quillmark.operators import matching, network, words
from quillmark.shared import written


class PaperAnalysis:
    """Tables of an analysis; each is planned when asked for and runs when used, save the
    citations, which are written once to the shared folder.

    ``docs``: (doc_id, text); ``references``: (doc_id, ref_ord, ref_id, ref_year,
    ref_first_author, ref_second_author, n_authors), or None.
    """

    def __init__(self, docs: DataFrame, references: DataFrame | None = None, citation_type: str = "all", window: int = 10, n_segments: int = 10, max_distance: int = 1000, min_word_length: int = 3, stopwords: DataFrame | None = None, expand: bool = True):
        self.docs, self.references, self.citation_type = docs, references, citation_type
        self.window, self.n_segments, self.max_distance, self.min_word_length, self.stopwords, self.expand = window, n_segments, max_distance, min_word_length, stopwords, expand

    @cached_property
    def citations(self) -> DataFrame:
        found = ci.scan(self.docs, citation_type=self.citation_type)
        # scanned once, whatever is built on it
        return written(ci.standardize(ci.expand(found) if self.expand else found), "analysis-citations")

    @cached_property
    def contexts(self) -> DataFrame:
        return ci.contexts(self.docs, self.citations, self.window)

    @cached_property
    def segments(self) -> DataFrame:
        return ci.map_to_segments(self.citations, self.n_segments)

    @cached_property
    def pairs(self) -> DataFrame:
        c = self.citations.withColumn("ord", F.col("citation_ord") * 1000 + F.coalesce(F.col("part"), F.lit(0))) if self.expand else self.citations.withColumn("ord", F.col("citation_ord"))
        return ci.cooccurrence(c.withColumn("citation", F.col("citation_text_clean")), self.max_distance)

    @cached_property
    def network(self) -> tuple[DataFrame, DataFrame]:
        c = self.segments.withColumn("ord", F.col("citation_ord")).withColumn("citation", F.col("citation_text_clean")).withColumn("section", F.col("segment"))
        kept = network.nodes(self.pairs, c)
        return kept, network.surviving(network.edges(self.pairs, self.max_distance), kept)

    @cached_property
    def words(self) -> DataFrame:
        return words.word_rows(self.docs, ["doc_id"], min_length=self.min_word_length, stopwords=self.stopwords)

    @cached_property
    def word_frequencies(self) -> DataFrame:
        return words.word_frequencies(self.words, ["doc_id"])

    @cached_property
    def mapping(self) -> DataFrame:
        own = self.citations.select("doc_id", "citation_id", "citation_type", "citation_text", "citation_text_clean")
        a = matching.match_numbered(own, self.references).select("doc_id", "citation_id", "matched_ref_id", "match_confidence")
        b = matching.match_narrative(own, self.references).select("doc_id", "citation_id", "matched_ref_id", "match_confidence")
        return a.unionByName(b)

    def summary(self) -> DataFrame:
        """One row per document: words, different words and their share; citations by
        kind, their density and the mean length of their contexts; references, matches
        of good confidence and all matches by label ('label n percent')."""
        kind = F.col("citation_type")
        c = self.citations.groupBy("doc_id").agg(F.count("*").alias("citations_extracted"), F.sum(kind.contains("narrative").cast("int")).alias("narrative_citations"), F.sum((kind == "parsed_from_multiple").cast("int")).alias("complex_citations_parsed"))
        length = self.contexts.groupBy("doc_id").agg(F.round(F.avg("context_word_count"), 4).alias("average_citation_context_length"))
        w = words.lexical_diversity(self.words, ["doc_id"]).withColumnsRenamed({"n_words": "total_words_analyzed", "n_unique": "unique_words"})
        out = words.text_stats(self.docs).select("doc_id", F.col("n_words").alias("_n")).join(w, "doc_id", "left").join(c, "doc_id", "left").join(length, "doc_id", "left")
        zero = lambda name: F.coalesce(F.col(name), F.lit(0)).alias(name)
        n = F.coalesce("citations_extracted", F.lit(0))
        columns = [
            "doc_id", zero("total_words_analyzed"), zero("unique_words"), zero("citations_extracted"), zero("narrative_citations"), (n - F.coalesce("narrative_citations", F.lit(0))).alias("parenthetical_citations"), zero("complex_citations_parsed"),
            "lexical_diversity", F.coalesce("average_citation_context_length", F.lit(0.0)).alias("average_citation_context_length"), F.round(n / F.col("_n") * 1000, 2).alias("citation_density_per_1000_words"),
        ]
        if self.references is None:
            return out.select(*columns, F.lit(self.citation_type).alias("citation_type_used"))
        refs = self.references.groupBy("doc_id").agg(F.count("*").alias("references_parsed"))
        by_label = self.mapping.groupBy("doc_id", "match_confidence").agg(F.count("*").alias("k"))
        good = F.col("match_confidence").isin("high", "high_second_author", "medium_multiple_matches", "medium_fuzzy")
        labels = by_label.groupBy("doc_id").agg(F.sum(F.when(good, F.col("k")).otherwise(0)).alias("citations_matched_to_refs"), F.sum("k").alias("_all"), F.array_sort(F.collect_list(F.struct("match_confidence", "k"))).alias("_q"))
        quality = F.array_join(F.transform("_q", lambda x: F.concat_ws(" ", x["match_confidence"], x["k"].cast("string"), F.round(x["k"] / F.col("_all") * 100, 1).cast("string"))), "; ")
        labels = labels.select("doc_id", "citations_matched_to_refs", quality.alias("match_quality"))
        return out.join(refs, "doc_id", "left").join(labels, "doc_id", "left").select(*columns, zero("references_parsed"), zero("citations_matched_to_refs"), "match_quality", F.lit(self.citation_type).alias("citation_type_used"))
