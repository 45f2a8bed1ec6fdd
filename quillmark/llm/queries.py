"""Queries of the training-text operators over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillmark.llm import bpe, distinctive, leakage, names, noise, reading, sentences, splitting, works
from quillmark.shared import load


def _scanned(spark: SparkSession, sf_dir: str) -> noise.Judgement:
    return noise.Judgement(noise.records(load(spark, sf_dir, "sentences"), load(spark, sf_dir, "matched_citations")))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scanned(spark, sf_dir).found()


def p1_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scanned(spark, sf_dir).repaired().distinct()


def p2_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names.sizes(names.entities(load(spark, sf_dir, "authors"), load(spark, sf_dir, "matched_citations")))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names.linked(names.entities(load(spark, sf_dir, "authors"), load(spark, sf_dir, "matched_citations")))


def p3_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reading.reading_levels(load(spark, sf_dir, "documents"), load(spark, sf_dir, "readability"), load(spark, sf_dir, "reading_labels"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p3_levels(spark, sf_dir).select("doc_id", "reading_level")


def p4_works(spark: SparkSession, sf_dir: str) -> DataFrame:
    return works.work_members(load(spark, sf_dir, "matched_citations"), load(spark, sf_dir, "crossref_refs"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return works.match(load(spark, sf_dir, "matched_citations"), load(spark, sf_dir, "crossref_refs")).select("mapping_id", "ref_row_id")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences.sentence_units(load(spark, sf_dir, "sentences")).distinct()


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distinctive.most_characteristic(load(spark, sf_dir, "cluster_descriptions"), ["paper_id", "section"]).withColumnRenamed("term", "ngram")


def p7_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distinctive.scores(load(spark, sf_dir, "cluster_descriptions"), ["paper_id", "section"]).withColumnRenamed("term", "ngram")


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_corpus(load(spark, sf_dir, "documents"))


def p8_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.decode_corpus(p8_ids(spark, sf_dir))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = leakage.leaks(load(spark, sf_dir, "documents"), load(spark, sf_dir, "eval_items"))
    return found.select("doc_id", "item_id").distinct()


def p9_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    return leakage.without_spans(docs, leakage.leaks(docs, load(spark, sf_dir, "eval_items")))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.oversized(load(spark, sf_dir, "documents"))


def p10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.split_corpus(load(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (p1_found, p1_repaired, p2_found, p2_entities, p3_found, p3_levels, p4_found, p4_works, p5_found, p7_found, p7_scores, p8_ids, p8_decoded, p9_found, p9_cleaned, p10_found, p10_pieces)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {}
