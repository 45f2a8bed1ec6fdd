"""Citation co-occurrence networks: nodes, edges, statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.operators.words import truncated


def edges(pairs: DataFrame, max_distance: int = 1000) -> DataFrame:
    """Edges within the distance, with width and the colour class of their distance."""
    d = F.abs("distance")
    near = pairs.where(d <= max_distance)
    return near.withColumn("width", F.round(F.greatest(F.lit(0.5), 3 - d / 200), 3)).withColumn("distance_class", F.when(d <= 300, "near").when(d <= 600, "medium").otherwise("far"))


def degrees(pairs: DataFrame) -> DataFrame:
    """(doc_id, citation, connections): ends of edges, parallel edges counted."""
    a, b = pairs.select("doc_id", F.col("citation1").alias("citation")), pairs.select("doc_id", F.col("citation2").alias("citation"))
    return a.unionAll(b).groupBy("doc_id", "citation").agg(F.count("*").alias("connections"))


def nodes(pairs: DataFrame, citations: DataFrame, min_connections: int = 1) -> DataFrame:
    """Nodes with at least ``min_connections``: their sections in order of first
    sight, size, border and label."""
    first = citations.groupBy("doc_id", "citation", "section").agg(F.min("ord").alias("o"))
    seen = first.groupBy("doc_id", "citation").agg(F.array_sort(F.collect_list(F.struct("o", "section"))).alias("s"))
    named = seen.select("doc_id", "citation", F.array_join(F.transform("s", lambda x: x["section"]), ", ").alias("sections"), F.size("s").alias("n_sections"), F.get("s", F.lit(0))["section"].alias("primary_section"))
    out = degrees(pairs).where(F.col("connections") >= min_connections).join(named, ["doc_id", "citation"], "left")
    out = out.withColumn("sections", F.coalesce("sections", F.lit("Unknown"))).withColumn("n_sections", F.coalesce("n_sections", F.lit(1))).withColumn("primary_section", F.coalesce("primary_section", F.lit("Unknown")))
    size = F.least(F.greatest(15 + F.col("connections") * 3, F.lit(15)), F.lit(40)) / 2
    return out.withColumn("size", F.round(size, 3)).withColumn("border", F.when(F.col("n_sections") > 1, 3).otherwise(1)).withColumn("label", truncated(F.col("citation"), 25))


def surviving(pairs: DataFrame, kept: DataFrame) -> DataFrame:
    """Edges whose ends are both kept nodes; degrees are not counted again."""
    n = kept.select("doc_id", "citation")
    one = pairs.join(n.withColumnRenamed("citation", "citation1"), ["doc_id", "citation1"], "left_semi")
    return one.join(n.withColumnRenamed("citation", "citation2"), ["doc_id", "citation2"], "left_semi")


def stats(kept: DataFrame, pairs: DataFrame) -> DataFrame:
    """Nodes, edges, mean distance and nodes in several sections of each document."""
    a = kept.groupBy("doc_id").agg(F.count("*").alias("n_nodes"), F.sum((F.col("n_sections") > 1).cast("int")).alias("multi_section_nodes"))
    b = pairs.groupBy("doc_id").agg(F.count("*").alias("n_edges"), F.round(F.avg(F.abs("distance")), 1).alias("avg_distance"))
    return a.join(b, "doc_id", "left").withColumn("n_edges", F.coalesce("n_edges", F.lit(0)))


def sections_of(kept: DataFrame) -> DataFrame:
    """Nodes by their first section."""
    return kept.groupBy("doc_id", F.col("primary_section").alias("section")).agg(F.count("*").alias("n_nodes"))
