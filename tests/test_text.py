"""Tokens, syllables, readability, names."""

import pytest
from pyspark.sql import functions as F

from quillmark.functions import names, regexscan
from quillmark.functions import text as tx

SYLLABLES = {"cat": 1, "happy": 2, "beautiful": 3, "university": 5, "make": 1, "table": 2, "walked": 1, "needed": 2, "created": 2, "boxes": 1, "files": 2, "action": 3, "education": 5, "": 0}


def test_syllables_and_counts_agree(spark):
    rows = spark.createDataFrame(list(SYLLABLES.items()), "w string, n int")
    for r in rows.select("w", "n", tx.syllables(F.col("w")).alias("s"), tx.readability(F.col("w"))["n_syllables"].alias("t")).collect():
        assert r.s == r.n
        assert (r.t or 0) == r.n


def test_readability_formulas(spark):
    df = spark.createDataFrame([(1, "The cat sat. It ran."), (2, ""), (3, None), (4, "123 456!")], "i int, t string")
    r = {x.i: x.r for x in df.select("i", tx.readability(F.col("t")).alias("r")).collect()}
    assert (r[1].n_words, r[1].n_syllables, r[1].n_sentences, r[1].n_characters) == (5, 5, 2, 14)
    assert r[1].flesch_kincaid_grade == round(0.39 * 2.5 + 11.8 - 15.59, 2)
    assert r[1].flesch_reading_ease == pytest.approx(206.835 - 1.015 * 2.5 - 84.6, abs=0.011)
    for i in (2, 3, 4):
        assert all(v is None for v in r[i])


def test_located_and_swept(spark):
    df = spark.createDataFrame([("é😀 ab1 b22 c",)], "t string")
    hits = df.select(regexscan.located(F.col("t"), r"[a-z]+\d+").alias("h")).first().h
    assert [(h.k, h.start_pos, h.end_pos, h.hit) for h in hits] == [(1, 4, 6, "ab1"), (2, 8, 10, "b22")]


@pytest.mark.parametrize(
    "a, b, same",
    [("Smith", "smith", True), ("van Raan", "Raan", True), ("García", "Garcia", True), ("Hansen", "Hansne", True), ("Smith", "Jones", False), (None, "Smith", False), ("", "Smith", False), ("Johanson", "Johansonn", True)],
)
def test_names_match(spark, a, b, same):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    assert df.select(names.names_match(F.col("a"), F.col("b")).alias("m")).first().m is same
