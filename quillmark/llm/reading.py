"""Reading level of English pages by smoothed unigram language models.

The running prose is cut out of the markup; a bounded sample of pages, seeded by
the Flesch-Kincaid formula and checked against trusted stored indices and
raters' labels, trains one unigram model per level; every page gets the level of
the highest posterior likelihood.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.functions.text import readability, replaced
from quillmark.llm.bpe import flat_words
from quillmark.shared import written

LEVELS = ("basic", "intermediate", "advanced")
#: Borders of the levels in Flesch-Kincaid grades (a border belongs to the upper level).
BORDERS = (6.0, 12.5)
#: Least words of prose; least share of English function words among them.
LEAST_WORDS, ENGLISH_SHARE = 60, 0.06
#: Pages in the training sample, words in the models, their additive smoothing.
SAMPLE, VOCABULARY, SMOOTHING = 6_000, 200_000, 0.1

# Frequent English function words that are no words of the other languages here.
ENGLISH = ("the", "of", "and", "to", "was", "is", "it", "that", "with", "for", "by", "at", "from", "they", "we", "on", "were", "its", "this", "which", "before", "after", "until", "under", "near", "although", "whereas", "throughout")

# Markup, in the order of its removal; each pass looks for one sign only.
MARKUP = [
    # comments; references (an unclosed one ends with its line); blocks without prose; other tags
    (
        r"<(?:!--(?s:.*?)(?:-->|\z)|ref(?:[^<>]*/>|[^<>]*>[^<\n]*(?:<(?!/?ref)[^<\n]*)*(?:</ref>)?)"
        r"|(gallery|math|code|pre|syntaxhighlight|timeline)[^<>]*>(?s:.*?)(?:</\1>|\z)|/?[a-zA-Z][^<>]*>)",
        " ",
    ),
    # headings, lists, and the lines of tables and templates
    (r"(?m)^[ \t]*[*#:;=|!{}].*$", ""),
    (r"\{{2,3}[^{}]*\}{2,3}", " "),
    (r"\{{2,3}[^{}]*\}{2,3}", " "),
    # categories and files; links; addresses
    (r"\[(?:\[[^\[\]|]*:[^\[\]]*\]\]|\[(?:[^\[\]|]*\|)?([^\[\]|]*)\]\]|[a-z]+://[^\s\]]*\s?([^\]]*)\])", "$1$2"),
    (r"'{2,}|&[a-z]+;", " "),
]

#: A line of prose holds the end of a sentence.
SENTENCE = r"[\p{L}\p{N}][)\]\"'’”]{0,3}[.!?…]+(?:[\s\"'’”)]|$)"


def prose(text: Column) -> Column:
    """The running sentences of a wiki page, line by line; null for null."""
    lines = F.filter(F.split(replaced(text, MARKUP), "\n"), lambda line: line.rlike(SENTENCE))
    return F.array_join(lines, "\n")


#: Text without any of the function words can't be English; most other pages end here.
ANY_ENGLISH = rf"(?i)(?<![a-z])(?:{'|'.join(ENGLISH)})(?![a-z])"


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}+"), F.lit(0))


def level_of(grade: Column) -> Column:
    return F.when(grade < BORDERS[0], LEVELS[0]).when(grade < BORDERS[1], LEVELS[1]).when(grade.isNotNull(), LEVELS[2])


class Judged:
    """Words of a batch of prose, with each text's number of words and whether it is English."""

    def __init__(self, column: pa.ListArray):
        self.flat, self.offsets = flat_words(column)
        coded = self.flat.dictionary_encode()
        self.distinct, self.place = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        english = set(ENGLISH)
        common = np.fromiter((w in english for w in self.distinct), bool, len(self.distinct))
        self.n = np.diff(self.offsets)
        self.doc = np.repeat(np.arange(len(self.n)), self.n)
        share = np.bincount(self.doc, common[self.place], len(self.n)) / np.maximum(self.n, 1)
        self.keep = np.flatnonzero((self.n >= LEAST_WORDS) & (share >= ENGLISH_SHARE))


def _english_only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, p, words) of the English texts."""
    for batch in batches:
        yield batch.take(pa.array(Judged(batch.column(2)).keep))


def trusted_levels(stored: DataFrame) -> DataFrame:
    """(doc_id, stored_level) of stored rows whose indices follow from their own
    counts; of several the newest."""
    grade = 0.39 * F.col("n_words") / F.col("n_sentences") + 11.8 * F.col("n_syllables") / F.col("n_words") - 15.59
    ease = 206.835 - 1.015 * F.col("n_words") / F.col("n_sentences") - 84.6 * F.col("n_syllables") / F.col("n_words")
    good = (F.abs(grade - F.col("flesch_kincaid_grade")) < 0.1) & (F.abs(ease - F.col("flesch_reading_ease")) < 0.5)
    return stored.where((F.col("n_words") > 0) & (F.col("n_sentences") > 0)).where(good).groupBy("doc_id").agg(F.max_by(F.struct("flesch_kincaid_grade", F.col("n_words").alias("stored_words")), "computed_at").alias("s")).select("doc_id", level_of(F.col("s.flesch_kincaid_grade")).alias("stored_level"), "s.stored_words")


def seeds(docs: DataFrame, stored: DataFrame, labels: DataFrame | None, key: str, text: str, sample: int) -> DataFrame:
    """(key, words, level) of the training pages: about ``sample`` pages drawn by
    the hash of their key, those in English, level by the formula; pages whose trusted stored index (of about
    as many words) or whose raters' majority differs are left out."""
    n = docs.count()
    chance = F.pmod(F.xxhash64(key), F.lit(1 << 30)) / float(1 << 30)
    few = docs.where((F.length(text) > 0) & (chance * n < sample) & F.col(text).rlike(ANY_ENGLISH))
    judged = few.select(F.col(key), prose(F.col(text)).alias("p")).select(key, "p", _words(F.col("p")).alias("words"))
    own = judged.mapInArrow(_english_only, judged.schema)
    levelled = own.select(key, "words", level_of(readability(F.col("p"))["flesch_kincaid_grade"]).alias("level"))
    drawn = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30) * n < sample
    checked = levelled.join(trusted_levels(stored.where(drawn)).withColumnRenamed("doc_id", key), key, "left")
    checked = checked.where(F.col("stored_level").isNull() | (F.col("stored_level") == F.col("level")) | (F.abs(F.col("stored_words") / F.size("words") - 1) > 0.1))
    if labels is not None:
        majority = labels.where(F.col("grade_band").isin(*LEVELS)).groupBy("doc_id").agg(F.mode("grade_band", True).alias("rated"), F.count("*").alias("raters")).where(F.col("raters") > 1).withColumnRenamed("doc_id", key)
        checked = checked.join(majority, key, "left").where(F.col("rated").isNull() | (F.col("rated") == F.col("level")))
    return checked.where(F.col("level").isNotNull()).select(key, "words", "level")


def models(training: DataFrame, vocabulary: int = VOCABULARY, smoothing: float = SMOOTHING) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(words, log likelihood per word and level with the unknown word last, log prior)."""
    counted = training.select(F.explode("words").alias("word"), "level").groupBy("word").pivot("level", list(LEVELS)).count().na.fill(0)
    rows = counted.withColumn("n", sum(F.col(x) for x in LEVELS)).where(F.col("n") > 1).orderBy(F.desc("n"), "word").limit(vocabulary).drop("n").toPandas()
    pages = {r["level"]: r["count"] for r in training.groupBy("level").count().collect()}
    counts = np.vstack([rows[list(LEVELS)].to_numpy(float).reshape(-1, len(LEVELS)), np.zeros((1, len(LEVELS)))]) + smoothing
    prior = np.array([pages.get(x, 0) for x in LEVELS], float) + 1.0
    return rows["word"].tolist(), np.log(counts) - np.log(counts.sum(0)), np.log(prior) - np.log(prior.sum())


def reading_levels(docs: DataFrame, stored: DataFrame, labels: DataFrame | None = None, key: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> DataFrame:
    """(key, reading_level, posterior, n_words) of every English page with at
    least ``LEAST_WORDS`` words of prose.

    The language is judged by the prose itself, not by a stored code. Null,
    empty and other texts give no row; repeated rows give one each; ties go to
    the easier level; without any training page there are no rows. The models
    hold at most ``VOCABULARY`` words, which bounds what is broadcast.
    """
    words, likelihood, prior = models(written(seeds(docs, stored, labels, key, text, sample), "reading-seeds"))
    shipped = docs.sparkSession.sparkContext.broadcast((words, likelihood, prior))
    names = [key, "reading_level", "posterior", "n_words"]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, likelihood, prior = shipped.value
        row = {w: i for i, w in enumerate(words)}
        for batch in batches:
            if not row:
                continue
            own_words = Judged(batch.column(1))
            own = np.fromiter((row.get(w, len(row)) for w in own_words.distinct), np.int64, len(own_words.distinct))
            doc, place, n, keep = own_words.doc, own_words.place, own_words.n, own_words.keep
            odds = np.stack([np.bincount(doc, likelihood[own, k][place], batch.num_rows) for k in range(len(prior))], 1) + prior
            post = np.exp(odds - odds.max(1, keepdims=True))
            post /= post.sum(1, keepdims=True)
            best = odds.argmax(1)[keep]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep)), pa.array([LEVELS[b] for b in best], pa.string()), pa.array(post[keep, best]), pa.array(n[keep], pa.int32())], names=names)

    kind = docs.schema[key].dataType.simpleString()
    own = docs.where((F.length(text) > 0) & F.col(text).rlike(ANY_ENGLISH)).select(F.col(key), _words(prose(F.col(text))).alias("w"))
    return own.mapInArrow(score, f"{key} {kind}, reading_level string, posterior double, n_words int")
