"""Words: statistics, frequencies, n-grams, distribution over sections or segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.functions.text import squash, tokens

# Common English function words, the default stop words.
STOPWORDS = (
    "a about above after again against all also although am an and any are as at be because been before being below between both but by can could did do does doing down during each few for from further had has have having he her here hers him his how i if in into is it its itself just me more most my no nor not now of off on once only or other our out over own same she should so some such than that the their them then there these they this those through to too under until up very was we were what when where which while who whom why will with would you your"
).split()


def text_stats(docs: DataFrame, text: str = "text") -> DataFrame:
    """Characters, words, sentences (pieces between terminators, an empty last one
    included) and words per sentence of the squashed text; null text gives no row."""
    t = docs.where(F.col(text).isNotNull()).select("doc_id", squash(F.col(text)).alias("t"))
    out = t.select("doc_id", F.length("t").alias("n_chars"), F.size(F.split("t", r"\s+", -1)).alias("n_words"), F.size(F.split("t", r"[.!?]+", -1)).alias("n_sentences"))
    return out.withColumn("avg_words_per_sentence", F.round(F.col("n_words") / F.col("n_sentences"), 2))


def stopword_table(spark, words=STOPWORDS) -> DataFrame:
    return spark.createDataFrame([(w,) for w in words], "word string")


def word_rows(docs: DataFrame, keys: list[str], text: str = "text", min_length: int = 1, drop_numbers: bool = True, stopwords: DataFrame | None = None) -> DataFrame:
    """(keys, pos, word): lower-cased tokens; short ones, numbers and stop words left out.

    The stop-word table is a parameter of fixed size and is broadcast.
    """
    rows = docs.select(*keys, F.posexplode(tokens(F.col(text))).alias("pos", "word")).where(F.length("word") >= min_length)
    if drop_numbers:
        rows = rows.where(~F.col("word").rlike("^[0-9]+$"))
    return rows if stopwords is None else rows.join(F.broadcast(stopwords), "word", "left_anti").select(*keys, "pos", "word")


def word_frequencies(words: DataFrame, keys: list[str]) -> DataFrame:
    """Count, share of the group's total and rank (ties by word) of each word."""
    w = Window.partitionBy(*keys)
    n = words.groupBy(*keys, "word").agg(F.count("*").alias("n"))
    return n.withColumn("frequency", F.round(F.col("n") / F.sum("n").over(w), 6)).withColumn("rank", F.row_number().over(w.orderBy(F.desc("n"), "word")))


def ngrams(words: Column, n: int) -> Column:
    """All runs of ``n`` words of an array, joined by blanks."""
    return F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(0), F.size(words) - n), lambda i: F.array_join(F.slice(words, i + 1, n), " "))).otherwise(F.array().cast("array<string>"))


def word_arrays(words: DataFrame, keys: list[str]) -> DataFrame:
    """The kept words of each group in their order."""
    return words.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda x: x["word"]).alias("words"))


def top_ngrams(arrays: DataFrame, keys: list[str], sizes: tuple[int, ...] = (1, 2, 3), k: int = 15) -> DataFrame:
    """The ``k`` most frequent n-grams of each size; shares are of the total for
    single words and of the top ``k`` for longer ones. Ties by n-gram."""
    def sized(n: int) -> Column:
        return F.transform(ngrams(F.col("words"), n), lambda g: F.struct(F.lit(n).alias("n"), g.alias("ngram")))

    grams = F.concat(*[sized(n) for n in sizes])
    counted = arrays.select(*keys, F.explode(grams).alias("g")).groupBy(*keys, "g.n", "g.ngram").agg(F.count("*").alias("cnt"))
    w = Window.partitionBy(*keys, "n")
    ranked = counted.withColumn("total", F.sum("cnt").over(w)).withColumn("rank", F.row_number().over(w.orderBy(F.desc("cnt"), "ngram"))).where(F.col("rank") <= k)
    base = F.when(F.col("n") == 1, F.col("total")).otherwise(F.sum("cnt").over(w))
    return ranked.withColumn("frequency", F.round(F.col("cnt") / base, 6)).drop("total")


def lexical_diversity(words: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct words over all words of each group."""
    return words.groupBy(*keys).agg(F.count("*").alias("n_words"), F.countDistinct("word").alias("n_unique")).withColumn("lexical_diversity", F.round(F.col("n_unique") / F.col("n_words"), 6))


def segments(docs: DataFrame, n: int, text: str = "text") -> DataFrame:
    """(doc_id, segment, text): ``n`` slices of equal length of the squashed text."""
    t = docs.where(F.length(F.trim(text)) > 0).select("doc_id", squash(F.col(text)).alias("t"))
    size = F.ceil(F.length("t") / n).cast("int")
    return t.select("doc_id", "t", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("segment"), size.alias("s")).select("doc_id", "segment", F.col("t").substr((F.col("segment") - 1) * F.col("s") + 1, F.col("s")).alias("text"))


def word_distribution(parts: DataFrame, terms: DataFrame, keys: list[str], stopwords: DataFrame | None = None, sizes: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """Count of each selected term (one to three words) in each part, the part's
    words and the term's share; stop words leave before n-grams are built."""
    words = word_rows(parts, keys, stopwords=stopwords, drop_numbers=False)
    arrays = word_arrays(words, keys)
    total = arrays.select(*keys, F.size("words").alias("total_words"))
    found = arrays.select(*keys, F.explode(F.concat(*[ngrams(F.col("words"), n) for n in sizes])).alias("word")).join(F.broadcast(terms), "word", "left_semi")
    return found.groupBy(*keys, "word").agg(F.count("*").alias("count")).join(total, keys).withColumn("relative_frequency", F.round(F.col("count") / F.col("total_words"), 6))


def dense(distribution: DataFrame, parts: DataFrame, terms: list[str], keys: list[str]) -> DataFrame:
    """The distribution with zeros for every term in every part.

    ``terms`` is the caller's own list, whatever its length; every part is a row for each."""
    spine = parts.select(*keys).distinct().withColumn("word", F.explode(F.array(*[F.lit(t) for t in dict.fromkeys(terms)]).cast("array<string>")))
    out = spine.join(distribution, [*keys, "word"], "left")
    return out.select(*keys, "word", F.coalesce("count", F.lit(0)).alias("count"), F.coalesce("relative_frequency", F.lit(0.0)).alias("relative_frequency"))


def top_words(frequencies: DataFrame, k: int = 20) -> DataFrame:
    """The ``k`` most frequent words of each group."""
    return frequencies.where(F.col("rank") <= k)


def truncated(text: Column, width: int) -> Column:
    """At most ``width`` characters, three dots in place of what is cut."""
    return F.when(F.length(text) > width, F.concat(F.substring(text, 1, width - 3), F.lit("..."))).otherwise(text)
