"""Text expressions: tokens, sentences, syllables, readability.

All are plain column expressions, so they stay in the scan's stage.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{M}\p{N}_]+"
SENTENCE_END = r"[.!?]+\s+|[.!?]+$"


def squash(text: Column) -> Column:
    """Line breaks and runs of white space become one blank; trimmed."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def tokens(text: Column) -> Column:
    """Lower-cased word tokens (letters, marks, digits, underscore)."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def joined_words(text: Column) -> Column:
    """Lower-cased tokens of ASCII letters, each between single blanks (' ' if none).

    A token with any other letter, mark, digit or underscore is left out.
    """
    spaced = F.concat(F.lit(" "), F.regexp_replace(F.lower(text), r"[^a-z0-9_\p{L}\p{M}\p{N}]++", " "), F.lit(" "))
    return F.regexp_replace(F.regexp_replace(spaced, " [a-z]*+[^a-z ][^ ]*+(?= )", ""), " {2,}", " ")


def alpha_words(text: Column) -> Column:
    """Lower-cased tokens of ASCII letters only."""
    return F.filter(F.split(joined_words(text), " "), lambda w: w != "")


def let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` evaluated once per row."""
    return F.transform(F.array(value), use)[0]


def n_sentences(text: Column) -> Column:
    """Non-blank pieces between sentence ends."""
    return F.size(F.filter(F.split(F.trim(text), SENTENCE_END, -1), lambda s: F.length(F.trim(s)) > 0))


# The silent endings exclude one another and the hiatus, so one test of each suffices.
SILENT = r"(?:(?<![^aeiouy]l)e|(?<![tdi])ed|(?<![iu])(?<![aeiou]l)es)$"
HIATUS = r"(?<![aeiou])i[aou][ns]$"


def syllables(word: Column) -> Column:
    """Syllables of a lower-case ASCII word: vowel groups, less a silent ending,
    plus the hiatus of -ion, -ian and the like; at least 1, none for ''."""
    groups = F.regexp_count(word, F.lit("[aeiouy]+"))
    change = F.when(word.rlike(SILENT) & (groups > 1), -1).when(word.rlike(HIATUS), 1).otherwise(0)
    return F.when(F.length(word) == 0, 0).otherwise(F.greatest(groups + change, F.lit(1)))


# The same counts over lower-case words between blanks, so that no expression
# runs per word: vowel groups, words without any, silent endings of words with
# two or more groups, hiatus endings; then words of three syllables or more.
_V, _C = "[aeiouy]", "[^aeiouy ]"
_GROUPS = f"{_V}++"
_NO_VOWEL = f" {_C}++(?= )"
_SILENT_WORD = f" (?={_C}*+{_V}++{_C}++{_V})[a-z]*{SILENT[:-1]}(?= )"
_HIATUS_WORD = f"{HIATUS[:-1]}(?= )"
_LONG = f" (?:{_C}*+{_V}++){{3}}"
_THREE_SILENT = f" (?={_C}*+{_V}++{_C}++{_V}++{_C}++{_V}++{_C}*+ )[a-z]*{SILENT[:-1]}(?= )"
_TWO_HIATUS = f" (?={_C}*+{_V}++{_C}++{_V}++{_C}*+ )[a-z]*{HIATUS[:-1]}(?= )"


def readability(text: Column) -> Column:
    """Struct of the four indices and their counts.

    Null, empty and wordless texts have null in every field.
    """

    def counted(c: Column) -> Column:
        n = lambda regex: F.regexp_count(c["j"], F.lit(regex))
        return F.struct(
            c["s"],
            c["w"],
            (n(_GROUPS) + n(_NO_VOWEL) - n(_SILENT_WORD) + n(_HIATUS_WORD)).alias("y"),
            (F.length(c["j"]) - c["w"] - 1).alias("c"),
            (n(_LONG) - n(_THREE_SILENT) + n(_TWO_HIATUS)).alias("x"),
        )

    blanks = lambda j: F.length(j) - F.length(F.replace(j, F.lit(" "), F.lit("")))
    words = let(joined_words(text), lambda j: F.struct(n_sentences(text).alias("s"), (blanks(j) - 1).alias("w"), j.alias("j")))
    return let(let(words, counted), _indices)


def _indices(c: Column) -> Column:
    s, w, y, x, n = (c[k] for k in "swyxc")
    good = (s > 0) & (w > 0)
    per_sentence, per_word, complex_share = w / s, y / w, x / w * 100
    two = lambda e: F.when(good, F.round(e + 1e-9, 2))  # noqa: E731 (a tie in decimals goes up)
    own = lambda e: F.when(good, e)
    return F.struct(
        two(0.39 * per_sentence + 11.8 * per_word - 15.59).alias("flesch_kincaid_grade"),
        two(206.835 - 1.015 * per_sentence - 84.6 * per_word).alias("flesch_reading_ease"),
        two(4.71 * (n / w) + 0.5 * per_sentence - 21.43).alias("automated_readability_index"),
        two(0.4 * (per_sentence + complex_share)).alias("gunning_fog_index"),
        own(s).alias("n_sentences"),
        own(w).alias("n_words"),
        own(y).alias("n_syllables"),
        own(n).alias("n_characters"),
        own(x).alias("n_complex_words"),
        two(per_sentence).alias("avg_sentence_length"),
        two(per_word).alias("avg_syllables_per_word"),
        two(complex_share).alias("pct_complex_words"),
    )


def balanced(columns: list[Column], combine=lambda a, b: a + b) -> Column:
    """Combine many columns as a balanced tree (a long chain overflows the planner's stack)."""
    while len(columns) > 1:
        columns = [combine(*columns[i : i + 2]) if i + 1 < len(columns) else columns[i] for i in range(0, len(columns), 2)]
    return columns[0]


def replaced(text: Column, pairs: list[tuple[str, str]]) -> Column:
    """Chained regular-expression replacements."""
    return reduce(lambda t, p: F.regexp_replace(t, p[0], p[1]), pairs, text)
