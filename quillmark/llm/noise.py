"""Repairing text read from scanned pages.

Three kinds of noise: words broken across lines, misrecognised characters, page
furniture. Correction candidates come from a character q-gram inverted join of
the corpus's own words; a boosted ranking chooses replacements; boosted line and
line-pair classifiers handle furniture and joins. All counts are of all texts, and all
models are trained on every word, compound, line and text of the corpus, which label
themselves: equal examples are counted together in Spark, and features lie on fixed
grids, so that what the driver trains on does not grow with the rows.

All texts are read twice: once to count words, compounds, broken pairs and lines, and
once to list what may be noise in each row.
"""

from __future__ import annotations

import collections
import functools
import math
import random
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.llm.boost import Boosted
from quillmark.shared import join_hot, written

# Signs that scanning puts in place of letters, and letter groups it confuses.
SIGNS = {"0": "o", "1": "l", "5": "s", "8": "b", "9": "g", "†": "t", "â": "a"}
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}
GROUPS = (("cl", "d"), ("rn", "m"), ("vv", "w"), ("ii", "u"), ("im", "nn"), ("li", "h"))
CONFUSED = {"c": "e", "i": "l", "h": "b"}
HYPHENS = "-‐¬­"
#: Signs that are letters of some languages, too.
LETTERS = "â"
#: Characters that are evidence of misreading inside a word, whether or not their letter is known.
ODD = "".join(dict.fromkeys([*SIGNS, *LIGATURES, *"0123456789"]))

WORD = r"[0-9A-Za-z†À-ÖØ-öø-ɏ̀-ͯﬀ-ﬆ]+"
#: Codes and numbers are no words (fewer than three letters, or capitals before digits), unless ``no_codes`` knows the word.
CODE = r"^(?:(?:[^\p{L}]*\p{L}){0,2}[^\p{L}]*|\p{Lu}+\p{N}+[\p{Lu}\p{N}]*|\p{N}+\p{Lu}*)$"
#: Words that may be the right spelling; least ratio of its count to the wrong one's.
TRUSTED, RATIO = 4, 5
#: q-gram size.
Q = 3
#: Most frequent clean words, left out before the words are shuffled (a bounded broadcast).
COMMON = 20_000


def folded(word: Column) -> Column:
    """Signs of misreading back to letters."""
    out = F.translate(word, "".join(SIGNS), "".join(SIGNS.values()))
    for sign, letters in LIGATURES.items():
        out = F.replace(out, F.lit(sign), F.lit(letters))
    return out


def skeleton(word: Column) -> Column:
    """Equal for words that differ by confused characters only."""
    out = folded(word)
    for group, letter in GROUPS:
        out = F.replace(out, F.lit(group), F.lit(letter))
    return F.translate(out, "".join(CONFUSED), "".join(CONFUSED.values()))


def forms(word: Column) -> Column:
    """What the search compares: the skeleton, and letter by letter the word without
    joined groups, where one exchanged character stays one."""
    return F.array_distinct(F.array(skeleton(word), F.translate(folded(word), "".join(CONFUSED), "".join(CONFUSED.values()))))


_FOLDED, _CONFUSED = str.maketrans(SIGNS | LIGATURES), str.maketrans(CONFUSED)
_FOLDS = re.compile(f"[{''.join((*SIGNS, *LIGATURES))}]").search


def fold_text(word: str) -> str:
    return word.translate(_FOLDED) if _FOLDS(word) else word


def skeleton_text(word: str) -> str:
    word = fold_text(word)
    for group, letter in GROUPS:
        word = word.replace(group, letter)
    return word.translate(_CONFUSED)


def forms_text(word: str) -> set[str]:
    return {skeleton_text(word), fold_text(word).translate(_CONFUSED)}


_WORD = re.compile(WORD)
_WRAP = re.compile(rf"[{HYPHENS}][ \t]*\r?\n")
_PAIR = re.compile(rf"([^\W\d_]+)([{HYPHENS}])[ \t]*\r?\n[ \t]*([^\W\d_]+)")
_JOIN = re.compile(rf"(?<=[^\W\d_])[{HYPHENS}][ \t]*\r?\n[ \t]*(?=[^\W\d_])")
_COMPOUND = re.compile(r"[^\W\d_]+-[^\W\d_]+")


def joined(text: str) -> str:
    """Hyphenated line ends joined; what stands there on purpose is judged elsewhere."""
    return _JOIN.sub("", text) if _WRAP.search(text) else text


def counted(rows: DataFrame) -> DataFrame:
    """(tag, item, n): how often each word and code ('w'), compound ('c') and pair broken
    at a line end ('b', its left part, sign and right part between tabs) stands in the
    texts, as written, how often each inner line ('o', see ``lines_of``), and the number
    of texts with lines ('l').

    Counted within each batch before the shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = {tag: collections.Counter() for tag in "wcblo"}
            for text in batch.column(0).to_pylist():
                if "\n" in text or "\x0c" in text:
                    n["l"][""] += 1
                    n["o"].update(item for _, _, item in lines_of(text))
                    if _WRAP.search(text):
                        n["b"].update("\t".join(m) for m in _PAIR.findall(text))
                        text = _JOIN.sub("", text)
                n["w"].update(_WORD.findall(text))
                if "-" in text:
                    n["c"].update(c for part in text.split() if "-" in part for c in _COMPOUND.findall(part))
            told = [(tag, item, k) for tag, own in n.items() for item, k in own.items()]
            columns = list(zip(*told)) if told else [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.int64())], names=["tag", "item", "n"])

    return rows.select("text").mapInArrow(run, "tag string, item string, n bigint").groupBy("tag", "item").agg(F.sum("n").alias("n"))


def tallied(rows: DataFrame, examples: Callable[..., Iterable[tuple[tuple[float, ...], int]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, labels and counts of all examples that ``rows`` give, each a tuple with
    its label at the end and its count. Equal ones are counted together, so there are
    as many as their grid has points in use, however many rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n: collections.Counter = collections.Counter()
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                for example, k in examples(*row):
                    n[example] += k
            yield pa.RecordBatch.from_arrays([pa.array([list(e) for e in n], pa.list_(pa.float64())), pa.array(list(n.values()), pa.int64())], names=["example", "n"])

    every = rows.mapInArrow(run, "example array<double>, n bigint").groupBy("example").agg(F.sum("n").alias("n"))
    return arrays((tuple(e), n) for e, n in every.collect())


def arrays(examples: Iterable[tuple[tuple[float, ...], int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    told = sorted(examples)  # the same model in whichever order they come
    x = np.array([e for e, _ in told] or np.empty((0, 1)), float)
    return x[:, :-1], x[:, -1], np.array([n for _, n in told], float)


def vocabulary(words: DataFrame) -> DataFrame:
    """(word, n, skeleton, signs) of (words): every distinct word, how often it stands,
    its skeleton, and its number of signs of misreading."""
    return of_spellings(words.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n")))


def of_spellings(written_so: DataFrame) -> DataFrame:
    """The vocabulary of the words as written, without codes.

    Letters alone need three: in shorter ones nothing tells misreading from initials.
    """
    # codes are told by their capitals, so they go before the case does
    counted = written_so.where(~F.col("word").rlike(CODE)).groupBy(F.lower("word").alias("word")).agg(F.sum("n").alias("n"))
    signs = F.length("word") - F.length(F.translate("word", ODD, ""))
    return counted.select("word", "n", skeleton(F.col("word")).alias("skeleton"), signs.alias("signs"))


def maybe_misread(word: Column) -> Column:
    """Codes that may be words: signs count as letters, of which there are three at least."""
    return (F.length(word) >= 3) & word.rlike(r"\p{L}") & word.rlike(f"[{''.join(SIGNS)}]")


@functools.lru_cache(maxsize=262_144)
def _no_word(word: str) -> bool:
    """Codes and numbers that ``CODE`` takes for such and ``maybe_misread`` does not: too few letters, no sign."""
    letters = sum(map(str.isalpha, word))
    return letters < 3 and (len(word) < 3 or not letters or not any(c in SIGNS for c in word))


def no_codes(written_so: DataFrame, words: DataFrame) -> DataFrame:
    """(word, right, n): what looks like a code, but is a known word with its signs
    read as letters. Short ones need a trusted word and more letters than signs."""
    told = written_so.where(F.col("word").rlike(CODE) & maybe_misread(F.col("word"))).groupBy(F.lower("word").alias("word")).agg(F.sum("n").alias("n")).withColumn("right", folded(F.col("word")))
    known = words.where("signs = 0").select(F.col("word").alias("right"), F.col("n").alias("n_right"))
    signs = F.length("word") - F.length(F.translate("word", ODD, ""))
    sure = (F.length("right") >= 5) | ((F.col("n_right") >= TRUSTED) & (F.col("n_right") >= RATIO * F.col("n")))
    return told.join(known, "right").where((F.col("n_right") >= F.col("n")) & (signs * 2 < F.length("word")) & sure).select("word", "right", "n")


#: Frequent q-grams whose counts are broadcast. All others count as the rarest; any
#: order of the q-grams gives the same candidates, a good one gives them from fewer pairs.
HOT_GRAMS = 20_000


def _padded(s: Column) -> Column:
    return F.concat(F.lit("^" * (Q - 1)), s, F.lit("$" * (Q - 1)))


def _grams(forms_: DataFrame) -> DataFrame:
    """(form, size, i, g): the q-grams of each form with their places."""
    s = F.col("padded")
    every = F.transform(F.sequence(F.lit(1), F.col("size") + (Q - 1)), lambda i: s.substr(i, F.lit(Q)))
    return forms_.withColumn("padded", _padded(F.col("form"))).select("form", "size", F.posexplode(every).alias("i", "g"))


def candidates(words: DataFrame) -> DataFrame:
    """(word, right, n, n_right, signs): pairs of a word and a more frequent clean
    one with forms at most one character apart, from an inverted join on q-grams.

    One exchanged, lost or added character breaks at most ``Q`` q-grams, so one of
    the ``Q + 1`` rarest of each form is left in both, as far from the start or
    from the end as before: no pair of two or more characters is lost.
    """
    # which letters a form has, as bits: one exchanged character changes two of them at most
    letters = F.aggregate(F.split("form", ""), F.lit(0).cast("bigint"), lambda bits, c: bits.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.ascii(c) % 64)))
    own = written(words.select("word", "n", "signs", F.explode(forms(F.col("word"))).alias("form")).where(F.length("form") > 0).withColumns({"size": F.length("form"), "letters": letters}), "noise-forms")
    grams = _grams(own.select("form", "size").distinct())
    rarity = grams.groupBy("g").agg(F.count("*").alias("df")).orderBy(F.desc("df"), "g").limit(HOT_GRAMS)
    # repeated q-grams of a form are one of its rarest together
    placed = grams.join(F.broadcast(rarity), "g", "left").groupBy("form", "size").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "g", "i"))).alias("all"))
    border = F.element_at(F.array_distinct(F.transform("all", lambda x: F.struct(x["df"], x["g"]))), F.least(F.lit(Q + 1), F.size(F.array_distinct(F.transform("all", lambda x: x["g"])))))
    rarest = placed.withColumn("border", border).select("form", F.explode(F.filter("all", lambda x: F.struct(x["df"], x["g"]) <= F.col("border"))).alias("x"), "size")
    keys = rarest.select("form", "size", F.explode(F.array(F.xxhash64("x.g", "x.i"), F.xxhash64("x.g", F.col("x.i") - F.col("size") - Q))).alias("gram"))
    index = written(own.join(keys, ["form", "size"]), "noise-grams")
    # forms at most one character apart differ by no more in length
    right = index.where((F.col("signs") == 0) & (F.col("n") >= TRUSTED)).select(F.explode(F.array(*[F.xxhash64("gram", F.col("size") + i) for i in (-1, 0, 1)])).alias("key"), F.col("form").alias("form_r"), F.col("letters").alias("letters_r"), F.col("word").alias("right"), F.col("n").alias("n_right"))
    near = index.select("word", "n", "signs", "form", "letters", F.xxhash64("gram", "size").alias("key")).join(right, "key").where((F.col("n_right") >= RATIO * F.col("n")) & (F.bit_count(F.col("letters").bitwiseXOR(F.col("letters_r"))) <= 2) & (F.col("word") != F.col("right")) & (F.levenshtein("form", "form_r", 1) >= 0))
    out = near.select("word", "n", "signs", "right", "n_right").distinct()
    # a sign of misreading is its own evidence: the folded word is a candidate, too
    signed = words.where(F.length(F.translate("word", "".join((*SIGNS, *LIGATURES)), "")) < F.length("word")).select("word", "n", "signs", folded(F.col("word")).alias("right"))
    # unless its sign is a letter of some language: then the word stands more often than without it
    known = words.select(F.col("word").alias("right"), F.col("n").alias("m"))
    own_letter = (F.col("n") >= TRUSTED) & (F.col("n") > F.coalesce("m", F.lit(0))) & (F.length(F.translate("word", LETTERS, "")) < F.length("word"))
    alone = signed.join(known, "right", "left").where(~own_letter).select("word", "n", "signs", "right", F.lit(0).cast("bigint").alias("n_right"))
    return out.unionByName(alone)


#: Of the characters between the nearest forms, an unlisted sign explains one; it stands for a letter, so it makes no word longer.
FEATURES = ("unexplained", "letters apart", "signs", "length", "same start", "same letters", "unlisted", "sign inside", "longer by sign")
UNLISTED = "".join(c for c in ODD if c not in SIGNS and c not in LIGATURES)


INSIDE = re.compile(rf"[a-zà-ɏ][{ODD}]+[a-zà-ɏ]")


def features(word: Column, right: Column, signs: Column) -> list[Column]:
    unlisted = F.length(word) - F.length(F.translate(word, UNLISTED, ""))
    apart = F.array_min(F.flatten(F.transform(forms(word), lambda a: F.transform(forms(right), lambda b: F.levenshtein(a, b)))))
    return [
        F.greatest(apart - unlisted, F.lit(0)), F.levenshtein(folded(word), right), signs, F.length(word), (F.substring(word, 1, 1) == F.substring(right, 1, 1)).cast("int"), (F.array_sort(F.split(word, "")) == F.array_sort(F.split(right, ""))).cast("int"),
        unlisted, word.rlike(INSIDE.pattern).cast("int"), F.when(unlisted > 0, F.length(folded(word)) - F.length(right)).otherwise(0),
    ]


@functools.lru_cache(maxsize=64)
def apart_text(word: str, right: str) -> int:
    return min(_distance(a, b) for a in forms_text(word) for b in forms_text(right))


def features_text(word: str, right: str) -> list[int]:
    """The same of two strings."""
    unlisted = sum(c in UNLISTED for c in word)
    return [
        max(apart_text(word, right) - unlisted, 0), _distance(fold_text(word), right), sum(c in ODD for c in word), len(word), int(word[:1] == right[:1]), int(sorted(word) == sorted(right)),
        unlisted, int(INSIDE.search(word) is not None), len(fold_text(word)) - len(right) if unlisted else 0,
    ]


def _distance(a: str, b: str) -> int:
    """Edit distance; what both start and end with costs nothing."""
    least = min(len(a), len(b))
    start = next((i for i in range(least) if a[i] != b[i]), least)
    a, b = a[start:], b[start:]
    least = min(len(a), len(b))
    end = next((i for i in range(least) if a[-1 - i] != b[-1 - i]), least)
    a, b = a[: len(a) - end], b[: len(b) - end]
    if not a or not b:
        return len(a) + len(b)
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def _misread(word: str, rng: random.Random) -> str:
    back = [(v, k) for k, v in (SIGNS | CONFUSED).items()] + [(b, a) for a, b in GROUPS] + list(GROUPS) + [(v, k) for k, v in LIGATURES.items()]
    rng.shuffle(back)
    for letters, sign in back:
        if letters in word:
            at = rng.choice([m.start() for m in re.finditer(re.escape(letters), word)])
            return word[:at] + sign + word[at + len(letters) :]
    return word


def _unlisted(word: str, rng: random.Random) -> str:
    """One letter read as a sign that no list ties to it."""
    i = rng.randrange(len(word))
    return word[:i] + rng.choice("2346789") + word[i + 1 :]


def _code(word: str, rng: random.Random) -> str:
    """A name with a number, on purpose, or a number that lost its blank."""
    number = "".join(rng.choice("0123456789") for _ in range(rng.randrange(1, 3)))
    return number + word if rng.random() < 0.3 else word[: rng.randrange(1, len(word) + 1)] + number


def _mistyped(word: str, rng: random.Random) -> str:
    i = rng.randrange(len(word) - 1)
    kind = rng.randrange(4)
    if kind == 0:
        return word[:i] + word[i + 1] + word[i] + word[i + 2 :]
    if kind == 1:
        return word[:i] + word[i] + word[i:]
    if kind == 2:
        return word[:i] + word[i + 1 :]
    return word[:i] + rng.choice("abdefghjkmnoprstuvwxyz") + word[i + 1 :]


def _exchanged(word: str, rng: random.Random) -> str:
    """Two neighbours exchanged that are confused in scans, too, so that forms stay equal."""
    at = [i for i in range(len(word) - 1) if word[i] != word[i + 1] and CONFUSED.get(word[i], word[i]) == CONFUSED.get(word[i + 1], word[i + 1])]
    i = rng.choice(at) if at else 0
    return word[:i] + word[i + 1] + word[i] + word[i + 2 :] if at else word


#: Words that a model of replacements needs; fewer are used as often as it takes.
ENOUGH = 500


def _examples(word: str, times: int = 1) -> Iterator[tuple[tuple[float, ...], int]]:
    """What one word would be misread, mistyped and made a code as."""
    rng = random.Random(word)
    for _ in range(times):
        # slips twice: those that look like misreading are few among them
        for label, make in ((1, _misread), (1, _unlisted), (0, _mistyped), (0, _mistyped), (0, _exchanged), (0, _code)):
            wrong, right = make(word, rng), word
            if make is _code and word not in wrong:
                right = word[: len(wrong)]  # the word a number at the end makes it look like
            if wrong != right and apart_text(wrong, right) <= 1:  # what the search can find
                yield (*features_text(wrong, right), label), 1


def ranking(words: DataFrame) -> Boosted:
    """Ranks a replacement: misread words against mistyped ones and codes, made of every
    trusted word of the vocabulary that the lists of confused letters hold for."""
    clean = words.where((F.col("signs") == 0) & (F.col("n") >= TRUSTED) & (F.length("word") >= 5) & F.col("word").rlike("^[a-z]+$"))
    times = math.ceil(ENOUGH / max(clean.count(), 1))
    return Boosted(rounds=80).fit(*tallied(clean.select("word"), functools.partial(_examples, times=times)))


def corrections(words: DataFrame) -> DataFrame:
    """(word, right, n): the misread words and their best replacement."""
    model = words.sparkSession.sparkContext.broadcast(ranking(words))
    pairs = candidates(words)
    inputs = pairs.select("word", "right", "n", "n_right", *[f.cast("double").alias(f"f{i}") for i, f in enumerate(features(F.col("word"), F.col("right"), F.col("signs")))])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[4:]], 1)
            p = model.value.score(x)
            keep = pa.array(np.flatnonzero(p >= 0.5))
            yield pa.RecordBatch.from_arrays([*(c.take(keep) for c in batch.columns[:5]), pa.array(p).take(keep)], names=["word", "right", "n", "n_right", "unexplained", "p"])

    scored = inputs.mapInArrow(score, "word string, right string, n bigint, n_right bigint, unexplained double, p double")
    # probabilities near 1 differ by chance only, so what explains the whole word goes before them
    best = F.struct((F.col("n_right") > 0).alias("known"), (-F.col("unexplained")).alias("explained"), "p", "n_right", "right")
    return scored.groupBy("word").agg(F.max_by("right", best).alias("right"), F.max("n").alias("n"))


# Lines --------------------------------------------------------------------------

_LINES = re.compile(r"[^\n\x0c]+")
_RUNS = re.compile(r"\d+|[^\W\d_](?:[\w'’-]*[^\W\d_])?")


def shape(line: str) -> str:
    """A line's outline: 9 for numbers, A, Aa or a for words by their case, equal
    neighbours once; signs and wide gaps stay."""
    def of(m: re.Match) -> str:
        w = m.group()
        return "9" if w[0].isdigit() else "A" if w.isupper() else "Aa" if w[0].isupper() else "a"

    parts = re.sub(r"\s", " ", _RUNS.sub(of, line.strip())).split(" ")
    return " ".join(p for i, p in enumerate(parts) if not i or p != parts[i - 1] or not p)


def _cut(line: str) -> bool:
    """Whether a line ends within a word."""
    return line[-1:] in HYPHENS and line[-2:-1].isalpha()


def _steps(n: float) -> int:
    """A count on a grid of quarter octaves."""
    return min(int(4 * math.log2(n + 1)), 75)


def _places(before: str, line: str, after: str) -> str:
    """A line's own figures, a character each: shares in sixteenths, lengths in steps."""
    s = line.strip()
    n = max(len(s), 1)
    figures = [
        16 * sum(c.isdigit() for c in s) // n, 16 * sum(c.isupper() for c in s) // n, _steps(len(s)), _steps(len(s.split())),
        before.rstrip()[-1:] in ".!?…", after.lstrip()[:1].islower(), s[:1].islower(), s[-1:] in ".!?…", "  " in s, _cut(s), _cut(before.rstrip()),
    ]
    return "".join(chr(48 + f) for f in figures)


#: Lines that start in lower case or end within a word are parts of a sentence; those that are none may stand inside of one.
OWN, BETWEEN_LINES = r"^.{6}0..0", r"^.{4}010..0"
_OWN, _BETWEEN = re.compile(OWN).match, re.compile(BETWEEN_LINES).match


def lines_of(text: str) -> list[tuple[int, int, str]]:
    """(start, end, item) of each inner line with text on both sides; the item is its
    outline, a tab and its own figures."""
    parts = [(m.start(), m.end(), m.group()) for m in _LINES.finditer(text) if not m.group().isspace()]
    return [(s, e, f"{shape(line)}\t{_places(parts[k - 1][2], line, parts[k + 1][2])}") for k, (s, e, line) in enumerate(parts) if k and k + 1 < len(parts)]


#: An outline's least number of lines, in so many texts with lines, and its least share inside of sentences.
FEW, IN_TEXTS, BETWEEN = 5, 5_000, 0.25


def least_lines(texts: int) -> float:
    return FEW * max(texts / IN_TEXTS, 1.0)


def _line_features(places: str, every: int, inside: int) -> tuple[float, ...]:
    return (_steps(every), int(16 * inside / max(every, 1)), *(ord(c) - 48 for c in places))


def _line_example(least: float, places: str, every: int, inside: int, n: int) -> Iterator[tuple[tuple[float, ...], int]]:
    yield (*_line_features(places, every, inside), int(every >= least and inside >= BETWEEN * every and _OWN(places) is not None)), n


def line_model(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> Boosted:
    return Boosted(rounds=20).fit(x, y, n) if y.any() else Boosted(rounds=0).fit([[0.0]], [0.0])  # no pages among these texts


def furniture_lines(tagged: DataFrame) -> DataFrame:
    """(item, n) of the lines (see ``lines_of``) that are furniture.

    What tells furniture is repetition: its outline stands in many texts, and there
    between a line that has not ended its sentence and one that goes on with it,
    while it is no part of the sentence itself. The outlines of all texts with their
    counts and shares of such places label all lines; the classifier learns these
    labels from the outline's figures and the line's own.
    """
    part, whole = F.split("item", "\t"), Window.partitionBy("outline")
    lines = tagged.where("tag = 'o'").select("item", "n", part[0].alias("outline"), part[1].alias("places"))
    inside = F.when(F.col("places").rlike(BETWEEN_LINES), F.col("n")).otherwise(0)
    figured = written(lines.select("item", "places", F.sum("n").over(whole).alias("every"), F.sum(inside).over(whole).alias("inside"), "n"), "noise-lines")
    texts = tagged.where("tag = 'l'").agg(F.sum("n")).first()[0] or 0
    examples = tallied(figured.select("places", "every", "inside", "n"), functools.partial(_line_example, least_lines(texts)))
    model = tagged.sparkSession.sparkContext.broadcast(line_model(*examples))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [_line_features(*row) for row in zip(*(c.to_pylist() for c in batch.columns[1:4]))]
            keep = pa.array(np.flatnonzero(model.value.score(x) >= 0.5) if x else [], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(keep), batch.column(4).take(keep)], names=["item", "n"])

    return figured.mapInArrow(score, "item string, n bigint")


class Lines:
    """The classifier of ``furniture_lines`` for a few texts in memory."""

    def __init__(self, texts: list[str]):
        items = collections.Counter(item for t in texts for _, _, item in lines_of(t))
        self.outlines: dict[str, list[int]] = {}
        for item, n in items.items():
            outline, places = item.split("\t")
            own = self.outlines.setdefault(outline, [0, 0])
            own[0] += n
            own[1] += n if _BETWEEN(places) else 0
        with_lines = sum("\n" in t or "\x0c" in t for t in texts)
        told: collections.Counter = collections.Counter()
        for item, n in items.items():
            outline, places = item.split("\t")
            told.update(dict(_line_example(least_lines(with_lines), places, *self.outlines[outline], n)))
        self.model = line_model(*arrays(told.items()))

    def furniture(self, text: str) -> list[tuple[int, int]]:
        """Spans of the furniture lines of a text; first and last lines can't be told from text."""
        lines = [(s, e, *item.split("\t")) for s, e, item in lines_of(text)]
        return [(s, e) for s, e, outline, places in lines if self.model.score([_line_features(places, *self.outlines.get(outline, (0, 0)))])[0] >= 0.5]


# Line pairs ---------------------------------------------------------------------


def _lookups(tagged: DataFrame) -> DataFrame:
    """(key, n): counts of words, and of compounds, in lower case."""
    return tagged.where("tag in ('w', 'c')").groupBy(F.lower("item").alias("key")).agg(F.sum("n").alias("n"))


def _pair_counts(parts: DataFrame, lookups: DataFrame) -> DataFrame:
    """(left, sign, rest, own, features) of pairs: counts, in half octaves, of the joined
    word (elsewhere), of the compound (elsewhere, if ``own``), of both parts; whether the
    sign is only ever a line end's, whether the right part goes on as a word does.

    ``parts``: (left, sign, rest, n, own), how often the pair itself was counted, and
    whether as a compound.
    """
    forms = {"joined": F.concat("left", "rest"), "compound": F.concat_ws("-", "left", "rest"), "l": F.col("left"), "r": F.col("rest")}
    keyed = parts.select("left", "sign", "rest", "n", "own", F.explode(F.array(*[F.struct(F.lit(k).alias("form"), F.lower(c).alias("key")) for k, c in forms.items()])).alias("x")).select("left", "sign", "rest", "n", "own", "x.form", "x.key")
    found = keyed.join(lookups.withColumnRenamed("n", "m"), "key", "left")
    wide = found.groupBy("left", "sign", "rest", "own").agg(F.max("n").alias("n"), *[F.coalesce(F.max(F.when(F.col("form") == k, F.col("m"))), F.lit(0)).alias(k) for k in forms])
    steps = lambda c: F.least(F.floor(2 * F.log2(F.greatest(c, F.lit(0)) + 1.0)), F.lit(40)).cast("double")
    goes_on = (F.substring("rest", 1, 1) == F.lower(F.substring("rest", 1, 1))) | ((F.col("left") == F.upper("left")) & (F.col("rest") == F.upper("rest")))
    elsewhere = [F.col("joined") - F.when(F.col("own"), 0).otherwise(F.col("n")), F.col("compound") - F.when(F.col("own"), F.col("n")).otherwise(0), F.col("l"), F.col("r")]
    return wide.select("left", "sign", "rest", "own", *[steps(c).alias(f"f{i}") for i, c in enumerate(elsewhere)], F.col("sign").isin("¬", "\u00ad").cast("double").alias("f4"), goes_on.cast("double").alias("f5"))


def pair_examples(tagged: DataFrame) -> DataFrame:
    """(left, sign, rest, n, own): every word of the corpus cut at some place, with some
    sign of its line ends, and every compound cut at its own hyphen. A place where a
    compound has its own is no place to cut a word at."""
    signs = tagged.where("tag = 'b'").groupBy(F.split("item", "\t")[1].alias("sign")).count().orderBy("sign").collect()
    chance, below, sign = F.pmod(F.xxhash64("item", F.lit("sign")), F.lit(sum(r["count"] for r in signs) or 1)), 0, F.lit("-")
    for r in signs:
        below += r["count"]
        sign = F.when(chance >= below - r["count"], r["sign"]).otherwise(sign)
    at = (F.pmod(F.xxhash64("item"), F.length("item") - 3) + 2).cast("int")
    part = F.split("item", "-")
    compounds = tagged.where("tag = 'c'").select(part[0].alias("left"), F.lit("-").alias("sign"), part[1].alias("rest"), F.lit(1).alias("n"), F.lit(True).alias("own"))
    words = tagged.where((F.col("tag") == "w") & F.col("item").rlike(r"^\p{L}{5,}$"))
    cut = words.select(F.col("item").substr(F.lit(1), at).alias("left"), sign.alias("sign"), F.col("item").substr(at + 1, F.length("item")).alias("rest"), F.lit(1).alias("n"), F.lit(False).alias("own"))
    return cut.join(compounds.select("left", "sign", "rest"), ["left", "sign", "rest"], "left_anti").unionByName(compounds)


def pair_model(tagged: DataFrame, lookups: DataFrame) -> Boosted:
    """Line pairs to join, from all words and compounds of the corpus with their own counts
    elsewhere: words cut at some place are to be joined, compounds cut at their own
    hyphen are not. Both weigh the same, however many there are."""
    features_ = [f"f{i}" for i in range(6)]
    told = _pair_counts(pair_examples(tagged), lookups).groupBy(*features_, (~F.col("own")).cast("int").alias("label")).count().collect()
    x, y, n = arrays((tuple(r)[:-1], r[-1]) for r in told)
    of_class = {label: n[y == label].sum() for label in (0, 1)}
    weight = np.array([k * n.sum() / 2 / of_class[label] for k, label in zip(n, y)]) if all(of_class.values()) else n
    return Boosted(rounds=40).fit(x, y, weight)


def broken_pairs(tagged: DataFrame) -> DataFrame:
    """(left, sign, rest) of the line pairs that are one word."""
    lookups = written(_lookups(tagged), "noise-lookups")
    part = F.split("item", "\t")
    parts = tagged.where("tag = 'b'").select(part[0].alias("left"), part[1].alias("sign"), part[2].alias("rest"), "n", F.lit(False).alias("own"))
    model = tagged.sparkSession.sparkContext.broadcast(pair_model(tagged, lookups))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[4:]], 1)
            keep = pa.array(np.flatnonzero(model.value.score(x) >= 0.5))
            yield pa.RecordBatch.from_arrays([c.take(keep) for c in batch.columns[:3]], names=["left", "sign", "rest"])

    return _pair_counts(parts, lookups).mapInArrow(score, "left string, sign string, rest string")


class Judgement:
    """What the operator finds in ``rows`` (record_kind, record_id, text)."""

    def __init__(self, rows: DataFrame):
        self.rows = rows.where(F.length("text") > 0).select("record_kind", "record_id", "text")
        tagged = written(counted(self.rows), "noise-counts")
        spelled = tagged.where("tag = 'w'").select(F.col("item").alias("word"), "n")
        self.vocabulary = written(of_spellings(spelled), "noise-words")
        told = corrections(self.vocabulary).withColumn("code", F.lit(False)).unionByName(no_codes(spelled, self.vocabulary).withColumn("code", F.lit(True)))
        self.corrections = written(told, "noise-corrections")
        self.broken = written(broken_pairs(tagged), "noise-pairs")
        self.furniture = written(furniture_lines(tagged), "noise-furniture")
        self._seen = None

    def seen(self) -> DataFrame:
        """(record_kind, record_id, tag, item) of what may be noise in each row: ligature
        signs ('f'), inner lines ('o'), words that are not common clean ones ('w'),
        pairs broken at a line end ('b')."""
        if self._seen is not None:
            return self._seen
        clean = self.vocabulary.join(self.corrections.where("not code").select("word"), "word", "left_anti").orderBy(F.desc("n"), "word").limit(COMMON)
        common = clean.select(F.explode(F.array_distinct(F.array("word", F.initcap("word"), F.upper("word")))).alias("as_written"))
        known = self.rows.sparkSession.sparkContext.broadcast(frozenset(r[0] for r in common.collect()))
        ligature = re.compile(f"[{''.join(LIGATURES)}]")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at, tags, items = [], [], []
                texts = batch.column(2).to_pylist()
                for i, text in enumerate(texts):
                    own = set()
                    if ligature.search(text):
                        own.add(("f", ""))
                    if "\n" in text or "\x0c" in text:
                        own.update(("o", item) for _, _, item in lines_of(text))
                        if _WRAP.search(text):
                            own.update(("b", "\t".join(m)) for m in _PAIR.findall(text))
                            text = _JOIN.sub("", text)
                    own.update(("w", w) for w in set(_WORD.findall(text)) - known.value if not _no_word(w))
                    for tag, item in own:
                        at.append(i)
                        tags.append(tag)
                        items.append(item)
                place = pa.array(at, pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(place), batch.column(1).take(place), pa.array(tags, pa.string()), pa.array(items, pa.string())], names=["record_kind", "record_id", "tag", "item"])

        self._seen = written(self.rows.mapInArrow(run, "record_kind string, record_id bigint, tag string, item string"), "noise-seen")
        return self._seen

    def misread(self) -> DataFrame:
        """(record_kind, record_id, word, right) of every misread word in a row."""
        words = self.seen().where("tag = 'w'").withColumn("code", F.col("item").rlike(CODE)).where(~F.col("code") | maybe_misread(F.col("item")))
        rare = words.select("record_kind", "record_id", F.lower("item").alias("word"), "code")
        return join_hot(rare, self.corrections, ["word", "code"], "n").select("record_kind", "record_id", "word", "right")

    def broken_words(self) -> DataFrame:
        """(record_kind, record_id, item) of the pairs in a row that are one word."""
        told = self.broken.select(F.concat_ws("\t", "left", "sign", "rest").alias("item"))
        return self.seen().where("tag = 'b'").join(told, "item").select("record_kind", "record_id", "item")

    def furniture_in(self) -> DataFrame:
        """(record_kind, record_id, item) of the lines of furniture in a row."""
        return join_hot(self.seen().where("tag = 'o'"), self.furniture, ["item"], "n").select("record_kind", "record_id", "item")

    def found(self) -> DataFrame:
        """(record_kind, record_id) of the noisy rows, distinct."""
        own = ["record_kind", "record_id"]
        return self.misread().select(*own).unionByName(self.broken_words().select(*own)).unionByName(self.furniture_in().select(*own)).unionByName(self.seen().where("tag = 'f'").select(*own)).distinct()

    def repaired(self) -> DataFrame:
        """(record_kind, record_id, repaired_text): readable paragraphs of every row."""
        own, none = ["record_kind", "record_id"], F.lit(None).cast("string")
        told = self.misread().select(*own, "word", "right", none.alias("item"), none.alias("line"))
        told = told.unionByName(self.broken_words().select(*own, none.alias("word"), none.alias("right"), "item", none.alias("line")))
        told = told.unionByName(self.furniture_in().select(*own, none.alias("word"), none.alias("right"), none.alias("item"), F.col("item").alias("line")))
        fixes = told.groupBy(*own).agg(F.map_from_entries(F.collect_set(F.when(F.col("word").isNotNull(), F.struct("word", "right")))).alias("fixes"), F.collect_set("item").alias("joins"), F.collect_set("line").alias("lines"))
        rows = self.rows.join(fixes, own, "left").select(*own, "text", "fixes", "joins", "lines")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = [repair(t, dict(f or ()), set(j or ()), set(o or ())) for t, f, j, o in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4, 5)))]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string())], names=[*own, "repaired_text"])

        return rows.mapInArrow(run, "record_kind string, record_id bigint, repaired_text string")


_TOKEN = re.compile(r"[^\W_†]*†?[^\W_]+(?:†[^\W_]*)*†?|[^\W_]+")


def repair(text: str, fixes: dict[str, str], joins: set[str], furniture: set[str]) -> str:
    """One text: furniture out, broken words joined, misread words replaced, lines
    reflowed. Blank lines end a paragraph; a hyphen that is a compound's own stays."""
    for s, e, item in reversed(lines_of(text)):
        if item in furniture:
            text = text[:s].rstrip() + "\n" + text[e:].lstrip()
    # a pair may share its right part with the next one's left
    text = re.sub(rf"([^\W\d_]+)([{HYPHENS}])[ \t]*\r?\n[ \t]*(?=([^\W\d_]+))", lambda m: m[1] + ("" if "\t".join(m.groups()) in joins else "-"), text)
    for sign, letters in LIGATURES.items():
        text = text.replace(sign, letters)

    def fix(m: re.Match) -> str:
        own = m.group()
        right = fixes.get(own.lower())
        if right is None:
            return own
        return right.upper() if own.isupper() and len(own) > 1 else right[:1].upper() + right[1:] if own[:1].isupper() else right

    paragraphs = re.split(r"\n[ \t]*\r?\n\s*", _TOKEN.sub(fix, text).strip())
    return "\n\n".join(" ".join(p.split()) for p in paragraphs if not p.isspace())


def records(sentences: DataFrame, citations: DataFrame) -> DataFrame:
    """(record_kind, record_id, text) of both tables; equal rows count once.

    Null and empty texts never hold noise.
    """
    a = sentences.select(F.lit("sentence").alias("record_kind"), F.col("sentence_id").alias("record_id"), "text")
    b = citations.select(F.lit("citation").alias("record_kind"), F.col("mapping_id").alias("record_id"), F.col("ref_full_text").alias("text"))
    return a.unionByName(b)
