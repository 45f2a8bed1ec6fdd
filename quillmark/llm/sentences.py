"""Sentence units of texts in many scripts, with their places.

Spaced scripts: every run of terminators is a node; abbreviations, numbers,
quotations, brackets and page furniture decide which nodes end a unit. Scripts
without spaces between words (Thai, Lao, Tibetan, Burmese, Khmer, Chinese, Japanese):
their terminators, and each gap is classified through the final words before it and
the opening words after it, found on the best path of a dictionary word lattice
through the whole runs on both sides. The opening and final words are learned from
the starts and ends of the corpus's own rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values -----------------------------------------------------------------
STRONG = "。！？｡؟۔።፧।॥"
TERMINATOR = re.compile(rf"[.!?…{STRONG}]+")
CLOSERS = re.compile(r"(?:[\s  ]?»|[\"'”’“)\]」』）】》])*")
OPENERS = "\"'“‘«„([「『（【《¿¡"
PAIRS = {"(": ")", "[": "]", "（": "）", "「": "」", "『": "』", "«": "»", "„": "“", "“": "”", "【": "】", "《": "》"}
# Abbreviations that never end a sentence, and those that may.
NEVER = frozenset("dr st mr mrs ms prof mme mlle mm sr sra srta hr fr nr fig figs tab sect sec no nos vol vols pp ca cf esp incl ex ej eq eqs ref refs vgl bzw approx e.g i.e z.b d.h p.ex p.ej т.е т.д rev gen".split())
MAY = frozenset("al jr co ltd inc corp a.m p.m etc usw bros".split())
MONTHS = "Januar|Februar|März|April|Mai|Juni|Juli|August|September|Oktober|November|Dezember"
# Signs that scanning puts in place of letters.
SLIPS = str.maketrans("0159†âôîûê", "olsgtaoiue")
# Scripts without spaces: those without terminators (Thai, Lao), and all of them.
UNMARKED = re.compile(r"[\u0e00-\u0eff]")
SPACELESS = {"thai": "\u0e00-\u0e7f", "lao": "\u0e80-\u0eff", "tibetan": "\u0f00-\u0f0c\u0f13-\u0fff", "burmese": "\u1000-\u1049\u104c-\u109f", "khmer": "\u1780-\u17d3\u17d6-\u17ff", "han": "\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff"}
_CLASS = "[" + "".join(SPACELESS.values()) + "]"
RUN = re.compile(_CLASS + "+")
HAN_FINALS = ("だ", "です", "ます", "でした", "ました", "た", "か", "よ", "ね", "了", "吗", "呢", "吧", "啊")
THAI_CONNECTORS = ("และ", "หรือ", "แต่", "ที่", "ซึ่ง", "ของ", "ใน", "จาก", "โดย", "กับ", "เพื่อ", "เพราะ", "ว่า", "ให้", "แล้ว", "ก็", "จึง", "ถึง", "ด้วย", "เป็น")
THAI_FINALS = ("ฯ", "ครับ", "ค่ะ", "คะ", "นะ", "จ้ะ", "แล้ว", "เลย")
# Lines of page furniture: numbers, running heads.
FURNITURE = re.compile(
    r"(?:(?<=\n)|(?<=\x0c)|(?<=\A))[ \t]*(?:"
    r"\d{1,4}|[-–—]\s?\d{1,4}\s?[-–—]|\[[ivxlcdm]{1,7}\]|\d{1,4}\s{2,}[^\W\d_][^\n\x0c]{3,60}|[^\W\d_][^\n\x0c|]{2,60}\s\|\s[^\n\x0c|]{2,60}\s{2,}\d{1,4}"
    r"|(?:Page|Seite|Página)\s\d{1,4}(?:\s(?:of|von|de)\s\d{1,4})?|[A-ZÀ-ÞŠŽ][A-ZÀ-ÞŠŽ'’ -]{2,40}\sET\sAL\.?|(?:[A-Z][\w&]*\.?\s){1,7}\d{1,4}\s\(\d{4}\)"
    r")[ \t]*(?=[\n\x0c]|\Z)"
)
MARK = "\ue000"
# ------------------------------------------------------------------------------


class Lattice:
    """Best path of dictionary words through a text without spaces."""

    def __init__(self, words: dict[str, float]):
        total = sum(words.values()) or 1.0
        self.cost = {w: -math.log(n / total) for w, n in words.items()}
        self.longest = max(map(len, words), default=1)
        self.unknown = max(self.cost.values(), default=1.0) + 5.0

    def path(self, text: str) -> list[str]:
        best: list[tuple[float, int]] = [(0.0, 0)]
        for end in range(1, len(text) + 1):
            top = (best[end - 1][0] + self.unknown, end - 1)
            for start in range(max(0, end - self.longest), end - 1):
                cost = self.cost.get(text[start:end])
                if cost is not None and best[start][0] + cost < top[0]:
                    top = (best[start][0] + cost, start)
            best.append(top)
        out, end = [], len(text)
        while end:
            start = best[end][1]
            out.append(text[start:end])
            end = start
        return out[::-1]


class Gaps:
    """Classifier of gaps between runs of a script without spaces."""

    def __init__(self, opening: dict[str, int], final: dict[str, int]):
        self.opening, self.final = set(opening), set(final) | set(THAI_FINALS) | set(HAN_FINALS)
        self.learned = bool(opening and final)
        words = {w: 1.0 for w in (*THAI_CONNECTORS, *THAI_FINALS, *HAN_FINALS)}
        for own in (opening, final):
            for w, n in own.items():
                words[w] = words.get(w, 0.0) + n
        self.lattice = Lattice(words)

    def ends(self, before: str, after: str) -> bool:
        """Whether a unit ends between these two runs: in scripts without terminators at
        a final or an opening word, in the others, where a gap without one is rare, at both."""
        first = self.lattice.path(after)[0]
        last = self.lattice.path(before)[-1]
        if first in THAI_CONNECTORS and first not in self.opening:
            return False
        if not UNMARKED.match(after):
            return last in self.final and first in self.opening
        return not self.learned or last in self.final or first in self.opening


def _pairs(text: str) -> list[tuple[int, int]]:
    """Matched quotations and brackets, outermost first by start; unmatched signs are ignored."""
    stack: list[tuple[str, int]] = []
    found = []
    for m in _SIGNS.finditer(text):
        c, i = m.group(), m.start()
        close = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == c), None)
        if close is not None:
            found.append((stack[close][1], i))
            del stack[close:]
        elif c == '"':
            stack.append(('"', i))
        elif c in PAIRS:
            stack.append((PAIRS[c], i))
    return sorted(found)


_SIGNS = re.compile(r'["()\[\]（）「」『』«»„“”【】《》]')


def units(text: str, gaps: Gaps) -> list[tuple[int, int]]:
    """(start, end) of each unit: characters from 1, inclusive."""
    if not text or text.isspace():
        return []
    masked = FURNITURE.sub(lambda m: MARK * len(m.group()), text) if "\n" in text or "\x0c" in text else text
    pairs = _pairs(masked)
    size = len(masked)
    cuts: list[int] = []
    start = _skip(masked, 0)
    for m in TERMINATOR.finditer(masked):
        a, b = m.span()
        if a < start:
            continue
        inside = [p for p in pairs if p[0] < a < p[1]]
        e = CLOSERS.match(masked, b).end() if b < size else b
        if inside and max(p[1] for p in inside) >= e:
            continue
        if not inside:
            opened = [p[0] for p in pairs if b <= p[0] < e]
            if opened:  # a sign right after the run opens the next quotation
                e = min(opened)
        n = e
        while n < size and (masked[n].isspace() or masked[n] == MARK):
            n += 1
        if n >= size:
            break
        if MARK in masked[e:n]:
            continue
        if _ends(masked, a, b, e, n, start, inside):
            cuts.append(e)
            start = n
    if RUN.search(masked):
        cuts = _with_gaps(masked, cuts, pairs, gaps)
    out, begin = [], 0
    for cut in [*cuts, size]:
        s, e = _skip(masked, begin), cut
        while e > s and (masked[e - 1].isspace()):
            e -= 1
        if e > s:
            out.append((s + 1, e))
        begin = cut
    return out


def _skip(text: str, i: int) -> int:
    while i < len(text) and text[i].isspace():
        i += 1
    return i


def _ends(text: str, a: int, b: int, e: int, n: int, start: int, inside: list[tuple[int, int]]) -> bool:
    lead = n
    while lead < len(text) - 1 and (text[lead] in OPENERS or text[lead].isspace()):
        lead += 1
    c = text[lead]
    cased = c.lower() != c.upper()
    lower = cased and c.islower() and not re.match(r"[a-z]{1,2}[A-Z]", text[lead : lead + 3])
    quoted = bool(inside) and min(p[0] for p in inside) > start
    if any(x in STRONG for x in text[a:b]):
        return not quoted or (cased and not lower)
    if quoted and not (cased and not lower):
        return False
    if lower:
        return False
    before = text[a - 1] if a > start else " "
    if e == n:  # nothing between the run and what follows
        if e == b and text[a:b] == "…":
            return True
        if c.isalpha() and n == lead or text[n] in OPENERS:
            word = _token(text, a, start)
            ok = before.isalpha() or before in "\"”’»)%" or before.isdigit() and b - a == 1
            if c.isdigit() or "www" in word or len(word) == 1:
                return False
            return ok and not (b - a == 1 and text[a] == "." and _short(word, text, lead))
        return False
    if text[a:b] == ".":
        return not _short(_token(text, a, start), text, lead)
    return True


def _token(text: str, a: int, start: int) -> str:
    i = a
    while i > start and not text[i - 1].isspace() and text[i - 1] not in OPENERS:
        i -= 1
    return text[i:a]


def _short(token: str, text: str, lead: int) -> bool:
    """Whether the full stop after ``token`` belongs to it."""
    if token.isdigit():
        return len(token) <= 2 and re.match(MONTHS, text[lead : lead + 9]) is not None
    word = token if token.isascii() and token.isalpha() else token.translate(SLIPS)
    word = word.lower()
    if word in MAY:
        return not (text[lead].isupper() or text[lead].isalpha() and text[lead].lower() == text[lead].upper())
    return word in NEVER or word.rpartition(".")[2] in NEVER and "." in word or len(word) == 1 and word.isalpha() and word.lower() != word.upper()


def _with_gaps(text: str, cuts: list[int], pairs: list[tuple[int, int]], gaps: Gaps) -> list[int]:
    known = set(cuts)
    runs = {m.start(): m.group() for m in RUN.finditer(text)}
    ends = {start + len(run): run for start, run in runs.items()}
    for m in re.finditer(r"\s+", text):
        a, b = m.span()
        if a == 0 or a in known or b not in runs or MARK in text[a - 1 : b + 1]:
            continue
        digits = re.search(r"[\d.,%]*\Z", text[max(0, a - 40) : a]).group()
        left = ends.get(a - len(digits), "")
        if not left and not digits[-1:].isdigit() or any(p[0] < a < p[1] for p in pairs):
            continue
        if digits and not UNMARKED.match(text[b]):
            continue
        if digits[-1:].isdigit() or not digits and gaps.ends(left, runs[b]):
            known.add(a)
    return sorted(known)


#: Least rows that begin (end) with an opening (final) word, least share of their script's
#: rows, and the words' letters. A row has one word of each length at either end, so no
#: script has more than 18 / LEAST_SHARE = 9,000 words of a kind, however many rows there are.
LEAST_ROWS, LEAST_SHARE, LETTERS = 5, 0.002, (3, 20)


def learned_words(rows: DataFrame, text: str) -> tuple[dict[str, int], dict[str, int]]:
    """Opening and final words: strings with which many distinct rows of a script
    without spaces begin and end."""
    found: dict[str, dict[str, int]] = {"a": {}, "b": {}}
    written_so = rows.where(F.col(text).rlike(_CLASS))
    script = F.coalesce(*[F.when(F.col(text).rlike(f"[{c}]"), name) for name, c in SPACELESS.items()])
    own = written_so.select(script.alias("script"), F.regexp_extract(text, rf"^\s*({_CLASS}+)", 1).alias("a"), F.regexp_extract(text, rf"({_CLASS}+)[\d.,%\s?!{STRONG}]*$", 1).alias("b")).distinct()
    sizes = F.sequence(F.lit(LETTERS[0]), F.lit(LETTERS[1]))
    words = lambda c, start: F.transform(F.filter(sizes, lambda n: n <= F.length(c)), lambda n: F.struct(F.lit(c).alias("end"), F.col(c).substr(start(n), n).alias("w")))
    parts = own.select("script", F.explode(F.concat(words("a", lambda n: F.lit(1)), words("b", lambda n: F.length("b") - n + 1))).alias("x"))
    total = own.groupBy("script").agg(F.count("*").alias("total"))
    many = parts.groupBy("script", "x.end", "x.w").count().join(F.broadcast(total), "script").where((F.col("count") >= LEAST_ROWS) & (F.col("count") >= LEAST_SHARE * F.col("total")))
    for r in many.collect():
        found[r["end"]][r["w"]] = r["count"]
    return found["a"], found["b"]


def sentence_units(rows: DataFrame, key: str = "sentence_id", text: str = "text") -> DataFrame:
    """(key, start_pos, end_pos) of every sentence unit of every row.

    Positions are characters of the stored text, 1-based and inclusive, closing
    marks included, white space around not. Null, empty and blank texts have
    none; repeated rows repeat their units; other columns are ignored.
    """
    gaps = Gaps(*learned_words(rows, text))
    shipped = rows.sparkSession.sparkContext.broadcast((gaps,))
    names = [key, "start_pos", "end_pos"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (own,) = shipped.value
        for batch in batches:
            found = [(i, s, e) for i, t in enumerate(batch.column(1).to_pylist()) for s, e in units(t, own)]
            i, s, e = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(i, pa.int32())), pa.array(s, pa.int32()), pa.array(e, pa.int32())], names=names)

    kind = rows.schema[key].dataType.simpleString()
    return rows.where(F.length(text) > 0).select(key, text).mapInArrow(run, f"{key} {kind}, start_pos int, end_pos int")
