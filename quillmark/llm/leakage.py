"""Finding evaluation passages inside a corpus.

The n-grams of all (normalised) passages form a broadcast hash set; every window
of the corpus is looked up in it, hits are compared word by word and chained along
the passage, and of each chain the words that agree are counted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.llm.bpe import flat_words

#: Words in a window; at most so many passage words between two windows of one
#: stretch, and so many more on the corpus side (markup put between).
WINDOW, GAP, INSERTED = 4, 10, 24
#: The passages' words that are broadcast at once; more are scanned for in several blocks of items.
BLOCK_WORDS = 5_000_000
WORD = r"[\p{L}\p{M}\p{N}]+"


def words(text: Column) -> Column:
    """Lower-cased runs of letters, marks and digits; case, punctuation, line
    breaks and markup signs do not count. Null gives null."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


class Passages:
    """Hash set of the passages' windows, with their items and places."""

    def __init__(self, items: list[tuple[int, list[str]]], window: int = WINDOW):
        self.window = window
        self.words: dict[str, int] = {}
        self.ids = [(k, [self.words.setdefault(w, len(self.words) + 1) for w in ws]) for k, ws in items]
        self.base = len(self.words) + 1
        self.at: dict[int, list[tuple[int, int]]] = {}
        for n, (_, ws) in enumerate(self.ids):
            row = np.array(ws, np.int64)
            for p, key in enumerate(self.keys(row)[0].tolist()):
                self.at.setdefault(key, []).append((n, p))
        self.sorted = np.sort(np.fromiter(self.at, np.int64, len(self.at)))

    def keys(self, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hash of each window, and whether it holds only passage words."""
        n = max(len(row) - self.window + 1, 0)
        key, good = np.zeros(n, np.int64), np.ones(n, bool)
        with np.errstate(over="ignore"):
            for i in range(self.window):
                key = key * np.int64(self.base) + row[i : i + n]
                good &= row[i : i + n] > 0
        return key, good

    def hits(self, row: np.ndarray) -> np.ndarray:
        """Places in ``row`` whose window is one of the passages'."""
        key, good = self.keys(row)
        at = np.flatnonzero(good)
        if not len(at) or not len(self.sorted):
            return at[:0]
        k = np.minimum(np.searchsorted(self.sorted, key[at]), len(self.sorted) - 1)
        return at[self.sorted[k] == key[at]]

    def verify(self, row: np.ndarray, places: np.ndarray, share: float) -> list[tuple[int, int, int, float]]:
        """(item id, first word, last word, share) of each stretch in the text ``row``
        that holds at least ``share`` of a passage's words in their order.

        Words count that agree, and single ones exchanged between two that agree.
        """
        key, _ = self.keys(row)
        seeds: dict[int, list[tuple[int, int]]] = {}
        for d in places.tolist():
            for n, p in self.at[int(key[d])]:
                if row[d : d + self.window].tolist() == self.ids[n][1][p : p + self.window]:  # keys may collide
                    seeds.setdefault(n, []).append((d, p))
        found = []
        for n, own in seeds.items():
            item, passage = self.ids[n]
            chains: list[tuple[int, int, int]] = []  # per seed: words that agree up to its end, first d, first p
            for k, (d, p) in enumerate(own):
                best = (self.window, d, p)
                for j in range(k - 1, -1, -1):
                    d0, p0 = own[j]
                    if d - d0 > GAP + INSERTED:
                        break
                    if 0 < p - p0 <= GAP and d > d0:
                        agreed = chains[j][0] + self._between(row, passage, d0 + self.window, p0 + self.window, d, p)
                        if agreed > best[0]:
                            best = (agreed, *chains[j][1:])
                chains.append(best)
            top = (0.0, 0, 0)
            for (d1, p1), (agreed, d0, p0) in zip(own, chains):
                a, b = self._left(row, passage, d0, p0), self._right(row, passage, d1 + self.window - 1, p1 + self.window - 1)
                top = max(top, ((agreed + a + b) / len(passage), d0 - a, d1 + self.window - 1 + b))
            if top[0] >= share:
                found.append((item, top[1], top[2], top[0]))
        return found

    def _between(self, row, passage, d0: int, p0: int, d: int, p: int) -> int:
        """Words gained by the window at (``d``, ``p``) after what ends before (``d0``,
        ``p0``): its own new ones and those between that agree."""
        if p <= p0 or d <= d0:
            return min(p - p0, d - d0) + self.window if p - p0 == d - d0 else 0
        a, b = row[d0:d].tolist(), passage[p0:p]
        if len(a) == len(b):  # words exchanged in their places; the ends agree
            same = [True, *(x == y for x, y in zip(a, b)), True]
            return self.window + sum(same[i] or (same[i - 1] and same[i + 1]) for i in range(1, len(same) - 1))
        best = [0] * (len(a) + 1)  # something was put between: the longest common sequence
        for y in b:
            diagonal = 0
            for i, x in enumerate(a, 1):
                diagonal, best[i] = best[i], diagonal + 1 if x == y else max(best[i], best[i - 1])
        return self.window + best[-1]

    @staticmethod
    def _left(row, passage, d, p) -> int:
        n = 0
        while d - n > 0 and p - n > 0:
            if row[d - n - 1] == passage[p - n - 1]:
                n += 1
            elif d - n > 1 and p - n > 1 and row[d - n - 2] == passage[p - n - 2]:
                n += 2
            else:
                break
        return n

    @staticmethod
    def _right(row, passage, d, p) -> int:
        n = 0
        while d + n + 1 < len(row) and p + n + 1 < len(passage):
            if row[d + n + 1] == passage[p + n + 1]:
                n += 1
            elif d + n + 2 < len(row) and p + n + 2 < len(passage) and row[d + n + 2] == passage[p + n + 2]:
                n += 2
            else:
                break
        return n


def _scan(docs: DataFrame, held: list[tuple[int, list[str]]], key: str, text: str, item_key: str, share: float, window: int) -> DataFrame:
    """:func:`leaks` of one block of passages, all of at least ``window`` words."""
    shipped = docs.sparkSession.sparkContext.broadcast(held)
    names = [key, item_key, "first_word", "last_word", "share"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passages = Passages([(k, list(w)) for k, w in shipped.value], window)
        for batch in batches:
            flat, offsets = flat_words(batch.column(1))
            coded = flat.dictionary_encode()
            own = np.fromiter((passages.words.get(w, 0) for w in coded.dictionary.to_pylist()), np.int64, len(coded.dictionary))
            row = own[coded.indices.to_numpy()] if len(own) else np.zeros(0, np.int64)
            at = passages.hits(row)
            doc = np.searchsorted(offsets, at, side="right") - 1
            inside = at + window <= offsets[doc + 1]
            at, doc = at[inside], doc[inside]
            out: list[tuple] = []
            for i, first in zip(*np.unique(doc, return_index=True)):
                places = at[first : np.searchsorted(doc, i, side="right")] - offsets[i]
                out += [(i, *x) for x in passages.verify(row[offsets[i] : offsets[i + 1]], places, share)]
            if out:
                i, item, a, b, s = zip(*out)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(i)), pa.array(item, pa.int64()), pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(s, pa.float64())], names=names)

    kind = docs.schema[key].dataType.simpleString()
    texts = docs.where(F.length(text) > 0).select(F.col(key), words(F.col(text)).alias("w"))
    return texts.mapInArrow(scan, f"{key} {kind}, {item_key} bigint, first_word int, last_word int, share double")


def leaks(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", passage: str = "passage", share: float = 0.5, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(key, item key, first_word, last_word, share): each stretch of at least
    ``share`` of an item's passage in a text, one (the longest) per pair.

    Words are numbered from 0 in :func:`words`. Single exchanged words and
    markup within a stretch are allowed. A passage of fewer words than the window
    must stand whole. Null and empty texts and passages give none; repeated rows
    repeat their results; other columns are ignored. The items are held-out tests of
    a fixed number; beyond ``block_words`` words they are broadcast in several
    blocks, each with a scan of its own, so none is left out.
    """
    rows = items.select(F.col(item_key), words(F.col(passage)).alias("w")).where(F.size("w") > 0)
    size, shortest = rows.agg(F.coalesce(F.sum(F.size("w")), F.lit(0)), F.coalesce(F.min(F.size("w")), F.lit(window))).first()
    blocks = max(-(-size // block_words), 1)
    found = None
    for n in range(min(shortest, window), window + 1):
        fits = F.size("w") >= window if n == window else F.size("w") == n
        for k in range(blocks):
            held = sorted({(r[0], tuple(r[1])) for r in rows.where(fits & (F.pmod(F.xxhash64(item_key), F.lit(blocks)) == k)).collect()})
            if held or n == window and k == 0:
                part = _scan(docs, held, key, text, item_key, share if n == window else 1.0, n)
                found = part if found is None else found.unionByName(part)
    return found


def without_leaks(docs: DataFrame, found: DataFrame, key: str = "doc_id") -> DataFrame:
    """The documents that hold no passage (all columns, repeated rows kept)."""
    return docs.join(found.select(key).distinct(), key, "left_anti")


def without_spans(docs: DataFrame, found: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text, n_spans) of every document, the stretches that :func:`leaks` found cut out.

    What stands between a stretch's first and last word goes with it; overlapping
    stretches go together; all else stays as it is. Null texts stay null.
    """
    spans = found.groupBy(key).agg(F.sort_array(F.collect_set(F.struct("first_word", "last_word"))).alias("spans"))
    told = docs.select(key, text).join(spans, key, "left")
    between, own = F.split(F.col(text), WORD, -1), F.regexp_extract_all(F.col(text), F.lit(WORD), F.lit(0))
    gone = lambda i: F.exists("spans", lambda s: i.between(s["first_word"], s["last_word"]))
    kept = F.transform(own, lambda w, i: F.when(gone(i), "").otherwise(w))
    # the sign before a word goes where the words on both of its sides do in one stretch
    inner = lambda i: F.exists("spans", lambda s: (i > s["first_word"]) & (i <= s["last_word"]))
    signs = F.transform(between, lambda b, i: F.when(inner(i), "").otherwise(b))
    whole = F.array_join(F.transform(F.arrays_zip(signs.alias("s"), kept.alias("w")), lambda x: F.concat(x["s"], F.coalesce(x["w"], F.lit("")))), "")
    return told.select(key, F.when(F.size("spans") > 0, whole).otherwise(F.col(text)).alias(text), F.coalesce(F.size("spans"), F.lit(0)).alias("n_spans"))
