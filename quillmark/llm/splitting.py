"""Cutting long texts into overlapping pieces by pointer doubling.

Every boundary of a text points to its farthest legal successor (the start of
the next piece, overlap included). Squaring that successor table log2 n times
marks all greedy cuts at once instead of walking them one after another. A text
is one row, so its table is squared where the row is: no shuffle is needed, and
a batch of texts is squared together as flat arrays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.llm import bpe

WORD, SENTENCE, LINE, PARAGRAPH = 0, 1, 2, 3

_classes: dict[str, int] = {}


def _word_class(word: str) -> int:
    """What a cut before this pre-token would be, or -1 within a line's text.

    Encoded as: bits of what ends *with* the pre-token."""
    known = _classes.get(word)
    if known is None:
        if word.isspace():
            known = PARAGRAPH if word.count("\n") > 1 else LINE if "\n" in word else WORD
        else:
            known = SENTENCE if word.rstrip("\"'”’»)]")[-1:] in tuple(".!?。！？።।؟…") and word[-1:] else WORD
        if len(_classes) < 500_000:
            _classes[word] = known
    return known


def doubling(successor: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Nodes reachable from ``first`` along ``successor`` (ends point to themselves).

    Round k holds the successor table of 2**k steps: the reached set grows by
    its image under that table, then the table is squared.
    """
    reached = np.zeros(len(successor), bool)
    reached[first] = True
    table = successor
    while True:
        nodes = np.flatnonzero(reached)
        reached[table[nodes]] = True
        squared = table[table]
        if np.array_equal(squared, table):
            return reached
        table = squared


def greedy_ends(at: np.ndarray, cls: np.ndarray, start: np.ndarray, limit: int, least: int) -> np.ndarray:
    """For each start (a row of ``at``), the farthest row whose place is within
    ``limit``; of natural rows (paragraph, line, sentence, in this order) one is
    preferred when it leaves a piece of at least ``least``."""
    far = np.searchsorted(at, at[start] + limit, side="right") - 1
    end = far.copy()
    open_ = np.ones(len(start), bool)
    for kind in (PARAGRAPH, LINE, SENTENCE):
        rows = np.flatnonzero(cls >= kind)
        if not len(rows):
            continue
        k = np.searchsorted(rows, far, side="right") - 1
        near = np.where(k >= 0, rows[np.maximum(k, 0)], 0)
        good = open_ & (k >= 0) & (near > start) & (at[near] - at[start] >= least)
        end[good] = near[good]
        open_ &= ~good
    return end


def cut(at: np.ndarray, cls: np.ndarray, limit: int, overlap: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of starts and ends of the pieces of one text.

    ``at``: token places of its boundaries, ascending, from 0 to the total; no
    two neighbours are more than ``limit`` apart.
    """
    last = len(at) - 1
    rows = np.arange(len(at))
    end = greedy_ends(at, cls, rows, limit, limit // 2)
    end = np.where(at[rows] + limit >= at[last], last, end)
    # The next piece starts at the last word boundary that shares the overlap, or at a
    # natural one that shares up to twice as much; it must reach beyond this one.
    nxt = np.searchsorted(at, at[end] - overlap, side="right") - 1
    natural = np.flatnonzero(cls >= SENTENCE)
    if len(natural):
        found = natural[np.maximum(np.searchsorted(natural, nxt, side="right") - 1, 0)]
        nxt = np.where((found <= nxt) & (at[found] >= at[end] - min(2 * overlap, limit // 2 - 1)), found, nxt)
    beyond = np.searchsorted(at, at[np.minimum(end + 1, last)] - limit, side="left")
    nxt = np.minimum(np.maximum(np.maximum(nxt, beyond), rows + 1), np.minimum(end, last))
    nxt = np.where(end == last, rows, nxt)  # the piece that reaches the end has no successor
    starts = np.flatnonzero(doubling(nxt, np.array([0])))
    return starts, end[starts]


def boundaries(size: np.ndarray, chars: np.ndarray, cls: np.ndarray, limit: int, inside) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(token place, class, character place) of every boundary of one text.

    A pre-token longer than ``limit`` also has a boundary at each of its tokens
    that ends with a whole character; ``inside(i)`` gives those of pre-token i.
    """
    at = np.concatenate([[0], np.cumsum(size)])
    char = np.concatenate([[0], np.cumsum(chars)])
    kind = np.concatenate([[PARAGRAPH], cls])
    long = np.flatnonzero(size > limit)
    if len(long):
        more = [inside(i) for i in long]
        kind = np.concatenate([kind, np.full(sum(len(x) for x, _ in more), WORD)])
        place = np.concatenate([at, *[at[i] + x for i, (x, _) in zip(long, more)]])
        char = np.concatenate([char, *[char[i] + y for i, (_, y) in zip(long, more)]])
        order = np.argsort(place, kind="stable")
        at, kind, char = place[order], kind[order], char[order]
    return at, kind, char


def _whole_characters(ids: list[int], one) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, characters) before each inner token border that is a character border."""
    whole = [one(i) for i in ids]
    starts = [sum((c & 0xC0) != 0x80 for c in w) for w in whole]
    border = np.array([(w[0] & 0xC0) != 0x80 for w in whole[1:]], bool)
    return np.arange(1, len(ids))[border], np.cumsum(starts)[:-1][border]


def split_corpus(docs: DataFrame, key: str = "doc_id", text: str = "text", limit: int = 1024, overlap: int = 64, ranks_path: str = bpe.RANKS, with_text: bool = True) -> DataFrame:
    """(key, piece, n_pieces, start_token, end_token, n_tokens, start_pos, end_pos
    and, if asked, piece_text) of every text.

    Sizes are counted in the text's own encoding; tokens are numbered from 0,
    ends exclusive. Each piece has at most ``limit`` tokens; consecutive pieces
    share ``overlap`` tokens, rounded up to a word's start, or up to twice as many
    from a natural boundary that lies there; less only where the next piece would
    else not reach beyond this one (before a pre-token nearly as long as the limit). Cuts fall at paragraphs, else lines, else sentences, else words;
    only a pre-token longer than ``limit`` is cut inside. Texts within the limit
    are one piece; null and empty texts give none. Repeated keys are cut row by
    row. Other columns are ignored.
    """
    if not 0 <= overlap < limit // 2:
        raise ValueError("the overlap must be less than half of the limit")
    words = bpe.split_words(docs.where(F.length(text) > 0), key, text)
    ints = ["piece", "n_pieces", "start_token", "end_token", "n_tokens", "start_pos", "end_pos"]
    names = [key, *ints, *["piece_text"] * with_text]

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe.encoder(ranks_path)
        encode = coder.encode_ordinary
        sizes: dict[str, int] = {}
        for batch in batches:
            flat, offsets = bpe.flat_words(batch.column(1))
            coded = flat.dictionary_encode()
            distinct = coded.dictionary.to_pylist()
            if len(sizes) > 500_000:
                sizes.clear()
            own = np.fromiter((sizes[w] if w in sizes else sizes.setdefault(w, len(encode(w))) for w in distinct), np.int64, len(distinct))
            kinds = np.fromiter(map(_word_class, distinct), np.int64, len(distinct))
            length = np.fromiter(map(len, distinct), np.int64, len(distinct))
            place = coded.indices.to_numpy()
            size = own[place]
            total = np.concatenate([[0], np.cumsum(size)])
            letters = np.concatenate([[0], np.cumsum(length[place])])
            tokens = total[offsets[1:]] - total[offsets[:-1]]
            short = np.flatnonzero(tokens <= limit)
            one, none = np.ones(len(short), int), np.zeros(len(short), int)
            parts = [(short, one, one, none, tokens[short], none, (letters[offsets[1:]] - letters[offsets[:-1]])[short])]
            for i in np.flatnonzero(tokens > limit):
                part = slice(offsets[i], offsets[i + 1])
                at, cls, char = boundaries(
                    size[part], length[place[part]], kinds[place[part]], limit, lambda k, p=place[part]: _whole_characters(encode(distinct[p[k]]), coder.decode_single_token_bytes)
                )
                a, b = cut(at, cls, limit, overlap)
                parts.append((np.full(len(a), i), np.arange(1, len(a) + 1), np.full(len(a), len(a)), at[a], at[b], char[a], char[b]))
            doc, piece, n_pieces, start, end, first, last = map(np.concatenate, zip(*parts))
            columns = [pa.array(x, pa.int32()) for x in (piece, n_pieces, start, end, end - start, first + 1, last)]
            if with_text:
                texts = ["".join(distinct[w] for w in place[offsets[i] : offsets[i + 1]]) for i in range(len(tokens))]
                columns.append(pa.array([texts[i][x:y] for i, x, y in zip(doc, first, last)], pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(doc)), *columns], names=names)

    kind = words.schema[key].dataType.simpleString()
    return words.mapInArrow(split, f"{key} {kind}, " + ", ".join(f"{n} int" for n in ints) + ", piece_text string" * with_text)


def oversized(docs: DataFrame, key: str = "doc_id", text: str = "text", limit: int = 1024, overlap: int = 64, ranks_path: str = bpe.RANKS) -> DataFrame:
    """(key) of the texts that need more than one piece; keys are distinct."""
    pieces = split_corpus(docs, key, text, limit, overlap, ranks_path, with_text=False)
    return pieces.where((F.col("piece") == 1) & (F.col("n_pieces") > 1)).select(key).distinct()
