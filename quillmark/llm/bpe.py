"""Encoding with a public byte-level BPE vocabulary by a distinct-word shuffle.

Texts are split into pre-tokens on the JVM. Blocks of texts keep the positions of
their distinct words as small codes; every distinct word of the corpus is encoded
once, its ids are joined back to the blocks' words by a shuffle on the word, and each
block's texts are reassembled by their codes. A frequent word is one row a block, so
no word is hot, and nothing that grows with the corpus is broadcast or collected.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.shared import written

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"

# Fixed value: the pre-token pattern of the vocabulary (contractions, words,
# numbers, other signs, white space). Java needs (?U) for Unicode white space.
PRE_TOKEN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: A block of texts ends where it has so many distinct words or pre-tokens (or with its
#: text, which may have more).
BLOCK_WORDS, BLOCK_TOKENS = 50_000, 2_000_000


@functools.lru_cache(maxsize=4)
def encoder(ranks_path: str):
    """The tiktoken encoder of a ranks file, made once per Python process."""
    import tiktoken

    with open(ranks_path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=PRE_TOKEN, mergeable_ranks=ranks, special_tokens={})


def pre_tokens(text: Column) -> Column:
    """Array of the pre-tokens of ``text``; null for null."""
    return F.regexp_extract_all(text, F.lit(f"(?U){PRE_TOKEN}"), F.lit(0))


def unassigned(text: Column) -> Column:
    """True where the JVM's character tables may lag behind the tokenizer's."""
    return text.rlike(r"\p{Cn}")


def split_words(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, words): pre-tokens of every row; null text gives a null array.

    Rows with code points that the JVM does not know are split in Python, so the
    result does not depend on the JVM's Unicode version.
    """
    rows = docs.select(F.col(key), F.col(text).alias("_text"))
    plain = rows.where(F.col("_text").isNull() | ~unassigned(F.col("_text"))).select(key, pre_tokens(F.col("_text")).alias("words"))
    schema = plain.schema

    def in_python(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        find = regex.compile(PRE_TOKEN).findall
        for batch in batches:
            words = pa.array([find(t) for t in batch.column(1).to_pylist()], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column(0), words], names=[key, "words"])

    odd = rows.where(F.col("_text").isNotNull() & unassigned(F.col("_text"))).mapInArrow(in_python, schema)
    return plain.unionByName(odd)


def encode_words(words: DataFrame, ranks_path: str = RANKS) -> DataFrame:
    """(word, ids): every distinct word encoded once."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = encoder(ranks_path).encode_ordinary
        for batch in batches:
            ids = pa.array([one(w) for w in batch.column(0).to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=["word", "ids"])

    return words.mapInArrow(encode, "word string, ids array<int>")


def flat_words(column: pa.ListArray) -> tuple[pa.Array, np.ndarray]:
    """All words of a batch and the offsets of its rows in them (null rows are empty)."""
    offsets = column.offsets.to_numpy().astype(np.int64)
    sizes = np.diff(offsets)
    if column.null_count:
        sizes[np.asarray(column.is_null())] = 0
    return column.flatten(), np.concatenate([[0], np.cumsum(sizes)])


def _parts(offsets: np.ndarray, place: np.ndarray, most_words: int, most_tokens: int) -> Iterator[tuple[int, int]]:
    """Row ranges of a batch that are one block each."""
    start, seen = 0, set()
    for i in range(len(offsets) - 1):
        if i > start and (len(seen) >= most_words or offsets[i] - offsets[start] >= most_tokens):
            yield start, i
            start, seen = i, set()
        seen.update(np.unique(place[offsets[i] : offsets[i + 1]]).tolist())
    if len(offsets) > 1:
        yield start, len(offsets) - 1


def blocks_of(words: DataFrame, key: str, most_words: int = BLOCK_WORDS, most_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(block, key, width, codes, words): a row for each text with the places of its
    pre-tokens among its block's distinct words, packed in ``width`` bytes each, and a
    row for each block with those words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            flat, offsets = flat_words(batch.column(1))
            coded = flat.dictionary_encode()
            place = coded.indices.to_numpy()
            whole = list(_parts(offsets, place, most_words, most_tokens)) if len(coded.dictionary) > most_words or len(flat) > most_tokens else [(0, batch.num_rows)]
            for a, b in whole:
                own, code = np.unique(place[offsets[a] : offsets[b]], return_inverse=True)
                width = 2 if len(own) < 1 << 16 else 4
                packed = code.astype(np.uint16 if width == 2 else np.uint32).tobytes()
                bounds = pa.array((offsets[a : b + 1] - offsets[a]) * width, pa.int32())
                codes = pa.Array.from_buffers(pa.binary(), b - a, [None, bounds.buffers()[1], pa.py_buffer(packed)])
                n = b - a
                columns = [pa.array(np.full(n, block)), batch.column(0).slice(a, n), pa.array(np.full(n, width, np.int32)), codes, pa.nulls(n, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(columns, names=names)
                known = pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), coded.dictionary.take(pa.array(own)))
                yield pa.RecordBatch.from_arrays([pa.array([block]), pa.nulls(1, batch.column(0).type), pa.nulls(1, pa.int32()), pa.nulls(1, pa.binary()), known], names=names)
                block += 1

    names = ["block", key, "width", "codes", "words"]
    kind = words.schema[key].dataType.simpleString()
    return words.select(key, "words").mapInArrow(run, f"block bigint, {key} {kind}, width int, codes binary, words array<string>")


def encode_corpus(docs: DataFrame, key: str = "doc_id", text: str = "text", ranks_path: str = RANKS, block_words: int = BLOCK_WORDS, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(key, ids) of every row of ``docs``.

    Null and empty texts get an empty list; strings that look like special
    tokens are ordinary text. Rows with equal keys each get their own text's list.
    Other columns are ignored; an empty table gives an empty table. The plan is the
    same at every size.
    """
    blocks = written(blocks_of(split_words(docs, key, text), key, block_words, block_tokens), "bpe-blocks")
    texts = blocks.where(F.col("codes").isNotNull()).select("block", key, "width", "codes")
    words = blocks.where(F.col("words").isNotNull()).select("block", F.posexplode("words").alias("code", "word"))
    encoded = written(encode_words(words.select("word").distinct(), ranks_path), "bpe-words")
    known = words.join(encoded, "word").select(F.col("block").alias("word_block"), "code", "ids")

    def fill(left: pa.Table, right: pa.Table) -> pa.Table:
        left, right = left.combine_chunks(), right.combine_chunks()
        ids = right.column("ids").combine_chunks() if right.num_rows else pa.array([], pa.list_(pa.int32()))
        values = ids.flatten().to_numpy()
        ends = np.cumsum(ids.value_lengths().to_numpy()) if right.num_rows else np.zeros(0, np.int64)
        row = np.empty(right.num_rows, np.int64)
        row[right.column("code").to_numpy()] = np.arange(right.num_rows)
        size = np.diff(ends, prepend=0)[row]
        start = ends[row] - size
        width = left.column("width")[0].as_py() if left.num_rows else 2
        codes = left.column("codes").to_pylist()
        place = np.frombuffer(b"".join(codes), np.uint16 if width == 2 else np.uint32).astype(np.int64)
        long = size[place]
        last = np.concatenate([[0], np.cumsum(long)])
        out = values[np.repeat(start[place] - last[:-1], long) + np.arange(int(last[-1]))]
        bounds = last[np.cumsum([0, *(len(c) // width for c in codes)])].astype(np.int32)
        return pa.table({key: left.column(key), "ids": pa.ListArray.from_arrays(pa.array(bounds), pa.array(out, pa.int32()))})

    kind = docs.schema[key].dataType.simpleString()
    return texts.groupBy("block").cogroup(known.groupBy("word_block")).applyInArrow(fill, f"{key} {kind}, ids array<int>")


@functools.lru_cache(maxsize=4)
def token_bytes(ranks_path: str) -> pa.BinaryArray:
    """The bytes of every token, by its id."""
    with open(ranks_path, "rb") as file:
        table = {int(n): base64.b64decode(b) for b, n in map(bytes.split, file)}
    return pa.array([table.get(i) for i in range(max(table) + 1)], pa.large_binary())


def decode_corpus(ids: DataFrame, key: str = "doc_id", column: str = "ids", ranks_path: str = RANKS) -> DataFrame:
    """(key, text): the token-byte table, of the vocabulary's fixed size, joined to the
    ids of each batch; an empty list gives '', null gives null."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = token_bytes(ranks_path)
        for batch in batches:
            flat, offsets = flat_words(batch.column(1))
            own = table.take(flat)
            ends = np.frombuffer(own.buffers()[1], np.int64, len(own) + 1)[offsets] if len(own) else np.zeros(len(offsets), np.int64)
            data = own.buffers()[2].to_pybytes() if len(own) else b""
            text = [data[a:b].decode("utf-8", "replace") if known else None for a, b, known in zip(ends, ends[1:], batch.column(1).is_valid().to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(text, pa.string())], names=[key, "text"])

    kind = ids.schema[key].dataType.simpleString()
    return ids.select(key, column).mapInArrow(decode, f"{key} {kind}, text string")
