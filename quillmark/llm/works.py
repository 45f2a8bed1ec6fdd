"""Matching cited works across two tables without a shared key.

Rows with equal titles are one node, unless their authors, years and volumes
contradict the title's usual ones. Nodes are sorted by several composite keys;
within a sliding window neighbours are compared by weighted field similarities.
Nodes of one table that agree form its works; works of the two tables are
assigned one to one so that the total confidence is largest, and all rows of
assigned works are pairs.
"""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.llm.names import components, plain
from quillmark.llm.noise import HYPHENS, fold_text
from quillmark.llm.sentences import FURNITURE
from quillmark.shared import join_hot, written

#: Neighbours compared on each side, least confidence of a match.
WINDOW, LEAST = 8, 0.8
#: Weights of the fields; fields missing on either side don't count. The tail is a title's last word.
WEIGHTS = {"tail": 0.35, "head": 0.3, "author": 0.15, "year": 0.08, "volume": 0.12, "page": 0.08, "journal": 0.07}
#: Least similarity of two tails, and of two authors that don't contradict each other.
TAIL, AUTHOR = 0.75, 0.5
#: Pairs of works in a component up to which it is assigned by the exact method, else by an auction; the auction's least raise.
EXACT, RAISE = 2_000, 0.01

KIND = re.compile(r"\b(?:(reply|response)|(erratum|corrigendum|correction)|(comment)|part\s+([ivx]+|\d+|two|three)|(?<=\s)(ii|iii|iv)(?=\W|$))", re.I)
_TITLE = re.compile(r"(?<![^\W_])(?:[A-ZÀ-Ý0-9†ŠŽŁ][\w†’'-]*|[“\"]\s*\w[\w†]*)(?:\s+[a-zà-ÿ0-9†ﬀ-ﬆ][\w†-]*){2,}(?:\s+[A-ZÀ-Ý0-9†ŠŽŁ][\w†-]*)?")
_YEAR = re.compile(r"(?<!\d)(1[6-9]\d\d|20\d\d)(?=[a-z]?(?!\d))")
_MAIN = re.compile(r"[:.?!]\s|[:.?!]$|,\s(?=part\b)", re.I)
_WORDS = re.compile(r"[^\W_]+")
_BROKEN = re.compile(rf"(?<=[^\W\d_])[{HYPHENS}][ \t]*\r?\n\s*(?=[^\W\d_])")
_MARKUP = re.compile(r"</?[a-z]+>")
# what follows the title up to the journal: a subtitle, a part
_TAIL = re.compile(r"(?:\s(?:II|III|IV)\b)?(?:\s*(?::[^.,\"”]*|,\s*Part\s\w+|\.\s(?:Reply|Erratum|Comment)\b))*(?:\s(?:II|III|IV)\b)?", re.I)
_JOURNAL = re.compile(r"[\s.,\"”]*([^\d,]*[^\d\W][.]?)")
_VOL = re.compile(r"\bvol\b.*", re.I)
_VOLUME = re.compile(r"vol\.?\s*(\d+)|,\s*(\d+)\s*\(|,\s*(\d+),|\s(\d+)\s*:|\s(\d+)\s\(")
_PAGE = re.compile(r"(\d+)\s*[-–—]\s*\d+\W*$|p\.\s*(\d+)\W*$")
_NEXT = re.compile(r",|;|&|\(|\band\b|\bet\s+al\b", re.I)
_LETTERS = re.compile(r"[^\W\d_]+")
_DIGITS = re.compile(r"\d+")
_LABEL = re.compile(r"^\[\d+\]\s*")
_ET_AL = re.compile(r"\bet\s+al\b", re.I)

#: Fields and their types; the journal is a hash of its words' first letters. Strings are never null, the others are null where a field is missing.
FIELDS = {"title": "string", "kind": "string", "author": "string", "year": "int", "volume": "bigint", "page": "bigint", "journal": "bigint"}


def cleaned(text: str) -> str:
    """Scanned text in one line: furniture out, broken words joined, markup off."""
    if "\n" in text or "\x0c" in text:
        text = _BROKEN.sub("", FURNITURE.sub("", text))
    if "<" in text:
        text = _MARKUP.sub("", text)
    return " ".join(text.split())


def title_key(title: str) -> str:
    """Folded words of the main title, without those that name a part or reply."""
    main = _MAIN.split(KIND.sub(" ", title) if KIND.search(title) else title, maxsplit=1)[0]
    return " ".join(_WORDS.findall(plain(fold_text(main))))


def kind_of(text: str) -> str:
    """Which part, reply or erratum of a work a title names ('' for the work itself)."""
    m = KIND.search(text)
    if not m:
        return ""
    if m[1]:
        return "reply"
    if m[2]:
        return "erratum"
    if m[3]:
        return "comment"
    n = (m[4] or m[5]).lower()
    return {"i": "", "1": "", "two": "ii", "2": "ii", "three": "iii", "3": "iii", "4": "iv"}.get(n, n)


@functools.lru_cache(maxsize=65_536)
def journal_key(text: str) -> str:
    """First letters of a journal's words, so that its short form has the same."""
    return "".join(w[0] for w in re.findall(r"[a-z]+", plain(_VOL.sub("", text))) if w not in ("of", "on", "in", "and", "the", "for"))


def _nothing() -> dict:
    return {f: "" if kind == "string" else None for f, kind in FIELDS.items()} | {"journal": ""}


def _number(m: re.Match | None) -> int | None:
    """The number that a pattern found, null where it is too long for one."""
    found = m[m.lastindex or 0] if m else ""
    return int(found) if found and len(found) <= 18 else None


def parse_text(text: str) -> dict:
    """Fields of a reference in running text, whichever its style."""
    s = cleaned(text)
    out = _nothing()
    # in capitals 'et al' cannot start or carry on a title
    m = _TITLE.search(_ET_AL.sub(lambda x: x.group().upper(), s) if " al" in s else s)
    if not m:
        return out | {"author": _family(_LABEL.sub("", s))}
    before, title, after = s[: m.start()], s[m.start() : m.end()], s[m.end() :]
    out["title"] = title_key(title)
    tail = _TAIL.match(after).group()
    rest = after[len(tail) :]
    out["kind"] = kind_of(" " + title + " " + tail)
    out["author"] = _family(_LABEL.sub("", before))
    out["year"] = _number(_YEAR.search(before[-12:]) or _YEAR.search(rest))
    j = _JOURNAL.match(rest)
    out["journal"] = journal_key(j[1]) if j else ""
    out["volume"] = _number(_VOLUME.search(rest))
    out["page"] = _number(_PAGE.search(rest[-24:]))
    return out


def _family(authors: str) -> str:
    """The longest word of the first name in a list of authors, which its family name
    nearly always is, and the same word in either order of an organisation's name."""
    first = _NEXT.split(authors, maxsplit=1)[0]
    words = [w for w in _LETTERS.findall(plain(fold_text(first))) if len(w) > 2]
    return max(words, key=len) if words else ""


def parse_fields(title, author, year, journal, volume, page, text) -> dict:
    """Fields of an index entry; what the entry lacks is read from its text."""
    out = parse_text(text) if text and text.strip() else _nothing()
    if title and title.strip():
        t = cleaned(title)
        out["title"] = title_key(t)
        out["kind"] = kind_of(" " + t) or out["kind"]
    if author and author.strip() and not out["author"]:
        out["author"] = _family(_first_of(author))
    if year and (y := _YEAR.search(year)):
        out["year"] = _number(y)
    if journal and journal.strip():
        out["journal"] = journal_key(journal)
    for field, value in (("volume", volume), ("page", page)):
        if value and (d := _DIGITS.search(value)):
            out[field] = _number(d)
    return out


def _first_of(value: str) -> str:
    for _ in range(3):
        s = value.strip()
        if s[:1] not in ("[", "{", '"'):
            return value
        try:
            value = json.loads(s)
        except ValueError:
            return s
        if isinstance(value, list):
            value = next((x for x in value if x), "")
        if isinstance(value, dict):
            return str(value.get("family") or value.get("name") or "") + ", " + str(value.get("given") or "")
        if not isinstance(value, str):
            return ""
    return value


def _parsed(df: DataFrame, parse, source: str) -> DataFrame:
    """(source, id, fields) by ``parse`` over the columns after the first."""
    types = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [parse(*r) for r in zip(*(c.to_pylist() for c in batch.columns[1:]))]
            fields = [pa.array([r[f] for r in rows], pa.string() if f == "journal" else types[kind]) for f, kind in FIELDS.items()]
            yield pa.RecordBatch.from_arrays([pa.repeat(source, batch.num_rows), batch.column(0), *fields], names=["source", "id", *FIELDS])

    told = df.mapInArrow(run, "source string, id bigint, " + ", ".join(f"{f} {'string' if f == 'journal' else kind}" for f, kind in FIELDS.items()))
    return told.withColumn("journal", F.when(F.length("journal") > 0, F.xxhash64("journal")))


def read_citations(citations: DataFrame) -> DataFrame:
    """Fields of the rows with a reference text."""
    return _parsed(citations.where(F.length(F.trim("ref_full_text")) > 0).select(F.col("mapping_id").alias("id"), "ref_full_text"), parse_text, "c")


def read_references(refs: DataFrame) -> DataFrame:
    """Fields of the index entries."""
    columns = ("article_title", "author", "ref_year", "journal", "volume", "first_page", "ref_full")
    return _parsed(refs.select(F.col("ref_row_id").alias("id"), *columns), parse_fields, "r")


# Nodes ---------------------------------------------------------------------------

_CITED = ("author", "year", "volume")


def _alike(a: Column, b: Column) -> Column:
    """Share of letters that agree."""
    return F.when(a == b, 1.0).otherwise(1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1)))


def nodes_of(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(variants, nodes): (cid, node, n) of each title with its cited fields, and (source,
    node, n, fields) of each node.

    A node is a title of a table with its most frequent fields. A variant that
    contradicts two of its author, year and volume is a node of its own.
    """
    key = ("source", "title", "kind")
    variants = rows.groupBy(*key, *_CITED).agg(F.count("*").alias("n"), F.max("page").alias("page"), F.max("journal").alias("journal"))
    variants = variants.withColumn("cid", F.xxhash64(*key, *_CITED)).withColumn("sig", F.xxhash64(*key))
    # variants were counted before the shuffle, so a frequent title is few rows here
    order = Window.partitionBy("sig").orderBy(F.desc("n"), "cid")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    fields = (*_CITED, "page", "journal")
    told = variants.select("*", F.row_number().over(order).alias("place"), F.sum("n").over(whole).alias("n_title"), *[F.first(F.when(F.length(f) > 0, F.col(f)) if f == "author" else F.col(f), True).over(whole).alias("usual_" + f) for f in fields])
    against = [(F.length("author") > 0) & (_alike(F.col("author"), F.coalesce("usual_author", "author")) < AUTHOR), F.abs(F.col("year") - F.col("usual_year")) > 1, F.col("volume") != F.col("usual_volume")]
    apart = sum((F.when(x, 1).otherwise(0) for x in against), F.lit(0)) >= 2
    told = written(told.withColumn("node", F.when(apart, F.xxhash64("sig", *_CITED)).otherwise(F.col("sig"))), "works-variants")
    alone = told.where("node <> sig").select("source", "node", "n", "title", "kind", *fields)
    usually = told.where("place = 1").select("source", F.col("sig").alias("node"), F.col("n_title").alias("n"), "title", "kind", F.coalesce("usual_author", F.lit("")).alias("author"), *[F.col("usual_" + f).alias(f) for f in fields[1:]])
    return told.select("cid", "node", "n"), usually.unionByName(alone)


# Sorted neighbourhood --------------------------------------------------------------


#: What the sliding window reads of a node, and what stands for it at a partition's border.
_SEEN = {"k": pa.int32(), "node": pa.int64(), "kind": pa.int64(), "tail": pa.string(), "author": pa.string(), "year": pa.int32(), "volume": pa.int64(), "page": pa.int64(), "journal": pa.int64()}


def _bags(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(counts of letters, lengths) of strings; half the difference of two counts is a
    lower bound of their edit distance."""
    own = pa.concat_arrays([column])  # offsets from 0
    ends = np.frombuffer(own.buffers()[1], np.int32, len(own) + 1)
    letters = np.frombuffer(own.buffers()[2] or b"", np.uint8, int(ends[-1]))
    size = np.diff(ends)
    row = np.repeat(np.arange(len(own)), size)
    return np.bincount(row * 32 + (letters & 31), minlength=len(own) * 32).reshape(len(own), 32).astype(np.int16), size


def _pairs_in(batch: pa.RecordBatch, window: int, place: np.ndarray | None = None) -> np.ndarray:
    """Pairs of nodes of a sorted batch (``_SEEN``) that may match, as rows (smaller,
    larger): at most ``window`` places apart and of one kind, where the most that their
    confidence can be is ``LEAST``, or of the same author, year and volume.
    ``place`` tells the rows' places where some between them are left out."""
    n = batch.num_rows
    if n < 2:
        return np.zeros((0, 2), np.int64)
    place = np.arange(n) if place is None else place
    col = {f: batch.column(i) if t == pa.string() else batch.column(i).fill_null(-1).to_numpy(zero_copy_only=False) for i, (f, t) in enumerate(_SEEN.items())}
    (tail, tail_size), (author, author_size) = _bags(col["tail"]), _bags(col["author"])
    out = []
    for d in range(1, min(window, n - 1) + 1):
        a, b = slice(0, n - d), slice(d, n)
        at = np.flatnonzero((col["k"][a] == col["k"][b]) & (col["kind"][a] == col["kind"][b]) & (place[b] - place[a] <= window))
        to = at + d
        at_most = lambda bag, size: 1 - np.abs(bag[at] - bag[to]).sum(1) / 2 / np.maximum(np.maximum(size[at], size[to]), 1)
        sims = {"tail": at_most(tail, tail_size), "author": at_most(author, author_size)}
        both = {"author": (author_size[at] > 0) & (author_size[to] > 0)}
        for f in ("year", "volume", "page", "journal"):
            x, y = col[f][at], col[f][to]
            both[f] = (x != -1) & (y != -1)
            sims[f] = np.where(x == y, 1.0, np.where(np.abs(x - y) <= 1, 0.7, 0.0) if f == "year" else 0.0)
        got, total = WEIGHTS["tail"] * sims["tail"] + WEIGHTS["head"], np.full(len(at), WEIGHTS["tail"] + WEIGHTS["head"])
        for f, known in both.items():
            got += known * WEIGHTS[f] * sims[f]
            total += known * WEIGHTS[f]
        cited = both["author"] & (sims["author"] >= 0.8) & both["year"] & (sims["year"] > 0) & both["volume"] & (sims["volume"] == 1)
        # the head counts as the same, and left out where that is more
        without = (got - WEIGHTS["head"]) / np.maximum(total - WEIGHTS["head"], 1e-9)
        keep = cited | ((sims["tail"] >= TAIL) & (np.maximum(got / total, without) >= LEAST - 1e-9))
        x, y = col["node"][at[keep]], col["node"][to[keep]]
        out.append(np.stack([np.minimum(x, y), np.maximum(x, y)], 1))
    return np.unique(np.concatenate(out), axis=0)


def neighbours(nodes: DataFrame, keys: list[Column], window: int = WINDOW) -> DataFrame:
    """(a, b): distinct pairs of nodes within ``window`` places of each other in the
    order of any key, that may match.

    All keys are sorted at once by range, ties by node, so equal keys are split.
    Each sorted partition is read once; its first and last ``window`` rows are kept
    aside, and pairs over the partitions' borders are found among those alone.
    """
    keyed = F.explode(F.array(*[F.struct(F.lit(i).alias("k"), key.alias("key")) for i, key in enumerate(keys)]))
    rows = nodes.select("node", F.xxhash64("kind").alias("kind"), F.substring_index("title", " ", -1).alias("tail"), "author", "year", "volume", "page", "journal", keyed.alias("x")).select("x.key", "x.k", *list(_SEEN)[1:])
    ordered = rows.repartitionByRange("k", "key", "node").sortWithinPartitions("k", "key", "node").select(*_SEEN)
    schema = "a bigint, b bigint, part int, place int, " + ", ".join(f"{f} {'string' if t == pa.string() else 'int' if t == pa.int32() else 'bigint'}" for f, t in _SEEN.items())

    def packed(pairs: np.ndarray, edge: pa.RecordBatch | None = None, part: int = 0, place: int = 0) -> pa.RecordBatch:
        n, m = len(pairs), edge.num_rows if edge is not None else 0
        left = [pa.concat_arrays([pa.array(pairs[:, i], pa.int64()), pa.nulls(m, pa.int64())]) for i in (0, 1)]
        at = [pa.concat_arrays([pa.nulls(n, pa.int32()), pa.array(x, pa.int32())]) for x in (np.full(m, part), place + np.arange(m))]
        rest = [pa.concat_arrays([pa.nulls(n, t), edge.column(i) if m else pa.nulls(0, t)]) for i, t in enumerate(_SEEN.values())]
        return pa.RecordBatch.from_arrays([*left, *at, *rest], names=["a", "b", "part", "place", *_SEEN])

    def slide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen, last = TaskContext.get().partitionId(), 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            if seen < window:
                yield packed(np.zeros((0, 2), np.int64), batch.slice(0, window - seen), part, seen)
            seen += batch.num_rows
            whole = batch if last is None else pa.Table.from_batches([last, batch]).combine_chunks().to_batches()[0]
            yield packed(_pairs_in(whole, window))
            last = whole.slice(max(whole.num_rows - window, 0))
        if last is not None:
            first = seen - last.num_rows
            skip = max(window - first, 0)  # rows told as first ones
            if skip < last.num_rows:
                yield packed(np.zeros((0, 2), np.int64), last.slice(skip), part, first + skip)

    told = written(ordered.mapInArrow(slide, schema), "works-near")

    def over_borders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [b for b in batches if b.num_rows]
        if own:
            whole = pa.Table.from_batches(own).combine_chunks().to_batches()[0]
            part, place = (whole.column(i).to_numpy() for i in (0, 1))
            last = np.flatnonzero(np.append(part[1:] != part[:-1], True))  # its last row tells a partition's size
            before = np.concatenate([[0], np.cumsum(place[last].astype(np.int64) + 1)])
            pairs = _pairs_in(pa.RecordBatch.from_arrays(whole.columns[2:], names=whole.schema.names[2:]), window, before[np.searchsorted(last, np.arange(len(part)))] + place)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    # two windows of rows a partition, however many rows there are
    borders = told.where("part is not null").select("part", "place", *_SEEN).coalesce(1).sortWithinPartitions("part", "place")
    return told.where("a is not null").select("a", "b").unionByName(borders.mapInArrow(over_borders, "a bigint, b bigint")).where("a <> b").distinct()


def scored(pairs: DataFrame) -> DataFrame:
    """``pairs`` (x, y) with their confidence: the weighted similarity of the fields that
    both have; 0 for another part or subject.

    Titles with other last words are of other subjects, unless all words of one
    stand in the longer other and author, year and volume agree: it was cut.
    """
    x, y = F.col("x"), F.col("y")
    words = lambda c: F.split(c["title"], " ")
    split = pairs.withColumn("p", words(x)).withColumn("q", words(y))
    # similarities first, so that each is computed once
    p, q = F.col("p"), F.col("q")
    head = lambda c: F.array_join(F.slice(c, 1, F.size(c) - 1), " ")
    told = split.select(
        *pairs.columns, p, q, head(p).alias("hx"), head(q).alias("hy"),
        _alike(F.element_at(p, -1), F.element_at(q, -1)).alias("tail"),
        F.when((F.length(x["author"]) > 0) & (F.length(y["author"]) > 0), _alike(x["author"], y["author"])).alias("author"),
        F.when(x["year"] == y["year"], 1.0).when(F.abs(x["year"] - y["year"]) <= 1, 0.7).when(x["year"].isNotNull() & y["year"].isNotNull(), 0.0).alias("year"),
        *[(x[f] == y[f]).cast("double").alias(f) for f in ("volume", "page", "journal")],
    )
    common = F.size(F.array_intersect(p, q))
    shorter = F.least(F.size(F.array_distinct(p)), F.size(F.array_distinct(q)))
    as_cited = (F.col("author") >= 0.8) & (F.col("volume") == 1) & (F.col("year") >= 0.7)
    shared = F.size(F.array_intersect(F.split("hx", " "), F.split("hy", " "))) / F.greatest(F.least(F.size(p), F.size(q)) - 1, F.lit(3))
    same_tail = F.col("tail") >= TAIL
    alike = F.when(F.col("hx") == F.col("hy"), 1.0).otherwise(F.greatest(_alike(F.col("hx"), F.col("hy")), shared))
    told = told.withColumn("head", F.when(same_tail & (F.length("hx") > 0) & (F.length("hy") > 0), F.when(shared == 1, 1.0).otherwise(alike)))
    told = told.withColumn("cut", F.coalesce(~same_tail & as_cited & (F.size(p) != F.size(q)) & (common == shorter), F.lit(False))).withColumn("tail", F.when(same_tail, F.col("tail")))
    total = sum((F.when(F.col(f).isNotNull(), w).otherwise(0.0) for f, w in WEIGHTS.items()), F.lit(0.0))
    got = sum((F.coalesce(F.col(f) * w, F.lit(0.0)) for f, w in WEIGHTS.items()), F.lit(0.0))
    match = (x["kind"] == y["kind"]) & (F.col("cut") | (F.col("tail").isNotNull() & F.coalesce(F.col("head") >= 0.5, F.lit(True)) & (total >= 0.4)))
    return told.select(*pairs.columns, F.when(match, got / total).otherwise(0.0).alias("confidence"))


# One to one ------------------------------------------------------------------------


def best_total(value: np.ndarray) -> np.ndarray:
    """Column of each row (-1 for none) so that the sum of ``value`` is largest; only
    positive values are taken. Shortest augmenting paths over a square of costs."""
    n, m = value.shape
    size = max(n, m)
    cost = np.zeros((size + 1, size + 1))
    cost[1 : n + 1, 1 : m + 1] = -np.maximum(value, 0)
    u, v, row, way = np.zeros(size + 1), np.zeros(size + 1), np.zeros(size + 1, int), np.zeros(size + 1, int)
    for i in range(1, size + 1):
        row[0], j0 = i, 0
        least, used = np.full(size + 1, np.inf), np.zeros(size + 1, bool)
        while True:
            used[j0] = True
            i0 = row[j0]
            slack = cost[i0] - u[i0] - v
            better = ~used & (slack < least)
            better[0] = False
            least[better], way[better] = slack[better], j0
            free = np.where(used, np.inf, least)
            free[0] = np.inf
            j1 = int(np.argmin(free))
            delta = free[j1]
            u[row[used]] += delta
            v[used] -= delta
            least[~used] -= delta
            j0 = j1
            if row[j0] == 0:
                break
        while j0:
            row[j0] = row[way[j0]]
            j0 = way[j0]
    out = np.full(n, -1)
    for j in range(1, m + 1):
        i = row[j] - 1
        if 0 <= i < n and value[i, j - 1] > 0:
            out[i] = j - 1
    return out


def auction(pairs: DataFrame, least_raise: float = RAISE) -> DataFrame:
    """(a, b, value): one-to-one by rounds of bids, for components of any size; the
    total is within ``least_raise`` a pair of the largest.

    Each round all free ``a`` bid for their best ``b`` what it is worth to them above
    their second best; each ``b`` goes to its highest bidder. Prices only rise, so it
    ends. A round is joins and aggregates over tables in the shared folder.
    """
    empty = pairs.select("a", "b", F.col("value").alias("price")).limit(0)
    held = written(empty, "works-held")
    while True:
        free = pairs.join(held.select("a"), "a", "left_anti").join(held.select("b", "price"), "b", "left")
        net = F.col("value") - F.coalesce("price", F.lit(0.0))
        offers = free.withColumn("net", net).where("net > 0").groupBy("a").agg(F.max(F.struct("net", "b", F.coalesce("price", F.lit(0.0)).alias("price"))).alias("top"), F.slice(F.sort_array(F.collect_list("net"), False), 2, 1).alias("next"))
        bids = offers.select("a", "top.b", (F.col("top.price") + F.col("top.net") - F.coalesce(F.get("next", F.lit(0)), F.lit(0.0)) + least_raise).alias("price"))
        won = written(bids.groupBy("b").agg(F.max_by("a", F.struct("price", "a")).alias("a"), F.max("price").alias("price")).select("a", "b", "price"), "works-won")
        if not won.limit(1).count():
            return pairs.join(held.select("a", "b"), ["a", "b"])
        held = written(held.join(won.select("b"), "b", "left_anti").select("a", "b", "price").unionByName(won), "works-held")


def assigned(pairs: DataFrame, exact: int = EXACT) -> DataFrame:
    """(a, b, confidence): works of both sides one to one, so that the total of
    confidences is largest (equal ones by ``support``).

    Pairs without a rival on either side are taken as they are. The others are
    assigned within their connected component: exactly where it has at most ``exact``
    pairs, else by auction.
    """
    worth = F.col("confidence") + F.least(F.col("support"), F.lit(1000)) * 1e-7
    rivals = lambda c: pairs.groupBy(c).agg(F.count("*").alias("n_" + c))
    told = written(pairs.withColumn("value", worth).join(rivals("a"), "a").join(rivals("b"), "b"), "works-rivals")
    out = told.where("n_a = 1 and n_b = 1").select("a", "b", "confidence")
    rest = told.where("n_a > 1 or n_b > 1").select("a", "b", "confidence", "value")
    if not rest.limit(1).count():
        return out
    roots = components(rest.select("a", "b"), "works-rival-roots")
    grouped = rest.join(roots, "a")
    sized = written(grouped.join(grouped.groupBy("root").agg(F.count("*").alias("size")), "root"), "works-sized")

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        a, b = rows["a"].unique(), rows["b"].unique()
        value = np.zeros((len(a), len(b)))
        i, j = pd.Index(a).get_indexer(rows["a"]), pd.Index(b).get_indexer(rows["b"])
        value[i, j] = rows["value"]
        return rows[best_total(value)[i] == j][["a", "b", "confidence"]]

    small = sized.where(F.col("size") <= exact).select("root", "a", "b", "confidence", "value")
    out = out.unionByName(small.groupBy("root").applyInPandas(solve, "a bigint, b bigint, confidence double"))
    large = sized.where(F.col("size") > exact).select("a", "b", "confidence", "value")
    if large.limit(1).count():
        out = out.unionByName(auction(large).select("a", "b", "confidence"))
    return out


# Works -----------------------------------------------------------------------------


def work_members(citations: DataFrame, refs: DataFrame) -> DataFrame:
    """(source, id, work, confidence): the rows of both tables whose works are assigned
    to each other, source 'c' and 'r'.

    Rows without any readable title are never matched. A row may lack any field;
    equal rows count once; empty tables give no rows.
    """
    rows = written(read_citations(citations).unionByName(read_references(refs)).where(F.length("title") > 0), "works-rows")
    variants, nodes = nodes_of(rows)
    title, tail = F.col("title"), F.substring_index("title", " ", -1)
    keys = [
        F.concat_ws(" ", tail, "kind", title),
        F.concat_ws(" ", F.reverse(tail), "kind", title),
        F.concat_ws(" ", "author", F.col("year").cast("string"), F.col("volume").cast("string"), tail),
        F.concat_ws(" ", F.substring_index(title, " ", 4), F.col("year").cast("string"), F.col("volume").cast("string"), tail),
    ]
    side = lambda c: nodes.select(F.col("node").alias(c), F.struct("source", "n", *FIELDS).alias("x" if c == "a" else "y"))
    near = scored(neighbours(nodes, keys).join(side("a"), "a").join(side("b"), "b"))
    # written before the filter, which would compute the confidence twice
    links = written(near.select("a", "b", F.col("x.source").alias("sa"), F.col("y.source").alias("sb"), F.least("x.n", "y.n").alias("n"), "confidence"), "works-links").where(F.col("confidence") >= LEAST)
    # works of each table
    own = components(links.where("sa = sb").select("a", "b"), "works-roots").withColumnRenamed("a", "node")
    work = written(nodes.select("node").join(own, "node", "left").select("node", F.coalesce("root", "node").alias("work")), "works-works")
    in_c = F.col("sa") == "c"
    cross = links.where("sa <> sb").select(F.when(in_c, F.col("a")).otherwise(F.col("b")).alias("cs"), F.when(in_c, F.col("b")).otherwise(F.col("a")).alias("rs"), "n", "confidence")
    of = lambda c: work.select(F.col("node").alias(c), F.col("work").alias(c + "_work"))
    pairs = cross.join(of("cs"), "cs").join(of("rs"), "rs").groupBy(F.col("cs_work").alias("a"), F.col("rs_work").alias("b")).agg(F.max("confidence").alias("confidence"), F.sum("n").alias("support"))
    best = written(assigned(written(pairs, "works-pairs")), "works-best")
    # a pair of works goes by the id of its first
    ends = best.select(F.col("a").alias("work"), F.col("a").alias("pair"), "confidence").unionByName(best.select(F.col("b").alias("work"), F.col("a").alias("pair"), "confidence"))
    facts = written(variants.join(work, "node").join(ends, "work").select("cid", "n", F.col("pair").alias("work"), "confidence"), "works-facts")
    ids = rows.select("source", "id", F.xxhash64("source", "title", "kind", *_CITED).alias("cid"))
    return join_hot(ids, facts, ["cid"], "n").select("source", "id", "work", "confidence").distinct()


def match(citations: DataFrame, refs: DataFrame) -> DataFrame:
    """(mapping_id, ref_row_id, confidence) of rows that describe the same work; see :func:`work_members`."""
    members = written(work_members(citations, refs), "works-members")
    c = members.where("source = 'c'").select("work", F.col("id").alias("mapping_id"), "confidence")
    r = members.where("source = 'r'").select("work", F.col("id").alias("ref_row_id"))
    return c.join(r, "work").select("mapping_id", "ref_row_id", "confidence")
