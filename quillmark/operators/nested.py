"""Flattening nested values into related child tables.

One pass visits every value depth first and emits tagged rows (table tag,
primary key, parent key, places, payload); written partitioned by tag, each part
gets its own schema.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quillmark.shared import own_dir


@dataclass(frozen=True)
class Level:
    """A child table: its tag, the field that holds its items, its own children.

    ``separator`` splits a plain text value of the level into items.
    """

    tag: str
    name: str
    children: tuple["Level", ...] = field(default_factory=tuple)
    separator: str | None = None


AFFILIATION = Level("affiliation", "affiliation", (Level("affiliation_department", "department"), Level("affiliation_id", "id")))
REF_AUTHOR = Level("ref_author", "author", (Level("ref_author_affiliation", "affiliation"),))
SUBJECT = Level("subject", "subject", (Level("subject_broader", "broader"),), separator=";")


def decoded(value):
    """A value as delivered: nested, plain text, or nested text of either, once or more."""
    while isinstance(value, str):
        text = value.strip()
        if text[:1] not in ("[", "{", '"'):
            return text or None
        try:
            value = json.loads(text)
        except ValueError:
            return text
    return value


def items(value, separator: str | None) -> Iterator[tuple[int, object]]:
    """(place from 1, item): null, blank and empty elements are none, but keep their place."""
    value = decoded(value)
    if isinstance(value, str) and separator:
        value = value.split(separator)
    for place, item in enumerate(value if isinstance(value, list) else [value], 1):
        item = decoded(item)
        if item is not None and item != []:
            yield place, item


def visit(level: Level, key: int, value, places: tuple[int, ...] = (), parent: str | None = None) -> Iterator[tuple]:
    """(tag, primary key, parent key, root key, places, payload), depth first."""
    for place, item in items(value, level.separator):
        at = (*places, place)
        own = f"{key}:{level.tag}:{'.'.join(map(str, at))}"
        held = {c.name for c in level.children}
        if isinstance(item, dict):
            payload = {k: v for k, v in item.items() if k not in held}
        else:
            payload = {"text": item}
        yield level.tag, own, parent, key, at, json.dumps(payload, ensure_ascii=False)
        if isinstance(item, dict):
            for child in level.children:
                yield from visit(child, key, item.get(child.name), at, own)


EMITTED = "tag string, item_id string, parent_item_id string, root_id bigint, ord1 int, ord2 int, payload string"


def emit(df: DataFrame, key: str, column: str, level: Level) -> DataFrame:
    """(tag, item_id, parent_item_id, root_id, ord1, ord2, payload) of ``column``.

    ``root_id`` is the row's ``key``; ord1 is the place of the item in the value,
    ord2 its place within that item (0 at the first level). Null, empty and
    blank values give no rows; malformed JSON is plain text; repeated rows give
    equal rows once per row; other columns are ignored.
    """
    names = ["tag", "item_id", "parent_item_id", "root_id", "ord1", "ord2", "payload"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [r for k, v in zip(*(c.to_pylist() for c in batch.columns)) for r in visit(level, k, v)]
            tag, own, parent, root, at, payload = zip(*rows) if rows else [()] * 6
            yield pa.RecordBatch.from_arrays(
                [pa.array(tag, pa.string()), pa.array(own, pa.string()), pa.array(parent, pa.string()), pa.array(root, pa.int64()), pa.array([x[0] for x in at], pa.int32()), pa.array([x[1] if len(x) > 1 else 0 for x in at], pa.int32()), pa.array(payload, pa.string())],
                names=names,
            )

    source = df.select(F.col(key).cast("bigint"), F.col(column).cast("string")).where(F.length(F.trim(F.col(column))) > 0)
    return source.mapInArrow(run, EMITTED)


#: Payload of each child table.
SCHEMAS = {
    "affiliation": "name string, text string, place struct<city:string,country:string>", "affiliation_department": "name string, text string, room string", "affiliation_id": "id string, `id-type` string, text string",
    "ref_author": "family string, given string, name string, text string, sequence string", "ref_author_affiliation": "name string, text string", "subject": "term string, text string, scheme string", "subject_broader": "term string, text string, code string",
}


def write_tables(emitted: DataFrame, path: str) -> None:
    """One write for all child tables, partitioned by tag."""
    emitted.write.partitionBy("tag").parquet(path)


def read_tables(spark: SparkSession, path: str) -> DataFrame:
    """What :func:`write_tables` wrote; a filter on the tag reads that part only. With no
    item at all it is empty."""
    return spark.read.schema(EMITTED).option("basePath", path).parquet(path)


def flattened(emitted: DataFrame, label: str = "nested") -> DataFrame:
    """``emitted`` written partitioned by tag into the shared folder, and read back."""
    path = f"{own_dir(emitted.sparkSession)}/{label}-{uuid.uuid4().hex}"
    write_tables(emitted, path)
    return read_tables(emitted.sparkSession, path)


def child_table(emitted: DataFrame, tag: str, schema: StructType | str | None = None) -> DataFrame:
    """The rows of one tag with its schema (or another one) applied to their payload; fields that are missing are null."""
    own = emitted.where(F.col("tag") == tag)
    keys = ["item_id", "parent_item_id", "root_id", "ord1", "ord2"]
    return own.select(*keys, F.from_json("payload", schema or SCHEMAS[tag]).alias("p")).select(*keys, "p.*")


def child_items(authors: DataFrame, refs: DataFrame, metadata: DataFrame) -> DataFrame:
    """(item_kind, parent_id, ord1, ord2) of every child item of the three tables, distinct."""
    parts = [emit(authors, "author_id", "affiliation", AFFILIATION), emit(refs, "ref_row_id", "author", REF_AUTHOR), emit(metadata, "paper_id", "subject", SUBJECT)]
    rows = flattened(parts[0].unionByName(parts[1]).unionByName(parts[2]))
    return rows.select(F.col("tag").alias("item_kind"), F.col("root_id").alias("parent_id"), "ord1", "ord2").distinct()
