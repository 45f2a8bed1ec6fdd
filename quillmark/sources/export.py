"""Results written out as files."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from quillmark.shared import own_dir


def export(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """``df`` as files of a format of Spark's ('csv' with a header line, 'parquet', 'json')."""
    writer = df.write.option("header", True).option("escape", '"') if fmt == "csv" else df.write
    writer.format(fmt).save(path)


def imported(spark, path: str, schema, fmt: str = "csv") -> DataFrame:
    """What :func:`export` wrote, with its schema."""
    reader = spark.read.schema(schema)
    return (reader.option("header", True).option("escape", '"') if fmt == "csv" else reader).format(fmt).load(path)


def exported(df: DataFrame, fmt: str = "csv") -> DataFrame:
    """``df`` written to the shared folder in a format and read back."""
    path = f"{own_dir(df.sparkSession)}/export-{uuid.uuid4().hex}"
    export(df, path, fmt)
    return imported(df.sparkSession, path, df.schema, fmt)
