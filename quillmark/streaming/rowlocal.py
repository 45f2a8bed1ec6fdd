"""Row-local operators on streams: the same column expressions as in batch.

They keep no state, so any output mode and sink will do; operators with groups
or ranks belong in ``foreachBatch``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.functions.text import readability
from quillmark.operators.citations import scan


def readability_stream(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, indices...) of each arriving document."""
    return docs.select("doc_id", readability(F.col(text)).alias("r")).select("doc_id", "r.*")


def citation_stream(docs: DataFrame, text: str = "text", citation_type: str = "all") -> DataFrame:
    """In-text citations of each arriving document."""
    return scan(docs, text, citation_type)


def per_batch(operator: Callable[[DataFrame], DataFrame], path: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that runs a batch operator on each micro-batch and
    writes it under its batch number, so that a batch run again replaces itself."""

    def run(batch: DataFrame, number: int) -> None:
        operator(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return run
