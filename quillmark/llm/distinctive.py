"""How characteristic a term is of a record: a two-Poisson mixture per term.

Over the records of a collection a term's count comes from one of two Poisson
components, a low one (mentioned in passing) and an elite one (the record is
about it). The mixture is fitted by expectation-maximisation on the term's
frequency histogram; an occurrence count is scored by the posterior probability of
the elite component. Where a term is absent from most records the low mean goes to
0 and that posterior is 1 from the first occurrence on, so terms are ranked by the
posterior times the count times minus the logarithm of the elite component's share.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.shared import join_hot, written


def term_key(term: Column) -> Column:
    """Lower case, trimmed, single blanks."""
    return F.trim(F.regexp_replace(F.lower(term), r"(?U)\s+", " "))


def fit(count: np.ndarray, records: np.ndarray, term: np.ndarray, n_terms: int, total: float, rounds: int = 60) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(share of the elite component, low mean, elite mean) of each term.

    Histogram in long form: ``records`` of the term numbered ``term`` have it
    ``count`` times, the rest of the ``total`` records not at all.
    """
    add = lambda x: np.bincount(term, x, n_terms)
    with_it, mass = add(records), add(records * count)
    without = np.maximum(total - with_it, 0.0)
    floor = 0.1 / total
    mean = mass / np.maximum(with_it, 1.0)
    share = np.clip(with_it / total * 0.5, floor, 0.5)
    elite = np.maximum(mean, 1.0)
    low = np.clip(mass / total * 0.1, floor, elite * 0.5)
    for _ in range(rounds):
        prior = np.log(share) - np.log1p(-share)
        odds = prior[term] + count * (np.log(elite) - np.log(low))[term] - (elite - low)[term]
        post = 1.0 / (1.0 + np.exp(-np.clip(odds, -500, 500)))
        none = 1.0 / (1.0 + np.exp(-np.clip(prior - (elite - low), -500, 500)))
        n_elite = add(records * post) + without * none
        n_low = np.maximum(total - n_elite, 1e-9)
        share = np.clip(n_elite / total, floor, 1 - floor)
        elite = np.maximum(add(records * count * post) / np.maximum(n_elite, 1e-9), 2 * floor)
        low = np.clip(add(records * count * (1 - post)) / n_low, floor, None)
        low, elite = np.minimum(low, elite), np.maximum(low, elite)
        low = np.minimum(low, elite * 0.999)
    return share, low, elite


def counts(rows: DataFrame, record: list[str], term: str, n: str) -> DataFrame:
    """(record..., term, n): repeated rows count once, spellings of a term add up.

    Rows without a term, with a blank term or without a positive count are left
    out; null record fields are values of their own.
    """
    own = rows.where(F.col(n) > 0).dropDuplicates()
    return own.select(*record, term_key(F.col(term)).alias("term"), F.col(n).cast("bigint").alias("n")).where(F.length("term") > 0).groupBy(*record, "term").agg(F.sum("n").alias("n"))


def mixtures(counted: DataFrame, record: list[str]) -> DataFrame:
    """(term, share, low, elite, n_records) of every term."""
    total = counted.select(*record).distinct().count()
    histogram = counted.groupBy("term", "n").agg(F.count("*").alias("records")).groupBy("term").agg(F.collect_list("n").alias("n"), F.collect_list("records").alias("records"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.diff(batch.column(1).offsets.to_numpy())
            term = np.repeat(np.arange(batch.num_rows), sizes)
            count, records = (batch.column(i).flatten().to_numpy().astype(float) for i in (1, 2))
            share, low, elite = fit(count, records, term, batch.num_rows, float(total))
            n_records = np.bincount(term, records, batch.num_rows).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, (share, low, elite, n_records))], names=["term", "share", "low", "elite", "n_records"])

    return histogram.mapInArrow(run, "term string, share double, low double, elite double, n_records bigint")


def scores(rows: DataFrame, record: list[str], term: str = "ngram", n: str = "n") -> DataFrame:
    """(record..., term, n, posterior, weight) of every term of every record.

    An empty table gives an empty table. Equal counts of a term have equal
    scores.
    """
    counted = written(counts(rows, record, term, n), "term-counts")
    fitted = written(mixtures(counted, record), "term-mixtures")
    odds = F.log("share") - F.log1p(-F.col("share")) + F.col("n") * (F.log("elite") - F.log("low")) - (F.col("elite") - F.col("low"))
    posterior = 1 / (1 + F.exp(-odds))
    return join_hot(counted, fitted, ["term"], "n_records").select(*record, "term", "n", posterior.alias("posterior"), (posterior * F.col("n") * -F.log("share")).alias("weight"))


def most_characteristic(rows: DataFrame, record: list[str], k: int = 3, term: str = "ngram", n: str = "n") -> DataFrame:
    """(record..., term) of the ``k`` terms with the highest weight; ties by term."""
    order = Window.partitionBy(*record).orderBy(F.desc("weight"), "term")
    return scores(rows, record, term, n).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(*record, "term")
