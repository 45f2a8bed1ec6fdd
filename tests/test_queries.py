"""Every core query runs, has rows, and agrees with its SQL twin on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from quillmark.plans import catalog

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


def _value(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (int, float)) or hasattr(v, "quantize"):
        return round(float(v), 5) + 0.0
    return str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, name):
    df = QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    rows = sorted(repr([_value(r[c]) for c in columns]) for r in df.collect())
    if name not in SQL:
        return
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    got = con.execute(SQL[name])
    names = [c[0] for c in got.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert sorted(repr([_value(r[i]) for i in order]) for r in got.fetchall()) == rows


def test_entry_without_training_operators():
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries())
