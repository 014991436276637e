"""The driver's contract, and every query with SQL held against DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from tarn.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def normal(rows):
    def cell(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return ""
        return f"{v:.5f}" if isinstance(v, float) else str(v)

    return sorted(tuple(map(cell, r)) for r in rows)


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 60


@needs_data
@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_against_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = entry.queries()[name](spark, SF)
    want = con.execute(entry.oracle_sql()[name])
    names = sorted(got.columns)
    columns = [d[0] for d in want.description]
    assert sorted(columns) == names
    assert normal(tuple(r[c] for c in names) for r in got.collect()) == normal(tuple(r[columns.index(c)] for c in names) for r in want.fetchall())


@needs_data
def test_entry(spark):
    assert entry.entry(spark).count() > 0
