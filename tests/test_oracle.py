"""Every registered query with SQL against DuckDB on the smallest tables."""

import os
import warnings

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SQL = entry.oracle_sql()
QUERIES = entry.queries()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, (list, np.ndarray)):
        return str([plain(x) for x in v])
    if v is None or pd.isna(v):
        return None
    return round(float(v), 4) if isinstance(v, (int, float, np.number)) and not isinstance(v, bool) else str(v)


def rows(frame):
    cols = sorted(frame.columns)
    return cols, sorted((tuple(map(plain, r)) for r in frame[cols].itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", [n for n in QUERIES if n in SQL])
def test_against_sql(spark, duck, sf, name):
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        got = QUERIES[name](spark, sf).toPandas()
    assert rows(got) == rows(duck.execute(SQL[name]).df())


@pytest.mark.parametrize("name", ["random_sample", "generated_catalog"])
def test_rows_only(spark, sf, name):
    a, b = (QUERIES[name](spark, sf).toPandas() for _ in range(2))
    assert len(a) and rows(a) == rows(b)  # seeded: the same rows again


def test_entry(spark):
    if os.path.isdir(entry.DATA):
        assert entry.entry(spark).count() > 0
