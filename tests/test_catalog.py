"""Every query with SQL gives what another engine gives on the same tables."""

import os

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry
from pointloom import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def _same(left, right):
    columns = sorted(left.columns)
    assert columns == sorted(right.columns)
    key = lambda df: df[columns].sort_values(columns).reset_index(drop=True).astype(str)
    assert len(left) == len(right)
    a, b = left[columns].sort_values(columns).reset_index(drop=True), right[columns].sort_values(columns).reset_index(drop=True)
    for c in columns:
        if a[c].dtype.kind == "f" or b[c].dtype.kind == "f":
            there = a[c].notna()
            assert (there == b[c].notna()).all(), c
            assert (abs(a[c][there].astype(float) - b[c][there].astype(float)) < 1e-3).all(), c
        else:
            assert (key(left)[c] == key(right)[c]).all(), c


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_equals_sql(spark, con, name):
    _same(catalog.QUERIES[name](spark, SF).toPandas(), con.sql(catalog.ORACLES[name]).df())


def test_wrong_numbers_and_nulls_are_seen():
    """What compares the results sees one wrong number, one null too many and one too few."""
    good = pd.DataFrame({"a": [1, 2, 3], "x": [0.5, np.nan, 2.0]})
    _same(good, good.assign(x=good.x + 1e-5))
    for x in ([0.5, np.nan, 9.0], [0.5, 1.0, 2.0], [np.nan, np.nan, 2.0], [9.0, np.nan, 99.0]):
        with pytest.raises(AssertionError):
            _same(good, good.assign(x=x))


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_oracles_are_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
