"""Each query with an oracle gives the oracle's rows."""

import glob
import os

import duckdb
import pytest

from brindle.plans import catalogue


@pytest.fixture(scope="module")
def db(data):
    c = duckdb.connect()
    for p in glob.glob(f"{data}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_oracle(spark, data, db, name):
    want = db.sql(catalogue.ORACLES[name])
    columns = sorted(want.columns)
    expected = sorted((tuple(r[want.columns.index(c)] for c in columns) for r in want.fetchall()), key=repr)
    got = catalogue.QUERIES[name](spark, data)
    assert sorted(got.columns) == columns
    assert sorted((tuple(r[c] for c in columns) for r in got.collect()), key=repr) == expected


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_rows_only(spark, data, name):
    assert catalogue.QUERIES[name](spark, data).count() > 0
