"""The operators that SQL can express give its rows on the driver's smallest tables."""

import glob
import os

import duckdb
import pytest

from brindle.llm import oracles, queries


@pytest.mark.parametrize("name", sorted(oracles.sql()))
def test_oracle(spark, data, name):
    db = duckdb.connect()
    for p in glob.glob(f"{data}/*.parquet"):
        db.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    want = db.sql(oracles.sql()[name])
    columns = sorted(want.columns)
    expected = sorted((tuple(r[want.columns.index(c)] for c in columns) for r in want.fetchall()), key=repr)
    got = queries.queries()[name](spark, data)
    assert sorted(got.columns) == columns
    assert sorted((tuple(r[c] for c in columns) for r in got.collect()), key=repr) == expected
