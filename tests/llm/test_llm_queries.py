"""Queries with SQL against DuckDB on the smallest tables."""

import glob

import duckdb
import pytest

from dagframe.llm.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_duckdb(spark, name):
    c = duckdb.connect()
    for p in glob.glob(f"{FOLDER}/*.parquet"):
        c.sql(f"CREATE VIEW {p.rsplit('/', 1)[1].split('.')[0]} AS SELECT * FROM '{p}'")
    want, got = c.sql(ORACLES[name]), QUERIES[name](spark, FOLDER)
    assert sorted(got.columns) == sorted(want.columns)
    order = sorted(want.columns)
    show = lambda rows: sorted([tuple(round(v, 5) if isinstance(v, float) else v for v in r) for r in rows], key=repr)
    assert show(got.select(*order).collect()) == show(want.select(*order).fetchall())
