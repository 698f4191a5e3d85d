"""Registered queries against DuckDB on the smallest tables."""

import glob

import duckdb
import pytest

import __spark_entry__
from dagframe import queries as engine_queries

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{FOLDER}/*.parquet"):
        c.sql(f"CREATE VIEW {p.rsplit('/', 1)[1].split('.')[0]} AS SELECT * FROM '{p}'")
    return c


def plain(names, rows):
    order = sorted(range(len(names)), key=lambda k: names[k])
    show = lambda v: round(v, 6) if isinstance(v, float) else v
    return sorted((tuple(show(r[k]) for k in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(engine_queries.QUERIES))
def test_against_duckdb(spark, duck, name):
    got = engine_queries.QUERIES[name](spark, FOLDER)
    want = duck.sql(engine_queries.ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got.columns, [tuple(r) for r in got.collect()]) == plain(want.columns, want.fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 3


def test_every_oracle_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
