"""Every catalog query against its SQL on DuckDB, rows and column names alike."""

import datetime
import math

import duckdb
import pytest
from tallyglass.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES.split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def cell(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def rows(names, found):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(str([cell(r[i]) for i in order]) for r in found)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_its_sql(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF)
    want = duck.sql(catalog.ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall())


def test_every_query_runs(spark):
    for name in set(catalog.QUERIES) - set(catalog.ORACLES):
        assert catalog.QUERIES[name](spark, SF).count() > 0
