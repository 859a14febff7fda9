"""Every rule over literal rows against the rows that are stated for it."""

import duckdb
import pytest
from tests import literals
from tests.test_catalog import rows


@pytest.mark.parametrize("name", sorted(literals.QUERIES))
def test_stated_rows(spark, name):
    got, want = literals.QUERIES[name](spark, ""), duckdb.sql(literals.ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall())
