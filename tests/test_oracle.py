"""Every registered query against its SQL, on the smallest tables."""

from __future__ import annotations

import __spark_entry__ as entry
import pytest
from catalog import CATALOG
from compare import compare, connect

SF = "/root/testdata/sf0.001"
# Those of the library; other subpackages test their own.
QUERIES = {name: q.run for name, q in CATALOG.items()}
SQL = {name: q.sql for name, q in CATALOG.items() if q.sql is not None}


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, con, name):
    # With a handful of sensors a few results are empty on both sides; compare.py asks for rows at
    # the next scale.
    assert compare(spark, con, SF, QUERIES[name], SQL[name], need_rows=False) == []


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_gives_rows(spark, con, name):
    assert compare(spark, con, SF, QUERIES[name], None) == []


def test_entry(spark):
    out = entry.entry(spark)
    assert set(out.columns) == {"sensor_id", "n", "rmse", "mae", "r2", "too_few", "decision", "branch"}
    assert out.count() > 0


def test_sql_only_for_queries():
    assert set(SQL) <= set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
