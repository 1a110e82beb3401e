"""Queries with SQL agree with DuckDB on the given tables; those without have rows."""

from __future__ import annotations

import pytest
from compare import compare, connect

from sensorspark.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_agrees_with_sql(spark, name):
    assert compare(spark, connect(SF), SF, QUERIES[name], SQL[name]) == []


def test_one_query_an_operator():
    assert sorted(int(n.split("_")[0][2:]) for n in QUERIES) == list(range(1, 14))
