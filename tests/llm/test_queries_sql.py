"""Registered queries against their SQL, and the driver's contract for them."""

import pytest

from vectrail.llm import queries

SQL = queries.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, small, same_rows, name):
    same_rows(queries.queries()[name](spark, small), SQL[name])


def test_ten_operators():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries() if n.startswith("op")) == list(range(1, 11))
