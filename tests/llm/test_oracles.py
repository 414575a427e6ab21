"""Operators with SQL against it, on the smallest tables."""

import pytest

from tenderlake.llm.queries import ORACLE_SQL, QUERIES

from ..compare import rows_of, rows_of_sql


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, sf_dir, duck, name):
    assert rows_of(QUERIES[name](spark, sf_dir)) == rows_of_sql(duck, ORACLE_SQL[name])
