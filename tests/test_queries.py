"""Every registered query of the library against its SQL on the smallest tables."""

import pytest

from tenderlake.plans import ingest, matching, normalisation, product, records, streams

from .compare import rows_of, rows_of_sql

QUERIES, SQL = {}, {}
for m in (matching, ingest, normalisation, product, records, streams):
    QUERIES |= m.QUERIES
    SQL |= m.SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, sf_dir, duck, name):
    assert rows_of(QUERIES[name](spark, sf_dir)) == rows_of_sql(duck, SQL[name])


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - SQL.keys()))
def test_has_rows(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert e.oracle_sql().keys() <= e.queries().keys()
