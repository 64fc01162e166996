"""Every registered query that has SQL agrees with it; every other one runs."""

import pytest
from oracle import check

import __spark_entry__ as entry
from inkledger.plans import extraction, files, scalars, tables

QUERIES = {k: q for r in (scalars.REG, tables.REG, extraction.REG, files.REG) for k, q in r.queries.items()}
SQL = {k: q for r in (scalars.REG, tables.REG, extraction.REG, files.REG) for k, q in r.sql.items()}


@pytest.mark.parametrize("key", sorted(SQL))
def test_matches_sql(spark, sf, key):
    check(spark, sf, QUERIES[key], SQL[key])


@pytest.mark.parametrize("key", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, sf, key):
    assert QUERIES[key](spark, sf).count() > 0


def test_registry(spark):
    assert set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
