"""Every registered query against its SQL, over the whole small tables."""

import pytest

import oracle
from __spark_entry__ import QUERIES, entry, oracle_sql, queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(n for n, e in QUERIES.items() if e.sql))
def test_matches_sql(spark, name):
    assert oracle.differences(spark, SF, QUERIES[name]) is None


@pytest.mark.parametrize("name", sorted(n for n, e in QUERIES.items() if not e.sql))
def test_runs_without_sql(spark, name):
    assert QUERIES[name].run(spark, SF).count() > 0


def test_contract(spark):
    assert entry(spark).count() > 0
    assert set(oracle_sql()) <= set(queries())
