"""Every registered query against its SQL, on the smallest tables."""

import compare
import pytest

import __spark_entry__ as entry

SF_DIR = "/root/testdata/sf0.001"
QUERIES, SQL = entry.queries(), entry.oracle_sql()
# Queries of the optional subpackage and the pipeline built on it.
OPTIONAL = {"pipeline", *(entry.llm_queries.QUERIES if entry.llm_queries else ())}


@pytest.fixture(scope="module")
def duck():
    return compare.connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    counts, problems, _ = compare.differences(spark, duck, SF_DIR, QUERIES[name], SQL[name])
    assert not problems, (counts, problems)


def test_every_query_has_sql():
    assert set(QUERIES) - OPTIONAL <= set(SQL) <= set(QUERIES)


def test_entry(spark):
    assert entry.entry(spark).count() == 1
