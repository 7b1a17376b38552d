"""Every registered query against its SQL on the smallest tables."""

import pytest

import oracle_check
from conftest import SF
from gridloom.plans import registry

registry.load_all()
ORACLES = registry.oracles()


# Too few rows in the smallest tables to have a result.
MAY_BE_EMPTY = {"fact_text_rank", "rank_of_point"}


@pytest.fixture(scope="module")
def con():
    return oracle_check.connect(SF)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_matches_sql(spark, con, name):
    problems = oracle_check.compare(registry.QUERIES[name](spark, SF), con, ORACLES[name])
    assert [p for p in problems if p != "EMPTY" or name not in MAY_BE_EMPTY] == []


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 1
    assert set(registry.QUERIES) <= set(entry.queries())
    assert set(registry.QUERIES) <= set(entry.oracle_sql()) <= set(entry.queries())
