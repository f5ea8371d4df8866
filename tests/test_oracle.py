"""Every query against its SQL in DuckDB."""

import pytest

from checks.catalogue import ORACLES, QUERIES
from checks.compare import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    same, ours, theirs, notes = compare(QUERIES[name](spark, SF), duck, ORACLES[name])
    assert same, notes
    assert ours == theirs > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql()) <= set(entry.queries())
