"""Every registered query against its SQL on the smallest tables."""

import pytest

from conftest import SMALL
from workload.check import compare
from workload.oracle import ORACLE
from workload.queries import QUERIES


def test_every_sql_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    result = compare(spark, SMALL, name)
    assert result["ok"], result
