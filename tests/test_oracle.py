"""Every query against its SQL, on the smallest tables."""

import pytest

from tools.check_oracle import compare, connect
from workload.oracle import statements
from workload.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


def test_every_query_has_sql():
    assert set(statements()) == set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, name):
    verdict = compare(spark, duck, SF, name)
    assert verdict.startswith("ok"), verdict
