"""Every registered query beside its SQL twin, on the smallest tables."""

import pytest

from oracle import compare, duck
from rolescope.plans import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, connection, name):
    assert compare(spark, connection, SF, QUERIES[name], ORACLES[name]) is None


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(ORACLES)
