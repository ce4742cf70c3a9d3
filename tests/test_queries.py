"""Every registered query beside its SQL twin, on the smallest tables."""

import pytest

from provloom.queries import ORACLES, QUERIES
from tests.oracle import connect, differences


#: Queries that begin at an element which the smallest tables lack.
LARGER = {"dsl_repeat_emit", "dsl_repeat_until", "dsl_unroll_path"}


@pytest.fixture(scope="module")
def connections(sf):
    return {False: (connect(sf), sf), True: (connect(sf.replace("0.001", "0.01")), sf.replace("0.001", "0.01"))}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_twin(spark, connections, name):
    con, sf = connections[name in LARGER]
    assert differences(spark, con, name, QUERIES[name], ORACLES[name], sf) is None


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - ORACLES.keys()))
def test_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() >= 0
