"""Every query against its SQL on the smallest test tables."""

import os

import pytest

import compare
from workload import ORACLES, QUERIES

# rules that need not find anything in the smallest tables
MAY_BE_EMPTY = {n for n in QUERIES if n.startswith("warn")} | {"cycles"}
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return compare.connect(SF)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    found = compare.check(spark, con, name, SF)
    assert found is None or (found == "both empty" and name in MAY_BE_EMPTY)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
