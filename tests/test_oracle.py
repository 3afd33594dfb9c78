"""Every catalogue query with SQL, value by value against DuckDB on the driver's files."""

import os

import pytest
from check import compare, connect

from loomline.queries.catalogue import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.01"
# Minutes of DuckDB time each; run them with tools/check.py.
SLOW = {"previous_lookback", "feature_matrix_full"}

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="driver tables absent")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(set(ORACLES) - SLOW))
def test_matches_sql(spark, con, name):
    assert compare(spark, con, FOLDER, name) == ""


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
    assert not [n for n in QUERIES if n.startswith("op") or "pipeline" in n]
