"""Every registered query with a SQL twin must match it; a fast subset runs here, the whole set with
``python tests/compare.py``."""

import pytest

from compare import compare, connect
from posegrid.catalog import load

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = load()
FAST = [n for n in ORACLES if n[0] in "apfu" or n.startswith(("j01", "j03", "j07", "j10", "w0", "s0", "s1", "t0", "c10"))]


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", FAST)
def test_query_matches_sql(spark, con, name):
    assert compare(spark, con, name, QUERIES[name], ORACLES[name], SF) is None


def test_names_match():
    assert set(ORACLES) <= set(QUERIES)
