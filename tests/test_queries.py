"""Every registered query with an oracle agrees with it; the others return rows."""

import pytest

from tests.oracle import ORACLES, QUERIES, compare, connect
from cladeframe.plans.catalog import alignment, operations, trees

FAST = [n for m in (alignment, trees, operations) for n in m.Q]


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", FAST)
def test_query(spark, con, sf, name):
    status, message, _ = compare(spark, con, sf, name)
    assert status in ("ok", "rows"), message
    assert "TYPES" not in message


def test_registry():
    assert set(ORACLES) <= set(QUERIES)
    assert len(QUERIES) > 150
