"""Every registered query runs on the smallest data set, and equals its SQL there."""
import pytest

import oracle_check as oc
from barloom.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oc.connect(FOLDER)


def test_every_query_has_sql():
    assert [q for q in QUERIES if q not in ORACLES] in ([], ["backtest"])
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    ok, note = oc.compare(spark, con, FOLDER, name, QUERIES[name], ORACLES.get(name))
    assert ok, note
