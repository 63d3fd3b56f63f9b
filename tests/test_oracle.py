"""Every query of the engine against its SQL."""

import pytest

import oracle
from tallyhound.plans import ALL_QUERIES, ALL_SQL


@pytest.fixture(scope="module")
def db(sf):
    return oracle.views(sf)


@pytest.mark.parametrize("name", sorted(ALL_QUERIES))
def test_query(spark, sf, db, name):
    frame = ALL_QUERIES[name](spark, sf)
    if name in ALL_SQL:
        assert not oracle.difference(frame, ALL_SQL[name], db)
    else:
        assert frame.count() > 0
