"""Every query against its SQL on whole tables."""

import pytest

import check
from feedloom.plans.catalog import QUERIES
from feedloom.plans.oracles import ORACLES


@pytest.fixture(scope="module")
def db(sf):
    return check.connect(sf)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, db, name):
    same, note = check.compare(spark, db, sf, name)
    assert same, note
