"""Every catalogue query against its oracle at the smallest scale."""

import pytest

from __spark_entry__ import entry
from careerloom.plans.catalogue import QUERIES
from careerloom.plans.oracle import ORACLE
from tools.check import canonical, oracle_db


@pytest.fixture(scope="module")
def db(sf):
    return oracle_db(sf)


def test_every_oracle_has_a_query():
    assert set(ORACLE) == set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_oracle(spark, sf, db, name):
    got = QUERIES[name](spark, sf).toPandas()
    want = db.execute(ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)


def test_entry(spark):
    assert entry(spark).count() > 0
