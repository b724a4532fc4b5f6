"""Every query with SQL gives the rows of its SQL, over whole tables."""

from pathlib import Path

import pytest

import __spark_entry__ as entry
from termloom.plans.oracles import ORACLES
from termloom.plans.queries import QUERIES
from tests.oracle import agree

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_core_query(spark, name):
    got, want = agree(spark, SF, QUERIES[name], ORACLES[name])
    assert got == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(ORACLES) <= set(QUERIES) and set(entry.oracle_sql()) <= set(entry.queries())
