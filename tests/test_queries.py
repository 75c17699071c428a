"""Every registered query against its SQL at the smallest scale; where that has no rows, at the next one."""

import os

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from oracle import compare, connect

FOLDER, NEXT = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
HEAVY = {"ml_fusion_experiment"}  # two forests and two boosted models; tests/test_models.py has a small one
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no driver tables")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", [n for n in queries() if n not in HEAVY])
def test_query_equals_its_sql(spark, con, name):
    problem = compare(spark, con, FOLDER, name, queries()[name], oracle_sql().get(name))
    if problem == "no rows on either side":
        problem = compare(spark, connect(NEXT), NEXT, name, queries()[name], oracle_sql().get(name))
    assert problem == "", problem


def test_every_oracle_has_its_query():
    assert set(oracle_sql()) <= set(queries())


def test_entry(spark):
    assert entry(spark).count() > 0
