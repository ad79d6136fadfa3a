"""Every registered query of the library against its SQL, on the smallest tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from check import compare, connect
from queries import catalog

FOLDER = "/root/testdata/sf0.001"
NAMES = list(catalog.REGISTRY)


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


def test_every_query_has_sql():
    assert set(NAMES) == {name for name in entry.oracle_sql() if name in catalog.REGISTRY}


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, duck, name):
    rows, problem = compare(spark, duck, name, FOLDER)
    assert problem is None, problem
    assert rows > 0
