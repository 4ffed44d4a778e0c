"""Every query with SQL gives the rows DuckDB gives, on whole tables."""

from __future__ import annotations

import os

import pytest

from postmill.bindings import ORACLES, QUERIES
from tests import oracle

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return oracle.tables(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    names, rows = oracle.spark_rows(QUERIES[name](spark, SF))
    if name not in ORACLES:
        assert names
        return
    assert (names, rows) == oracle.sql_rows(con, ORACLES[name])
