"""Every registered query equals its DuckDB oracle (rows, columns, values)."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as E
from sitepulse.plans.catalog import QUERIES
from oracle_compare import compare, duck
from conftest import SF_SMALL

NAMES = sorted(QUERIES)
# SITEPULSE_ORACLE_SF=/root/testdata/sf0.01 runs the gate's own scale
SF = os.environ.get("SITEPULSE_ORACLE_SF", SF_SMALL)


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_query_has_an_oracle():
    assert set(QUERIES) <= set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.parametrize("name", NAMES)
def test_matches_oracle(spark, con, name):
    r = compare(spark, con, name, E.queries()[name], E.oracle_sql()[name], SF)
    assert r["ok"], r


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "entry" in df.columns
