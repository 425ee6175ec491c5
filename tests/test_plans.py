"""Plan shape checks: the physical plans we rely on at scale."""

from __future__ import annotations

import contextlib
import io

import pytest

import __spark_entry__ as E
from sitepulse.plans.catalog import QUERIES
from conftest import SF_SMALL


def plan(df, mode: str = "formatted") -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode=mode)
    return buf.getvalue()


def test_latest_per_day_uses_window_group_limit(spark):
    p = plan(E.queries()["latest_per_day"](spark, SF_SMALL))
    assert "WindowGroupLimit" in p and "Partial" in p and "Final" in p


@pytest.mark.parametrize("name", ["period_rollup", "daily_coverage_long", "block_summary"])
def test_date_filter_pushed_to_scan(spark, name):
    p = plan(E.queries()[name](spark, SF_SMALL))
    assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts," in p


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_python_udf(spark, name):
    p = plan(E.queries()[name](spark, SF_SMALL))
    for op in ("BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas", "MapInPandas", "PythonUDF"):
        assert op not in p


def test_column_pruning_on_log_scan(spark):
    p = plan(E.queries()["daily_series"](spark, SF_SMALL))
    assert "ReadSchema: struct<ts:timestamp_ntz>" in p
