"""Invariants that hold on any data, and determinism across partitionings."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from conftest import SF_SMALL
from sitepulse.plans import params as P
from sitepulse.plans.bindings import bind_events

Q = E.queries()


def test_rollup_row_per_registry_entity(spark):
    b = bind_events(spark, SF_SMALL)
    assert Q["period_rollup"](spark, SF_SMALL).count() == b.registry.count()


def test_activity_le_entry_le_days(spark):
    days = (P.RANGE[1] - P.RANGE[0]).days + 1
    r = Q["period_rollup"](spark, SF_SMALL)
    assert r.where((F.col("activity") > F.col("entry")) | (F.col("entry") > days)).count() == 0


def test_lists_partition_the_rollup(spark):
    r = Q["period_rollup"](spark, SF_SMALL)
    assert Q["no_activity_list"](spark, SF_SMALL).count() == r.where("activity = 0").count()
    assert Q["has_entries_list"](spark, SF_SMALL).count() == r.where("entry <> 0").count()


def test_level_counts_sum_to_registry(spark):
    long = Q["entry_levels_long"](spark, SF_SMALL)
    total = long.agg(F.sum("n")).first()[0]
    assert total == Q["period_rollup"](spark, SF_SMALL).count()
    shares = long.groupBy("block", "area_type", "school_type").agg(F.sum("share").alias("s"))
    assert shares.where("s IS NOT NULL AND abs(s - 1) > 1e-9").count() == 0


def test_coverage_present_le_total(spark):
    cov = Q["daily_coverage_long"](spark, SF_SMALL)
    assert cov.where("present > total").count() == 0
    b = bind_events(spark, SF_SMALL)
    assert cov.agg(F.sum("total")).first()[0] == b.registry.count()


@pytest.mark.parametrize("name", ["period_rollup", "activity_levels_wide", "latest_per_day", "block_summary"])
def test_same_answer_under_any_partitioning(spark, name):
    def rows():
        return sorted(map(tuple, Q[name](spark, SF_SMALL).collect()), key=repr)

    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "1")
        a = rows()
        spark.conf.set("spark.sql.shuffle.partitions", "64")
        b = rows()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert a == b


def test_range_reports_share_one_checkpointed_rollup(spark):
    from sitepulse.plans import reports as R

    b = bind_events(spark, SF_SMALL)
    lazy = R.range_reports(b.log, b.registry, *P.RANGE, roles=b.roles)
    cut = R.range_reports(b.log, b.registry, *P.RANGE, roles=b.roles, materialize=True)
    for k in lazy:
        a = sorted(map(tuple, lazy[k].collect()), key=repr)
        c = sorted(map(tuple, cut[k].collect()), key=repr)
        assert a == c, k
    # the checkpointed rollup no longer plans a scan of the log
    import contextlib
    import io

    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        cut["entry_levels"].explain()
    assert "events.parquet" not in buf.getvalue()


def test_same_answer_on_shuffled_input(spark):
    from sitepulse.operators import flag_repeats, period_rollup

    b = bind_events(spark, SF_SMALL)

    def rows(df):
        return sorted(map(tuple, df.collect()), key=repr)

    base = rows(period_rollup(b.log, b.registry, *P.RANGE, roles=b.roles))
    flags = rows(flag_repeats(b.log, b.roles))
    for shuffled in (b.log.orderBy(F.rand(7)), b.log.repartition(13), b.log.repartition(3, "seq")):
        assert rows(period_rollup(shuffled, b.registry.repartition(5), *P.RANGE, roles=b.roles)) == base
        assert rows(flag_repeats(shuffled, b.roles)) == flags
