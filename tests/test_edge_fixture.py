"""Edge cases with hand-computed answers (FIXTURES.md section 4)."""

from __future__ import annotations

import datetime as dt

import pytest

import fixture_edge as FX
from sitepulse.operators import (
    daily_coverage_long,
    daily_coverage_wide,
    entity_detail,
    month_rollup,
    monthly_crosstab,
    period_rollup,
)
from sitepulse.operators.crosstab import activity_levels_wide
from sitepulse.plans import reports as R

JULY = dt.date(2025, 7, 17)


@pytest.fixture(scope="module")
def tables(spark):
    return FX.registry(spark), FX.log(spark)


@pytest.fixture(scope="module")
def july(tables):
    reg, log = tables
    return month_rollup(log, reg, JULY, roles=FX.ROLES)


def test_rollup(july):
    got = {r.record_id: (r.entry, r.participants, r.activity) for r in july.collect()}
    assert got == {
        "S1-1": (2, 32.0, 1),
        "S1-2": (0, 0.0, 0),
        "S1-3": (1, 0.0, 1),
        "S2-1": (1, 5.0, 0),
        "S2-2": (1, 7.0, 1),
        "NOID": (1, 0.0, 1),
        "S3-7-b": (1, 4.0, 1),
    }


def test_key_split_in_rollup(july):
    got = {r.record_id: (r.site_code, r.id_code, r.id_num) for r in july.collect()}
    assert got["NOID"] == ("NOID", None, None)
    assert got["S3-7-b"] == ("S3", "7-b", None)
    assert got["S1-1"] == ("S1", "1", 1.0)


def test_coverage(tables):
    reg, log = tables
    day = dt.date(2025, 7, 2)
    got = {
        (r.block, f"{r.area_type}_{r.school_type}"): (r.present, r.total)
        for r in daily_coverage_long(log, reg, day, roles=FX.ROLES).collect()
    }
    assert got == {
        ("East", "R_GA"): (1, 1),
        ("North", "R_GS"): (2, 2),
        ("North", "U_GA"): (0, 1),
        ("South", "U_PS"): (2, 2),
        ("West", "R_PS"): (0, 1),
    }
    mixed = daily_coverage_long(log, reg, day, roles=FX.ROLES, only_mixed=True).collect()
    assert {r.block for r in mixed} == {"North"}
    wide = {r.block: r.asDict() for r in daily_coverage_wide(log, reg, day, roles=FX.ROLES).collect()}
    assert set(wide) == {"East", "North", "South", "West"}
    assert wide["North"]["R_GS"] == 2 and wide["North"]["R_GS_P"] == 1.0
    assert wide["North"]["U_GA"] == 0 and wide["North"]["U_GA_P"] == 0.0
    assert wide["North"]["U_PS_P"] is None  # 0 of 0
    assert wide["North"]["total"] == 2 and wide["North"]["total_P"] == pytest.approx(2 / 3)


def test_entry_levels_north(july):
    rows = {r.entry: r.asDict() for r in R.entry_levels_wide(july).where("block = 'North'").collect()}
    assert sorted(rows) == [0, 1, 2]
    assert [rows[i]["R_GS_entry"] for i in (0, 1, 2)] == [0, 1, 1]
    assert [rows[i]["R_GS_entry_P"] for i in (0, 1, 2)] == [0.0, 0.5, 0.5]
    assert [rows[i]["U_GA_entry"] for i in (0, 1, 2)] == [1, 0, 0]
    assert [rows[i]["U_GA_entry_P"] for i in (0, 1, 2)] == [1.0, 0.0, 0.0]
    for i in (0, 1, 2):
        assert rows[i]["U_PS_entry"] == 0 and rows[i]["U_PS_entry_P"] is None


def test_activity_levels(july):
    got = {}
    for r in R.activity_levels_long(july).where("n > 0").collect():
        got[(r.block, f"{r.area_type}_{r.school_type}", r.activity)] = (r.n, float(r.participants))
    assert got == {
        ("East", "R_GA", 1): (1, 0.0),
        ("North", "R_GS", 1): (2, 32.0),
        ("North", "U_GA", 0): (1, 0.0),
        ("South", "U_PS", 0): (1, 5.0),
        ("South", "U_PS", 1): (1, 7.0),
        ("West", "R_PS", 1): (1, 4.0),
    }
    wide = {r.activity: r for r in activity_levels_wide(july).where("block = 'South'").collect()}
    assert wide[0]["U_PS_participants_P"] == 5 / 12 and wide[1]["U_PS_participants_P"] == 7 / 12


def test_monthly_crosstab(july):
    got = {}
    for r in monthly_crosstab(july).collect():
        d = r.asDict()
        got[r.block] = tuple(
            sum(v for k, v in d.items() if k.startswith(m + "_")) for m in ("entry", "activity", "participants")
        )
    assert got == {"East": (1, 1, 0), "North": (3, 2, 32), "South": (2, 1, 12), "West": (1, 1, 4)}


def test_lists(july):
    assert {r.record_id for r in R.no_activity_list(july).collect()} == {"S1-2", "S2-1"}
    assert {r.record_id for r in R.has_entries_list(july).collect()} == {
        "NOID",
        "S1-1",
        "S1-3",
        "S2-1",
        "S2-2",
        "S3-7-b",
    }


def test_series(tables):
    reg, log = tables
    got = {r.day: r.entries for r in R.daily_series(log, FX.ROLES).collect()}
    d = dt.date
    assert got == {d(2025, 7, 2): 9, d(2025, 7, 3): 1, d(2025, 7, 31): 1, d(2025, 8, 1): 1, None: 1}
    by_block = {
        r.block: r.entries
        for r in R.daily_series_by_block(log, reg, roles=FX.ROLES).where(f"day = DATE'2025-07-02'").collect()
    }
    assert by_block == {"East": 1, "North": 4, "South": 3, None: 1}


def test_block_summary(tables):
    reg, log = tables
    s = {r.block: r for r in R.block_summary(log, reg, dt.date(2025, 7, 3), roles=FX.ROLES).collect()}
    got = {b: (r.entries, r.activities, r.unknown_status) for b, r in s.items()}
    assert got == {"East": (1, 1, 0), "North": (4, 3, 0), "South": (3, 1, 1), "West": (0, 0, 0)}
    assert s["North"].schools == 3 and s["North"].n_R == 2 and s["North"].n_GA == 1
    tot = R.summary_totals(R.block_summary(log, reg, dt.date(2025, 7, 3), roles=FX.ROLES)).first()
    assert (tot.schools, tot.entries, tot.activities, tot.unknown_status) == (7, 8, 5, 1)
    first = [r.block for r in R.first_blocks(R.block_summary(log, reg, dt.date(2025, 7, 3), roles=FX.ROLES), 3).collect()]
    assert first == ["East", "North", "South"]


def test_entity_detail_and_lists(tables):
    reg, log = tables
    lo, hi = dt.date(2025, 7, 1), dt.date(2025, 7, 31)
    det = entity_detail(log, reg, lo, hi, record_ids=["S1-2"], roles=FX.ROLES)
    rows = R.entity_day_list(det).collect()
    assert len(rows) == 1 and rows[0].task_schedule_date is None and rows[0].activity_text == "Not done"
    assert R.entity_kpis(det).first().entries == 0
    det = entity_detail(log, reg, lo, hi, record_ids=["S1-1"], roles=FX.ROLES)
    days = {r.task_schedule_date: (r.date_text, r.activity_text) for r in R.entity_day_list(det).collect()}
    assert days == {dt.date(2025, 7, 2): ("02 Jul 2025", "Not done"), dt.date(2025, 7, 3): ("03 Jul 2025", "Done")}
    k = R.entity_kpis(det).first()
    assert (k.entries, k.activities) == (2, 1)
    # numeric ID matches the same ID at two sites; the full key does not
    by_id = entity_detail(log, reg, lo, hi, ids=[1], roles=FX.ROLES)
    assert {r.record_id for r in by_id.collect()} == {"S1-1", "S2-1"}
    # unknown status is kept raw and reads as not done after the fill
    s21 = entity_detail(log, reg, lo, hi, record_ids=["S2-1"], roles=FX.ROLES).first()
    assert (s21.status_raw, s21.brush_activity) == (3, 0)


def test_filters_and_validation(tables):
    reg, log = tables
    lo, hi = dt.date(2025, 7, 1), dt.date(2025, 7, 31)
    got = period_rollup(log, reg, lo, hi, blocks=["North"], areas=["R"], roles=FX.ROLES)
    assert {r.record_id for r in got.collect()} == {"S1-1", "S1-3"}
    with pytest.raises(ValueError):
        period_rollup(log, reg, lo, hi, blocks=[], roles=FX.ROLES)
    with pytest.raises(ValueError):
        period_rollup(log, reg, hi, lo, roles=FX.ROLES)


def test_null_keys_match_null_safe(spark):
    reg = spark.createDataFrame(
        [(None, "1", "R", "GS", "A", "X"), ("S1-1", "1", "R", "GS", "B", "X")],
        "record_id STRING, site STRING, area_type STRING, school_type STRING, school STRING, block STRING",
    )
    log = spark.createDataFrame(
        [(1, None, dt.datetime(2025, 7, 2, 9), dt.date(2025, 7, 2), 1, 3.0)],
        "seq BIGINT, record_id STRING, task_start_date TIMESTAMP_NTZ, task_schedule_date DATE, "
        "brush_activity INT, participants DOUBLE",
    )
    lo, hi = dt.date(2025, 7, 1), dt.date(2025, 7, 31)
    got = {r.school: r.entry for r in period_rollup(log, reg, lo, hi, roles=FX.ROLES).collect()}
    assert got == {"A": 1, "B": 0}
    got = {r.school: r.entry for r in period_rollup(log, reg, lo, hi, roles=FX.ROLES, null_safe=False).collect()}
    assert got == {"A": 0, "B": 0}


def test_series_dedupe_and_texts(tables, july):
    reg, log = tables
    got = {r.day: r.entries for r in R.daily_series(log, FX.ROLES, dedupe=True).collect()}
    assert got[dt.date(2025, 7, 2)] == 6  # S1-1, S1-3, S2-1, S2-2, GHOST-9, NOID
    act = {
        (r.block, r.area_type, r.school_type, r.activity): r.cell_text
        for r in R.activity_cell_text(R.activity_levels_long(july)).collect()
    }
    assert act[("North", "R", "GS", 1)] == "2 (100.00%) / 32 Participants (100.00%)"
    mon = {r.block: r.R_GS for r in R.monthly_cell_text(monthly_crosstab(july)).collect()}
    assert mon["North"] == "Entered: 3 / Activities: 2 / Students: 32"


def test_operators_read_inputs_through_roles_only(spark, tables):
    """Rename every input column; with matching Roles the answers are unchanged."""
    reg, log = tables
    reg2 = reg.select(
        reg.record_id.alias("rid"),
        reg.site.alias("st"),
        reg.area_type.alias("zone"),
        reg.school_type.alias("cat"),
        reg.school.alias("label"),
        reg.block.alias("region"),
    )
    log2 = log.select(
        log.seq.alias("n"),
        log.record_id.alias("rid"),
        log.task_start_date.alias("t0"),
        log.task_schedule_date.alias("d"),
        log.brush_activity.alias("code"),
        log.participants.alias("qty"),
    )
    roles = FX.Roles(
        entity="rid", day="d", start="t0", status="code", measure="qty", tiebreak=("n",),
        key="rid", name="label", group="region", area="zone", kind="cat",
    )
    lo, hi = dt.date(2025, 7, 1), dt.date(2025, 7, 31)
    day, as_of = dt.date(2025, 7, 2), dt.date(2025, 7, 3)

    def rows(df):
        return sorted(map(tuple, df.collect()), key=repr)

    pairs = [
        (period_rollup(log, reg, lo, hi, roles=FX.ROLES), period_rollup(log2, reg2, lo, hi, roles=roles)),
        (entity_detail(log, reg, lo, hi, roles=FX.ROLES), entity_detail(log2, reg2, lo, hi, roles=roles)),
        (daily_coverage_wide(log, reg, day, roles=FX.ROLES), daily_coverage_wide(log2, reg2, day, roles=roles)),
        (R.block_summary(log, reg, as_of, roles=FX.ROLES), R.block_summary(log2, reg2, as_of, roles=roles)),
        (R.daily_series_by_block(log, reg, roles=FX.ROLES), R.daily_series_by_block(log2, reg2, roles=roles)),
        (R.first_blocks_series(log, reg, roles=FX.ROLES), R.first_blocks_series(log2, reg2, roles=roles)),
        (R.school_options(reg, roles=FX.ROLES), R.school_options(reg2, roles=roles)),
    ]
    for a, b in pairs:
        assert a.columns == b.columns
        assert rows(a) == rows(b)


def test_repeat_flags(tables):
    from sitepulse.operators import flag_repeats

    _, log = tables
    got = {r.seq: r.dup for r in flag_repeats(log, FX.ROLES).collect()}
    # (S1-1, 07-02): seq 2 is the latest (11:00); seq 1 is older, seq 3 has a NULL start
    assert (got[1], got[2], got[3]) == (True, False, True)
    # equal start: the first in source order wins
    assert (got[7], got[8]) == (False, True)
    # single rows (incl. the orphan and the NULL-day row) are never repeats
    assert not any(got[s] for s in (4, 5, 6, 9, 10, 11, 12, 13))


def test_empty_log_gives_zero_filled_reports(spark, tables):
    reg, log = tables
    empty = log.limit(0)
    lo, hi = dt.date(2025, 7, 1), dt.date(2025, 7, 31)
    roll = period_rollup(empty, reg, lo, hi, roles=FX.ROLES)
    assert roll.count() == 7 and roll.where("entry <> 0 OR activity <> 0").count() == 0
    levels = R.entry_levels_wide(roll).collect()
    assert {(r.block, r.entry) for r in levels} == {("North", 0), ("South", 0), ("East", 0), ("West", 0)}
    cov = daily_coverage_long(empty, reg, dt.date(2025, 7, 2), roles=FX.ROLES).collect()
    assert sum(r.total for r in cov) == 7 and all(r.present == 0 for r in cov)
    s = R.block_summary(empty, reg, dt.date(2025, 7, 3), roles=FX.ROLES).collect()
    assert all((r.entries, r.activities, r.unknown_status) == (0, 0, 0) for r in s)
    assert R.summary_totals(R.block_summary(empty, reg, dt.date(2025, 7, 3), roles=FX.ROLES)).first().schools == 7
    assert R.daily_series(empty, FX.ROLES).count() == 0


def test_entity_key_types_may_differ(spark, tables):
    """Registry keyed by text, log by number: same answer as matching types."""
    from pyspark.sql import functions as F

    reg = spark.createDataFrame(
        [("7", "S1-7", "R", "GS", "A", "X"), ("8", "S1-8", "U", "GS", "B", "X"), (None, "S1-9", "R", "GS", "C", "X")],
        "k string, record_id string, area_type string, school_type string, school string, block string",
    )
    log = spark.createDataFrame(
        [(1, 7, dt.datetime(2025, 7, 2, 9), dt.date(2025, 7, 2), 1, 2.0),
         (2, None, dt.datetime(2025, 7, 2, 9), dt.date(2025, 7, 2), 1, 3.0)],
        "seq BIGINT, k BIGINT, task_start_date TIMESTAMP_NTZ, task_schedule_date DATE, "
        "brush_activity INT, participants DOUBLE",
    )
    roles = FX.Roles(entity="k", tiebreak=("seq",))
    lo, hi = dt.date(2025, 7, 1), dt.date(2025, 7, 31)
    got = {r.record_id: r.entry for r in period_rollup(log, reg, lo, hi, roles=roles).collect()}
    assert got == {"S1-7": 1, "S1-8": 0, "S1-9": 1}
    same = period_rollup(log, reg.withColumn("k", F.col("k").cast("bigint")), lo, hi, roles=roles)
    assert {r.record_id: r.entry for r in same.collect()} == got
    by_block = R.daily_series_by_block(log, reg, roles=roles).collect()
    assert [(r.block, r.entries) for r in by_block] == [("X", 2)]


def test_display_order(tables, july):
    reg, log = tables
    ids = [r.record_id for r in R.sorted_for_display("period_rollup", july).collect()]
    # numeric IDs ascending, keys without a numeric ID last (as R's arrange puts NA last)
    assert ids[:5] == ["S1-1", "S2-1", "S1-2", "S2-2", "S1-3"] and set(ids[5:]) == {"NOID", "S3-7-b"}
    det = entity_detail(log, reg, dt.date(2025, 7, 1), dt.date(2025, 7, 31), record_ids=["S1-1"], roles=FX.ROLES)
    days = [r.task_schedule_date for r in R.sorted_for_display("entity_day_list", R.entity_day_list(det)).collect()]
    assert days == [dt.date(2025, 7, 3), dt.date(2025, 7, 2)]
    assert set(R.DISPLAY_ORDER) <= {
        "period_rollup", "month_rollup", "entity_detail", "entity_day_list", "daily_coverage_long",
        "daily_coverage_wide", "entry_levels_wide", "entry_levels_long", "activity_levels_wide",
        "activity_levels_long", "no_activity_list", "has_entries_list", "monthly_crosstab", "block_summary",
        "first_blocks", "daily_series", "daily_series_by_block", "first_blocks_series", "filter_blocks",
        "school_options",
    }
