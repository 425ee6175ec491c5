from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from sitepulse.functions.scalars import (
    key_is_valid,
    mask_key,
    month_bounds,
    percent_text,
    safe_number,
    split_key,
    validate_choice,
    validate_range,
)
from sitepulse.sources import settings as S


def _one_col(spark, values, fn, dtype="string"):
    df = spark.createDataFrame([(v,) for v in values], f"x {dtype}")
    return [r[0] for r in df.select(fn(F.col("x"))).collect()]


def test_safe_number(spark):
    good = _one_col(spark, ["12", "1e3", "3.5", "-2", " 7 ", "007"], safe_number)
    assert good == [12.0, 1000.0, 3.5, -2.0, 7.0, 7.0]
    bad = _one_col(spark, ["abc", "", "1d", "0x1A", "NaN", None], safe_number)
    assert bad == [None] * 6


def test_split_key(spark):
    df = spark.createDataFrame([("S1-2",), ("NOID",), ("S3-7-b",), ("S4-",)], "k string")
    site, rest = split_key("k")
    got = [tuple(r) for r in df.select(site, rest).collect()]
    assert got == [("S1", "2"), ("NOID", None), ("S3", "7-b"), ("S4", "")]


def test_mask_and_key_pattern(spark):
    key = "0123456789abcdef0123456789abcdef"
    assert _one_col(spark, [key], mask_key) == ["0123 * * * * cdef"]
    assert _one_col(spark, [key, key[:31], "g" + key[1:], key + "\n", None], key_is_valid) == [
        True,
        False,
        False,
        True,
        False,
    ]


def test_month_bounds_and_validation():
    assert month_bounds("2025-07-17") == (dt.date(2025, 7, 1), dt.date(2025, 7, 31))
    assert month_bounds(dt.date(2024, 2, 10)) == (dt.date(2024, 2, 1), dt.date(2024, 2, 29))
    with pytest.raises(ValueError):
        validate_range("2025-07-02", "2025-07-01")
    with pytest.raises(ValueError):
        validate_choice("Block", [])
    assert validate_choice("Block", None) is None


def test_percent_text(spark):
    df = spark.createDataFrame([(1, 3), (1, 8), (0, 0), (2, 2)], "n long, t long")
    got = [r[0] for r in df.select(percent_text("n", "n", "t")).collect()]
    assert got == ["1 (33.33%)", "1 (12.50%)", "0", "2 (100.00%)"]


def test_freshness(spark):
    now = dt.datetime(2025, 7, 10, 12, 0, 0)
    epoch = (now - dt.datetime(1970, 1, 1)).total_seconds()
    rows = [
        ("a", str(int(epoch - 24 * 3600)), 1),
        ("b", str(int(epoch - 24 * 3600 - 1)), 1),
        ("c", "not a time", 1),
        ("d", str(int(epoch - 24.5 * 3600)), 1),
        ("e", str(int(epoch - 25.5 * 3600)), 1),
    ]
    df = spark.createDataFrame(rows, "name string, value string, version long")
    got = {r.name: r for r in S.freshness(df, now).collect()}
    assert got["a"].stale is False and got["b"].stale is True and got["c"].stale is True
    assert got["d"].age_hours_rounded == 24.0 and got["e"].age_hours_rounded == 26.0
    assert got["a"].last_update == dt.datetime(2025, 7, 9, 12, 0, 0)
    assert got["a"].last_update_text == "09 Jul 2025 12:00 PM"


def test_settings_last_write_wins(spark, scratch):
    path = f"{scratch}/settings"
    S.upsert(spark, path, {"api_key": "old", "last_update": "1"}, now=dt.datetime(2025, 1, 1))
    S.upsert(spark, path, {"api_key": "new"}, now=dt.datetime(2025, 1, 2))
    assert S.lookup(spark, path, "api_key") == "new"
    assert S.lookup(spark, path, "last_update") == "1"
    assert S.lookup(spark, path, "missing") is None


def test_word(spark):
    from sitepulse.functions.scalars import word

    df = spark.createDataFrame([("R_GS_activity",), ("U_PS_participants_P",), ("x",)], "c string")
    got = [tuple(r) for r in df.select(word("c", 1, -2), word("c", -2, -1), word("c", 2)).collect()]
    assert got == [("R_GS", "GS_activity", "GS"), ("U_PS_participants", "participants_P", "PS"), (None, None, None)]


def test_freshness_ignores_session_time_zone(spark):
    from sitepulse.functions.scalars import epoch_seconds_ntz_sql

    now = dt.datetime(2025, 7, 10, 12, 0, 0)
    epoch = int((dt.datetime(2025, 7, 9, 15, 30) - dt.datetime(1970, 1, 1)).total_seconds())
    df = spark.createDataFrame([("k", str(epoch), 1)], "name string, value string, version long")
    ts = spark.createDataFrame([(dt.datetime(2025, 7, 9, 15, 30),)], "t timestamp_ntz")
    old = spark.conf.get("spark.sql.session.timeZone")
    out = []
    try:
        for tz in ("UTC", "America/New_York", "Asia/Kolkata"):
            spark.conf.set("spark.sql.session.timeZone", tz)
            r = S.freshness(df, now).first()
            secs = ts.select(F.expr(epoch_seconds_ntz_sql("t"))).first()[0]
            out.append((r.last_update, r.last_update_text, r.age_hours, secs))
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert out[0] == out[1] == out[2]
    assert out[0][1] == "09 Jul 2025 03:30 PM" and out[0][2] == 20.5 and out[0][3] == epoch


def test_cells_need_a_selection():
    from sitepulse.schema import cells

    assert [c for _, _, c in cells()] == ["R_GS", "U_GS", "R_GA", "U_GA", "R_PS", "U_PS"]
    assert [c for _, _, c in cells(["U"], ["PS"])] == ["U_PS"]
    with pytest.raises(ValueError):
        cells([], None)


def test_recode_and_generic_latest(spark):
    from sitepulse.functions.scalars import recode_status, status_label
    from sitepulse.operators.dedupe import day_order, latest_per
    from sitepulse.schema import Roles

    assert _one_col(spark, [1, 2, 3, None], recode_status, "int") == [1, 0, None, None]
    assert _one_col(spark, [0, 1, 5], status_label, "int") == ["Not done", "Done", None]
    df = spark.createDataFrame(
        [("a", 1, 5, 1), ("a", 1, 7, 2), ("a", 1, None, 3), ("b", 2, 1, 4)],
        "e string, d int, s int, t int",
    )
    roles = Roles(entity="e", day="d", start="s", tiebreak=("t",))
    got = {(r.e, r.d): r.t for r in latest_per(df, ["e", "d"], day_order(roles)).collect()}
    assert got == {("a", 1): 2, ("b", 2): 4}
