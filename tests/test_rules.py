"""No silent loss, source order, pruning and store rules."""

from __future__ import annotations

import contextlib
import datetime as dt
import io
import os

import pytest
from pyspark.sql import functions as F

import fixture_edge as FX
from conftest import SF_SMALL
from sitepulse.functions.scalars import percent_of, safe_number, safe_number_sql
from sitepulse.operators import daily_coverage_wide, entity_detail, flag_repeats, latest_per_day, month_rollup, period_rollup
from sitepulse.plans import params as P
from sitepulse.plans import reports as R
from sitepulse.plans import synth
from sitepulse.plans.bindings import table
from sitepulse.plans.catalog import QUERIES
from sitepulse.schema import Roles
from sitepulse.sources import ingest, settings
from sitepulse.streaming.series import _add_batch, read_series


def plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("store"))
    raw, labels = synth.raw_export(spark, SF_SMALL), synth.label_export(spark, SF_SMALL)
    ingest.publish_snapshot(spark, ingest.extract_registry(raw, labels), ingest.extract_log(raw), root)
    return root


@contextlib.contextmanager
def ansi(spark, on: bool):
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", str(on).lower())
    try:
        yield
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)


# ---------------------------------------------------------------- no silent loss


@pytest.mark.parametrize("on", [True, False])
def test_large_measures_stay_in_sums(spark, on):
    with ansi(spark, on):
        large = QUERIES["period_rollup_large"](spark, SF_SMALL).agg(F.sum("participants")).first()[0]
        plain = QUERIES["period_rollup"](spark, SF_SMALL).agg(F.sum("participants")).first()[0]
    assert large == pytest.approx(plain * P.LARGE_FACTOR, rel=1e-12) and large > 1e10


@pytest.mark.parametrize("on", [True, False])
def test_overflowing_sums_fail(spark, on):
    reg = FX.registry(spark)
    log = FX.log(spark).withColumn("participants", F.lit("9" * 38).cast("decimal(38,0)"))
    with ansi(spark, on), pytest.raises(Exception, match="(?i)overflow|out of range|cannot be represented"):
        period_rollup(log, reg, "2025-07-01", "2025-07-31", roles=FX.ROLES).collect()


def test_a_measure_that_does_not_fit_fails(spark):
    from sitepulse.plans.bindings import exact_measure_sql

    df = spark.createDataFrame([(1.5e10,), (float("nan"),), (None,)], "v double")
    assert [r[0] and float(r[0]) for r in df.selectExpr(exact_measure_sql("v")).collect()] == [1.5e10, None, None]
    with pytest.raises(Exception, match="does not fit"):
        spark.createDataFrame([(1e30,)], "v double").selectExpr(exact_measure_sql("v")).collect()


def test_rows_landed_during_the_session_are_counted(spark, scratch):
    for name in ("customer", "nation", "region", "events"):
        table(spark, SF_SMALL, name).write.parquet(f"{scratch}/{name}.parquet")
    before = QUERIES["daily_series"](spark, scratch).agg(F.sum("entries")).first()[0]
    table(spark, SF_SMALL, "events").write.mode("append").parquet(f"{scratch}/events.parquet")
    assert QUERIES["daily_series"](spark, scratch).agg(F.sum("entries")).first()[0] == 2 * before


HEAD = "record_id,redcap_repeat_instrument,redcap_repeat_instance,site,task_schedule_date,brush_activity_1_5,first_to_fifth_participants"


def _land(path, *lines, head=HEAD):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write("\n".join([head, *lines]) + "\n")


def _labels(spark, path):
    with open(path, "w") as f:
        f.write("record_id,block1\nS1-1,North\n")
    return path


def test_refresh_keeps_a_row_with_one_bad_value(spark, scratch):
    good = [f"S1-1,implementation_status,{i},,2025-07-02,1,{i}" for i in range(1, 20)]
    _land(f"{scratch}/raw/a.csv", "S1-1,,,1,,,", *good, "S1-1,implementation_status,20,,not-a-day,1,20")
    root = f"{scratch}/store"
    version = ingest.refresh(spark, f"{scratch}/raw", _labels(spark, f"{scratch}/labels.csv"), root, fmt="csv")
    _, log = ingest.read_snapshot(spark, root)
    assert log.count() == 20 and log.where("task_schedule_date IS NULL").first().participants == 20
    rejected = spark.read.parquet(f"{root}/v={version}/rejected").collect()
    assert len(rejected) == 1 and "not-a-day" in rejected[0].text
    # above the stated rate nothing becomes current
    _land(f"{scratch}/bad/a.csv", "S1-1,,,1,,,", "S1-1,implementation_status,1,,2025-07-02,x,1")
    with pytest.raises(ValueError, match="do not parse"):
        ingest.refresh(spark, f"{scratch}/bad", f"{scratch}/labels.csv", root, fmt="csv")
    assert ingest.current_version(spark, root) == version


def test_csv_short_and_long_rows_are_marked(spark, scratch):
    _land(f"{scratch}/raw/a.csv", "S1-1,,,1,,,", "S1-2,,", "S1-3,,,1,,,,extra")
    got = {r.record_id: r[ingest.CORRUPT] is not None for r in ingest.read_export(spark, f"{scratch}/raw", "csv").collect()}
    assert got == {"S1-1": False, "S1-2": True, "S1-3": True}


def test_csv_files_with_other_headers_fail(spark, scratch):
    _land(f"{scratch}/raw/a.csv", "S1-1,,,1,,,")
    _land(f"{scratch}/raw/b.csv", "1,S1-2,,,,,", head=",".join(["site", "record_id", *HEAD.split(",")[1:3], *HEAD.split(",")[4:]]))
    with pytest.raises(Exception, match="(?i)header"):
        ingest.read_export(spark, f"{scratch}/raw", "csv").collect()


def test_sink_refuses_epochs_that_do_not_follow(spark, scratch):
    reg, log = FX.registry(spark), FX.log(spark).select("record_id", "task_schedule_date")
    sink = f"{scratch}/series"
    write = _add_batch(sink, reg, Roles(), "ckpt")
    write(log, 0), write(log, 1), write(log, 1)
    total = read_series(spark, sink).agg(F.sum("entries")).first()[0]
    assert total == 2 * log.count()
    for other, epoch in ((write, 0), (write, 3), (_add_batch(sink, reg, Roles(), "new"), 2)):
        with pytest.raises(ValueError):
            other(log, epoch)
    with pytest.raises(ValueError):
        _add_batch(f"{scratch}/fresh", reg, Roles(), "ckpt")(log, 4)
    assert read_series(spark, sink).agg(F.sum("entries")).first()[0] == total


# ------------------------------------------------------------------ source order


def test_ties_need_a_source_order(spark):
    with pytest.raises(ValueError):
        latest_per_day(FX.log(spark), Roles())


def test_first_source_row_wins_in_any_input_order(spark, store):
    reg, log = ingest.read_snapshot(spark, store)
    tied = log.unionByName(log.withColumns({"seq": F.col("seq") + 1_000_000, "participants": F.lit(-1.0)}))
    roles, span = ingest.SNAPSHOT_ROLES, P.RANGE
    want = sorted(map(tuple, period_rollup(log, reg, *span, roles=roles).collect()), key=str)
    for n in (1, 7):
        got = period_rollup(tied.repartition(n, F.rand(n)), reg, *span, roles=roles).collect()
        assert sorted(map(tuple, got), key=str) == want


def test_exact_twins_leave_one_latest(spark):
    log = FX.log(spark)
    got = flag_repeats(log.unionByName(log), FX.ROLES)
    assert got.where("NOT dup").count() == log.select("record_id", "task_schedule_date").distinct().count()
    assert got.columns == [*log.columns, "dup"]


# ------------------------------------------------------------------ pruning


def test_one_day_reports_read_one_month(spark, store):
    reg, log = ingest.read_snapshot(spark, store)
    roles = ingest.SNAPSHOT_ROLES
    for df in (daily_coverage_wide(log, reg, P.DAY, roles=roles), R.block_summary(log, reg, P.AS_OF, roles=roles)):
        text = plan(df)
        assert "day_month" in text.split("PartitionFilters: [")[1].split("]")[0]
        rows = df.collect()
        assert rows


def test_a_selected_school_cuts_the_log_scan(spark, store):
    reg, log = ingest.read_snapshot(spark, store)
    one = entity_detail(log, reg, *P.RANGE, record_ids=["C-1"], roles=ingest.SNAPSHOT_ROLES)
    scan = [x for x in plan(one).split("PushedFilters: ")[1:] if "task_schedule_date" in x.split("ReadSchema")[0]]
    assert scan and "C-1" in scan[0].split("ReadSchema")[0]
    everything = entity_detail(log, reg, *P.RANGE, roles=ingest.SNAPSHOT_ROLES)
    assert sorted(map(tuple, one.collect()), key=str) == sorted(map(tuple, everything.where("record_id = 'C-1'").collect()), key=str)


def test_ids_match_at_every_site(spark):
    reg, log = FX.registry(spark), FX.log(spark)
    got = entity_detail(log, reg, "2025-07-01", "2025-07-31", ids=[1], roles=FX.ROLES).collect()
    assert {r.record_id for r in got} == {"S1-1", "S2-1"} and len(got) == 3
    none = entity_detail(log, reg, "2025-07-01", "2025-07-31", record_ids=["S1-2"], roles=FX.ROLES).collect()
    assert len(none) == 1 and none[0].task_schedule_date is None
    other = Roles(entity="k", tiebreak=("seq",))  # the log does not carry the full key
    a = entity_detail(log.withColumnRenamed("record_id", "k"), reg.withColumn("k", F.col("record_id")), "2025-07-01", "2025-07-31", ids=[1], roles=other)
    assert sorted(map(tuple, a.collect()), key=str) == sorted(map(tuple, got), key=str)


def test_snapshot_files_do_not_follow_the_input_tasks(spark, scratch):
    raw = synth.raw_export(spark, SF_SMALL)
    log = ingest.extract_log(raw).withColumn(
        "task_schedule_date", F.add_months("task_schedule_date", (F.col("seq") % 12).cast("int"))
    )
    root = f"{scratch}/store"
    version = ingest.publish_snapshot(spark, FX.registry(spark), log.repartition(16), root)
    files = [f for _, _, fs in os.walk(f"{root}/log/v={version}") for f in fs if f.endswith(".parquet")]
    assert 12 <= len(files) <= 2 * 14


# ------------------------------------------------------------------ store rules


def test_publish_is_current_whatever_the_clock_says(spark, scratch):
    root, reg, log = f"{scratch}/store", FX.registry(spark), FX.log(spark).withColumn("activity_date", F.col("task_schedule_date"))
    now = dt.datetime(2025, 7, 2, 12)
    for when in (now, now, now - dt.timedelta(days=30)):
        version = ingest.publish_snapshot(spark, reg, log, root, now=when)
        assert ingest.current_version(spark, root) == version


def test_freshness_of_an_empty_store_and_the_refresh_decision(spark, scratch):
    root = f"{scratch}/store"
    ingest.ensure_tables(spark, root)
    now = dt.datetime(2025, 7, 2, 12)
    rows = settings.freshness(settings.read(spark, f"{root}/settings"), now, names=["last_update"])
    assert rows.where("name = 'last_update'").first().stale is True
    synth.raw_export(spark, SF_SMALL).write.parquet(f"{scratch}/raw")
    synth.label_export(spark, SF_SMALL).write.parquet(f"{scratch}/labels")
    args = (spark, f"{scratch}/raw", f"{scratch}/labels", root)
    first = ingest.refresh_if_stale(*args, now=now)
    assert first and ingest.refresh_if_stale(*args, now=now + dt.timedelta(hours=24)) is None
    second = ingest.refresh_if_stale(*args, now=now + dt.timedelta(hours=24, seconds=1))
    assert second not in (None, first)


def test_a_bad_key_is_not_stored(spark, scratch):
    path = f"{scratch}/settings"
    for bad in ("", "xyz", "g" * 32, "a" * 31):
        with pytest.raises(ValueError):
            settings.set_key(spark, path, bad)
    settings.set_key(spark, path, "0123456789abcdefABCDEF0123456789")
    assert settings.lookup(spark, path, "api_key").startswith("0123")


def test_compaction_keeps_the_last_writes(spark, scratch, monkeypatch):
    path = f"{scratch}/settings"
    for i in range(5):
        settings.upsert(spark, path, {"a": str(i), f"b{i}": "x"})
    want = sorted(map(tuple, settings.read(spark, path).collect()))
    settings.compact(spark, path)
    assert sorted(map(tuple, settings.read(spark, path).collect())) == want
    assert len([f for f in os.listdir(path) if f.endswith(".parquet")]) == 1
    os.rename(path, f"{scratch}/gone")  # as if the job died while the store was being replaced
    assert settings.lookup(spark, path, "a") == "4"
    settings.upsert(spark, path, {"a": "5"})
    assert settings.lookup(spark, path, "a") == "5" and settings.lookup(spark, path, "b0") == "x"


def test_a_long_stream_keeps_a_bounded_sink(spark, scratch, monkeypatch):
    from sitepulse.streaming import series

    monkeypatch.setattr(series, "SLOTS", 2)
    monkeypatch.setattr(series, "COMPACT_EVERY", 2)
    reg, log = FX.registry(spark), FX.log(spark).select("record_id", "task_schedule_date")
    sink = f"{scratch}/series"
    write = series._add_batch(sink, reg, Roles())
    for epoch in (0, 1, 2, 2, 3, 4):
        write(log, epoch)
    assert series.read_series(spark, sink).agg(F.sum("entries")).first()[0] == 5 * log.count()
    assert len([d for d in os.listdir(sink) if d.startswith("slot=")]) == 2


# ------------------------------------------------------------------ scalars


def test_both_number_parsers_agree(spark):
    texts = ["1", "1d", "1f", "1x5", "1.5", ".5", "5.", "1e3", "-2", "+2", "0x1", "NaN", "", " 7 ", "1.5.2", "1 2", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select("t", safe_number("t").alias("a"), F.expr(safe_number_sql("t")).alias("b")).collect()
    assert all(r.a == r.b for r in got)
    assert {r.t for r in got if r.a is not None} == {"1", "1.5", ".5", "5.", "1e3", "-2", "+2", " 7 "}


def test_percent_is_exact(spark):
    df = spark.createDataFrame([(1, 3), (2, 3), (1, 200_000), (199_999, 200_000), (5, 0), (0, 7)], "a long, b long")
    assert [r[0] for r in df.select(percent_of("a", "b")).collect()] == ["33.33", "66.67", "0.00", "100.00", None, "0.00"]


def test_unlisted_codes_stay_in_lists_and_leave_level_tables(spark):
    reg = FX.registry(spark).withColumn("school_type", F.expr("CASE WHEN record_id = 'S1-2' THEN 'XX' ELSE school_type END"))
    roll = month_rollup(FX.log(spark), reg, dt.date(2025, 7, 1), roles=FX.ROLES)
    assert roll.where("record_id = 'S1-2'").count() == 1
    assert {r.entry for r in R.entry_levels_wide(roll).where("block = 'North'").collect()} == {1, 2}
