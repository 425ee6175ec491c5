"""Refresh job: export -> versioned snapshot -> typed read; settings pointer."""

from __future__ import annotations

import contextlib
import datetime as dt
import io

from pyspark.sql import functions as F

import __spark_entry__ as E
from conftest import SF_SMALL
from sitepulse.operators import period_rollup
from sitepulse.plans import params as P
from sitepulse.plans import synth
from sitepulse.schema import LOG_SCHEMA, REGISTRY_SCHEMA
from sitepulse.sources import ingest, settings


def test_refresh_round_trip(spark, scratch):
    raw = synth.raw_export(spark, SF_SMALL)
    labels = synth.label_export(spark, SF_SMALL)
    raw.write.parquet(f"{scratch}/landing/raw")
    labels.write.parquet(f"{scratch}/landing/labels")
    root = f"{scratch}/store"
    assert ingest.current_version(spark, root) is None
    v1 = ingest.refresh(spark, f"{scratch}/landing/raw", f"{scratch}/landing/labels", root)
    assert ingest.current_version(spark, root) == v1
    reg, log = ingest.read_snapshot(spark, root)
    assert reg.schema == REGISTRY_SCHEMA
    assert [f.name for f in log.schema] == [*LOG_SCHEMA.fieldNames(), "day_month"]
    assert reg.count() == E.queries()["registry_extract"](spark, SF_SMALL).count()
    assert log.count() == E.queries()["log_extract"](spark, SF_SMALL).count()
    # day filters prune month directories of the stored log
    rollup = period_rollup(log, reg, *P.RANGE, roles=ingest.SNAPSHOT_ROLES)
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        rollup.explain("formatted")
    assert "PartitionFilters: [isnotnull(day_month" in buf.getvalue()
    assert "day_month" in buf.getvalue().split("PartitionFilters: [")[1].split("]")[0]
    # the stored tables drive the same report as the bound driver tables
    assert rollup.count() == reg.count()
    bound = E.queries()["period_rollup"](spark, SF_SMALL)
    key = ["record_id", "entry", "participants", "activity"]
    # the stored log re-parses participants from text (double), the bound log sums decimals;
    # the export's keys are C-<key>, the bound ones S<region>-<key>
    assert sorted((r[0], r[1], round(r[2], 6), r[3]) for r in rollup.select(*key).collect()) == sorted(
        ("C-" + r[0].split("-")[1], r[1], round(float(r[2]), 6), r[3]) for r in bound.select(*key).collect()
    )
    # a second refresh publishes a new version; the old one stays readable
    v2 = ingest.refresh(spark, f"{scratch}/landing/raw", f"{scratch}/landing/labels", root)
    assert v2 != v1 and ingest.current_version(spark, root) == v2
    old_reg, _ = ingest.read_snapshot(spark, root, v1)
    assert old_reg.count() == reg.count()
    age = settings.freshness(settings.read(spark, f"{root}/settings").where("name = 'last_update'"), dt.datetime.now())
    assert age.first().stale is False


def test_refresh_rejects_empty_export(spark, scratch):
    root = f"{scratch}/store"
    ingest.ensure_tables(spark, root)
    v0 = ingest.current_version(spark, root)
    empty = spark.createDataFrame([], ingest.RAW_EXPORT_SCHEMA)
    empty.write.parquet(f"{scratch}/raw")
    spark.createDataFrame([], ingest.LABEL_EXPORT_SCHEMA).write.parquet(f"{scratch}/labels")
    try:
        ingest.refresh(spark, f"{scratch}/raw", f"{scratch}/labels", root)
        raise AssertionError("expected ValueError")
    except ValueError:
        pass
    assert ingest.current_version(spark, root) == v0


def test_csv_export_keeps_bad_lines_out(spark, scratch):
    path = f"{scratch}/raw.csv"
    with open(path, "w") as f:
        f.write(",".join(ingest.RAW_EXPORT_SCHEMA.fieldNames()) + "\n")
        f.write("S1-1,,,1,R,GS,Alpha,,,,,\n")
        f.write("S1-1,implementation_status,1,,,,,2025-07-02 09:00:00,2025-07-02,2025-07-02,1,12\n")
        f.write("S1-1,implementation_status,2,,,,,2025-07-02 09:00:00,2025-07-02,2025-07-02,notanint,12\n")
    df = ingest.read_export(spark, path, "csv")
    rows = df.collect()
    assert len(rows) == 3
    assert sum(r[ingest.CORRUPT] is not None for r in rows) == 1
    log = ingest.extract_log(df.where(F.col(ingest.CORRUPT).isNull()).drop(ingest.CORRUPT))
    assert [r.participants for r in log.collect()] == [12.0]


def test_labels_deduplicated(spark):
    raw = spark.createDataFrame(
        [("S1-1", None, None, "1", "R", "GS", "A", None, None, None, None, None)], ingest.RAW_EXPORT_SCHEMA
    )
    labels = spark.createDataFrame([("S1-1", "North"), ("S1-1", None), ("S1-1", "North")], "record_id string, block1 string")
    reg = ingest.extract_registry(raw, labels).collect()
    assert len(reg) == 1 and reg[0].block == "North"


def test_table_exists_and_export(spark, scratch):
    assert not ingest.table_exists(spark, f"{scratch}/nothing")
    df = E.queries()["block_summary"](spark, SF_SMALL)
    ingest.export_table(df, f"{scratch}/out_csv", "csv")
    back = spark.read.option("header", True).csv(f"{scratch}/out_csv")
    assert back.count() == df.count() and set(back.columns) == set(df.columns)
    ingest.export_table(df, f"{scratch}/out_pq", "parquet")
    assert ingest.table_exists(spark, f"{scratch}/out_pq")


def test_cli_refresh_then_report(spark, scratch):
    from sitepulse import cli

    synth.raw_export(spark, SF_SMALL).write.parquet(f"{scratch}/raw")
    synth.label_export(spark, SF_SMALL).write.parquet(f"{scratch}/labels")
    root = f"{scratch}/store"
    cli.main(["refresh", "--raw", f"{scratch}/raw", "--labels", f"{scratch}/labels", "--root", root])
    out = f"{scratch}/report"
    cli.main(
        ["report", "monthly_crosstab", "--root", root, "--month", "2024-01-15", "--out", out, "--format", "parquet"]
    )
    got = spark.read.parquet(out)
    want = E.queries()["monthly_crosstab"](spark, SF_SMALL)
    assert got.count() == want.count() == 5
    g = {r.block: r.entry_R_GS for r in got.collect()}
    w = {r.block: r.entry_R_GS for r in want.collect()}
    assert g == w


def test_json_export_with_a_bad_line(spark, scratch):
    path = f"{scratch}/raw.json"
    with open(path, "w") as f:
        f.write('{"record_id": "S1-1", "site": "1", "area_type": "R", "school_type": "GS", "school1": "A"}\n')
        f.write('{"record_id": "S1-1", "redcap_repeat_instrument": "implementation_status", '
                '"task_schedule_date": "2025-07-02", "brush_activity_1_5": 1, "first_to_fifth_participants": "7"}\n')
        f.write("{not json\n")
    df = ingest.read_export(spark, path, "json")
    # (Spark rejects scans that need only the corrupt-record column, so read rows whole)
    assert sum(r[ingest.CORRUPT] is not None for r in df.collect()) == 1
    good = df.where(F.col(ingest.CORRUPT).isNull()).drop(ingest.CORRUPT)
    labels = spark.createDataFrame([("S1-1", "North")], "record_id string, block1 string")
    assert [r.block for r in ingest.extract_registry(good, labels).collect()] == ["North"]
    assert [r.participants for r in ingest.extract_log(good).collect()] == [7.0]


def test_cli_every_report_builds_and_runs(spark, scratch):
    import argparse

    from sitepulse import cli

    synth.raw_export(spark, SF_SMALL).write.parquet(f"{scratch}/raw")
    synth.label_export(spark, SF_SMALL).write.parquet(f"{scratch}/labels")
    root = f"{scratch}/store"
    ingest.refresh(spark, f"{scratch}/raw", f"{scratch}/labels", root)
    reg, log = ingest.read_snapshot(spark, root)
    a = argparse.Namespace(
        lo="2024-01-08", hi="2024-01-14", day="2024-01-10", month="2024-01-01", as_of="2024-01-11",
        blocks=None, areas=None, kinds=None, record_ids=None, ids=None, only_mixed=False, k=3,
    )
    names = [
        "period_rollup", "month_rollup", "entity_detail", "entity_day_list", "entity_kpis",
        "daily_coverage_long", "daily_coverage_wide", "entry_levels_wide", "entry_levels_long",
        "activity_levels_wide", "activity_levels_long", "no_activity_list", "has_entries_list",
        "monthly_crosstab", "block_summary", "summary_totals", "first_blocks", "daily_series",
        "daily_series_by_block", "first_blocks_series", "filter_blocks", "school_options",
    ]
    for name in names:
        df = cli.build_report(name, reg, log, a)
        assert df.count() > 0, name
    # the stored snapshot gives the same rollup counts as the bound driver tables
    got = cli.build_report("period_rollup", reg, log, a).where("entry > 0").count()
    assert got == E.queries()["has_entries_list"](spark, SF_SMALL).count()


def test_csv_export_columns_bind_by_name(spark, scratch):
    path = f"{scratch}/wide.csv"
    with open(path, "w") as f:
        f.write("extra_a,brush_activity_1_5,record_id,task_schedule_date,redcap_repeat_instrument,first_to_fifth_participants,extra_b\n")
        f.write("x,1,S1-1,2025-07-02,implementation_status,12,y\n")
        f.write("x,,S1-2,2025-07-03,implementation_status,abc,y\n")
    df = ingest.read_export(spark, path, "csv")
    rows = {r.record_id: r for r in df.collect()}
    assert rows["S1-1"].brush_activity_1_5 == 1 and rows["S1-1"].task_schedule_date == dt.date(2025, 7, 2)
    assert rows["S1-1"].site is None and rows["S1-1"][ingest.CORRUPT] is None
    log = {r.record_id: r.participants for r in ingest.extract_log(df.drop(ingest.CORRUPT)).collect()}
    assert log == {"S1-1": 12.0, "S1-2": None}


def test_failed_publish_keeps_the_previous_snapshot(spark, scratch):
    raw = synth.raw_export(spark, SF_SMALL)
    labels = synth.label_export(spark, SF_SMALL)
    reg, log = ingest.extract_registry(raw, labels), ingest.extract_log(raw)
    root = f"{scratch}/store"
    v1 = ingest.publish_snapshot(spark, reg, log, root)
    # the log write fails inside the job, after the registry of the new version was written
    broken = log.withColumn("participants", F.when(F.col("participants") > 0, F.raise_error("lost")).cast("double"))
    try:
        ingest.publish_snapshot(spark, reg, broken, root)
        raise AssertionError("expected the write to fail")
    except Exception as ex:  # noqa: BLE001
        assert "lost" in str(ex)
    assert ingest.current_version(spark, root) == v1
    r1, l1 = ingest.read_snapshot(spark, root)
    assert l1.count() == log.count() and r1.count() == reg.count()
    # a retry publishes a complete new version
    v3 = ingest.publish_snapshot(spark, reg, log, root)
    assert v3 != v1 and ingest.current_version(spark, root) == v3
    assert ingest.read_snapshot(spark, root)[1].count() == log.count()


def test_cli_sorted_export(spark, scratch):
    from sitepulse import cli

    synth.raw_export(spark, SF_SMALL).write.parquet(f"{scratch}/raw")
    synth.label_export(spark, SF_SMALL).write.parquet(f"{scratch}/labels")
    root = f"{scratch}/store"
    cli.main(["refresh", "--raw", f"{scratch}/raw", "--labels", f"{scratch}/labels", "--root", root])
    out = f"{scratch}/blocks"
    cli.main(["report", "daily_series_by_block", "--root", root, "--out", out, "--format", "csv", "--sorted"])
    rows = [(r.block, r.day) for r in spark.read.option("header", True).csv(out).collect()]
    assert len(rows) > 0 and rows == sorted(rows, key=lambda t: (t[0] is None, t[0] or "", t[1] or ""))


def test_table_exists_by_catalog_name(spark):
    spark.range(1).createOrReplaceTempView("sitepulse_probe_view")
    assert ingest.table_exists(spark, "sitepulse_probe_view")
    assert not ingest.table_exists(spark, "sitepulse_no_such_table")
