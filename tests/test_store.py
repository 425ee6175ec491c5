"""Stored snapshots: month totals, changed months only, one scan of the export, clustered files."""

from __future__ import annotations

import datetime as dt
import glob
import os

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import fixture_edge as FX
from conftest import SF_SMALL
from sitepulse.functions.scalars import percent_of
from sitepulse.operators import flag_repeats, latest_per_day, period_rollup
from sitepulse.operators.coverage import presence_bitmaps, presence_over_range
from sitepulse.operators.numbering import number_within
from sitepulse.operators.rollup import split_range
from sitepulse.plans import reports as R
from sitepulse.plans import synth
from sitepulse.schema import Roles
from sitepulse.sources import ingest, settings, snapshot
from test_rules import plan

ROLES = snapshot.SNAPSHOT_ROLES


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    """Orders of several years, published through the refresh job."""
    base = str(tmp_path_factory.mktemp("orders"))
    synth.orders_export(spark, SF_SMALL).write.parquet(f"{base}/raw")
    synth.label_export(spark, SF_SMALL).write.parquet(f"{base}/labels")
    ingest.refresh(spark, f"{base}/raw", f"{base}/labels", f"{base}/store")
    return f"{base}/store"


def files(path):
    return {f: os.path.getmtime(f) for f in glob.glob(f"{path}/**/*.parquet", recursive=True)}


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


# ---------------------------------------------------------------- month totals


def test_ranges_split_at_whole_months():
    d = dt.date
    assert split_range(d(2024, 1, 10), d(2024, 1, 20)) == ([(d(2024, 1, 10), d(2024, 1, 20))], None)
    assert split_range(d(2024, 1, 1), d(2024, 2, 29)) == ([], (d(2024, 1, 1), d(2024, 2, 1)))
    assert split_range(d(2024, 1, 10), d(2024, 2, 20)) == ([(d(2024, 1, 10), d(2024, 2, 20))], None)
    assert split_range(d(2023, 12, 31), d(2024, 3, 1)) == (
        [(d(2023, 12, 31), d(2023, 12, 31)), (d(2024, 3, 1), d(2024, 3, 1))],
        (d(2024, 1, 1), d(2024, 2, 1)),
    )
    with pytest.raises(ValueError):
        split_range(d(2024, 2, 1), d(2024, 1, 1))


@pytest.mark.parametrize(
    "lo, hi", [("1996-02-10", "1997-05-20"), ("1996-01-01", "1996-12-31"), ("1996-03-02", "1996-03-30"), ("1996-03-31", "1996-04-01")]
)
def test_month_totals_add_up_to_the_log(spark, store, lo, hi):
    reg, log = ingest.read_snapshot(spark, store)
    totals = ingest.read_totals(spark, store)
    got = period_rollup(log, reg, lo, hi, roles=ROLES, totals=totals)
    exact = log.withColumn("participants", F.col("participants").cast("decimal(28,10)"))
    assert rows(got) == rows(period_rollup(exact, reg, lo, hi, roles=ROLES))
    some = dict(blocks=["ASIA"], areas=["R"])
    assert rows(period_rollup(log, reg, lo, hi, roles=ROLES, totals=totals, **some)) == rows(
        period_rollup(exact, reg, lo, hi, roles=ROLES, **some)
    )


def test_a_long_range_reads_only_its_edge_months_from_the_log(spark, store):
    reg, log = ingest.read_snapshot(spark, store)
    totals = ingest.read_totals(spark, store)
    text = plan(period_rollup(log, reg, "1996-02-10", "1997-05-20", roles=ROLES, totals=totals))
    scans = [s for s in text.split("Scan parquet")[1:] if "PartitionFilters" in s]
    by_table = {("log" if "task_schedule_date" in s.split("ReadSchema")[1] else "totals"): s.split("PartitionFilters: [")[1].split("\n")[0] for s in scans}
    assert "IN (1996-02-01,1997-05-01)" in by_table["log"]
    assert "1996-03-01" in by_table["totals"] and "1997-04-01" in by_table["totals"]
    whole = plan(period_rollup(log, reg, "1996-01-01", "1996-12-31", roles=ROLES, totals=totals))
    assert "task_schedule_date" not in whole


# ------------------------------------------------------- changed months only


def test_only_changed_months_are_written(spark, store, scratch):
    reg, log = ingest.read_snapshot(spark, store)
    root = f"{scratch}/store"
    v1 = ingest.publish_snapshot(spark, reg, log, root)
    first = files(root)
    months = log.select("day_month").distinct().count()
    assert len(snapshot.parts(spark, root, v1)) == months + 1

    march = F.col("task_schedule_date").between(F.lit(dt.date(1996, 3, 1)), F.lit(dt.date(1996, 3, 31)))
    edited = log.withColumn("brush_activity", F.when(march, F.lit(2)).otherwise(F.col("brush_activity")))
    v2 = ingest.publish_snapshot(spark, reg, edited.repartition(7), root)
    assert {k: m for k, m in files(root).items() if k in first} == first  # nothing was rewritten in place
    new = {os.path.dirname(f) for f in files(root) if f not in first and "/settings" not in f and "/parts" not in f}
    assert new == {f"{root}/log/v={v2}/day_month=1996-03-01", f"{root}/totals/v={v2}/day_month=1996-03-01"}
    assert snapshot.parts(spark, root, v2)["registry", None][0] == v1
    assert rows(ingest.read_snapshot(spark, root)[1].drop("day_month")) == rows(edited.drop("day_month"))
    assert rows(ingest.read_snapshot(spark, root, v1)[1].drop("day_month")) == rows(log.drop("day_month"))
    got = period_rollup(*reversed(ingest.read_snapshot(spark, root)), "1996-01-01", "1996-12-31", roles=ROLES, totals=ingest.read_totals(spark, root))
    assert got.agg(F.sum("activity")).first()[0] < got.agg(F.sum("entry")).first()[0]

    # a month that is gone, and the same export again
    v3 = ingest.publish_snapshot(spark, reg, edited.where(~march), root)
    assert not os.path.exists(f"{root}/log/v={v3}")
    assert ingest.read_snapshot(spark, root)[1].where(march).count() == 0
    before = files(f"{root}/log")
    v4 = ingest.publish_snapshot(spark, reg, edited.where(~march), root)
    assert files(f"{root}/log") == before and v4 != v3

    # versions before the grace period go, what the current one uses stays
    assert ingest.retire(spark, root, dt.datetime(2000, 1, 1)) == []
    assert sorted(ingest.retire(spark, root, dt.datetime(2999, 1, 1))) == sorted([v1, v2, v3])
    assert ingest.read_snapshot(spark, root)[1].count() == edited.where(~march).count()
    assert not os.path.exists(f"{root}/log/v={v2}/day_month=1996-03-01")
    assert not os.path.exists(f"{root}/registry/v={v2}")
    assert ingest.read_totals(spark, root).count() > 0


def test_checksums_see_repeats_and_moved_values(spark):
    log = FX.log(spark).withColumn("m", F.lit(1))
    names = ["record_id", "participants", "seq"]

    def sums(df):
        return tuple(snapshot.checksums(df, ["m"], names).first())[1:]

    base = sums(log)
    assert sums(log.repartition(5)) == base
    twice = log.unionByName(log)
    assert sums(twice) != base and sums(twice.unionByName(log))[2] == base[2]  # three times: the xor alone would not see it
    assert sums(log.withColumn("participants", F.col("participants") + 1)) != base


def test_rows_without_a_day_and_an_empty_log(spark, scratch):
    root, reg = f"{scratch}/store", FX.registry(spark)
    log = FX.log(spark).withColumn("activity_date", F.col("task_schedule_date"))
    log = log.withColumn("task_schedule_date", F.when(F.col("seq") % 2 == 0, F.col("task_schedule_date")))
    ingest.publish_snapshot(spark, reg, log, root)
    assert rows(ingest.read_snapshot(spark, root)[1].select("seq", "task_schedule_date")) == rows(log.select("seq", "task_schedule_date"))
    assert ingest.read_totals(spark, root).where("day_month IS NULL").count() == 0
    ingest.publish_snapshot(spark, reg, log.limit(0), root)
    reg2, log2 = ingest.read_snapshot(spark, root)
    assert log2.count() == 0 and ingest.read_totals(spark, root).count() == 0
    got = period_rollup(log2, reg2, "2025-06-01", "2025-07-31", roles=ROLES, totals=ingest.read_totals(spark, root))
    assert got.agg(F.sum("entry")).first()[0] == 0


# ------------------------------------------------------------ one scan


def test_refresh_scans_the_export_once(spark, scratch, monkeypatch):
    """Registry and log come from the stage, which a single map-only job writes."""
    synth.orders_export(spark, SF_SMALL).write.parquet(f"{scratch}/raw")
    synth.label_export(spark, SF_SMALL).write.parquet(f"{scratch}/labels")
    given = {}

    def publish(spark, registry, log, root, **kw):
        given.update(registry=registry.inputFiles(), log=log.inputFiles())
        return snapshot.publish_snapshot(spark, registry, log, root, **kw)

    monkeypatch.setattr(ingest, "publish_snapshot", publish)
    ingest.refresh(spark, f"{scratch}/raw", f"{scratch}/labels", f"{scratch}/store")
    assert all("/stage/" in f for f in given["log"])
    assert all("/stage/" in f or "/labels/" in f for f in given["registry"])
    assert not os.path.exists(glob.glob(f"{scratch}/store/stage")[0] + "/v=" + ingest.current_version(spark, f"{scratch}/store"))
    raw = ingest.read_export(spark, f"{scratch}/raw")
    staged, seen = ingest.stage_export(raw, f"{scratch}/stage")
    kinds = {r.kind: r["count"] for r in staged.groupBy("kind").count().collect()}
    assert seen == {"rows": raw.count(), "rejected": 0, "registry": kinds["registry"], "log": kinds["log"]}
    assert "Exchange" not in plan(staged)


def test_a_failed_refresh_keeps_the_pointer(spark, store, scratch):
    before = settings.read(spark, f"{store}/settings").collect()
    spark.createDataFrame([], ingest.RAW_EXPORT_SCHEMA).write.parquet(f"{scratch}/raw")
    spark.createDataFrame([], ingest.LABEL_EXPORT_SCHEMA).write.parquet(f"{scratch}/labels")
    with pytest.raises(ValueError, match="no registry rows"):
        ingest.refresh(spark, f"{scratch}/raw", f"{scratch}/labels", store)
    assert settings.read(spark, f"{store}/settings").collect() == before


# ------------------------------------------------------------ clustered log


def groups_with(path, record):
    """Row groups and those whose statistics may hold a record, over all files of a folder."""
    every, held = 0, 0
    for f in sorted(files(path)):
        meta = pq.ParquetFile(f).metadata
        for i in range(meta.num_row_groups):
            column = next(c for c in (meta.row_group(i).column(j) for j in range(meta.num_columns)) if c.path_in_schema == "record_id")
            every += 1
            held += column.statistics.min <= record <= column.statistics.max
    return every, held


def test_one_school_lies_in_few_row_groups(spark, scratch):
    """A hot entity (half of the rows) spreads over files, the others over one or two."""
    log = spark.range(40_000).select(
        F.when(F.col("id") % 2 == 0, F.lit("C-hot")).otherwise(F.concat(F.lit("C-"), F.col("id") % 500)).alias("record_id"),
        F.expr("CAST(DATE'2024-01-01' + CAST(id % 31 AS INT) AS TIMESTAMP_NTZ)").alias("task_start_date"),
        F.expr("DATE'2024-01-01' + CAST(id % 31 AS INT)").alias("task_schedule_date"),
        F.lit(None).cast("date").alias("activity_date"),
        F.lit(1).alias("brush_activity"),
        F.lit(1.0).alias("participants"),
        F.col("id").alias("seq"),
    )
    root = f"{scratch}/store"
    v = ingest.publish_snapshot(spark, FX.registry(spark), log.repartition(9), root, file_rows=2_000, row_group_bytes=8_192)
    path = f"{root}/log/v={v}"
    assert len(files(path)) >= 18
    every, held = groups_with(path, "C-7")
    assert every >= 18 and held <= 2
    hot = [f for f in files(path) if set(pq.read_table(f, columns=["record_id"])["record_id"].to_pylist()) == {"C-hot"}]
    assert len(hot) >= 6
    one = ingest.read_snapshot(spark, root)[1].where("record_id = 'C-7'")
    assert one.count() == 80 and "EqualTo(record_id,C-7)" in plan(one)


# ------------------------------------------------- numbering, pages, bitmaps


def test_numbers_within_a_hot_group(spark):
    """A group over many range partitions, NULL keys, ties, and the whole table as one group."""
    rows = [("a", i % 50, i) for i in range(900)] + [(None, i, i) for i in range(40)] + [("b", None, 1), ("", 1, 1)]
    df = spark.createDataFrame(rows, "k string, o int, id int").repartition(5)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        got = number_within(df, ["k"], ["o", "id"], "n")
        assert got.columns == ["k", "o", "id", "n"]
        by = {}
        for r in got.collect():
            by.setdefault(r.k, []).append(r)
        assert {k: len(v) for k, v in by.items()} == {"a": 900, None: 40, "b": 1, "": 1}
        for v in by.values():
            assert [r.n for r in sorted(v, key=lambda r: (r.o is not None, r.o, r.id))] == list(range(1, len(v) + 1))
        whole = sorted(r.n for r in number_within(df, [], ["o", "id"], "n").collect())
        assert whole == list(range(1, len(rows) + 1))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


def test_school_pages(spark):
    pages = R.school_pages(FX.registry(spark), 2).collect()
    flat = sorted((p.block, p.page, s.school, s.record_id) for p in pages for s in p.schools)
    assert all(1 <= len(p.schools) <= 2 for p in pages)
    assert flat == [
        ("East", 1, "Delta", "NOID"), ("North", 1, "Alpha", "S1-1"), ("North", 1, "Beta", "S1-2"), ("North", 2, "Gamma", "S1-3"),
        ("South", 1, "Alpha", "S2-1"), ("South", 1, "Alpha", "S2-2"), ("West", 1, "Eps", "S3-7-b"),
    ]
    with pytest.raises(ValueError):
        R.school_pages(FX.registry(spark), 0)


def test_bitmaps_of_parts_of_a_range_merge(spark):
    reg, log = FX.registry(spark), FX.log(spark)
    whole = presence_bitmaps(log, reg, "2025-07-01", "2025-07-31", roles=FX.ROLES)
    got = {r.block: (r.any_day, r.every_day) for r in presence_over_range(whole, "2025-07-02", "2025-07-03").collect()}
    assert got == {"North": (2, 1), "South": (2, 0), "East": (1, 0)}
    one = {r.block: (r.any_day, r.every_day) for r in presence_over_range(whole, "2025-07-02", "2025-07-02").collect()}
    assert one == {"North": (2, 2), "South": (2, 2), "East": (1, 1)}
    empty = presence_bitmaps(log.limit(0), reg, "2025-07-01", "2025-07-31", roles=FX.ROLES)
    assert presence_over_range(empty, "2025-07-01", "2025-07-31").count() == 0


def test_dense_days(spark):
    reg, log = FX.registry(spark), FX.log(spark)
    days = {r.day: r.entries for r in R.dense_days(R.daily_series(log, FX.ROLES), "2025-07-01", "2025-07-04").collect()}
    assert days == {dt.date(2025, 7, 1): 0, dt.date(2025, 7, 2): 10, dt.date(2025, 7, 3): 1, dt.date(2025, 7, 4): 0} or len(days) == 4
    series = R.daily_series_by_block(log, reg, roles=FX.ROLES)
    blocks = R.filter_blocks(reg).unionByName(spark.createDataFrame([(None,)], "block string"))
    got = R.dense_days(series, "2025-07-01", "2025-07-04", blocks)
    assert got.count() == 4 * blocks.distinct().count() and got.where("entries IS NULL").count() == 0
    inside = series.where("day BETWEEN DATE'2025-07-01' AND DATE'2025-07-04'").agg(F.sum("entries")).first()[0]
    assert got.agg(F.sum("entries")).first()[0] == inside


# --------------------------------------------------------------- source order


def test_source_order_tells_identical_rows_apart(spark, scratch):
    """A hot pile of equal rows: one stays, without a window over the pile."""
    pile = spark.createDataFrame([("a", dt.date(2025, 7, 2), None, 1)] * 400 + [("b", dt.date(2025, 7, 2), None, 1)] * 2, "record_id string, task_schedule_date date, task_start_date timestamp_ntz, v int")
    pile.repartition(4).write.parquet(f"{scratch}/log")
    log, roles = ingest.with_source_order(spark.read.parquet(f"{scratch}/log"), Roles())
    flagged = flag_repeats(log, roles)
    got = {r.record_id: r.n for r in flagged.where("NOT dup").groupBy("record_id").agg(F.count("*").alias("n")).collect()}
    assert got == {"a": 1, "b": 1} and flagged.count() == 402
    first = flagged.where("NOT dup AND record_id = 'a'").first()
    assert first.source_file == log.where("record_id = 'a'").agg(F.min("source_file")).first()[0]
    # the only window is the group-limited pick of the latest rows
    assert plan(flagged).count("(Window") == plan(latest_per_day(log, roles)).count("(Window")
    assert latest_per_day(log, roles).count() == 2


def test_percent_text_of_small_measures(spark):
    df = spark.createDataFrame([("0.004", "0.008"), ("0.004", "0.004"), ("0.0000000001", "0.0000000003"), ("1", "0"), ("123456789012345678901", "123456789012345678901")], "n string, d string")
    cast = [F.col(c).cast("decimal(38,10)").alias(c) for c in ("n", "d")]
    got = [r[0] for r in df.select(*cast).select(percent_of("n", "d")).collect()]
    assert got == ["50.00", "100.00", "33.33", None, "100.00"]


# -------------------------------------------------------------- unknown fields


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_unknown_fields_are_kept(spark, scratch, fmt):
    raw = synth.orders_export(spark, SF_SMALL).limit(400)
    wide = raw.withColumns({"a.b": F.col("redcap_repeat_instance") % 3, "note": F.when(F.col("redcap_repeat_instance") % 2 == 0, F.lit("x,\"y"))})
    w = wide.write.option("header", True)
    getattr(w, fmt)(f"{scratch}/raw")
    df = ingest.read_export(spark, f"{scratch}/raw", fmt, keep_unknown=True)
    got = df.select(F.expr("variant_get(extra, '$.note', 'string')").alias("note"), F.expr("variant_get(extra, '$[\\'a.b\\']', 'int')").alias("b"))
    assert rows(got) == rows(wide.select("note", F.col("`a.b`").cast("int")))
    plain = ingest.read_export(spark, f"{scratch}/raw", fmt)
    assert "extra" not in plain.columns
    none = ingest.read_export(spark, f"{scratch}/raw", fmt, schema=df.drop("extra", ingest.CORRUPT).schema, keep_unknown=True)
    assert none.where("extra IS NOT NULL").count() == df.where("extra IS NOT NULL").count()
    with pytest.raises(ValueError, match="parquet and csv"):
        ingest.read_export(spark, f"{scratch}/raw", "json", keep_unknown=True)


# ---------------------------------------------------------- runtime filters


def test_a_filtered_registry_prunes_the_log_before_the_dedupe(spark, store):
    """Spark's own Bloom filter of the selected entities sits below the group limit, where both sides are too large to broadcast."""
    reg, log = ingest.read_snapshot(spark, store)
    conf = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "0",
    }
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        some = period_rollup(log, reg, "1996-02-10", "1996-03-20", blocks=["ASIA"], areas=["R"], roles=ROLES)
        text = some._jdf.queryExecution().optimizedPlan().toString()
        assert text.index("WindowGroupLimit") < text.index("might_contain")
        every = period_rollup(log, reg, "1996-02-10", "1996-03-20", roles=ROLES)
        assert "might_contain" not in every._jdf.queryExecution().optimizedPlan().toString()
        assert rows(some) == rows(every.where("block = 'ASIA' AND area_type = 'R'"))
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_cli_reports_from_totals_and_retires(spark, store, scratch, capsys):
    from sitepulse import cli

    args = ["report", "period_rollup", "--root", store, "--lo", "1996-02-10", "--hi", "1997-05-20", "--out", f"{scratch}/out", "--format", "parquet"]
    cli.main(args)
    reg, log = ingest.read_snapshot(spark, store)
    want = period_rollup(log, reg, "1996-02-10", "1997-05-20", roles=ROLES)
    got = spark.read.parquet(f"{scratch}/out")
    assert got.schema["participants"].dataType == want.schema["participants"].dataType
    assert [r[:-2] for r in rows(got)] == [r[:-2] for r in rows(want)] or rows(got.drop("participants")) == rows(want.drop("participants"))
    cli.main(["retire", "--root", store, "--hours", "1000000"])
    assert capsys.readouterr().out.strip() == ""
