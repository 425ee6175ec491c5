"""Incremental series equals the batch report after every landed batch."""

from __future__ import annotations

import datetime as dt
import os

from pyspark.sql import functions as F

from conftest import SF_SMALL
from sitepulse.plans import reports as R
from sitepulse.plans import synth
from sitepulse.sources import ingest
from sitepulse.streaming import read_series, start_series_stream
from sitepulse.schema import Roles


def _as_set(df):
    return {(r.block, r.day, r.entries) for r in df.collect()}


def test_series_stream_matches_batch(spark, scratch):
    raw = synth.raw_export(spark, SF_SMALL)
    reg = ingest.extract_registry(raw, synth.label_export(spark, SF_SMALL))
    log = ingest.extract_log(raw)
    landing, sink = f"{scratch}/landing", f"{scratch}/series"
    ckpt = os.path.join(spark.conf.get("spark.checkpoint.dir"), os.path.basename(scratch), "series")
    early = log.where(F.col("task_schedule_date") < dt.date(2024, 1, 15))
    late = log.where(~(F.col("task_schedule_date") < dt.date(2024, 1, 15)) | F.col("task_schedule_date").isNull())
    # second drop re-delivers some early days (late data) -- they must be added, not dropped
    early.write.parquet(f"{landing}/part1")
    q = start_series_stream(spark, f"{landing}/*", reg, sink, roles=Roles(), checkpoint=ckpt, available_now=True)
    q.awaitTermination(300)
    assert _as_set(read_series(spark, sink)) == _as_set(R.daily_series_by_block(early, reg, roles=Roles()))
    late.write.parquet(f"{landing}/part2")
    early.limit(50).write.parquet(f"{landing}/part3")
    both = early.unionByName(late).unionByName(early.limit(50))
    q = start_series_stream(spark, f"{landing}/*", reg, sink, roles=Roles(), checkpoint=ckpt, available_now=True)
    q.awaitTermination(300)
    got = read_series(spark, sink)
    assert got.agg(F.sum("entries")).first()[0] == both.count()
    landed = spark.read.parquet(f"{landing}/*")
    assert _as_set(got) == _as_set(R.daily_series_by_block(landed, reg, roles=Roles()))


def test_replayed_epoch_is_counted_once(spark, scratch):
    from sitepulse.streaming.series import _add_batch

    raw = synth.raw_export(spark, SF_SMALL)
    reg = ingest.extract_registry(raw, synth.label_export(spark, SF_SMALL))
    log = ingest.extract_log(raw).select("record_id", "task_schedule_date")
    a = log.where(F.col("task_schedule_date") < dt.date(2024, 1, 10))
    b = log.where(F.col("task_schedule_date") >= dt.date(2024, 1, 10))
    sink = f"{scratch}/series"
    write = _add_batch(sink, reg, Roles())
    write(a, 0)
    write(b, 1)
    write(b, 1)  # the same epoch again, as after a failure between write and commit
    got = read_series(spark, sink)
    assert got.agg(F.sum("entries")).first()[0] == a.count() + b.count()
    assert _as_set(got) == _as_set(R.daily_series_by_block(log, reg, roles=Roles()))


def test_many_micro_batches_add_up(spark, scratch):
    raw = synth.raw_export(spark, SF_SMALL)
    reg = ingest.extract_registry(raw, synth.label_export(spark, SF_SMALL))
    log = ingest.extract_log(raw)
    landing, sink = f"{scratch}/landing", f"{scratch}/series"
    ckpt = os.path.join(spark.conf.get("spark.checkpoint.dir"), os.path.basename(scratch), "many")
    for i, (lo, hi) in enumerate([(1, 8), (8, 16), (16, 24), (24, 32)]):
        part = log.where(F.dayofmonth("task_schedule_date").between(lo, hi - 1))
        part.coalesce(1).write.parquet(f"{landing}/p{i}")
    q = start_series_stream(
        spark, f"{landing}/*", reg, sink, roles=Roles(), checkpoint=ckpt, available_now=True, max_files_per_trigger=1
    )
    q.awaitTermination(300)
    assert len(q.recentProgress) >= 4  # one micro-batch per landed file
    landed = spark.read.parquet(f"{landing}/*")
    assert _as_set(read_series(spark, sink)) == _as_set(R.daily_series_by_block(landed, reg, roles=Roles()))
