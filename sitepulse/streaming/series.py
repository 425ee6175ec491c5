"""Daily entry series (R4/R5) kept current as log files land.

The reference recomputes its series from a full snapshot on every refresh,
so late entries are always counted.  The incremental form keeps that
property: no watermark (no row is ever dropped as late).  Each micro-batch
is reduced by the batch report and added to the previous totals, which are
one row per (block, day).

Sink protocol (exactly-once under retries): epoch ``e`` writes the complete
table to ``<sink>/slot=<e mod SLOTS>`` with overwrite, then appends ``e`` to
the sink's pointer table (the append-only settings store).  A replayed epoch
rewrites the same directory and re-appends the same pointer; readers take
the highest committed epoch (one aggregate row).  So a sink holds SLOTS
tables however long it runs, a reader has SLOTS - 1 epochs to finish, and
the pointer table is compacted every COMPACT_EVERY epochs.  A sink belongs to the
checkpoint that first wrote it: another one, or an epoch that neither
follows nor repeats the last one (a lost checkpoint starts again at 0), is
refused instead of being counted wrongly.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sitepulse.plans.reports import daily_series_by_block
from sitepulse.schema import LOG_SCHEMA, Roles
from sitepulse.sources import ingest, settings


def _checkpoint_root(spark: SparkSession) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        raise ValueError("set spark.checkpoint.dir (a shared folder) or pass checkpoint=")
    return root


#: Complete tables kept in a sink, and epochs between compactions of its pointer table.
SLOTS = 8
COMPACT_EVERY = 100


def _slot(sink: str, epoch: int) -> str:
    return os.path.join(sink, f"slot={epoch % SLOTS}")


def _pointer(sink: str) -> str:
    return os.path.join(sink, "_pointer")


def _latest_epoch(spark: SparkSession, sink: str) -> int | None:
    """Highest committed epoch.  One aggregate row reaches the driver,
    however many epochs have been committed."""
    if not ingest.table_exists(spark, _pointer(sink)):
        return None
    e = F.col("value").cast("long")
    rows = settings.stored(spark, _pointer(sink)).where(F.col("name") == "epoch")
    return rows.agg(F.max(e).alias("e")).first()["e"]


def read_series(spark: SparkSession, sink: str) -> DataFrame:
    """The latest complete series table: (block, day, entries)."""
    latest = _latest_epoch(spark, sink)
    if latest is None:
        return spark.createDataFrame([], "block STRING, day DATE, entries BIGINT")
    return spark.read.parquet(_slot(sink, latest))


def _check_owner(spark: SparkSession, sink: str, stream: str, epoch_id: int) -> None:
    last = _latest_epoch(spark, sink)
    if last is None:
        if epoch_id:
            raise ValueError(f"{sink} has no epoch before {epoch_id}; its earlier counts are lost")
        return
    owner = settings.lookup(spark, _pointer(sink), "stream")
    if owner != stream:
        raise ValueError(f"{sink} belongs to the stream with checkpoint {owner!r}, not {stream!r}")
    if epoch_id not in (last, last + 1):
        raise ValueError(f"epoch {epoch_id} does not follow epoch {last} of {sink}; was the checkpoint lost?")


def _add_batch(sink: str, registry: DataFrame, roles: Roles, stream: str = ""):
    def write(batch: DataFrame, epoch_id: int) -> None:
        spark = batch.sparkSession
        _check_owner(spark, sink, stream, epoch_id)
        # the batch report itself: counts per (entity, day) first, then the
        # registry join, then per (block, day) -- skew-safe, AQE applies
        totals = daily_series_by_block(batch, registry, roles=roles)
        if epoch_id:
            old = spark.read.parquet(_slot(sink, epoch_id - 1))
            totals = (
                old.unionByName(totals)
                .groupBy("block", "day")
                .agg(F.sum("entries").cast("long").alias("entries"))
            )
        totals.write.mode("overwrite").parquet(_slot(sink, epoch_id))
        settings.upsert(spark, _pointer(sink), {"epoch": str(epoch_id), "stream": stream})
        if epoch_id and epoch_id % COMPACT_EVERY == 0:
            settings.compact(spark, _pointer(sink))

    return write


def start_series_stream(
    spark: SparkSession,
    log_dir: str,
    registry: DataFrame,
    sink: str,
    *,
    roles: Roles = Roles(),
    log_schema=LOG_SCHEMA,
    checkpoint: str | None = None,
    available_now: bool = False,
    max_files_per_trigger: int | None = None,
) -> StreamingQuery:
    """Start the incremental R5 series over parquet log files under ``log_dir``.

    The stream only delivers new rows.  Each micro-batch runs the batch
    report over them (orphans count under a NULL block, as in the batch
    report) and adds its counts to the previous committed epoch, so there is
    no streaming state store and no watermark: late rows are always counted.
    The checkpoint defaults to a folder under the session's
    ``spark.checkpoint.dir``.
    """
    checkpoint = checkpoint or os.path.join(_checkpoint_root(spark), "series-stream")
    reader = spark.readStream.schema(log_schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    rows = reader.parquet(log_dir).select(roles.entity, roles.day)
    writer = rows.writeStream.foreachBatch(_add_batch(sink, registry, roles, checkpoint)).option(
        "checkpointLocation", checkpoint
    )
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()
