"""Key/value settings store.

An append-only parquet table of (name, value, version).  A write appends
rows; a read keeps, per name, the row with the highest version (last write
wins).  A write's version is above all versions in the store, whatever the
caller's clock says; of two writes that race to one version the larger value
wins on every read, so a writer that must know reads back.  Appends never rewrite earlier files, so a failed or
retried write cannot lose the previous value.
"""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitepulse.functions.scalars import datetime_text, key_is_valid, mask_key, safe_number
from sitepulse.fixed import KEY_PATTERN, STALE_AFTER_HOURS
from sitepulse.schema import SETTINGS_SCHEMA

_EPOCH = dt.datetime(1970, 1, 1)


def epoch_ntz() -> Column:
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")


def _micros(now: dt.datetime) -> int:
    delta = now - _EPOCH
    return (delta.days * 86400 + delta.seconds) * 1_000_000 + delta.microseconds


def upsert(spark: SparkSession, path: str, values: dict[str, str], *, now: dt.datetime | None = None) -> None:
    """Append (name, value, version) rows; version = now in epoch micros, or
    one more than the store's highest if the clock is behind it."""
    now = now or dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    _restore(spark, path)
    version = max(_micros(now), _highest(spark, path) + 1)
    rows = [(str(k), str(v), version) for k, v in values.items()]
    spark.createDataFrame(rows, SETTINGS_SCHEMA).coalesce(1).write.mode("append").parquet(path)


def stored(spark: SparkSession, path: str) -> DataFrame:
    """All rows of the store; the compaction's copy while the store itself is missing or empty."""
    own = _rows(spark, path)
    if own is None or not own.take(1):
        copied = _rows(spark, _copy(path))
        own = own if copied is None else copied
    if own is None:
        raise FileNotFoundError(f"no settings store at {path}")
    return own


def _rows(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.schema(SETTINGS_SCHEMA).parquet(path)
    except AnalysisException:
        return None


def _restore(spark: SparkSession, path: str) -> None:
    """Finish a compaction that died while it replaced the store."""
    own, copied = _rows(spark, path), _rows(spark, _copy(path))
    if copied is not None and (own is None or not own.take(1)):
        copied.coalesce(1).write.mode("append").parquet(path)


def _copy(path: str) -> str:
    return path.rstrip("/") + ".compacting"


def _highest(spark: SparkSession, path: str) -> int:
    """Highest version in the store (one scalar), or -1."""
    try:
        return stored(spark, path).agg(F.coalesce(F.max("version"), F.lit(-1))).first()[0]
    except FileNotFoundError:
        return -1


def compact(spark: SparkSession, path: str) -> None:
    """Rewrite the store as one file with the last write of each name.

    The rows are first copied beside the store, and reads use that copy while
    the store is being replaced, so a crash loses nothing.  Runs without
    another writer (a write in between would be lost).
    """
    rows = latest(stored(spark, path)).select(*SETTINGS_SCHEMA.fieldNames())
    rows.coalesce(1).write.mode("overwrite").parquet(_copy(path))
    copied = spark.read.schema(SETTINGS_SCHEMA).parquet(_copy(path))
    copied.coalesce(1).write.mode("overwrite").parquet(path)


def set_key(spark: SparkSession, path: str, key: str, name: str = "api_key", **kw) -> None:
    """Store an access key; refuses one that does not match the key pattern."""
    if not re.fullmatch(KEY_PATTERN.strip("^$"), key or ""):
        raise ValueError("the access key must be 32 hex digits")
    upsert(spark, path, {name: key}, **kw)


def latest(df: DataFrame, *, order: Sequence[str] = ("version", "seq")) -> DataFrame:
    """Last write per name: (name, value, version)."""
    order = [c for c in order if c in df.columns]
    rank = F.struct(*[F.col(c) for c in order], F.col("value"))
    return (
        df.groupBy("name")
        .agg(F.max_by(F.struct("value", order[0]), rank).alias("__l"))
        .select("name", F.col("__l.value").alias("value"), F.col(f"__l.{order[0]}").alias("version"))
    )


def read(spark: SparkSession, path: str) -> DataFrame:
    return latest(stored(spark, path))


def lookup(spark: SparkSession, path: str, name: str) -> str | None:
    """Point lookup of one value (S10); a single scalar reaches the driver."""
    row = read(spark, path).where(F.col("name") == name).select("value").first()
    return None if row is None else row["value"]


def freshness(
    latest_rows: DataFrame,
    now: dt.datetime,
    stale_after_hours: float = STALE_AFTER_HOURS,
    names: Sequence[str] = (),
) -> DataFrame:
    """Age of each value read as epoch seconds (S11): hours, half-even
    rounded hours, strict ``> stale_after_hours`` staleness (a missing or
    unparsable value is stale) and the 'dd MMM yyyy hh:mm a' text.  Each of
    ``names`` without a row gets one with a NULL value, which is stale."""
    if names:
        spark = latest_rows.sparkSession
        wanted = spark.createDataFrame([(n,) for n in dict.fromkeys(names)], "name string")
        missing = wanted.join(latest_rows, "name", "left_anti").withColumn("value", F.lit(None).cast("string"))
        latest_rows = latest_rows.select("name", "value").unionByName(missing)
    secs = safe_number("value")
    now_s = _micros(now) / 1_000_000
    age = (F.lit(now_s) - secs) / F.lit(3600.0)
    last = F.timestamp_add("MICROSECOND", F.round(secs * 1_000_000).cast("long"), epoch_ntz())
    return latest_rows.select(
        "name",
        last.alias("last_update"),
        age.alias("age_hours"),
        F.bround(age, 0).alias("age_hours_rounded"),
        (secs.isNull() | (age > stale_after_hours)).alias("stale"),
        datetime_text(last).alias("last_update_text"),
    )


def check_keys(df: DataFrame, column: str = "key") -> DataFrame:
    """Key pattern check and masked display form."""
    return df.select(
        "*",
        key_is_valid(column).alias("valid"),
        mask_key(column).alias("masked"),
    )
