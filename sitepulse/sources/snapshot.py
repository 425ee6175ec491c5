"""Stored snapshots (S6, S7): registry, log and month totals, published together.

A publish compares the new log with the current one month by month and
writes only the months that differ; the rest stay where they are.  What a
version consists of is one small table: per month (and for the registry) the
folder that holds it, its number of rows and two order-independent sums of
row hashes.  The settings pointer ``current_version`` makes a version
current, so a reader sees all of it or none.

    <root>/log/v=<folder>/day_month=<month>/     the log, clustered by entity
    <root>/totals/v=<folder>/day_month=<month>/  deduped totals per entity and month
    <root>/registry/v=<folder>/                  the registry
    <root>/parts/v=<version>/                    part, month, folder, rows, checksums
    <root>/settings/                             the pointer

Within a month the log is range-partitioned and sorted by entity, then day
and source order.  So one school lies in few row groups, which Parquet's
statistics and its Bloom filter on the key tell, while an entity with very
many entries still spreads over files by its days.
"""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitepulse.operators.rollup import month_totals
from sitepulse.schema import LOG_SCHEMA, REGISTRY_SCHEMA, Roles
from sitepulse.sources import settings as S

#: Log rows of one file (about).
FILE_ROWS = 4_000_000

#: Bytes of a row group: small enough that one school's rows are a small read.
ROW_GROUP_BYTES = 32 << 20

MONTH = "day_month"

#: Fields of the export that no schema names, as one VARIANT object.
EXTRA = "extra"

#: Order of a month's rows.
CLUSTERED = ["record_id", "task_schedule_date", "task_start_date", "seq"]

PARTS_SCHEMA = T.StructType(
    [
        T.StructField("part", T.StringType()),
        T.StructField(MONTH, T.DateType()),
        T.StructField("folder", T.StringType()),
        T.StructField("rows", T.LongType()),
        T.StructField("hash_sum", T.DecimalType(38, 0)),
        T.StructField("hash_xor", T.LongType()),
    ]
)

TOTALS_SCHEMA = T.StructType(
    [
        T.StructField("record_id", T.StringType()),
        T.StructField("entry", T.LongType()),
        T.StructField("participants", T.DecimalType(38, 10)),
        T.StructField("activity", T.LongType()),
    ]
)

# Roles for a published snapshot: the log keeps its month partition column
# and the export's order.
SNAPSHOT_ROLES = Roles(day_partition=MONTH, tiebreak=("seq",))


def new_version() -> str:
    now = dt.datetime.now(dt.timezone.utc)
    return now.strftime("%Y%m%dT%H%M%S") + "-" + uuid.uuid4().hex[:8]


def checksums(df: DataFrame, keys: list, columns: list[str]) -> DataFrame:
    """Rows, sum and xor of the rows' 64-bit hashes per key: equal for equal sets of rows in any order.

    One partial aggregate; the sums are decimals, which no number of rows overflows.
    """
    h = F.xxhash64(*[F.to_json(c) if df.schema[c].dataType == T.VariantType() else F.col(c) for c in columns])
    hashed = df.select(*keys, h.alias("h"))
    return hashed.groupBy(*[F.col(k) if isinstance(k, str) else k for k in hashed.columns[:-1]]).agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum(F.col("h").cast("decimal(20,0)")).cast("decimal(38,0)").alias("hash_sum"),
        F.bit_xor("h").alias("hash_xor"),
    )


def parts(spark: SparkSession, root: str, version: str | None) -> dict:
    """(part, month) -> (folder, rows, hash_sum, hash_xor) of a version: one row per stored month."""
    if version is None:
        return {}
    rows = spark.read.schema(PARTS_SCHEMA).parquet(f"{root}/parts/v={version}").collect()
    return {(r["part"], r[MONTH]): (r["folder"], r["rows"], r["hash_sum"], r["hash_xor"]) for r in rows}


def current_version(spark: SparkSession, root: str) -> str | None:
    try:
        return S.lookup(spark, f"{root}/settings", "current_version")
    except FileNotFoundError:
        return None


def publish_snapshot(
    spark: SparkSession,
    registry: DataFrame,
    log: DataFrame,
    root: str,
    *,
    version: str | None = None,
    now: dt.datetime | None = None,
    need_registry: bool = False,
    stamp: bool = True,
    file_rows: int = FILE_ROWS,
    row_group_bytes: int = ROW_GROUP_BYTES,
) -> str:
    """Write what differs from the current version, then flip the pointer.

    ``log`` is read twice (checksums, then the months that differ), so it
    should be stored already, as ``ingest.refresh`` stages it.  Nothing
    becomes current if a write fails or, with ``need_registry``, if the
    registry is empty.  ``stamp=False`` leaves ``last_update`` alone (no data
    was refreshed).
    """
    version = version or new_version()
    now = now or dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    before = parts(spark, root, current_version(spark, root))
    found = {("registry", None): _write_registry(spark, registry, root, version, before.get(("registry", None)))}
    if need_registry and not found["registry", None][1]:
        raise ValueError("the export has no registry rows; keeping the current snapshot")

    names = LOG_SCHEMA.fieldNames() + [c for c in log.columns if c == EXTRA]
    rows = log.select(*names).withColumn(MONTH, F.trunc("task_schedule_date", "MM"))
    new = {("log", r[MONTH]): tuple(r)[1:] for r in checksums(rows, [MONTH], names).collect()}
    changed = [k for k, sums in new.items() if before.get(k, ())[1:] != sums]
    _write_months(spark, rows, root, version, {m: new[p, m][0] for p, m in changed}, file_rows, row_group_bytes)
    for k, sums in new.items():
        found[k] = (version if k in changed else before[k][0], *sums)

    table = [(part, month, *rest) for (part, month), rest in found.items()]
    spark.createDataFrame(table, PARTS_SCHEMA).coalesce(1).write.mode("errorifexists").parquet(f"{root}/parts/v={version}")
    epoch = (now - dt.datetime(1970, 1, 1)).total_seconds()
    values = {"current_version": version} | ({"last_update": f"{epoch:.0f}"} if stamp else {})
    S.upsert(spark, f"{root}/settings", values, now=now)
    if current_version(spark, root) != version:
        raise RuntimeError(f"another publish overtook {version}; it is written but not current")
    return version


def _write_registry(spark, registry: DataFrame, root: str, version: str, before: tuple | None) -> tuple:
    """The registry is written whole, its count and checksums observed on the way; of an equal one the old folder stays."""
    names = REGISTRY_SCHEMA.fieldNames()
    h = F.xxhash64(*names)
    seen = Observation()
    registry.select(*names).observe(
        seen,
        F.count(F.lit(1)).alias("rows"),
        F.sum(h.cast("decimal(20,0)")).cast("decimal(38,0)").alias("hash_sum"),
        F.bit_xor(h).alias("hash_xor"),
    ).write.mode("errorifexists").parquet(f"{root}/registry/v={version}")
    sums = tuple(seen.get[k] for k in ("rows", "hash_sum", "hash_xor"))
    if before and before[1:] == sums:
        delete(spark, f"{root}/registry/v={version}")
        return before
    return (version, *sums)


def in_months(months: list) -> F.Column:
    """Rows of the months, the rows without a day (None) included."""
    days = [m for m in months if m is not None]
    cond = F.col(MONTH).isin(days) if days else F.lit(False)
    return cond | F.col(MONTH).isNull() if None in months else cond


def _write_months(spark, rows: DataFrame, root: str, version: str, months: dict, file_rows: int, group_bytes: int) -> None:
    """The months' rows, in as many range partitions as their counted rows need, and their totals."""
    if not months:
        return
    files = sum(-(-count // file_rows) for count in months.values())
    at_once = min(len(months), spark.sparkContext.defaultParallelism)  # many small months are written side by side
    n = max(files, at_once)
    dealt = rows.where(in_months(list(months))).repartitionByRange(n, MONTH, *CLUSTERED)
    base = f"{root}/log/v={version}"
    (
        dealt.sortWithinPartitions(MONTH, *CLUSTERED)
        .write.mode("errorifexists")
        .partitionBy(MONTH)
        .option("parquet.block.size", group_bytes)
        .option("parquet.bloom.filter.enabled#record_id", "true")
        .parquet(base)
    )
    written = _read(spark, f"{root}/log", LOG_SCHEMA, {m: version for m in months})
    totals = month_totals(written.where(F.col(MONTH).isNotNull()), MONTH, SNAPSHOT_ROLES)
    (
        totals.repartitionByRange(max(files // 8, at_once), MONTH, "record_id")  # far fewer entities than entries
        .sortWithinPartitions(MONTH, "record_id")
        .write.mode("errorifexists")
        .partitionBy(MONTH)
        .parquet(f"{root}/totals/v={version}")
    )


def _read(spark: SparkSession, base: str, schema: T.StructType, folders: dict) -> DataFrame:
    """The months' folders as one scan with ``day_month`` as partition column."""
    whole = T.StructType([*schema.fields, T.StructField("v", T.StringType()), T.StructField(MONTH, T.DateType())])
    if not folders:
        return spark.createDataFrame([], whole).drop("v")
    name = {m: "__HIVE_DEFAULT_PARTITION__" if m is None else m.isoformat() for m in folders}
    paths = [f"{base}/v={folder}/{MONTH}={name[m]}" for m, folder in folders.items()]
    return spark.read.schema(whole).option("basePath", base).parquet(*paths).drop("v")


def read_snapshot(
    spark: SparkSession, root: str, version: str | None = None, extra: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Typed read of the published registry and log (S7), with ``extra`` the log's unknown fields too.

    The log carries ``day_month`` (its partition column); use
    ``SNAPSHOT_ROLES`` so day filters prune month directories."""
    found = _parts_of(spark, root, version)
    folder = found["registry", None][0]
    reg = spark.read.schema(REGISTRY_SCHEMA).parquet(f"{root}/registry/v={folder}")
    schema = T.StructType([*LOG_SCHEMA.fields, *[T.StructField(EXTRA, T.VariantType())] * extra])
    return reg, _read(spark, f"{root}/log", schema, {m: f[0] for (p, m), f in found.items() if p == "log"})


def read_totals(spark: SparkSession, root: str, version: str | None = None) -> DataFrame:
    """Deduped totals per entity and month (record_id, entry, participants, activity, day_month) of a version.

    Give it to ``period_rollup`` as ``totals``: then a range reads its whole
    months from here and only its edge months from the log.
    """
    found = _parts_of(spark, root, version)
    folders = {m: f[0] for (p, m), f in found.items() if p == "log" and m is not None}
    return _read(spark, f"{root}/totals", TOTALS_SCHEMA, folders)


def _parts_of(spark: SparkSession, root: str, version: str | None) -> dict:
    version = version or current_version(spark, root)
    if version is None:
        raise FileNotFoundError(f"no published snapshot under {root}")
    return parts(spark, root, version)


def retire(spark: SparkSession, root: str, before: dt.datetime, keep: int = 1) -> list[str]:
    """Remove versions made before ``before`` (UTC, the grace period's start), but the newest ``keep`` and the current one.

    A folder goes only if no version that stays lists it; staged exports and
    rejected rows go with their version.  Returns the versions removed.
    """
    listed = spark.read.schema("part string, v string").parquet(f"{root}/parts").select("v").distinct()
    versions = sorted(r["v"] for r in listed.collect())
    current = current_version(spark, root)
    stay = {current, *versions[len(versions) - keep :]} | {v for v in versions if v >= before.strftime("%Y%m%dT%H%M%S")}
    gone = [v for v in versions if v not in stay]
    used = {(p, f[0]) for v in stay if v in versions for (p, _), f in parts(spark, root, v).items()}
    used |= {(p, m, f[0]) for v in stay if v in versions for (p, m), f in parts(spark, root, v).items()}
    for v in gone:
        for (part, month), (folder, *_) in parts(spark, root, v).items():
            if part == "registry" and (part, folder) not in used:
                delete(spark, f"{root}/registry/v={folder}")
            elif part == "log" and (part, month, folder) not in used:
                name = "__HIVE_DEFAULT_PARTITION__" if month is None else month.isoformat()
                delete(spark, f"{root}/log/v={folder}/{MONTH}={name}")
                delete(spark, f"{root}/totals/v={folder}/{MONTH}={name}")
        for path in (f"v={v}", f"stage/v={v}", f"parts/v={v}"):
            delete(spark, f"{root}/{path}")
    return gone


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder of a finished or retired version."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
