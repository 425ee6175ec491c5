"""Refresh job (R19): landed form export -> staged rows -> published snapshot.

S1/S2  read the raw and label exports with explicit schemas
S3/S4  split by row kind (registry: NULL instrument; log: the status form)
S5-S8  create / write / read / test stored tables (``sources.snapshot``)
The raw export is scanned once: a map-only write stages its rows by kind and
counts them on the way.  Registry and log are read from the stage.  A failed
refresh leaves the previous snapshot in place.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import replace

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.errors import AnalysisException

from sitepulse.functions.scalars import code_label, safe_number
from sitepulse.functions.sqlexpr import ident, lit
from sitepulse.schema import (
    AREA_LABELS,
    KIND_LABELS,
    LABEL_EXPORT_SCHEMA,
    LOG_INSTRUMENT,
    LOG_SCHEMA,
    RAW_EXPORT_SCHEMA,
    REGISTRY_SCHEMA,
)
from sitepulse.schema import Roles
from sitepulse.sources import settings as S
from sitepulse.sources.snapshot import (  # noqa: F401  (re-exported)
    EXTRA,
    SNAPSHOT_ROLES,
    current_version,
    delete,
    new_version,
    publish_snapshot,
    read_snapshot,
    read_totals,
    retire,
)

CORRUPT = "_corrupt_record"
#: Columns that hold a row's place in the files it was read from.
SOURCE = ("source_file", "source_row")
#: Share of rows with a value that does not parse above which a refresh fails.
MAX_REJECTED = 0.1


def read_export(
    spark: SparkSession, path: str, fmt: str = "parquet", schema=RAW_EXPORT_SCHEMA, keep_unknown: bool = False
) -> DataFrame:
    """Read a landed export with a fixed schema, columns matched by name.

    Extra columns in the export are ignored and missing ones read as NULL,
    so a wide form export works as is.  With ``keep_unknown`` (parquet, csv)
    the non-NULL fields outside the schema go into one VARIANT column,
    ``extra``, under their names; csv fields are text there.  csv/json rows
    that do not parse are kept, with their text in ``_corrupt_record``,
    instead of failing the job.
    """
    if keep_unknown and fmt == "json":
        raise ValueError("unknown fields can be kept of parquet and csv exports")
    if fmt == "csv":
        return _read_csv_by_name(spark, path, schema, keep_unknown)
    if keep_unknown:
        found = spark.read.format(fmt).load(path).schema  # the files' footers
        unknown = [f for f in found.fields if f.name not in schema.fieldNames()]
        whole = spark.read.schema(T.StructType([*schema.fields, *unknown])).format(fmt).load(path)
        return whole.select(*schema.fieldNames(), _variant([f.name for f in unknown]))
    if fmt == "json":
        with_corrupt = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
        return (
            spark.read.schema(with_corrupt)
            .option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", CORRUPT)
            .json(path)
        )
    return spark.read.schema(schema).format(fmt).load(path)


def _variant(names: list[str]) -> Column:
    """The named columns as one VARIANT object without its NULL fields; NULL if nothing is left."""
    if not names:
        return F.lit(None).cast("variant").alias(EXTRA)
    fields = F.to_json(F.struct(*[F.col(ident(c)) for c in names]))  # leaves NULL fields out
    return F.when(fields != "{}", F.parse_json(fields)).alias(EXTRA)


def _read_csv_by_name(spark: SparkSession, path: str, schema, keep_unknown: bool = False) -> DataFrame:
    """csv header names select the columns (a csv schema would bind by
    position); all files must have the same header, which Spark checks file
    by file.  Each typed value is a ``try_cast``.  A row with a value that is
    present but does not parse, or with too few or too many fields, is
    marked corrupt."""
    names = spark.read.option("header", True).csv(path).columns
    present = set(names)
    text = T.StructType([T.StructField(c, T.StringType()) for c in [*names, CORRUPT]])
    raw = (
        spark.read.schema(text)
        .option("header", True)
        .option("enforceSchema", False)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT)
        .csv(path)
    )
    cols, bad = [], [F.col(CORRUPT).isNotNull()]
    for f in schema.fields:
        src = F.col(f"`{f.name}`") if f.name in present else F.lit(None).cast("string")
        if isinstance(f.dataType, T.StringType):
            cols.append(src.alias(f.name))
            continue
        typed = src.try_cast(f.dataType)
        cols.append(typed.alias(f.name))
        bad.append(src.isNotNull() & typed.isNull())
    any_bad = bad[0]
    for b in bad[1:]:
        any_bad = any_bad | b
    shown = F.coalesce(F.col(CORRUPT), F.to_json(F.struct(*[F.col(f"`{c}`") for c in names])))
    extra = [_variant([c for c in names if c not in schema.fieldNames()])] if keep_unknown else []
    return raw.select(*cols, *extra, F.when(any_bad, shown).alias(CORRUPT))


def read_labels(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return read_export(spark, path, fmt, LABEL_EXPORT_SCHEMA).select("record_id", "block1")


def one_label(labels: DataFrame) -> DataFrame:
    """One label per record: a repeated record must not fan the registry
    out.  The smallest non-NULL label wins (deterministic)."""
    return labels.groupBy("record_id").agg(F.min("block1").alias("block1"))


def extract_registry(raw: DataFrame, labels: DataFrame) -> DataFrame:
    rows = raw.where(F.col("redcap_repeat_instrument").isNull()).select(
        "record_id", "site", "area_type", "school_type", "school1"
    )
    lab = one_label(labels).withColumnRenamed("record_id", "__lid")
    return (
        rows.join(lab, rows["record_id"].eqNullSafe(lab["__lid"]), "left")
        .withColumnsRenamed({"block1": "block", "school1": "school"})
        .select(*REGISTRY_SCHEMA.fieldNames())
    )


def extract_log(raw: DataFrame) -> DataFrame:
    return raw.where(F.col("redcap_repeat_instrument") == LOG_INSTRUMENT).select(
        "record_id",
        "task_start_date",
        "task_schedule_date",
        "activity_date",
        F.col("brush_activity_1_5").alias("brush_activity"),
        safe_number("first_to_fifth_participants").alias("participants"),
        F.col("redcap_repeat_instance").alias("seq"),
        *[c for c in raw.columns if c == EXTRA],
    )


def with_source_order(log: DataFrame, roles: Roles) -> tuple[DataFrame, Roles]:
    """A log as read from its files, with each row's file and place in it as last tiebreak.

    For a log without a sequence column: the reference keeps the first row
    in source order, and identical rows still have one first.
    """
    named = log.select("*", F.col("_metadata.file_path").alias(SOURCE[0]), F.col("_metadata.row_index").alias(SOURCE[1]))
    return named, replace(roles, tiebreak=(*roles.tiebreak, *SOURCE), unique_order=True)


def label_codes(registry: DataFrame) -> DataFrame:
    """Code-to-label for the two dimensions (fixed code books)."""
    return registry.select(
        "record_id",
        "block",
        "area_type",
        code_label("area_type", AREA_LABELS).alias("area_label"),
        "school_type",
        code_label("school_type", KIND_LABELS).alias("school_label"),
    )


# ------------------------------------------------------------------ storage


def empty(spark: SparkSession, schema) -> DataFrame:
    return spark.createDataFrame([], schema)


def table_exists(spark: SparkSession, name_or_path: str) -> bool:
    """A catalog table by name, or a readable parquet table at a path."""
    if "/" not in name_or_path:
        return spark.catalog.tableExists(name_or_path)
    try:
        spark.read.parquet(name_or_path).schema
    except AnalysisException:
        return False
    return True


def export_table(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """Tabular export of a report (S12): csv with a header, or parquet."""
    w = df.write.mode("overwrite")
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.format(fmt).save(path)


#: Kind of a row: NULL for a row of which nothing parses and for other instruments.
KIND = (
    "CASE WHEN {corrupt} IS NOT NULL AND coalesce({columns}) IS NULL THEN NULL"
    f" WHEN redcap_repeat_instrument IS NULL THEN 'registry' WHEN redcap_repeat_instrument = {lit(LOG_INSTRUMENT)} THEN 'log' END"
)


def stage_export(raw: DataFrame, path: str) -> tuple[DataFrame, dict]:
    """Write an export's rows by kind in one pass; the stored rows and what was counted on the way.

    No row is shuffled, so every input partition is counted once, in the
    stage that writes it.  Rows of other instruments are counted and left
    out, unless they have a value that does not parse.
    """
    columns = RAW_EXPORT_SCHEMA.fieldNames()
    corrupt = ident(CORRUPT) if CORRUPT in raw.columns else "CAST(NULL AS STRING)"
    kind = KIND.format(corrupt=corrupt, columns=", ".join(f"CAST({ident(c)} AS STRING)" for c in columns))
    extra = [c for c in raw.columns if c == EXTRA]
    rows = raw.select(*columns, *extra, F.expr(corrupt).alias("text"), F.expr(kind).alias("kind"))
    seen = Observation()
    (
        rows.observe(
            seen,
            F.count(F.lit(1)).alias("rows"),
            F.count("text").alias("rejected"),
            F.count_if(F.col("kind") == "registry").alias("registry"),
            F.count_if(F.col("kind") == "log").alias("log"),
        )
        .where("kind IS NOT NULL OR text IS NOT NULL")
        .write.mode("errorifexists")
        .partitionBy("kind")
        .parquet(path)
    )
    return raw.sparkSession.read.schema(rows.schema).parquet(path), seen.get


def refresh(
    spark: SparkSession,
    raw_path: str,
    labels_path: str,
    root: str,
    *,
    fmt: str = "parquet",
    now: dt.datetime | None = None,
    max_rejected: float = MAX_REJECTED,
    keep_unknown: bool = False,
) -> str:
    """Stage the raw export, split it, publish what changed as a new snapshot.

    The previous snapshot stays current until the new one is complete, and
    if the export holds no registry row.  A csv/json row with a value that
    does not parse keeps its place with that value NULL; its text goes to
    the version's ``rejected`` table too.  A row of which nothing parses is
    only there.  More than ``max_rejected`` such rows fail the refresh.  The
    staged rows are removed once the version is current.
    """
    version = new_version()
    stage = f"{root}/stage/v={version}"
    staged, seen = stage_export(read_export(spark, raw_path, fmt, keep_unknown=keep_unknown), stage)
    if seen["rejected"]:
        base = f"{root}/v={version}"
        bad = staged.where(F.col("text").isNotNull()).select("record_id", "text")
        bad.write.mode("errorifexists").parquet(f"{base}/rejected")
        if seen["rejected"] > max_rejected * seen["rows"]:
            raise ValueError(
                f"{seen['rejected']} of {seen['rows']} rows do not parse (see {base}/rejected); keeping the current snapshot"
            )
    registry = extract_registry(staged.where("kind = 'registry'"), read_labels(spark, labels_path, fmt))
    log = extract_log(staged.where("kind = 'log'"))
    publish_snapshot(spark, registry, log, root, version=version, now=now, need_registry=True)
    delete(spark, stage)
    return version


def refresh_if_stale(
    spark: SparkSession, raw_path: str, labels_path: str, root: str, *, now: dt.datetime | None = None, **kw
) -> str | None:
    """The refresh decision: refresh where ``last_update`` is missing or too
    old, else do nothing.  Returns the new version, or None."""
    now = now or dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    if table_exists(spark, f"{root}/settings"):
        rows = S.freshness(S.read(spark, f"{root}/settings"), now, names=["last_update"])
        if not rows.where("name = 'last_update'").first()["stale"]:
            return None
    return refresh(spark, raw_path, labels_path, root, now=now, **kw)


def ensure_tables(spark: SparkSession, root: str) -> None:
    """Publish an empty, typed snapshot if none exists yet; it counts as never refreshed."""
    if current_version(spark, root) is None:
        publish_snapshot(spark, empty(spark, REGISTRY_SCHEMA), empty(spark, LOG_SCHEMA), root, stamp=False)
