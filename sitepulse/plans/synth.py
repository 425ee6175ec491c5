"""Inputs that Spark derives from the driver tables for the ingest and
settings queries (the reference reads them from a form server)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitepulse.functions.scalars import epoch_seconds_ntz_sql, safe_number, split_key
from sitepulse.plans import params as P
from sitepulse.plans.bindings import EVENT_STATUS, ORDER_STATUS, lookup_sql, registry, table
from sitepulse.schema import LOG_INSTRUMENT, RAW_EXPORT_SCHEMA

JUNK_NUMBER = "n/a"


def _null(name: str) -> F.Column:
    return F.lit(None).cast(RAW_EXPORT_SCHEMA[name].dataType).alias(name)


def _record(key: str) -> F.Column:
    return F.concat(F.lit("C-"), F.col(key).cast("string")).alias("record_id")


def raw_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat export: one registry row per customer (NULL instrument) and one
    log row per event.  Both form their record_id ``C-<key>`` from the
    customer key alone, so no row of the log needs a join."""
    reg = registry(spark, sf_dir)
    reg_rows = reg.select(
        _record("entity_key"),
        _null("redcap_repeat_instrument"),
        _null("redcap_repeat_instance"),
        "site",
        "area_type",
        "school_type",
        F.col("school").alias("school1"),
        _null("task_start_date"),
        _null("task_schedule_date"),
        _null("activity_date"),
        _null("brush_activity_1_5"),
        _null("first_to_fifth_participants"),
    )
    ev = table(spark, sf_dir, "events")
    log_rows = ev.select(
        _record("user_id"),
        F.lit(LOG_INSTRUMENT).alias("redcap_repeat_instrument"),
        F.col("event_id").alias("redcap_repeat_instance"),
        _null("site"),
        _null("area_type"),
        _null("school_type"),
        _null("school1"),
        F.col("ts").alias("task_start_date"),
        F.to_date("ts").alias("task_schedule_date"),
        F.to_date("ts").alias("activity_date"),
        F.expr(lookup_sql("event_type", EVENT_STATUS)).alias("brush_activity_1_5"),
        F.when(F.col("event_type") == "error", F.lit(JUNK_NUMBER))
        .otherwise(F.col("value").cast("string"))
        .alias("first_to_fifth_participants"),
    )
    return reg_rows.unionByName(log_rows)


def orders_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``raw_export`` with one log row per order: several years of months."""
    rows = raw_export(spark, sf_dir).where("redcap_repeat_instrument IS NULL")
    orders = table(spark, sf_dir, "orders").select(
        _record("o_custkey"),
        F.lit(LOG_INSTRUMENT).alias("redcap_repeat_instrument"),
        F.col("o_orderkey").alias("redcap_repeat_instance"),
        *[_null(c) for c in ("site", "area_type", "school_type", "school1")],
        F.col("o_orderdate").alias("task_start_date"),
        F.to_date("o_orderdate").alias("task_schedule_date"),
        F.to_date("o_orderdate").alias("activity_date"),
        F.expr(lookup_sql("o_orderstatus", ORDER_STATUS)).alias("brush_activity_1_5"),
        F.col("o_totalprice").cast("string").alias("first_to_fifth_participants"),
    )
    return rows.unionByName(orders)


def label_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(record_id, block1); GA records are repeated with a NULL label."""
    reg = registry(spark, sf_dir)
    labelled = reg.select(_record("entity_key"), F.col("block").alias("block1"))
    repeats = reg.where(F.col("school_type") == "GA").select(_record("entity_key"), F.lit(None).cast("string").alias("block1"))
    return labelled.unionByName(repeats)


def settings_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Key/value writes: one per event, name = type/user, value = epoch
    seconds as text, version = event time (event_id breaks ties)."""
    ev = table(spark, sf_dir, "events")
    secs = F.expr(epoch_seconds_ntz_sql("ts"))
    return ev.select(
        F.concat(F.col("event_type"), F.lit("/"), F.col("user_id").cast("string")).alias("name"),
        secs.cast("string").alias("value"),
        F.col("ts").alias("version"),
        F.col("event_id").alias("seq"),
    )


def access_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """32-hex keys from event ids; error events give 31 chars, signups a 'g'."""
    ev = table(spark, sf_dir, "events")
    h = F.md5(F.col("event_id").cast("string"))
    key = (
        F.when(F.col("event_type") == "error", F.substring(h, 1, 31))
        .when(F.col("event_type") == "signup", F.concat(F.lit("g"), F.substring(h, 2, 31)))
        .otherwise(h)
    )
    return ev.select("event_id", key.alias("key"))


def key_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Composite keys with zero, one and two dashes, split on the first, and
    ids that only look like numbers (``1d``, ``1f``, ``1x5``)."""
    c = table(spark, sf_dir, "customer").select(
        "c_custkey", "c_name", "c_nationkey", "c_mktsegment", "c_acctbal"
    )
    base = F.concat(F.lit("S"), F.col("c_nationkey").cast("string"), F.lit("-"), F.col("c_custkey").cast("string"))
    key = (
        F.when(F.col("c_mktsegment") == "MACHINERY", F.col("c_name"))
        .when(F.col("c_mktsegment") == "BUILDING", F.concat(base, F.lit("-x")))
        .when(F.col("c_mktsegment") == "HOUSEHOLD", F.concat(base, F.lit("d")))
        .when((F.col("c_mktsegment") == "FURNITURE") & (F.col("c_acctbal") > 5000), F.concat(base, F.lit("x5")))
        .when(F.col("c_mktsegment") == "FURNITURE", F.concat(base, F.lit("f")))
        .otherwise(base)
    )
    site, rest = split_key(key)
    return c.select(
        "c_custkey",
        key.alias("key"),
        site.alias("site_code"),
        rest.alias("id_code"),
        safe_number(rest).alias("id_num"),
    )


def with_null_keys(reg: DataFrame, log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """NULL entity keys on both sides: ASIA/GA registry rows, and every log
    row without a known status (about two fifths of the log: a hot key)."""
    reg = reg.withColumn(
        "entity_key",
        F.when((F.col("block") == "ASIA") & (F.col("school_type") == "GA"), F.lit(None)).otherwise(
            F.col("entity_key")
        ),
    )
    log = log.withColumn(
        "entity_key", F.when(F.col("brush_activity").isNull(), F.lit(None)).otherwise(F.col("entity_key"))
    )
    return reg, log


def awkward(spark: SparkSession, reg: DataFrame, log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Registry and log with the cases that the plain tables lack.

    EUROPE has an entry of every entity on the report day (100 % coverage),
    AFRICA none (0 %).  Rural government schools of ASIA have no area,
    private ones of AMERICA an unlisted kind, schools of the MIDDLE EAST no
    block; rural private schools of ASIA are
    missing from the registry, so their entries are orphans, and the cell
    (U, PS) of AFRICA is empty.  Log rows without a measure have no day,
    log rows with an unknown status no start.
    """
    day = F.lit(P.DAY)
    every = reg.where("block = 'EUROPE'").select(
        "entity_key",
        F.lit(P.DAY).cast("timestamp_ntz").alias("task_start_date"),
        day.alias("task_schedule_date"),
        F.lit(1).alias("brush_activity"),
        F.lit(1).cast(log.schema["participants"].dataType).alias("participants"),
        F.lit(-1).cast("long").alias("seq"),
    )
    africa = reg.where("block = 'AFRICA'").select(F.col("entity_key").alias("__a"))
    on_day = (F.col("task_schedule_date") == day) & (F.col("entity_key") == F.col("__a"))
    log = log.join(africa, on_day, "left_anti").unionByName(every)
    log = log.withColumns(
        {
            "task_schedule_date": F.when(F.col("participants").isNotNull(), F.col("task_schedule_date")),
            "task_start_date": F.when(F.col("brush_activity").isNotNull(), F.col("task_start_date")),
        }
    )
    reg = reg.where(
        "NOT (block = 'ASIA' AND area_type = 'R' AND school_type = 'PS')"
        " AND NOT (block = 'AFRICA' AND area_type = 'U' AND school_type = 'PS')"
    )
    reg = reg.withColumns(
        {
            "area_type": F.expr("CASE WHEN block = 'ASIA' AND area_type = 'R' AND school_type = 'GS' THEN NULL ELSE area_type END"),
            "school_type": F.expr("CASE WHEN block = 'AMERICA' AND school_type = 'PS' THEN 'XX' ELSE school_type END"),
            "block": F.expr("CASE WHEN block = 'MIDDLE EAST' THEN NULL ELSE block END"),
        }
    )
    return reg, log
