"""Registered queries over the stored snapshot.

Each lands an export that Spark derives from the driver's tables, publishes
it through the refresh job in a folder of its own under the shared folder,
and reports from what was stored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitepulse.operators.crosstab import monthly_crosstab
from sitepulse.operators.dedupe import flag_repeats
from sitepulse.operators.rollup import month_rollup, period_rollup
from sitepulse.plans import params as P
from sitepulse.plans import reports as R
from sitepulse.plans import synth
from sitepulse.plans.bindings import bind_events, table
from sitepulse.schema import Roles
from sitepulse.session import new_folder
from sitepulse.sources import ingest, snapshot


def published(spark: SparkSession, sf_dir: str) -> str:
    """The root of a store that holds the orders, refreshed from landed exports."""
    base = new_folder(spark, "store")
    synth.orders_export(spark, sf_dir).write.parquet(f"{base}/raw")
    synth.label_export(spark, sf_dir).write.parquet(f"{base}/labels")
    ingest.refresh(spark, f"{base}/raw", f"{base}/labels", f"{base}/root")
    return f"{base}/root"


def q_stored_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R6 over fifteen months: thirteen stored month totals and the log's two edge months."""
    root = published(spark, sf_dir)
    reg, log = ingest.read_snapshot(spark, root)
    return period_rollup(
        log, reg, *P.LONG_RANGE, roles=ingest.SNAPSHOT_ROLES, totals=ingest.read_totals(spark, root)
    )


def q_stored_monthly_crosstab(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R16 of one month from its stored totals alone."""
    root = published(spark, sf_dir)
    reg, log = ingest.read_snapshot(spark, root)
    totals = ingest.read_totals(spark, root)
    return monthly_crosstab(month_rollup(log, reg, P.ORDERS_MONTH, roles=ingest.SNAPSHOT_ROLES, totals=totals))


def q_stored_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored log, typed, with its month."""
    return ingest.read_snapshot(spark, published(spark, sf_dir))[1]


def q_stored_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.read_snapshot(spark, published(spark, sf_dir))[0]


def q_empty_store_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store made empty, then a registry without entries: every entity with zeros."""
    root = new_folder(spark, "store")
    ingest.ensure_tables(spark, root)
    if not ingest.table_exists(spark, f"{root}/settings"):
        raise RuntimeError("the store was not made")
    log = ingest.read_snapshot(spark, root)[1].drop("day_month")
    raw, labels = synth.raw_export(spark, sf_dir), synth.label_export(spark, sf_dir)
    ingest.publish_snapshot(spark, ingest.extract_registry(raw, labels), log, root)
    reg, log = ingest.read_snapshot(spark, root)
    return period_rollup(log, reg, *P.LONG_RANGE, roles=ingest.SNAPSHOT_ROLES, totals=ingest.read_totals(spark, root))


def q_changed_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Months of the current version after one month's statuses changed: rows, and whether it was written anew."""
    root = published(spark, sf_dir)
    reg, log = ingest.read_snapshot(spark, root)
    lo, hi = P.CHANGED_MONTH
    inside = F.col("task_schedule_date").between(F.lit(lo), F.lit(hi))
    edited = log.withColumn("brush_activity", F.when(inside, F.lit(2)).otherwise(F.col("brush_activity")))
    version = ingest.publish_snapshot(spark, reg, edited, root)
    parts = spark.read.schema(snapshot.PARTS_SCHEMA).parquet(f"{root}/parts/v={version}")
    return parts.where("part = 'log'").select(
        snapshot.MONTH, "rows", (F.col("folder") == version).alias("written")
    )


def q_stored_unknown_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields that no schema names, kept by the refresh and read back from the stored log."""
    base = new_folder(spark, "store")
    asked = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("redcap_repeat_instance"), F.col("o_orderpriority").alias("visit priority"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("weight"),
    )
    raw = synth.orders_export(spark, sf_dir)
    raw.join(asked, "redcap_repeat_instance", "left").write.parquet(f"{base}/raw")
    synth.label_export(spark, sf_dir).write.parquet(f"{base}/labels")
    ingest.refresh(spark, f"{base}/raw", f"{base}/labels", f"{base}/root", keep_unknown=True)
    log = ingest.read_snapshot(spark, f"{base}/root", extra=True)[1]
    return log.groupBy(F.expr("variant_get(extra, '$[\\'visit priority\\']', 'string')").alias("priority"), "day_month").agg(
        F.count(F.lit(1)).alias("n"),
        F.count(F.expr("variant_get(extra, '$.weight', 'double')")).alias("weighed"),
        F.max(F.expr("variant_get(extra, '$.weight', 'double')")).alias("heaviest"),
    )


def q_refresh_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the refresh's one pass counts of a csv export, and the stored rows by kind.

    Orders with an unknown status land with a text where a number belongs.
    """
    base = new_folder(spark, "landing")
    raw = synth.orders_export(spark, sf_dir)
    code = F.expr("CASE WHEN brush_activity_1_5 IS NULL AND redcap_repeat_instrument IS NOT NULL THEN 'x'"
                  " ELSE CAST(brush_activity_1_5 AS STRING) END")
    raw.withColumn("brush_activity_1_5", code).write.option("header", True).csv(f"{base}/raw")
    staged, seen = ingest.stage_export(ingest.read_export(spark, f"{base}/raw", "csv"), f"{base}/stage")
    kinds = staged.groupBy("kind").agg(
        F.count(F.lit(1)).alias("stored"), F.count("text").alias("with_text"), F.count("brush_activity_1_5").alias("coded")
    )
    return kinds.withColumns({f"seen_{k}": F.lit(v).cast("long") for k, v in seen.items()})


def q_export_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The block summary written as csv with a header and read back."""
    b = bind_events(spark, sf_dir)
    summary = R.block_summary(b.log, b.registry, P.AS_OF, roles=b.roles)
    path = new_folder(spark, "export")
    ingest.export_table(summary, path, "csv")
    return spark.read.schema(summary.schema).option("header", True).csv(path)


def q_repeat_flags_source_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W1 over a log without a sequence column: ties (every order of a customer and day) keep the files' order."""
    orders, roles = ingest.with_source_order(table(spark, sf_dir, "orders"), Roles(entity="entity_key"))
    log = orders.selectExpr(
        "o_custkey AS entity_key",
        "o_orderdate AS task_start_date",
        "to_date(o_orderdate) AS task_schedule_date",
        "o_orderkey AS order_key",
        *ingest.SOURCE,
    )
    return flag_repeats(log, roles).drop(*ingest.SOURCE, "task_start_date")


QUERIES = {name[2:]: fn for name, fn in list(globals().items()) if name.startswith("q_") and callable(fn)}
