"""Bind the driver's TPC-H-style tables to the registry / log roles.

registry <- customer x nation x region (one row per customer)
log      <- events (main) or orders (second log)

The log keeps the numeric customer key as its entity, so it never has to
be joined to ``customer`` before it is aggregated; ``record_id``
(``S<region>-<custkey>``) lives on the registry side only.  nation and
region are fixed-domain dimension tables (25 and 5 rows); their joins are
left to Spark's size-checked broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitepulse.functions.scalars import exact_measure_sql
from sitepulse.functions.sqlexpr import lit
from sitepulse.schema import Roles

# How the driver tables map onto the reference's dimensions.
ACCTBAL_URBAN_ABOVE = 5000
SEGMENT_KIND = {
    "AUTOMOBILE": "GS",
    "FURNITURE": "GS",
    "BUILDING": "GA",
    "HOUSEHOLD": "GA",
    "MACHINERY": "PS",
}
EVENT_STATUS = {"purchase": 1, "click": 1, "view": 2}
ORDER_STATUS = {"F": 1, "O": 2}
NO_MEASURE_EVENT = "error"

ROLES = Roles(entity="entity_key", tiebreak=("seq",))

# Declared read schemas (columns this engine reads): no footer inference
# per read, and a type drift in the inputs fails at the scan.
TABLE_SCHEMAS = {
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "region": "r_regionkey INT, r_name STRING",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, "
    "o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING",
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Reads the files that are there now: every call lists them anew."""
    reader = spark.read
    if name in TABLE_SCHEMAS:
        reader = reader.schema(TABLE_SCHEMAS[name])
    return reader.parquet(f"{sf_dir}/{name}.parquet")


def lookup_sql(c: str, mapping: dict) -> str:
    """A small fixed code book as SQL text (one expression, one plan call)."""
    cases = " ".join(f"WHEN {lit(k)} THEN {v if isinstance(v, int) else lit(v)}" for k, v in mapping.items())
    return f"CASE {c} {cases} END"


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n, r = (table(spark, sf_dir, name) for name in ("customer", "nation", "region"))
    j = c.join(n, F.expr("c_nationkey = n_nationkey"), "left").join(r, F.expr("n_regionkey = r_regionkey"), "left")
    return j.selectExpr(
        "c_custkey AS entity_key",
        "concat('S', CAST(n_regionkey AS STRING), '-', CAST(c_custkey AS STRING)) AS record_id",
        "CAST(n_regionkey AS STRING) AS site",
        f"CASE WHEN c_acctbal > {ACCTBAL_URBAN_ABOVE} THEN 'U' ELSE 'R' END AS area_type",
        f"{lookup_sql('c_mktsegment', SEGMENT_KIND)} AS school_type",
        "c_name AS school",
        "r_name AS block",
    )


def events_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(
        "user_id AS entity_key",
        "ts AS task_start_date",
        "to_date(ts) AS task_schedule_date",
        f"{lookup_sql('event_type', EVENT_STATUS)} AS brush_activity",
        f"CASE WHEN event_type <> {lit(NO_MEASURE_EVENT)} THEN {exact_measure_sql('value')} END AS participants",
        "event_id AS seq",
    )


def orders_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(
        "o_custkey AS entity_key",
        "o_orderdate AS task_start_date",
        "to_date(o_orderdate) AS task_schedule_date",
        f"{lookup_sql('o_orderstatus', ORDER_STATUS)} AS brush_activity",
        f"{exact_measure_sql('o_totalprice')} AS participants",
        "o_orderkey AS seq",
    )


class Bound:
    """Registry + log + roles; each table is read only when first used."""

    def __init__(self, spark: SparkSession, sf_dir: str, log_fn, roles: Roles = ROLES):
        self._spark, self._dir, self._log_fn, self.roles = spark, sf_dir, log_fn, roles
        self._registry = self._log = None

    @property
    def registry(self) -> DataFrame:
        if self._registry is None:
            self._registry = registry(self._spark, self._dir)
        return self._registry

    @property
    def log(self) -> DataFrame:
        if self._log is None:
            self._log = self._log_fn(self._spark, self._dir)
        return self._log


def bind_events(spark: SparkSession, sf_dir: str) -> Bound:
    return Bound(spark, sf_dir, events_log)


def bind_orders(spark: SparkSession, sf_dir: str) -> Bound:
    return Bound(spark, sf_dir, orders_log)
