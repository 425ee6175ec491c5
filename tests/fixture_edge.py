"""FIXTURES.md section 4: hand-made registry and log with known answers."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from sitepulse.functions.scalars import safe_number
from sitepulse.schema import REGISTRY_SCHEMA, Roles

REGISTRY_ROWS = [
    ("S1-1", "1", "R", "GS", "Alpha", "North"),
    ("S1-2", "1", "U", "GA", "Beta", "North"),
    ("S1-3", "1", "R", "GS", "Gamma", "North"),
    ("S2-1", "2", "U", "PS", "Alpha", "South"),
    ("S2-2", "2", "U", "PS", "Alpha", "South"),
    ("NOID", "9", "R", "GA", "Delta", "East"),
    ("S3-7-b", "3", "R", "PS", "Eps", "West"),
]


def _ts(s):
    return None if s is None else dt.datetime.fromisoformat(s)


def _d(s):
    return None if s is None else dt.date.fromisoformat(s)


LOG_ROWS = [
    (1, "S1-1", "2025-07-02 09:00", "2025-07-02", 1, "10"),
    (2, "S1-1", "2025-07-02 11:00", "2025-07-02", 2, "12"),
    (3, "S1-1", None, "2025-07-02", 1, "99"),
    (4, "S1-1", "2025-07-03 09:00", "2025-07-03", 1, "20"),
    (5, "S1-3", "2025-07-02 09:00", "2025-07-02", 1, None),
    (6, "S2-1", "2025-07-02 08:00", "2025-07-02", 3, "5"),
    (7, "S2-2", "2025-07-02 08:00", "2025-07-02", 1, "7"),
    (8, "S2-2", "2025-07-02 08:00", "2025-07-02", 2, "8"),
    (9, "GHOST-9", "2025-07-02 08:00", "2025-07-02", 1, "50"),
    (10, "S1-2", "2025-08-01 09:00", "2025-08-01", 1, "30"),
    (11, "S1-2", "2025-07-31 09:00", None, 1, "5"),
    (12, "NOID", "2025-07-02 09:00", "2025-07-02", 1, "abc"),
    (13, "S3-7-b", "2025-07-31 23:59", "2025-07-31", 1, "4"),
]

ROLES = Roles(tiebreak=("seq",))


def registry(spark):
    return spark.createDataFrame(REGISTRY_ROWS, REGISTRY_SCHEMA)


def log(spark):
    rows = [(s, r, _ts(t), _d(d), b, p) for s, r, t, d, b, p in LOG_ROWS]
    df = spark.createDataFrame(
        rows,
        "seq BIGINT, record_id STRING, task_start_date TIMESTAMP_NTZ, task_schedule_date DATE, "
        "brush_activity INT, participants_raw STRING",
    )
    return df.withColumn("participants", safe_number(F.col("participants_raw"))).drop("participants_raw")
