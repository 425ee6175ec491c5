"""Table schemas, column roles and dimension domains."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

from sitepulse.fixed import (  # noqa: F401  (re-exported)
    AREA_LABELS,
    AREAS,
    KIND_LABELS,
    KINDS,
    LOG_INSTRUMENT,
    STATUS_DONE,
    STATUS_LABELS,
    STATUS_NOT_DONE,
)


@dataclass(frozen=True)
class Roles:
    """Column roles.  Operators read inputs through these names only.

    ``entity`` is the join key and must exist under that name in both the
    registry and the log.  ``tiebreak`` columns carry the source order: of
    entries with equal start times the first one in that order wins (all
    ascending).  The latest-per-day pick refuses to run without them.
    """

    entity: str = "record_id"
    day: str = "task_schedule_date"
    start: str = "task_start_date"
    status: str = "brush_activity"
    measure: str = "participants"
    tiebreak: tuple[str, ...] = field(default_factory=tuple)
    key: str = "record_id"
    name: str = "school"
    group: str = "block"
    area: str = "area_type"
    kind: str = "school_type"
    # The tiebreak columns tell all rows of an (entity, day, start) apart.
    unique_order: bool = False
    # Month partition column of a stored log (first day of the day's month);
    # day filters also constrain it so whole directories are pruned.
    day_partition: str | None = None


REGISTRY_SCHEMA = T.StructType(
    [
        T.StructField("record_id", T.StringType()),
        T.StructField("site", T.StringType()),
        T.StructField("area_type", T.StringType()),
        T.StructField("school_type", T.StringType()),
        T.StructField("school", T.StringType()),
        T.StructField("block", T.StringType()),
    ]
)

LOG_SCHEMA = T.StructType(
    [
        T.StructField("record_id", T.StringType()),
        T.StructField("task_start_date", T.TimestampNTZType()),
        T.StructField("task_schedule_date", T.DateType()),
        T.StructField("activity_date", T.DateType()),
        T.StructField("brush_activity", T.IntegerType()),
        T.StructField("participants", T.DoubleType()),
        T.StructField("seq", T.LongType()),
    ]
)

SETTINGS_SCHEMA = T.StructType(
    [
        T.StructField("name", T.StringType(), False),
        T.StructField("value", T.StringType(), False),
        T.StructField("version", T.LongType(), False),
    ]
)

# Raw form export: registry rows have a NULL repeat instrument, log rows carry
# LOG_INSTRUMENT and, in the repeat instance, their order within the record.
# Participants arrive as text and are coerced on extract.
RAW_EXPORT_SCHEMA = T.StructType(
    [
        T.StructField("record_id", T.StringType()),
        T.StructField("redcap_repeat_instrument", T.StringType()),
        T.StructField("redcap_repeat_instance", T.LongType()),
        T.StructField("site", T.StringType()),
        T.StructField("area_type", T.StringType()),
        T.StructField("school_type", T.StringType()),
        T.StructField("school1", T.StringType()),
        T.StructField("task_start_date", T.TimestampNTZType()),
        T.StructField("task_schedule_date", T.DateType()),
        T.StructField("activity_date", T.DateType()),
        T.StructField("brush_activity_1_5", T.IntegerType()),
        T.StructField("first_to_fifth_participants", T.StringType()),
    ]
)

LABEL_EXPORT_SCHEMA = T.StructType(
    [
        T.StructField("record_id", T.StringType()),
        T.StructField("block1", T.StringType()),
    ]
)


def cells(areas=None, kinds=None) -> list[tuple[str, str, str]]:
    """Requested (area, kind, "area_kind") cells: the fixed pivot columns."""
    areas = AREAS if areas is None else tuple(areas)
    kinds = KINDS if kinds is None else tuple(kinds)
    if not areas or not kinds:
        raise ValueError("a crosstab needs one area type and one school type or more")
    return [(a, k, f"{a}_{k}") for k in kinds for a in areas]
