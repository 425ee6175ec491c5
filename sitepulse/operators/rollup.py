"""Per-entity period rollups that keep every registered entity.

Plan shape (see ``explain``): date filter pushed into the log scan ->
WindowGroupLimit(partial) -> exchange on (entity, day) -> latest row ->
partial aggregate -> exchange on entity -> final aggregate -> outer join
with the (already filtered) registry.  The log is reduced to one row per
entity before it meets the registry, so the join carries no log volume.
Broadcast is left to Spark's size checks (static threshold, then AQE
runtime statistics); the fallback is a sort-merge join.
"""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitepulse.functions.scalars import (
    exact_measure_sql,
    month_bounds,
    recode_status_sql,
    safe_number_sql,
    split_key_sql,
    validate_choice,
    validate_range,
)
from sitepulse.functions.sqlexpr import ident, lit
from sitepulse.operators.dedupe import latest_per_day
from sitepulse.schema import Roles

KEYS = ["__k", "__kn"]

ENTITY_COLUMNS = [
    "record_id",
    "site_code",
    "id_code",
    "id_num",
    "school",
    "block",
    "area_type",
    "school_type",
]


def entity_keys(df: DataFrame, name: str, prefix: str = "__k") -> list:
    """Null-safe join key as two plain columns: (value or zero, is NULL).

    Matching NULL to NULL (as the reference's joins do) with ``eqNullSafe``
    makes Spark re-hash both sides on these two expressions.  Grouping the
    log by the same two columns instead lets the join reuse the aggregate's
    hash partitioning, so the aggregated side is not shuffled twice.
    """
    c = ident(name)
    dtype = df.schema[name].dataType
    if isinstance(dtype, T.StringType):
        value = f"coalesce({c}, '')"
    elif isinstance(dtype, T.NumericType):
        value = f"coalesce({c}, CAST(0 AS {dtype.simpleString()}))"
    else:
        value = f"coalesce(CAST({c} AS STRING), '')"
    return [F.expr(value).alias(prefix), F.expr(f"{c} IS NULL").alias(prefix + "n")]


def in_range(log: DataFrame, lo, hi, roles: Roles = Roles()) -> DataFrame:
    """Inclusive day range (literals, so Catalyst pushes it to the scan)."""
    lo, hi = validate_range(lo, hi)
    cond = f"{ident(roles.day)} BETWEEN DATE'{lo.isoformat()}' AND DATE'{hi.isoformat()}'"
    if roles.day_partition:
        first, last = lo.replace(day=1), hi.replace(day=1)
        cond += f" AND {ident(roles.day_partition)} BETWEEN DATE'{first.isoformat()}' AND DATE'{last.isoformat()}'"
    return log.where(F.expr(cond))


def filtered_registry(
    registry: DataFrame,
    blocks=None,
    areas=None,
    kinds=None,
    roles: Roles = Roles(),
) -> DataFrame:
    """Registry restricted to the selected groups / dims, canonical columns.

    ``None`` = no filter; an empty list raises.  Membership drops NULL
    values, as the reference's filters do.  Filtering here, before any
    join, is the same result as filtering after it, on less data.
    """
    blocks = validate_choice("Block", blocks)
    areas = validate_choice("Area type", areas)
    kinds = validate_choice("School type", kinds)
    reg = registry
    if blocks is not None:
        reg = reg.where(F.col(roles.group).isin(list(blocks)))
    if areas is not None:
        reg = reg.where(F.col(roles.area).isin(list(areas)))
    if kinds is not None:
        reg = reg.where(F.col(roles.kind).isin(list(kinds)))
    key = f"CAST({ident(roles.key)} AS STRING)"
    site, rest = split_key_sql(key)
    return reg.select(
        *entity_keys(reg, roles.entity),
        F.expr(key).alias("record_id"),
        F.expr(site).alias("site_code"),
        F.expr(rest).alias("id_code"),
        F.expr(safe_number_sql(rest)).alias("id_num"),
        F.col(roles.name).alias("school"),
        F.col(roles.group).alias("block"),
        F.col(roles.area).alias("area_type"),
        F.col(roles.kind).alias("school_type"),
    )


def exact_sum(e: str) -> str:
    """A sum in Spark's own sum type that fails where it would overflow.

    Without ANSI mode an overflowing decimal sum is NULL, which a later zero
    fill would publish as 0; a NULL sum of non-NULL values is that case.
    """
    return f"CASE WHEN sum({e}) IS NULL AND count({e}) > 0 THEN raise_error('sum overflows') ELSE sum({e}) END"


def _measure_sum(log: DataFrame, roles: Roles) -> str:
    dtype = log.schema[roles.measure].dataType
    m = ident(roles.measure)
    if isinstance(dtype, T.DecimalType):
        return exact_sum(m)
    if isinstance(dtype, T.StringType):
        return f"sum({safe_number_sql(m)})"
    return f"sum({m})"


def _counted(measure: str, roles: Roles) -> list:
    """The totals of deduped days: entry, participants (``measure`` as SQL), activity."""
    return [
        F.count(F.lit(1)).alias("entry"),
        F.expr(measure).alias("participants"),
        F.expr(f"CAST(sum({recode_status_sql(ident(roles.status))}) AS BIGINT)").alias("activity"),
    ]


def entity_totals(log: DataFrame, lo, hi, roles: Roles = Roles()) -> DataFrame:
    """Deduped days per entity in [lo, hi]: entry, participants, activity."""
    days = latest_per_day(in_range(log, lo, hi, roles), roles)
    return days.groupBy(*entity_keys(days, roles.entity)).agg(*_counted(_measure_sum(days, roles), roles))


def _exact_measure(log: DataFrame, roles: Roles) -> str:
    """The measure's sum as DECIMAL(38,10): the same in any order and however the days are grouped."""
    m = ident(roles.measure)
    dtype = log.schema[roles.measure].dataType
    if isinstance(dtype, T.StringType):
        m = safe_number_sql(m)
    if not isinstance(dtype, (T.DecimalType, T.IntegralType)):
        m = exact_measure_sql(m)
    return f"CAST({exact_sum(f'CAST({m} AS DECIMAL(28, 10))')} AS DECIMAL(38, 10))"


def month_totals(log: DataFrame, month: str, roles: Roles = Roles()) -> DataFrame:
    """Deduped totals per (entity, month); ``month`` is a column of the log that the day determines."""
    days = latest_per_day(log, roles)
    return days.groupBy(roles.entity, month).agg(*_counted(_exact_measure(days, roles), roles))


def split_range(lo, hi) -> tuple[list[tuple[dt.date, dt.date]], tuple[dt.date, dt.date] | None]:
    """[lo, hi] as at most two parts of months and the first and last of the whole months between them."""
    lo, hi = validate_range(lo, hi)
    day = dt.timedelta(days=1)
    first = lo if lo.day == 1 else month_bounds(lo)[1] + day
    last = hi if hi == month_bounds(hi)[1] else hi.replace(day=1) - day
    if first > last:
        return [(lo, hi)], None
    edges = [(a, b) for a, b in ((lo, first - day), (last + day, hi)) if a <= b]
    return edges, (first, last.replace(day=1))


def ranged_totals(log: DataFrame, totals: DataFrame, lo, hi, roles: Roles) -> DataFrame:
    """``entity_totals`` put together from stored month totals and the log's days outside whole months.

    Days of one month are never counted in another, so totals of months add
    up.  The log's scan is left with the one or two edge months.
    """
    edges, whole = split_range(lo, hi)
    found = []
    if whole:
        stored = totals.where(F.col(roles.day_partition).between(F.lit(whole[0]), F.lit(whole[1])))
        found.append(stored.select(*entity_keys(stored, roles.entity), "entry", "participants", "activity"))
    if edges:
        spans = " OR ".join(f"{ident(roles.day)} BETWEEN DATE'{a}' AND DATE'{b}'" for a, b in edges)
        months = ", ".join(f"DATE'{a.replace(day=1)}'" for a, _ in edges)
        days = latest_per_day(log.where(f"({spans}) AND {ident(roles.day_partition)} IN ({months})"), roles)
        found.append(
            days.groupBy(*entity_keys(days, roles.entity)).agg(*_counted(_exact_measure(days, roles), roles))
        )
    return reduce(DataFrame.unionByName, found).groupBy(*KEYS).agg(
        F.sum("entry").alias("entry"),
        F.expr(f"CAST({exact_sum('participants')} AS DECIMAL(38, 10))").alias("participants"),
        F.sum("activity").alias("activity"),
    )


def join_on_keys(left: DataFrame, right: DataFrame, how: str = "left", keys=KEYS) -> DataFrame:
    """Equi-join on the null-safe key columns of ``entity_keys``.

    If the two sides' entity columns have different types (say text in the
    registry, a number in the log), both value columns are compared as
    text; otherwise the plain columns are used and the join reuses the
    sides' hash partitioning.
    """
    value, isnull = keys
    if left.schema[value].dataType != right.schema[value].dataType:
        # one placeholder for NULL on both sides, the value as text otherwise
        as_text = F.expr(f"CASE WHEN {isnull} THEN '' ELSE CAST({value} AS STRING) END")
        left = left.withColumn(value, as_text)
        right = right.withColumn(value, as_text)
    return left.join(right, list(keys), how)


def _join_registry(reg: DataFrame, right: DataFrame, null_safe: bool) -> DataFrame:
    """Registry-preserving left join on the entity key columns."""
    if not null_safe:
        right = right.where(~F.col("__kn"))
    return join_on_keys(reg, right, "left").drop(*KEYS)


def period_rollup(
    log: DataFrame,
    registry: DataFrame,
    lo,
    hi,
    *,
    blocks=None,
    areas=None,
    kinds=None,
    roles: Roles = Roles(),
    null_safe: bool = True,
    totals: DataFrame | None = None,
) -> DataFrame:
    """One row per filtered registry entity, zero-filled totals.

    entry = deduped days with an entry in [lo, hi]; participants = sum of
    the measure over those days (NULL skipped); activity = days whose
    status is 'done'.  Entities without entries get zeros; log entities
    missing from the registry are dropped.  With the log's stored month
    ``totals`` (``snapshot.read_totals``; roles with a month partition) only
    the range's incomplete months are read from the log.
    """
    reg = filtered_registry(registry, blocks, areas, kinds, roles)
    if totals is None:
        found = entity_totals(log, lo, hi, roles)
    else:
        found = ranged_totals(log, totals, lo, hi, roles)
    ptype = found.schema["participants"].dataType.simpleString()
    return _join_registry(reg, found, null_safe).select(
        *ENTITY_COLUMNS,
        F.expr("CAST(coalesce(entry, 0) AS BIGINT)").alias("entry"),
        F.expr(f"coalesce(participants, CAST(0 AS {ptype}))").alias("participants"),
        F.expr("CAST(coalesce(activity, 0) AS BIGINT)").alias("activity"),
    )


def month_rollup(log, registry, month: dt.date | str, **kw) -> DataFrame:
    """``period_rollup`` over the calendar month containing ``month``."""
    lo, hi = month_bounds(month)
    return period_rollup(log, registry, lo, hi, **kw)


def selection(record_ids=None, ids=None) -> list[str]:
    """SQL predicates of a selection over a key column written as ``{key}``."""
    out = []
    if record_ids is not None:
        keys = ", ".join(lit(k).replace("{", "{{").replace("}", "}}") for k in validate_choice("school", record_ids))
        out.append("{key} IN (" + keys + ")")
    if ids is not None:
        numbers = ", ".join(f"{float(i)!r}D" for i in validate_choice("school", ids))
        out.append(safe_number_sql(split_key_sql("{key}")[1]) + f" IN ({numbers})")
    return out


def selected_log(log: DataFrame, reg: DataFrame, picked: list[str], roles: Roles) -> DataFrame:
    """Log rows of the selected entities.

    Where the log carries the full key itself, the selection is a literal
    predicate on the log's scan.  Otherwise the log is semi-joined with the
    selected registry rows, left to Spark's size checks.  Either way it is a
    filter on the dedupe's own key, so it can run before it.
    """
    if roles.entity == roles.key and isinstance(log.schema[roles.entity].dataType, T.StringType):
        return log.where(F.expr(" AND ".join(p.format(key=ident(roles.entity)) for p in picked)))
    keys = reg.select(*KEYS).distinct()
    marked = log.select("*", *entity_keys(log, roles.entity))
    return join_on_keys(marked, keys, "left_semi").drop(*KEYS)


def entity_detail(
    log: DataFrame,
    registry: DataFrame,
    lo,
    hi,
    *,
    record_ids=None,
    ids=None,
    blocks=None,
    areas=None,
    kinds=None,
    roles: Roles = Roles(),
    null_safe: bool = True,
) -> DataFrame:
    """Deduped days per entity, registry-preserving, no aggregate.

    An entity without entries in range yields one row with a NULL day.
    ``record_ids`` selects by full key, ``ids`` by numeric ID (which can
    match one ID at several sites); ``None`` keeps every entity.  A
    selection also cuts the log before it is deduped (``selected_log``).
    """
    reg = filtered_registry(registry, blocks, areas, kinds, roles)
    picked = selection(record_ids, ids)
    rows = in_range(log, lo, hi, roles)
    if picked:
        reg = reg.where(F.expr(" AND ".join(p.format(key="record_id") for p in picked)))
        rows = selected_log(rows, reg, picked, roles)
    days = latest_per_day(rows, roles)
    mtype = days.schema[roles.measure].dataType.simpleString()
    days = days.select(
        *entity_keys(days, roles.entity),
        F.col(roles.day).alias("task_schedule_date"),
        F.col(roles.status).alias("status_raw"),
        F.expr(recode_status_sql(ident(roles.status))).alias("__status"),
        F.col(roles.measure).alias("__measure"),
    )
    return _join_registry(reg, days, null_safe).select(
        *ENTITY_COLUMNS,
        "task_schedule_date",
        "status_raw",
        F.expr("coalesce(__status, 0)").alias("brush_activity"),
        F.expr(f"coalesce(__measure, CAST(0 AS {mtype}))").alias("participants"),
    )
