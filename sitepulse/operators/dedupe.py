"""Latest row per key (G6) and the 'not the first' flag.

``row_number() == 1`` over (keys, order) plans as WindowGroupLimit
Partial + Final: each map task keeps only its local top row per key before
the exchange, so a hot key costs one row per task in the shuffle, not all
of its rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitepulse.functions.sqlexpr import ident
from sitepulse.schema import Roles

_RN = "__rn"


def day_order(roles: Roles) -> list[Column]:
    """Newest start first, NULL start last, then the first in source order."""
    _source_order(roles)
    order = [F.col(roles.start).desc_nulls_last()]
    order += [F.col(c).asc_nulls_last() for c in roles.tiebreak]
    return order


def _source_order(roles: Roles) -> tuple[str, ...]:
    if not roles.tiebreak:
        raise ValueError("Roles.tiebreak must name the source-order columns: equal start times need an order")
    return roles.tiebreak


def latest_per(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(_RN, F.row_number().over(w)).where(F.col(_RN) == 1).drop(_RN)


def _day_window_sql(roles: Roles) -> str:
    keys = ", ".join(ident(c) for c in (roles.entity, roles.day))
    order = [f"{ident(roles.start)} DESC NULLS LAST"]
    order += [f"{ident(c)} ASC NULLS LAST" for c in _source_order(roles)]
    return f"row_number() OVER (PARTITION BY {keys} ORDER BY {', '.join(order)})"


def latest_per_day(log: DataFrame, roles: Roles = Roles()) -> DataFrame:
    """One row per (entity, day): the entry with the latest start."""
    return log.withColumn(_RN, F.expr(_day_window_sql(roles))).where(f"{_RN} = 1").drop(_RN)


def flag_repeats(log: DataFrame, roles: Roles = Roles(), name: str = "dup") -> DataFrame:
    """Boolean column: True for every row of an (entity, day) but the latest.

    Not a window over each (entity, day) -- that would put a hot group in
    one task.  The latest row per group comes from the skew-safe
    ``latest_per_day``; every log row is then matched against it on
    (entity, day, start, tiebreak...).  Hashing on all of those spreads even
    a hot group over every partition.  Rows that agree on all of them are
    numbered, so exactly one of them can be the latest; the numbering runs
    over such twins only and reuses the join's partitioning.  Where the
    roles say that the order is unique (``ingest.with_source_order`` makes it
    so for any log in files), there are no twins and nothing is numbered.
    """
    cols = [roles.entity, roles.day, roles.start, *roles.tiebreak]
    latest = latest_per_day(log, roles).select(
        *[F.col(c).alias(f"__l{i}") for i, c in enumerate(cols)], F.lit(False).alias("__dup")
    )
    cond = None
    for i, c in enumerate(cols):
        eq = F.col(f"__log.{ident(c)}").eqNullSafe(F.col(f"__l{i}"))
        cond = eq if cond is None else cond & eq
    number = F.lit(1)
    if not roles.unique_order:
        number = F.row_number().over(Window.partitionBy(*[F.col(c) for c in cols]).orderBy(F.lit(1)))
    joined = log.withColumn(_RN, number).alias("__log").join(latest, cond, "left")
    first = ~F.coalesce(F.col("__dup"), F.lit(True)) & (F.col(_RN) == 1)
    return joined.select(*[F.col(f"__log.{ident(c)}") for c in log.columns], (~first).alias(name))
