"""Crosstabs over per-entity rollups: level distributions (R10, R11) and the
monthly block x cell table (R16).

Each wide table is ONE aggregate with conditional counts/sums per fixed
cell (requested area x kind), so missing level x cell combinations are
zero-filled by construction and the pivot needs no value-discovery job.
Within-block shares are a window over the aggregated rows only (a few rows
per block), never over the input.  The level tables hold the requested cells
only: an entity with another (or no) area or kind code stays in rollups and
lists, where ``None`` means no filter, but reaches no level row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitepulse.functions.sqlexpr import ident, in_cell, lit
from sitepulse.operators.rollup import exact_sum
from sitepulse.schema import cells


def _cell_sum(df: DataFrame, name: str, area: str, kind: str) -> str:
    """Zero-filled sum over one cell, in Spark's own sum type; decimals fail on overflow."""
    e = f"CASE WHEN {in_cell(area, kind)} THEN {ident(name)} END"
    decimal = isinstance(df.schema[name].dataType, T.DecimalType)
    return f"coalesce({exact_sum(e) if decimal else f'sum({e})'}, 0)"


def _listed(df: DataFrame, cs) -> DataFrame:
    """Entities of the requested cells; others have no column in a wide table."""
    return df.where(F.expr(" OR ".join(f"coalesce({in_cell(a, k)}, false)" for a, k, _ in cs)))


def _share(c: str, group: str = "block") -> Column:
    """Share of a count within its group: c / sum(c) over the group."""
    c, g = ident(c), ident(group)
    return F.expr(f"try_divide(CAST({c} AS DOUBLE), CAST(sum({c}) OVER (PARTITION BY {g}) AS DOUBLE))")


def level_counts_wide(rollup: DataFrame, level: str = "entry", areas=None, kinds=None) -> DataFrame:
    """Entities per (block, level) for each cell, and each count's share
    of its cell's entities in the block (``_P``; NULL for an empty cell)."""
    cs = cells(areas, kinds)
    counts = [f"{name}_{level}" for _, _, name in cs]
    g = _listed(rollup, cs).groupBy("block", level).agg(
        *[F.expr(f"count_if({in_cell(a, k)})").alias(c) for (a, k, _), c in zip(cs, counts)]
    )
    return g.select("block", level, *counts, *[_share(c).alias(f"{c}_P") for c in counts])


def activity_levels_wide(rollup: DataFrame, areas=None, kinds=None) -> DataFrame:
    """As R10 by number of activity days, plus the participants of each
    (block, level, cell) and their share of the cell's participants."""
    cs = cells(areas, kinds)
    aggs, n_cols, p_cols = [], [], []
    for a, k, name in cs:
        n, p = f"{name}_activity", f"{name}_participants"
        aggs.append(F.expr(f"count_if({in_cell(a, k)})").alias(n))
        aggs.append(F.expr(_cell_sum(rollup, "participants", a, k)).alias(p))
        n_cols.append(n)
        p_cols.append(p)
    g = _listed(rollup, cs).groupBy("block", "activity").agg(*aggs)
    return g.select(
        "block",
        "activity",
        *n_cols,
        *[_share(c).alias(f"{c}_P") for c in n_cols],
        *p_cols,
        *[_share(c).alias(f"{c}_P") for c in p_cols],
    )


def monthly_crosstab(rollup: DataFrame, areas=None, kinds=None) -> DataFrame:
    """Per block, entries / activities / participants of each cell."""
    cs = cells(areas, kinds)
    aggs = []
    for measure in ("entry", "activity", "participants"):
        for a, k, name in cs:
            aggs.append(F.expr(_cell_sum(rollup, measure, a, k)).alias(f"{measure}_{name}"))
    return rollup.groupBy("block").agg(*aggs)


def wide_to_long(wide: DataFrame, id_cols: list[str], templates: dict[str, str], areas=None, kinds=None) -> DataFrame:
    """Unpivot fixed cell columns to rows (area_type, school_type, values...).

    ``templates`` maps an output column to a name pattern with ``{c}`` for
    the cell, e.g. ``{"n": "{c}_entry", "share": "{c}_entry_P"}``.
    """
    rows = []
    for a, k, name in cells(areas, kinds):
        vals = ", ".join(f"{ident(t.format(c=name))} AS {ident(out)}" for out, t in templates.items())
        rows.append(f"struct({lit(a)} AS area_type, {lit(k)} AS school_type, {vals})")
    return wide.select(*id_cols, F.expr(f"inline(array({', '.join(rows)}))"))
