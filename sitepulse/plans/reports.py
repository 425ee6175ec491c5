"""Named reports composed from the operators.

All return lazy DataFrames; ordering is applied only where the report is
defined by it (first-k blocks) -- list tables are sorted at the sink.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitepulse.functions.sqlexpr import ident
from sitepulse.functions.sqlexpr import lit as sql_lit
from sitepulse.functions.scalars import (
    as_date,
    recode_status_sql,
    day_heading,
    day_text,
    month_heading,
    number_text,
    percent_of,
    percent_text,
    status_label,
    validate_choice,
    validate_range,
    word,
)
from sitepulse.fixed import ACTIVITY_TEXT, DATE_FORMAT, MONTHLY_TEXT
from sitepulse.operators.crosstab import activity_levels_wide, level_counts_wide, wide_to_long
from sitepulse.operators.dedupe import latest_per_day
from sitepulse.operators.numbering import number_within
from sitepulse.operators.rollup import entity_keys, filtered_registry, in_range, join_on_keys
from sitepulse.schema import AREAS, KINDS, Roles

# ---------------------------------------------------------------- R1-R3 cards


def block_summary(
    log: DataFrame,
    registry: DataFrame,
    as_of,
    *,
    roles: Roles = Roles(),
    dedupe: bool = False,
    areas=None,
    kinds=None,
) -> DataFrame:
    """Per registry block -- entities, per-area and per-kind counts, and
    the entries / done activities / unknown-status entries of ``as_of - 1``.

    Entries count raw log rows (``dedupe=False``, as the reference does).
    Unknown status is skipped in ``activities`` and counted separately
    instead of turning the total NULL.  One conditional aggregate over the
    registry + one aggregate over the day's log, joined on block.
    """
    day = as_date(as_of) - dt.timedelta(days=1)
    areas = AREAS if areas is None else tuple(areas)
    kinds = KINDS if kinds is None else tuple(kinds)
    rows = in_range(log, day, day, roles)
    if dedupe:
        rows = latest_per_day(rows, roles)
    status = recode_status_sql(ident(roles.status))
    per_entity = rows.groupBy(*entity_keys(rows, roles.entity)).agg(
        F.count(F.lit(1)).alias("entries"),
        F.expr(f"CAST(sum({status}) AS BIGINT)").alias("activities"),
        F.expr(f"count_if(({status}) IS NULL)").alias("unknown_status"),
    )
    blocks_of = registry.select(*entity_keys(registry, roles.entity), F.col(roles.group).alias("block"))
    # Log entities absent from the registry get a NULL block, as a left join
    # from the log does in the reference; they surface only if the registry
    # itself has a NULL block.
    log_by_block = (
        join_on_keys(per_entity, blocks_of, "left")
        .groupBy(*entity_keys(blocks_of, "block", "__b"))
        .agg(
            F.expr("sum(entries)").alias("entries"),
            F.expr("sum(activities)").alias("activities"),
            F.expr("sum(unknown_status)").alias("unknown_status"),
        )
    )
    area, kind = ident(roles.area), ident(roles.kind)
    reg_counts = registry.groupBy(*entity_keys(registry, roles.group, "__b")).agg(
        F.count(F.lit(1)).alias("schools"),
        *[F.expr(f"count_if({area} = {sql_lit(a)})").alias(f"n_{a}") for a in areas],
        *[F.expr(f"count_if({kind} = {sql_lit(k)})").alias(f"n_{k}") for k in kinds],
    )
    # both sides are hash-partitioned on the (null-safe) block key columns
    # by their own aggregates, so this join adds no exchange
    j = reg_counts.join(log_by_block, ["__b", "__bn"], "left")
    return j.select(
        F.expr("CASE WHEN __bn THEN NULL ELSE __b END").alias("block"),
        "schools",
        *[f"n_{a}" for a in areas],
        *[f"n_{k}" for k in kinds],
        *[F.expr(f"CAST(coalesce({c}, 0) AS BIGINT)").alias(c) for c in ("entries", "activities", "unknown_status")],
    )


def summary_totals(summary: DataFrame) -> DataFrame:
    """R2: column totals of the block summary (one row)."""
    return summary.agg(
        *[F.expr(f"CAST(coalesce(sum({ident(c)}), 0) AS BIGINT)").alias(c) for c in summary.columns if c != "block"]
    )


def first_blocks(summary: DataFrame, k: int = 3) -> DataFrame:
    """The first ``k`` blocks in key order (TakeOrderedAndProject)."""
    return summary.orderBy(F.col("block").asc_nulls_last()).limit(k)


# -------------------------------------------------------------- R4-R5 series


def daily_series(log: DataFrame, roles: Roles = Roles(), *, dedupe: bool = False) -> DataFrame:
    """Entries per day over the whole log (NULL day is its own row).
    Raw rows by default, as the reference counts; ``dedupe=True`` counts
    entity-days instead."""
    if dedupe:
        log = latest_per_day(log, roles)
    return log.groupBy(F.col(roles.day).alias("day")).agg(F.count(F.lit(1)).alias("entries"))


def daily_series_by_block(
    log: DataFrame, registry: DataFrame, *, roles: Roles = Roles(), blocks=None, dedupe: bool = False
) -> DataFrame:
    """Entries per (block, day).  The log is first counted per
    (entity, day) -- partial aggregation absorbs hot entities -- and only those
    counts meet the registry; orphans fall into the NULL block."""
    blocks = validate_choice("Block", blocks)
    if dedupe:
        log = latest_per_day(log, roles)
    per = log.groupBy(*entity_keys(log, roles.entity), F.col(roles.day).alias("day")).agg(
        F.count(F.lit(1)).alias("n")
    )
    reg = registry.select(*entity_keys(registry, roles.entity), F.col(roles.group).alias("block"))
    out = (
        join_on_keys(per, reg, "left")
        .groupBy("block", "day")
        .agg(F.sum("n").cast("long").alias("entries"))
    )
    if blocks is not None:
        out = out.where(F.col("block").isin(list(blocks)))
    return out


def first_blocks_series(
    log: DataFrame, registry: DataFrame, *, k: int = 3, roles: Roles = Roles(), dedupe: bool = False
) -> DataFrame:
    """R5 as shown on the cards: the series of the first ``k`` blocks in key
    order (a NULL block, last in order, never matches, as with ``==``).
    The block list is at most ``k`` rows, so the semi join is cheap by
    construction."""
    firsts = (
        registry.select(F.col(roles.group).alias("block"))
        .distinct()
        .orderBy(F.col("block").asc_nulls_last())
        .limit(k)
    )
    series = daily_series_by_block(log, registry, roles=roles, dedupe=dedupe)
    return series.join(firsts, "block", "left_semi")


# ------------------------------------------------------- R10, R11 distributions


def entry_levels_wide(rollup: DataFrame, areas=None, kinds=None) -> DataFrame:
    return level_counts_wide(rollup, "entry", areas, kinds)


def entry_levels_long(rollup: DataFrame, areas=None, kinds=None) -> DataFrame:
    wide = entry_levels_wide(rollup, areas, kinds)
    return wide_to_long(wide, ["block", "entry"], {"n": "{c}_entry", "share": "{c}_entry_P"}, areas, kinds)


def activity_levels_long(rollup: DataFrame, areas=None, kinds=None) -> DataFrame:
    wide = activity_levels_wide(rollup, areas, kinds)
    return wide_to_long(
        wide,
        ["block", "activity"],
        {
            "n": "{c}_activity",
            "share": "{c}_activity_P",
            "participants": "{c}_participants",
            "participants_share": "{c}_participants_P",
        },
        areas,
        kinds,
    )


# ------------------------------------------------------------ R12-R15 lists


def entity_day_list(detail: DataFrame) -> DataFrame:
    """Day text and Done / Not done per deduped day (newest first at the
    sink).  Unknown status counts as not done after zero fill; an entity with
    no entries keeps one row with a NULL day."""
    return detail.select(
        "record_id",
        "task_schedule_date",
        day_text("task_schedule_date", DATE_FORMAT).alias("date_text"),
        status_label("brush_activity").alias("activity_text"),
    )


def entity_kpis(detail: DataFrame) -> DataFrame:
    """Days with an entry (NULL-day placeholder rows excluded) and done
    activities, per entity."""
    return detail.groupBy("record_id").agg(
        F.count("task_schedule_date").alias("entries"),
        F.coalesce(F.sum("brush_activity"), F.lit(0)).cast("long").alias("activities"),
    )


def no_activity_list(rollup: DataFrame) -> DataFrame:
    """Entities with no done activity in the period."""
    return rollup.where(F.col("activity") == 0).select("record_id", "id_num", "block", "school", "entry")


def has_entries_list(rollup: DataFrame) -> DataFrame:
    """Entities with at least one entry in the period."""
    return rollup.where(F.col("entry") != 0).select("record_id", "id_num", "block", "school", "activity", "entry")


def range_reports(
    log: DataFrame,
    registry: DataFrame,
    lo,
    hi,
    *,
    blocks=None,
    areas=None,
    kinds=None,
    roles: Roles = Roles(),
    totals: DataFrame | None = None,
    materialize: bool = False,
) -> dict[str, DataFrame]:
    """The four date-range reports (R10, R11, R14, R15) over ONE rollup.

    The reference memoises the rollup and shares it; here the caller picks:
    ``materialize=True`` checkpoints it once into the shared checkpoint
    folder (one scan of the log for all four reports, and a lineage cut),
    otherwise each report plans its own (lazy) rollup.  With the stored month
    ``totals`` the rollup reads whole months from there.
    """
    from sitepulse.operators.rollup import period_rollup
    from sitepulse.session import materialize as cut

    rollup = period_rollup(log, registry, lo, hi, blocks=blocks, areas=areas, kinds=kinds, roles=roles, totals=totals)
    if materialize:
        rollup = cut(rollup)
    return {
        "rollup": rollup,
        "entry_levels": entry_levels_wide(rollup, areas, kinds),
        "activity_levels": activity_levels_wide(rollup, areas, kinds),
        "no_activity": no_activity_list(rollup),
        "has_entries": has_entries_list(rollup),
    }


# ---------------------------------------------------------- R17 filter options


def filter_blocks(registry: DataFrame, roles: Roles = Roles()) -> DataFrame:
    return registry.select(F.col(roles.group).alias("block")).distinct()


def block_words(registry: DataFrame, roles: Roles = Roles()) -> DataFrame:
    """First and last word of each block's name (short labels of long names)."""
    return filter_blocks(registry, roles).select(
        "block", word("block", 1, sep=" ").alias("first_word"), word("block", -1, sep=" ").alias("last_word")
    )


def school_options(registry: DataFrame, *, blocks=None, areas=None, kinds=None, roles: Roles = Roles()) -> DataFrame:
    """Selectable entities per block, flat (block, school, record_id, id_code).

    The flat form is the default on purpose: nesting one list per block
    would collect a whole block into one row."""
    reg = filtered_registry(registry, blocks, areas, kinds, roles)
    return reg.select("block", "school", "record_id", "id_code")


def school_pages(
    registry: DataFrame, size: int = 100, *, blocks=None, areas=None, kinds=None, roles: Roles = Roles()
) -> DataFrame:
    """Selectable entities nested per block, in pages (block, page, schools) of at most ``size``.

    ``schools`` is an array of (school, record_id) by school name.  A block
    of any size is cut into pages by its rows' places, which are numbered
    over range partitions, so no row and no task holds a whole block.
    """
    if size < 1:
        raise ValueError("a page holds one school or more")
    flat = school_options(registry, blocks=blocks, areas=areas, kinds=kinds, roles=roles).select(
        "block", "school", "record_id"
    )
    placed = number_within(flat, ["block"], ["school", "record_id"], "place")
    page = F.call_function("div", F.col("place") - 1, F.lit(size)) + 1
    return placed.groupBy("block", page.alias("page")).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("place", "school", "record_id"))),
            lambda s: F.struct(s["school"].alias("school"), s["record_id"].alias("record_id")),
        ).alias("schools")
    )


def dense_days(series: DataFrame, lo, hi, blocks: DataFrame | None = None) -> DataFrame:
    """A daily series with every day of [lo, hi] (for every block): days without entries are zero rows.

    The day grid is generated; with ``blocks`` (a column ``block``) it is
    repeated for each, NULL included.
    """
    lo, hi = validate_range(lo, hi)
    days = F.expr(f"explode(sequence(DATE'{lo}', DATE'{hi}'))").alias("day")
    if blocks is None:
        grid = series.sparkSession.range(1).select(days)
        return grid.join(series.select("day", "entries"), "day", "left").fillna(0, ["entries"])
    keys = [F.coalesce("block", F.lit("")).alias("__b"), F.col("block").isNull().alias("__n")]
    grid = blocks.select("block").distinct().select("block", *keys, days)
    found = series.select(*keys, "day", "entries")
    return grid.join(found, ["__b", "__n", "day"], "left").select("block", "day", "entries").fillna(0, ["entries"])


# ------------------------------------------------------------- F16 cell text


def coverage_cell_text(coverage_long: DataFrame) -> DataFrame:
    """Coverage cell as shown: ``present (share%)``."""
    return coverage_long.select(
        "block",
        "area_type",
        "school_type",
        percent_text("present", "present", "total").alias("cell_text"),
    )


def activity_cell_text(activity_long: DataFrame) -> DataFrame:
    """Activity-level cell as shown, without HTML:
    ``n (p%) / k Participants (q%)``."""
    cell = Window.partitionBy("block", "area_type", "school_type")
    return activity_long.select(
        "block",
        "activity",
        "area_type",
        "school_type",
        F.format_string(
            ACTIVITY_TEXT,
            percent_text("n", "n", F.sum("n").over(cell)),
            number_text("participants"),
            F.coalesce(percent_of("participants", F.sum("participants").over(cell)), F.lit("0")),
        ).alias("cell_text"),
    )


def entry_cell_text(entry_long: DataFrame) -> DataFrame:
    """Entry-level cell as shown: ``n (p%)`` of the cell's entities in the block."""
    cell = Window.partitionBy("block", "area_type", "school_type")
    return entry_long.select(
        "block", "entry", "area_type", "school_type", percent_text("n", "n", F.sum("n").over(cell)).alias("cell_text")
    )


def series_headings(series: DataFrame) -> DataFrame:
    """The daily series with the day and month texts that head its columns."""
    return series.select("day", day_heading("day").alias("day_text"), month_heading("day").alias("month_text"), "entries")


def monthly_cell_text(crosstab: DataFrame, areas=None, kinds=None) -> DataFrame:
    """Monthly crosstab cell as shown: ``Entered: e / Activities: a / Students: s``."""
    from sitepulse.schema import cells

    return crosstab.select(
        "block",
        *[
            F.format_string(
                MONTHLY_TEXT,
                F.col(f"entry_{c}"),
                F.col(f"activity_{c}"),
                number_text(f"participants_{c}"),
            ).alias(c)
            for _, _, c in cells(areas, kinds)
        ],
    )


# -------------------------------------------------------------- O2 display order

# Sort keys of each report as the reference shows it (ascending, NULLs last,
# unless marked desc).  Applied only at the sink: ordering a lazy report is a
# global sort, which no other step needs.
DISPLAY_ORDER: dict[str, list[tuple[str, bool]]] = {
    "period_rollup": [("id_num", False), ("record_id", False)],
    "month_rollup": [("id_num", False), ("record_id", False)],
    "entity_detail": [("record_id", False), ("task_schedule_date", True)],
    "entity_day_list": [("record_id", False), ("task_schedule_date", True)],
    "daily_coverage_long": [("block", False), ("area_type", False), ("school_type", False)],
    "daily_coverage_wide": [("block", False)],
    "entry_levels_wide": [("block", False), ("entry", False)],
    "entry_levels_long": [("block", False), ("entry", False), ("area_type", False), ("school_type", False)],
    "activity_levels_wide": [("block", False), ("activity", False)],
    "activity_levels_long": [("block", False), ("activity", False), ("area_type", False), ("school_type", False)],
    "no_activity_list": [("block", False), ("id_num", False)],
    "has_entries_list": [("block", False), ("id_num", False)],
    "monthly_crosstab": [("block", False)],
    "block_summary": [("block", False)],
    "first_blocks": [("block", False)],
    "daily_series": [("day", False)],
    "daily_series_by_block": [("block", False), ("day", False)],
    "first_blocks_series": [("block", False), ("day", False)],
    "filter_blocks": [("block", False)],
    "school_options": [("block", False), ("school", False)],
}


def sorted_for_display(name: str, df: DataFrame) -> DataFrame:
    """The report in the order the reference displays it (for exports)."""
    keys = DISPLAY_ORDER.get(name)
    if not keys:
        return df
    return df.orderBy(*[F.col(c).desc_nulls_last() if desc else F.col(c).asc_nulls_last() for c, desc in keys])
