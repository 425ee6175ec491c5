"""Daily coverage (R9): entities with at least one entry on a day, against
all filtered entities of their (block, area, kind) cell."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitepulse.functions.scalars import as_date, validate_range
from sitepulse.operators.numbering import number_within
from sitepulse.operators.rollup import KEYS, _join_registry, entity_keys, filtered_registry, in_range, join_on_keys
from sitepulse.functions.sqlexpr import ident, in_cell
from sitepulse.schema import Roles, cells


def _marked_registry(log, registry, day, blocks, areas, kinds, roles, null_safe) -> DataFrame:
    day = as_date(day)
    present = (
        in_range(log, day, day, roles)
        .select(*entity_keys(log, roles.entity))
        .distinct()
        .withColumn("__present", F.lit(True))
    )
    reg = filtered_registry(registry, blocks, areas, kinds, roles)
    return _join_registry(reg, present, null_safe)


def daily_coverage_long(
    log: DataFrame,
    registry: DataFrame,
    day,
    *,
    blocks=None,
    areas=None,
    kinds=None,
    roles: Roles = Roles(),
    only_mixed: bool = False,
    null_safe: bool = True,
) -> DataFrame:
    """(block, area_type, school_type, present, total, share).

    ``only_mixed=True`` keeps only blocks with both present and absent
    entities, which is what the reference's table shows.
    """
    marked = _marked_registry(log, registry, day, blocks, areas, kinds, roles, null_safe)
    long = marked.groupBy("block", "area_type", "school_type").agg(
        F.count_if(F.col("__present")).alias("present"),
        F.count(F.lit(1)).alias("total"),
    )
    long = long.withColumn("share", F.try_divide(F.col("present"), F.col("total")))
    if only_mixed:
        w = Window.partitionBy("block")
        long = (
            long.withColumns({"__bp": F.sum("present").over(w), "__bt": F.sum("total").over(w)})
            .where((F.col("__bp") > 0) & (F.col("__bp") < F.col("__bt")))
            .drop("__bp", "__bt")
        )
    return long


def daily_coverage_wide(
    log: DataFrame,
    registry: DataFrame,
    day,
    *,
    blocks=None,
    areas=None,
    kinds=None,
    roles: Roles = Roles(),
    only_mixed: bool = False,
    null_safe: bool = True,
) -> DataFrame:
    """One row per block: present count and share for each fixed cell, and
    ``total`` / ``total_P`` over the requested cells."""
    marked = _marked_registry(log, registry, day, blocks, areas, kinds, roles, null_safe)
    cs = cells(areas, kinds)
    present = "coalesce(__present, false)"
    in_any = " OR ".join(f"coalesce({in_cell(a, k)}, false)" for a, k, _ in cs)
    aggs = []
    for a, k, name in cs:
        aggs.append(F.expr(f"count_if({in_cell(a, k)} AND {present})").alias(name))
        aggs.append(F.expr(f"count_if({in_cell(a, k)})").alias(f"__{name}_n"))
    aggs.append(F.expr(f"count_if(({in_any}) AND {present})").alias("total"))
    aggs.append(F.expr(f"count_if({in_any})").alias("__total_n"))
    aggs.append(F.expr(f"count_if({present})").alias("__all_present"))
    aggs.append(F.count(F.lit(1)).alias("__all"))
    g = marked.groupBy("block").agg(*aggs)
    if only_mixed:
        g = g.where((F.col("__all_present") > 0) & (F.col("__all_present") < F.col("__all")))
    names = [name for _, _, name in cs]
    return g.select(
        "block",
        *names,
        *[F.expr(f"try_divide({ident(n)}, {ident('__' + n + '_n')})").alias(f"{n}_P") for n in names],
        "total",
        F.expr("try_divide(total, __total_n)").alias("total_P"),
    )


def presence_bitmaps(log: DataFrame, registry: DataFrame, lo, hi, *, roles: Roles = Roles()) -> DataFrame:
    """(block, day, bucket, bits): the entities of each block with an entry on each day, as bitmaps.

    Entities are numbered densely, block by block, so 32,768 of them share
    one bitmap of 4 KB.  Bitmaps of days, weeks or snapshots merge by OR and
    AND without another read of the log; a count of set bits is an exact
    count of distinct entities.
    """
    reg = filtered_registry(registry, roles=roles).select(*KEYS, "block").distinct()
    numbered = number_within(reg, [], ["block", *KEYS], "place")
    rows = in_range(log, lo, hi, roles)
    days = rows.select(*entity_keys(rows, roles.entity), F.col(roles.day).alias("day")).distinct()
    placed = join_on_keys(days, numbered, "inner")
    return placed.groupBy("block", "day", F.bitmap_bucket_number("place").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits")
    )


def presence_over_range(bitmaps: DataFrame, lo, hi) -> DataFrame:
    """(block, any_day, every_day): distinct entities with an entry on a day, and on each day, of [lo, hi]."""
    lo, hi = validate_range(lo, hi)
    days = (hi - lo).days + 1
    inside = bitmaps.where(F.col("day").between(F.lit(lo), F.lit(hi)))
    merged = inside.groupBy("block", "bucket").agg(
        F.bitmap_or_agg("bits").alias("any"), F.bitmap_and_agg("bits").alias("every"), F.count(F.lit(1)).alias("days")
    )
    every = F.when(F.col("days") == days, F.bitmap_count("every")).otherwise(0)
    return merged.groupBy("block").agg(
        F.sum(F.bitmap_count("any")).alias("any_day"), F.sum(every).cast("long").alias("every_day")
    )
