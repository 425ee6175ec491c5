"""Row numbers within groups of any size, without a window over a whole group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitepulse.session import materialize


def number_within(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """``df`` with ``name``: the row's place (from 1) in its group by ``order``, NULL first.

    Rows are range-partitioned by key and order, so a large group lies in
    many partitions; each numbers its part and adds the parts before it,
    which a small table counts.  The partitions are cut loose from their
    lineage first: range bounds are sampled and must not be drawn again.
    Rows equal in all of ``order`` get their numbers in any order.
    """
    part, before, n = "__part", "__before", "__count"
    ranged = df.repartitionByRange(*keys, *order).withColumn(part, F.spark_partition_id())
    rows = materialize(ranged)
    same = {f"__group{i}": F.coalesce(F.col(k).cast("string"), F.lit("")) for i, k in enumerate(keys)}
    same |= {f"__null{i}": F.col(k).isNull() for i, k in enumerate(keys)}
    rows = rows.withColumns(same) if same else rows
    ids = list(same)
    earlier = Window.partitionBy(*ids).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    if not ids:  # one group: as many rows as partitions
        earlier = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(*ids, part).agg(F.count(F.lit(1)).alias(n))
    offsets = counts.withColumn(before, F.sum(n).over(earlier)).where(f"{before} IS NOT NULL").drop(n)
    own = Window.partitionBy(*ids, part).orderBy(*[F.asc_nulls_first(c) for c in order])
    place = F.row_number().over(own) + F.coalesce(before, F.lit(0).cast("long"))
    return rows.join(offsets, [*ids, part], "left").withColumn(name, place).select(*df.columns, name)
