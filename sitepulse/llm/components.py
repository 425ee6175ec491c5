"""Connected components by alternating star contractions.

Every round points each node's neighbours at the smallest node it knows
(first the larger neighbours, then the smaller ones); the number of rounds
grows with the logarithm of a component's diameter.  Minima are combined
before the exchange, and each round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitepulse.llm.storage import Scratch


def _state(edges: DataFrame) -> tuple:
    h = F.xxhash64("u", "v")
    row = edges.agg(
        F.count(F.lit(1)), F.coalesce(F.sum(F.shiftright(h, 20)), F.lit(0)), F.coalesce(F.expr("bit_xor(xxhash64(u, v))"), F.lit(0))
    ).first()
    return tuple(row)


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """edges have u > v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v")))


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(u, v) for every node u that is not the smallest of its component v.

    ``edges`` has long columns u and v; loops and repeated edges do no harm.
    Nodes without a link to another node do not appear.
    """
    ordered = edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    now = scratch.table(ordered.distinct(), "edges-0")
    state, step = _state(now), 0
    while state[0]:
        step += 1
        now = scratch.table(_small_star(_large_star(now).distinct()).distinct(), f"edges-{step}")
        before, state = state, _state(now)
        if state == before:
            break
    return now
