"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenderlake.llm.common import Scratch


def connected_components(scratch: Scratch, edges: DataFrame, a: str, b: str) -> DataFrame:
    """``(node, root)`` for every node that can reach a smaller one; root is the smallest. Roots have no row of their own.

    Each step is one min-aggregation and one equi-join; the number of steps
    grows with the logarithm of a component's size, not with its diameter. A
    node with very many neighbours is pre-aggregated before the shuffle, and
    the join back is a plain sort-merge join that AQE splits when skewed.
    Edges with a null end or two equal ends are ignored; an empty table gives
    an empty table. Ids may be any ordered type.
    """
    now = scratch.cut(
        edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    )
    before = _digest(now)
    while before[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = scratch.cut(small.union(least).distinct())
        scratch.drop(now)
        now, digest = after, _digest(after)
        if digest == before:
            break
        before = digest
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _digest(edges: DataFrame) -> tuple:
    h = F.xxhash64("u", "v")
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.shiftright(h, 20)), F.bit_xor(h)).first())
