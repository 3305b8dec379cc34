"""Organisations as trees: parents from history, all ancestors to any depth, roll-up of descendants, and affiliates for size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenderlake.operators.scale import cut


def parent_of_history(history: Column, is_top: Column, fallbacks: Sequence[Column], date: str = "effectivedate", path: str = "fhfullparentpathid") -> Column:
    """The parent's id: none for a top organisation, else the second last part of the path of the newest history entry, else the first fallback that isn't empty.

    Entries without a date are the oldest; a path of one part names no parent.
    """
    newest = F.reduce(history, F.try_element_at(F.filter(history, lambda x: x.isNotNull()), F.lit(1)), lambda best, x: F.when(F.coalesce(x[date], F.lit("")) > F.coalesce(best[date], F.lit("")), x).otherwise(best))
    parts = F.split(newest[path], r"\.")
    of_path = F.when(F.size(parts) >= 2, F.try_element_at(parts, F.lit(-2)))
    filled = [F.when(c.cast("string") != "", c.cast("string")) for c in fallbacks]
    return F.when(F.coalesce(is_top, F.lit(False)), F.lit(None).cast("string")).otherwise(F.coalesce(F.when(of_path != "", of_path), *filled))


def leaps(step: DataFrame) -> list[DataFrame] | None:
    """``(node, ancestor)`` tables of each node's ancestor 1, 2, 4, 8, ... steps up, as long as any has one; None if a node has two parents or a cycle is met."""
    n, children = step.agg(F.count(F.lit(1)), F.count_distinct("node")).first()
    if n != children:
        return None
    out = [step]
    while 1 << len(out) - 1 <= n:  # a way of more steps than there are edges is in a cycle
        up = out[-1].select(F.col("node").alias("ancestor"), F.col("ancestor").alias("_far"))
        out.append(cut(out[-1].join(up, "ancestor").select("node", F.col("_far").alias("ancestor"))))
        if out[-1].isEmpty():
            return out[:-1]
    return None if n else out


def ancestors(edges: DataFrame, child: str, parent: str) -> DataFrame:
    """``(node, ancestor, depth)``: every ancestor of every node, nearest way, to any depth.

    Ways of up to 2 ** i steps are joined to those of exactly so many, so a
    depth of n takes log2(n) rounds. In a forest that makes each way once, and
    none is gathered again. Elsewhere the nearest of several ways is kept; a
    cycle ends by itself: each of its nodes is then its own ancestor, which
    tells it. Edges with a null end or to the node itself are left out.
    """
    step = edges.where(F.col(child).isNotNull() & F.col(parent).isNotNull() & (F.col(child) != F.col(parent)))
    known = cut(step.select(F.col(child).alias("node"), F.col(parent).alias("ancestor"), F.lit(1).cast("long").alias("depth")).distinct())

    def longer(leap: DataFrame, reach: int) -> DataFrame:
        on = known.select(F.col("node").alias("_mid"), F.col("ancestor").alias("_far"), "depth")
        return leap.select("node", F.col("ancestor").alias("_mid")).join(on, "_mid").select("node", F.col("_far").alias("ancestor"), (F.col("depth") + reach).alias("depth"))

    tree = leaps(known.select("node", "ancestor"))
    if tree is not None:
        for i, leap in enumerate(tree):
            known = known.unionByName(cut(longer(leap, 1 << i)))
        return known
    reach, leap = 1, known
    while not leap.isEmpty():
        known = cut(known.unionByName(longer(leap, reach)).groupBy("node", "ancestor").agg(F.min("depth").alias("depth")))
        reach *= 2
        leap = known.where(F.col("depth") == reach)
    return known


def rolled_up(nodes: DataFrame, key: str, parent: str, value: str) -> DataFrame:
    """``nodes`` with ``depth`` (0 for a root), ``n_descendants``, ``rolled_up`` (its value and those of all below it) and ``in_cycle``.

    A node below itself counts once. Sums are made where the rows are before
    they are shuffled, so a root over everything is no hot key.
    """
    ways = ancestors(nodes, key, parent)
    below = ways.where("node != ancestor").join(nodes.select(F.col(key).alias("node"), F.col(value).alias("_v")), "node").groupBy(F.col("ancestor").alias("_above")).agg(F.count(F.lit(1)).alias("n_descendants"), F.sum("_v").alias("_sum"))
    above = ways.groupBy(F.col("node").alias("_below")).agg(F.max(F.when(F.col("node") != F.col("ancestor"), F.col("depth"))).alias("depth"), F.max(F.col("node") == F.col("ancestor")).alias("in_cycle"))
    out = nodes.join(below, F.col(key) == F.col("_above"), "left").join(above, F.col(key) == F.col("_below"), "left")
    own = F.coalesce(F.col(value), F.lit(0))
    return out.select(*nodes.columns, F.coalesce("depth", F.lit(0)).alias("depth"), F.coalesce("n_descendants", F.lit(0)).alias("n_descendants"), (own + F.coalesce("_sum", F.lit(0))).alias("rolled_up"), F.coalesce("in_cycle", F.lit(False)).alias("in_cycle"))


def chain(ways: DataFrame, sep: str = ".") -> DataFrame:
    """``(node, path, depth)``: the ancestors from the top down to the node; as many as the node's depth meet in a row."""
    listed = F.array_sort(F.collect_list(F.struct((-F.col("depth")).alias("d"), F.col("ancestor").cast("string").alias("a"))))
    return ways.where("node != ancestor").groupBy("node").agg(F.concat_ws(sep, F.transform(listed, lambda x: x["a"]), F.col("node").cast("string")).alias("path"), F.max("depth").alias("depth"))


#: Relationships whose size counts as one's own. Fixed values.
AFFILIATED = ("SISTER_SUBSIDIARY", "JV_PARTNER")


def affiliate_size(orgs: DataFrame, links: DataFrame, key: str, size: str, threshold: str, relation: str = "relationship", approved: str = "mpa_approved", affiliate_size: str = "affiliate_size") -> DataFrame:
    """``orgs`` with its size alone and with affiliates against ``threshold``, and whether affiliates make it other than small.

    Sister companies and partners of a joint venture add their size, but for
    partners under an approved agreement; teaming adds nothing. An affiliate
    without a size makes the sum a lower bound and is counted. Without a size
    of one's own or a threshold over zero nothing is decided.
    """
    joined = F.upper(relation).isin(*AFFILIATED)
    shielded = (F.upper(relation) == "JV_PARTNER") & F.coalesce(F.upper(approved) == "Y", F.lit(False))
    counted = joined & ~shielded
    tally = links.groupBy(key).agg(
        F.count_if(counted).alias("n_affiliates"), F.count_if(counted & F.col(affiliate_size).isNull()).alias("n_unknown"),
        F.count_if(shielded | (F.upper(relation) == "TEAMING")).alias("n_excluded"), F.sum(F.when(counted, F.col(affiliate_size))).alias("_more"),
    )
    out = orgs.join(tally, key, "left").na.fill(0, ["n_affiliates", "n_unknown", "n_excluded"])
    limit = F.when(F.col(threshold) > 0, F.col(threshold))
    combined = F.col(size) + F.coalesce("_more", F.lit(0))
    alone, both = F.col(size) <= limit, combined <= limit
    headroom = F.round(100.0 * (limit - combined) / limit, 2)
    return out.select(*orgs.columns, "n_affiliates", "n_unknown", "n_excluded", combined.alias("combined_size"), alone.alias("small_alone"), both.alias("small_combined"), F.coalesce(alone & ~both, F.lit(False)).alias("flipped"), headroom.alias("headroom_pct"))
