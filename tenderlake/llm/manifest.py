"""A Merkle manifest of a table: a leaf for each row, a tree for each source, one root, and a proof for every row."""

from __future__ import annotations

from collections.abc import Sequence
from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from tenderlake.llm.common import Scratch

FANOUT = 3
#: Levels that one group collapses: at most 3^7 = 2,187 nodes meet in it.
LEVELS = 7
STEPS = ArrayType(StructType().add("left", "string").add("right", "string"))


def field(c: Column) -> Column:
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(columns: Sequence[Column]) -> Column:
    """The digest of a row: each value with its length in bytes before it, so that no two rows read alike; ``-`` for null."""
    return F.sha2(F.concat(*[field(c) for c in columns]), 256)


def numbered(scratch: Scratch, nodes: DataFrame, tree: str, order: Sequence[Column]) -> DataFrame:
    """``nodes`` with ``_i``, the place in its tree from 0, and ``_n``, the size of the tree.

    Rows are dealt by ranges of tree and order, so a tree may span tasks. Each
    range tells how many rows of each tree it has; the sums of the ranges
    before are added to the place within a range.
    """
    sort = [F.asc_nulls_first(tree), *order]
    ranged = scratch.cut(nodes.repartitionByRange(*sort).withColumn("_range", F.spark_partition_id()))
    sizes = ranged.groupBy(tree, "_range").agg(F.count(F.lit(1)).alias("_here"))
    by = Window.partitionBy(tree)
    before = F.coalesce(F.sum("_here").over(by.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select(F.col(tree).alias("_tree"), F.col("_range").alias("_r"), before.alias("_before"), F.sum("_here").over(by).alias("_n"))
    place = F.row_number().over(Window.partitionBy(tree, "_range").orderBy(*order)) - 1
    joined = ranged.withColumn("_place", place).join(sizes, F.col(tree).eqNullSafe(F.col("_tree")) & (F.col("_range") == F.col("_r")))
    return joined.withColumn("_i", F.col("_before") + F.col("_place")).drop("_tree", "_r", "_before", "_place", "_range")


def climb(nodes: list[str], levels: int) -> list[list[str]]:
    """The nodes of a bucket by level, up to what remains of it."""
    out = [nodes]
    for _ in range(levels):
        below = out[-1]
        out.append([sha256("".join(below[i : i + FANOUT]).encode()).hexdigest() for i in range(0, len(below), FANOUT)])
    return out


def levels_of(n: int) -> int:
    """How often runs are replaced by their digest until one node remains; a superblock does at most LEVELS of it."""
    k = 0
    while k < LEVELS and n > FANOUT**k:
        k += 1
    return k


def steps(tree: list[list[str]], i: int) -> list[tuple[str, str]]:
    """What stands left and right of a node in its run, level by level within the bucket."""
    out = []
    for nodes in tree[:-1]:
        first = i - i % FANOUT
        out.append(("".join(nodes[first:i]), "".join(nodes[i + 1 : first + FANOUT])))
        i //= FANOUT
    return out


def fold(node: str, proof: Sequence[tuple[str, str]]) -> str:
    for left, right in proof:
        node = sha256(f"{left}{node}{right}".encode()).hexdigest()
    return node


def collapse(nodes: DataFrame, tree: str, node: str) -> DataFrame:
    """The roots of superblocks as nodes of the next, smaller table: ``(tree, _i, _n, node)``."""
    schema = StructType([nodes.schema[tree]]).add("_i", "long").add("_n", "long").add(node, "string")

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_i")
        n = int(rows["_n"].iloc[0])
        root = climb(list(rows[node]), levels_of(n))[-1][0]
        return pd.DataFrame({tree: [rows[tree].iloc[0]], "_i": [int(rows["_block"].iloc[0])], "_n": [-(-n // FANOUT**LEVELS)], node: [root]})

    blocks = nodes.select(tree, "_i", "_n", node, F.expr(f"_i div {FANOUT**LEVELS}").alias("_block"))
    return blocks.groupBy(tree, "_block").applyInPandas(one, schema)


def proofs(nodes: DataFrame, tree: str, node: str, upper: DataFrame | None) -> DataFrame:
    """``nodes`` with ``_top`` and ``_proof``: the steps within the superblock and then those that ``upper`` gives for its root.

    ``upper``: ``(tree, _i, _top, _proof)`` of the roots of superblocks. It is
    grouped with a block, so a proof of the levels above is sent once a block,
    not once a row. None: there are no levels above.
    """
    schema = StructType([*nodes.schema.fields]).add("_top", "string").add("_proof", STEPS)
    names = [f.name for f in nodes.schema.fields]
    block = F.expr(f"_i div {FANOUT**LEVELS}").alias("_block")

    def told(rows: pd.DataFrame, top: str | None, above: list[tuple[str, str]]) -> pd.DataFrame:
        rows = rows.sort_values("_i").reset_index(drop=True)
        tiers = climb(list(rows[node]), levels_of(int(rows["_n"].iloc[0])))
        rows["_top"] = top or tiers[-1][0]
        rows["_proof"] = [[{"left": a, "right": b} for a, b in steps(tiers, i) + above] for i in range(len(rows))]
        return rows[[*names, "_top", "_proof"]]

    def alone(rows: pd.DataFrame) -> pd.DataFrame:
        return told(rows, None, [])

    def with_upper(rows: pd.DataFrame, over: pd.DataFrame) -> pd.DataFrame:
        if not len(rows):
            return pd.DataFrame(columns=[*names, "_top", "_proof"])
        return told(rows, over["_top"].iloc[0], [(x["left"], x["right"]) for x in over["_proof"].iloc[0]])

    blocks = nodes.select(*names, block).groupBy(tree, "_block")
    if upper is None:
        return blocks.applyInPandas(alone, schema)
    return blocks.cogroup(upper.select(tree, F.col("_i").alias("_block"), "_top", "_proof").groupBy(tree, "_block")).applyInPandas(with_upper, schema)


def prove(scratch: Scratch, nodes: DataFrame, tree: str, node: str) -> DataFrame:
    """Every node's tree root ``_top`` and its proof: superblocks are collapsed until one node a tree remains, then proofs are put together from above."""
    tiers, most = [nodes], nodes.agg(F.max("_n")).first()[0] or 0
    while most > FANOUT**LEVELS:
        tiers.append(scratch.cut(collapse(tiers[-1], tree, node)))
        most = -(-most // FANOUT**LEVELS)
    out = None
    for tier in reversed(tiers):
        out = proofs(tier, tree, node, out)
        if tier is not nodes:
            out = scratch.cut(out.select(tree, "_i", "_top", "_proof"))
    return out


def merkle_manifest(
    docs: DataFrame, id_col: str = "doc_id", tree_col: str = "source", fields: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"), suspect: Column | None = None,
) -> DataFrame:
    """``(id, leaf, subroot, root, proof, suspect_leaf)`` for every row: the digest of its ``fields``, its tree's and the table's root, and its proof.

    ``proof`` lists, level by level from the leaf to the root, the digests left
    and right of the node in its run of three. Within a tree rows stand by id
    (null first), rows of one id by leaf; equal rows have equal leaves, and
    each has its own place. Trees stand null first, then by the bytes of their
    name. ``suspect`` may give another leaf for the row to be verified with
    the same proof. Nulls are a value of their own, an empty text has length
    0; very long texts are digested whole where they are read, and only
    digests are shuffled. A hot tree is spread over tasks by ranges of ids and
    collapsed by blocks of 3^7 nodes. Other columns are not read. An empty
    table gives an empty table.
    """
    scratch = Scratch(docs.sparkSession, "manifest")
    leaf = leaf_of([docs[f"`{c}`"] for c in fields])
    leaves = docs.select(docs[f"`{id_col}`"].alias("_doc"), docs[f"`{tree_col}`"].cast("string").alias("_source"), leaf.alias("leaf"), (leaf if suspect is None else suspect).alias("suspect_leaf"))
    nodes = scratch.cut(numbered(scratch, leaves, "_source", [F.asc_nulls_first("_doc"), F.asc("leaf")]))
    lower = scratch.cut(prove(scratch, nodes, "_source", "leaf")) if not nodes.isEmpty() else None
    if lower is None:
        return nodes.select(F.col("_doc").alias(id_col), "leaf", F.col("leaf").alias("subroot"), F.col("leaf").alias("root"), F.array().cast(STEPS).alias("proof"), "suspect_leaf")
    tops = lower.where("_i = 0").select(F.lit("all").alias("_all"), F.col("_source").alias("_name"), F.col("_top").alias("subroot"))
    tops = scratch.cut(numbered(scratch, tops, "_all", [F.asc_nulls_first("_name")]))
    upper = scratch.cut(prove(scratch, tops, "_all", "subroot").select("_name", F.col("_top").alias("root"), F.col("_proof").alias("_above")))
    out = lower.join(upper, F.col("_source").eqNullSafe(F.col("_name")))
    return out.select(F.col("_doc").alias(id_col), "leaf", F.col("_top").alias("subroot"), "root", F.concat("_proof", "_above").alias("proof"), "suspect_leaf")


def proof_digest(proof: Column) -> Column:
    """The digest of all siblings of a proof, one after the other."""
    return F.sha2(F.array_join(F.transform(proof, lambda x: F.concat(x["left"], x["right"])), ""), 256)


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and a proof give: equal to the table's root only for the row that the proof was made for."""
    return F.aggregate(proof, leaf, lambda node, x: F.sha2(F.concat(x["left"], node, x["right"]), 256))
