"""Near-duplicate documents: minhash signatures joined by an inverted index, confirmed on full shingle sets."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tenderlake.llm.common import Scratch
from tenderlake.llm.components import connected_components

#: Bytes of text hashed at once.
CHUNK = 1 << 20
#: The most documents, and bytes of shingle sets, in one half of a verified block.
BLOCK_DOCS, BLOCK_BYTES = 1_500, 24 << 20
#: So many keys of 24 bytes are broadcast at most, to spare a shuffle of all texts.
BROADCAST_ROWS = 500_000
#: Stands for a null id in joins.
NO_ID = -(1 << 63)

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_RANDOM = np.random.Generator(np.random.PCG64(20240229))
ODD = _RANDOM.integers(0, 1 << 63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash of each word; words are runs of bytes that aren't ASCII white space."""
    out, begin = [], 0
    while begin < len(text):
        end = min(len(text), begin + CHUNK)
        if end < len(text):  # cut at white space
            while end > begin and not IS_SPACE[text[end]]:
                end -= 1
            if end == begin:
                end = begin + CHUNK
                while end < len(text) and not IS_SPACE[text[end]]:
                    end += 1
        part = np.frombuffer(text, np.uint8, end - begin, begin)
        at = np.flatnonzero(~IS_SPACE[part])
        if len(at):
            first = np.flatnonzero(np.diff(at, prepend=-2) > 1)
            size = np.diff(first, append=len(at))
            place = np.arange(len(at)) - np.repeat(first, size)
            powers = np.cumprod(np.full(int(size.max()), ODD[0]))
            out.append(np.add.reduceat((part[at].astype(np.uint64) + np.uint64(1)) * powers[place], first))
        begin = end
    return mix(np.concatenate(out)) if out else np.zeros(0, np.uint64)


def shingle_set(text: str | None, words: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the text's word shingles, A-Z lower-cased; a shorter text is one shingle."""
    h = word_hashes((text or "").encode("utf-8", "surrogatepass").lower())
    n = min(words, len(h))
    if not n:
        return h
    total = sum(h[j : len(h) - n + 1 + j] * ODD[1 + j % 15] + np.uint64(j) for j in range(n))
    return np.unique(mix(total))


def signature(shingles: np.ndarray, size: int) -> np.ndarray:
    """Coordinates of 64 bits, so that unrelated documents share one by accident at no number of documents that there is."""
    a = np.random.Generator(np.random.PCG64(size)).integers(0, 1 << 63, size, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    least = np.full(size, np.uint64(0xFFFFFFFFFFFFFFFF))
    for i in range(0, len(shingles), 4096):
        least = np.minimum(least, (shingles[i : i + 4096, None] * a).min(0))
    return least.view(np.int64)


def fewest_matches(size: int, similarity: float, risk: float = 1e-6) -> int:
    """Matching coordinates that a pair of that similarity has, but for ``risk``."""
    below = 0.0
    for k in range(size + 1):
        below += math.comb(size, k) * similarity**k * (1 - similarity) ** (size - k)
        if below > risk:
            return max(k, 1)
    return size


def signatures(docs: DataFrame, size: int, words: int) -> DataFrame:
    """``(doc, hash, n, c1, c2, sig)``: set size, a 128-bit digest of the set, minhash signature (null for an empty set)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, c1, c2, sig = [], [], [], []
            for text in batch.column(2):
                s = shingle_set(text.as_py(), words)
                n.append(len(s))
                c1.append(int((s * ODD[1]).sum(dtype=np.uint64).view(np.int64)))
                c2.append(int(mix(s ^ ODD[2]).sum(dtype=np.uint64).view(np.int64)))
                sig.append(signature(s, size) if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, pa.int64()) for c in (n, c1, c2)), pa.array(sig, pa.list_(pa.int64()))], ["doc", "hash", "n", "c1", "c2", "sig"])

    return docs.select("doc", "hash", "text").mapInArrow(rows, "doc long, hash long, n long, c1 long, c2 long, sig array<long>")


def candidate_clusters(scratch: Scratch, classes: DataFrame, size: int, fewest: int) -> DataFrame:
    """``(cls, cluster)``: any two classes with ``fewest`` equal coordinates are in one cluster.

    Classes are posted under their coordinate-value pairs. In an order of
    the pairs that puts rare ones first, two classes with ``fewest`` pairs
    in common share one among the first ``size - fewest + 1`` of each, so
    only that prefix is posted, and a class with too few pairs that occur
    twice is skipped. Members of a posting are tied to its least member: rows
    stay linear in the postings, however many classes share one.
    """
    pairs = classes.select("cls", F.posexplode("sig").alias("i", "v")).select("cls", F.xxhash64("i", "v").alias("pair"))
    often = pairs.groupBy("pair").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = pairs.join(often, "pair")
    own = Window.partitionBy("cls")
    prefix = (
        shared.withColumn("rank", F.row_number().over(own.orderBy("n", "pair"))).withColumn("all", F.count(F.lit(1)).over(own))
        .where(F.col("rank") <= F.col("all") - (fewest - 1)).select("cls", "pair")
    )
    prefix = scratch.cut(prefix)
    first = prefix.groupBy("pair").agg(F.min("cls").alias("first"))
    ties = prefix.join(first, "pair").where("cls != first").select("cls", "first").distinct()
    tied = connected_components(scratch, ties, "cls", "first").select(F.col("node").alias("cls"), F.col("root").alias("cluster"))
    tied = scratch.cut(tied)
    scratch.drop(prefix)
    return tied.union(tied.select(F.col("cluster").alias("cls"), "cluster").distinct())


def verified_links(members: DataFrame, fewest: int, percent: int) -> DataFrame:
    """``(a, b)``: a spanning forest of the links within each block of ``members``.

    ``members`` has ``cluster, i, j`` (a pair of blocks), ``block, cls, n, sig, shingles``.
    Pairs with ``fewest`` equal coordinates are confirmed on their full sets,
    the likeliest first; a pair that is already connected needs no test.
    """

    def check(key, table):  # without type hints: Spark tries to resolve them
        _, i, j = (k.as_py() for k in key)
        order = np.argsort(table["cls"].to_numpy())
        doc, n, block = (table[c].to_numpy()[order] for c in ("cls", "n", "block"))
        sig = np.array(table["sig"].to_pylist(), np.int64)[order]
        raw = table["shingles"].to_pylist()
        sets: dict[int, frozenset] = {}

        def full(k: int) -> frozenset:
            if k not in sets:
                sets[k] = frozenset(np.frombuffer(raw[order[k]], np.uint64).tolist())
            return sets[k]

        found = []
        for k in range(len(doc) - 1):
            ok = 100 * np.minimum(n[k + 1 :], n[k]) >= percent * np.maximum(n[k + 1 :], n[k])
            if i != j:
                ok &= block[k + 1 :] != block[k]
            other = np.flatnonzero(ok) + k + 1
            same = (sig[other] == sig[k]).sum(1)
            good = same >= fewest
            found.append(np.stack([same[good], np.full(good.sum(), k), other[good]], 1))
        pairs = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
        parent = list(range(len(doc)))

        def root(k: int) -> int:
            while parent[k] != k:
                parent[k] = parent[parent[k]]
                k = parent[k]
            return k

        links = []
        for _, a, b in pairs[np.argsort(-pairs[:, 0], kind="stable")].tolist():
            if (ra := root(a)) != (rb := root(b)):
                both = len(full(a) & full(b))
                if 100 * both >= percent * (int(n[a]) + int(n[b]) - both):
                    parent[max(ra, rb)] = min(ra, rb)
                    links.append((doc[a], doc[b]))
        return pa.table({"a": pa.array([x[0] for x in links], pa.int64()), "b": pa.array([x[1] for x in links], pa.int64())})

    return members.groupBy("cluster", "i", "j").applyInArrow(check, "a long, b long")


def classified(scratch: Scratch, own: DataFrame, percent: int, words: int, size: int) -> DataFrame:
    """``(doc, hash, n, component, home)`` for each row of ``own`` (doc, hash, text), without its text.

    ``component`` is the least id of the rows that links connect, ``home`` the
    least (id, hash) of them, null ids last; both are null for an empty set.
    Rows are documents: links don't pass from one text to another of the same
    id. Rows with equal sets are one class, which has a number of its own and
    is compared once.
    """
    sigs = scratch.cut(signatures(own, size, words))
    place = F.struct(F.col("doc").isNull().alias("last"), F.coalesce("doc", F.lit(NO_ID)).alias("doc"), "hash")
    classes = sigs.where("n > 0").groupBy("c1", "c2", "n").agg(F.min("doc").alias("rep"), F.min(place).alias("home"), F.first("sig").alias("sig"))
    classes = scratch.cut(classes.withColumn("cls", F.monotonically_increasing_id()))  # numbers stay once they are written
    fewest = fewest_matches(size, percent / 100)
    clusters = scratch.cut(candidate_clusters(scratch, classes.select("cls", "sig"), size, fewest))

    joined = classes.select("cls", "n", "sig", "home.doc", "home.hash").join(clusters, "cls")
    blocks = joined.groupBy("cluster").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_DOCS), F.ceil(F.sum("n") * 8 / BLOCK_BYTES)).cast("int").alias("blocks"))
    placed = scratch.cut(joined.join(blocks, "cluster").withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int")))

    def with_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = pa.array([shingle_set(t.as_py(), words).tobytes() for t in batch.column(1)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), sets], ["cls", "shingles"])

    homes = placed.select("cls", "doc", "hash")
    homes = F.broadcast(homes) if homes.count() <= BROADCAST_ROWS else homes
    texts = own.withColumn("doc", F.coalesce("doc", F.lit(NO_ID))).join(homes, ["doc", "hash"]).select("cls", "text")
    sets = scratch.cut(texts.mapInArrow(with_sets, "cls long, shingles binary").dropDuplicates(["cls"]))
    partner = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    members = (
        placed.join(sets, "cls").withColumn("other", partner)
        .select("cluster", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "cls", "n", "sig", "shingles")
    )
    links = scratch.cut(verified_links(members, fewest, percent))
    scratch.drop(sets)
    scratch.drop(placed)
    roots = connected_components(scratch, links, "a", "b").select(F.col("node").alias("cls"), "root")
    rooted = scratch.cut(classes.drop("sig").join(roots, "cls", "left").withColumn("root", F.coalesce("root", "cls")))
    least = rooted.groupBy("root").agg(F.min("rep").alias("component"), F.min("home").alias("home"))
    named = rooted.select("c1", "c2", "n", "root").join(least, "root").drop("root")
    return scratch.keep_only(scratch.cut(sigs.drop("sig").join(named, ["c1", "c2", "n"], "left").select("doc", "hash", "n", "component", "home")))


def keyed_texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("doc"), text_hash(text_col).alias("hash"), text.alias("text"))


def text_hash(text_col: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, words: int = 5, size: int = 64) -> DataFrame:
    """Per row: its id, ``n_shingles``, ``component_id`` (least id reachable by links) and ``kept`` (id is that least one).

    Two documents are linked if 100 * shared >= ``percent`` * all of their
    distinct shingles. Documents with equal sets are one class and are
    compared once. Links between classes are found by signatures of ``size``
    coordinates: one of similarity ``percent`` escapes with a chance of 1e-6.

    Null and empty texts have no shingles and no links. Each row is a
    document, so an id with several texts may be in several components, and
    repeated rows share one. Rows without id are linked like others; they have
    the component's least id, or none if it has no id, and are kept only in
    that case. An empty table gives an empty table; other columns are not read.

    Clusters of candidates are verified in pairs of blocks of bounded size, so
    a group of any size is spread over tasks; within one that is alike
    throughout, most pairs are skipped as already connected.
    """
    out = classified(Scratch(docs.sparkSession, "minhash"), keyed_texts(docs, id_col, text_col), percent, words, size)
    component = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc"))
    kept = F.coalesce(F.col("doc") == component, component.isNull())
    return out.select(F.col("doc").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), kept.alias("kept"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, words: int = 5, size: int = 64) -> DataFrame:
    """``docs`` with one row of each group that :func:`near_duplicates` links, and all rows without a word; all columns stay.

    The row with the least id stays (of several texts of that id the one of
    the least hash; null ids come last); of rows equal in id and text any.
    Texts are joined with what goes by (id, hash of the text): a broadcast of
    at most BROADCAST_ROWS rows, else one shuffle.
    """
    scratch = Scratch(docs.sparkSession, "near")
    rows = classified(scratch, keyed_texts(docs, id_col, text_col), percent, words, size).where("n > 0")
    rows = rows.withColumn("doc", F.coalesce("doc", F.lit(NO_ID)))
    stays = (F.col("home")["doc"] == F.col("doc")) & (F.col("home")["hash"] == F.col("hash"))
    counts = rows.groupBy("doc", "hash").agg(F.count(F.lit(1)).alias("_n"), F.max(stays).alias("_stays"))
    marked = scratch.cut(counts.where("_n > 1 or not _stays").withColumnsRenamed({"doc": "_near_id", "hash": "_near_hash"}))

    def matching(df: DataFrame, keys: DataFrame, how: str) -> DataFrame:
        keys = keys.select("_near_id", "_near_hash")
        keys = F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys
        return df.join(keys, (F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)) == F.col("_near_id")) & (text_hash(text_col) == F.col("_near_hash")), how)

    once = matching(docs, marked, "left_anti")
    repeated = marked.where("_stays")
    if repeated.isEmpty():
        return once
    one = matching(docs, repeated, "left_semi").withColumns({"_near_id": F.col(id_col).cast("long"), "_near_hash": text_hash(text_col)}).dropDuplicates(["_near_id", "_near_hash"])
    return once.unionByName(one.drop("_near_id", "_near_hash"))
