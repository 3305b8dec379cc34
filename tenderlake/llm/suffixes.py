"""Removal of long repeated byte strings: bucket refinement over runs of suffixes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenderlake.llm.common import Scratch

#: Bytes that are hashed together.
CHUNK = 1 << 20
#: Stands for a null id in joins.
NO_ID = -(1 << 63)
#: Suffixes in a block of the second refinement.
BLOCK = 16
_RANDOM = np.random.Generator(np.random.PCG64(97))
BYTE = _RANDOM.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = 0x5851F42D4C957F2D
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n."""
    size = 1 << max(n - 1, 1).bit_length()
    if size not in _POWERS:
        _POWERS.clear()
        _POWERS[size] = tuple(np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, np.uint64(b))])) for b in (BASE, pow(BASE, -1, 1 << 64)))
    up, down = _POWERS[size]
    return up[:n], down[:n]


def gram_hashes(data: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit hash of the q bytes from each place on."""
    up, down = powers(len(data))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(BYTE[data] * up)])
    return (total[q:] - total[:-q]) * down[: len(data) - q + 1]


def window_minima(v: np.ndarray, w: int) -> np.ndarray:
    """The least of each ``w`` neighbours, by doubling."""
    width = 1
    while 2 * width <= w:
        v = np.minimum(v[:-width], v[width:])
        width *= 2
    return np.minimum(v[: len(v) - (w - width)], v[w - width :]) if w > width else v


def suffix_runs(data: np.ndarray, begin: np.ndarray, end: np.ndarray, length: int, q: int) -> tuple[np.ndarray, ...]:
    """Runs of neighbouring suffixes that have the same q-gram as their mark: first and last suffix, mark, hash of the q-gram.

    Texts lie at ``begin`` to ``end`` in ``data``; suffixes are places with
    ``length`` bytes before the text's end. A suffix's mark is the q-gram of
    least hash among those in its ``length`` bytes (the leftmost if equal), so
    equal strings of ``length`` bytes have their mark at the same offset.
    """
    none = (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    if len(data) < length:
        return none
    grams = gram_hashes(data, q)
    mixed = (grams ^ (grams >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    ranked = (mixed & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
    mark = (window_minima(ranked, length - q + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    long = end - begin >= length
    edge = np.zeros(len(data) + 1, np.int32)
    np.add.at(edge, begin[long], 1)
    np.add.at(edge, end[long] - length + 1, -1)
    places = np.flatnonzero(np.cumsum(edge[: len(mark)]))
    if not len(places):
        return none
    marks = mark[places]
    first = np.flatnonzero(np.diff(marks, prepend=-1) != 0)
    last = np.append(first[1:], len(places)) - 1
    return places[first], places[last], marks[first], grams[marks[first]]


def text_column(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a binary column, without a copy."""
    wide = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1], wide)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    return offsets, np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)


def groups(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """``(first text, last + 1)`` of texts that together have up to CHUNK bytes, or of one longer text."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + CHUNK, "right")) - 1)
        yield i, j
        i = j


def group_runs(data: np.ndarray, offsets: np.ndarray, length: int, q: int) -> tuple[np.ndarray, ...]:
    """:func:`suffix_runs` of the texts between ``offsets``; a longer text goes in overlapping parts."""
    parts = []
    for at in range(int(offsets[0]), max(int(offsets[-1]), int(offsets[0]) + 1), CHUNK):
        to = min(int(offsets[-1]), at + CHUNK + length - 1)
        first, last, mark, gram = suffix_runs(data[at:to], np.maximum(offsets[:-1], at) - at, np.minimum(offsets[1:], to) - at, length, q)
        parts.append((first + at, last + at, mark + at, gram))
    if len(parts) == 1:
        return parts[0]
    first, last, mark, gram = (np.concatenate(x) for x in zip(*parts, strict=True))
    fresh = np.flatnonzero(np.diff(mark, prepend=-1) != 0)  # a run that goes on in the next part is one
    return first[fresh], last[np.append(fresh[1:], len(mark)) - 1] if len(mark) else last, mark[fresh], gram[fresh]


def first_buckets(docs: DataFrame, length: int, q: int) -> DataFrame:
    """``(doc, hash, first, last, mark, gram, whole)`` for each run of suffixes.

    ``gram`` is the initial bucket. ``whole`` hashes every byte that a suffix
    with this mark could cover; 0 if the text has not got them all.
    """
    reach = length - q

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = text_column(batch.column(2))
            view = memoryview(data)
            for i, j in groups(offsets):
                first, last, mark, gram = group_runs(data, offsets[i : j + 1], length, q)
                if not len(first):
                    continue
                own = i + np.searchsorted(offsets[i : j + 1], first, "right") - 1
                low, high = mark - reach, mark + length
                inside = (low >= offsets[own]) & (high <= offsets[own + 1])
                whole = [(xxhash.xxh3_64_intdigest(view[a:b]) or 1) if ok else 0 for a, b, ok in zip(low.tolist(), high.tolist(), inside.tolist(), strict=True)]
                take = pa.array(own)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(take), batch.column(1).take(take), *(pa.array(x - offsets[own]) for x in (first, last, mark)), pa.array(gram.view(np.int64)), pa.array(np.array(whole, np.uint64).view(np.int64))],
                    ["doc", "hash", "first", "last", "mark", "gram", "whole"],
                )

    return docs.mapInArrow(rows, "doc long, hash long, first long, last long, mark long, gram long, whole long")


def shared_buckets(scratch: Scratch, runs: DataFrame, bucket: list[str]) -> tuple[DataFrame, DataFrame]:
    """``(settled, open)`` of the rows that share their ``bucket`` with another row.

    Settled are those that share ``whole`` too. Open are the others, and of
    each kind of settled rows one that stands for them in a bucket with open
    ones. Rows are counted by bucket and ``whole`` together, with a map-side
    combine, so a string with a third of all rows is one row a task; the join
    back is a sort-merge join whose large partitions AQE splits.
    """
    rest = [c for c in runs.columns if c not in (*bucket, "whole")]
    counts = scratch.cut(runs.groupBy(*bucket, "whole").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*rest)).alias("one")))
    equal = (F.col("whole") != 0) & (F.col("n") > 1)
    shared = counts.groupBy(*bucket).agg(F.sum("n").alias("all"), F.max(~equal).alias("left")).where("`all` > 1").drop("all")
    kinds = scratch.cut(counts.join(shared, bucket).withColumn("settled", equal))
    marked = scratch.cut(runs.join(kinds.select(*bucket, "whole", "settled"), [*bucket, "whole"]).drop("whole"))
    scratch.drop(counts)
    stand_ins = kinds.where("settled and left").select(*bucket, *[F.col("one")[c].alias(c) for c in rest])
    return marked.where("settled").drop("settled"), marked.where("not settled").drop("settled").unionByName(stand_ins)


def lists(column: pa.Array, names: list[str]) -> Iterator[list[np.ndarray]]:
    """For each row the fields of its list of structs; none for a null list."""
    offsets = column.offsets.to_numpy()
    values = [column.values.field(n).to_numpy(zero_copy_only=False) for n in names]
    for i in range(len(column)):
        yield [v[offsets[i] : offsets[i + 1]] for v in values]


def split_blocks(docs: DataFrame, open_runs: DataFrame, length: int) -> DataFrame:
    """The open runs' suffixes in blocks of BLOCK: ``same`` hashes the bytes that all suffixes of the block have, ``whole`` those that any has."""
    tasks = open_runs.groupBy("doc", "hash").agg(F.collect_set(F.struct("first", "last", "mark", "gram")).alias("runs"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = text_column(batch.column(2))
            view, out = memoryview(data), []
            for row, (first, last, mark, gram) in enumerate(lists(batch.column(3), ["first", "last", "mark", "gram"])):
                low, high = int(offsets[row]), int(offsets[row + 1])
                for f, t, m, g in zip(first.tolist(), last.tolist(), mark.tolist(), gram.tolist(), strict=True):
                    for block in range((m - t) // BLOCK, (m - f) // BLOCK + 1):
                        right = m - block * BLOCK
                        left = right - BLOCK + 1
                        same = xxhash.xxh3_64_intdigest(view[low + right : low + left + length])
                        whole = (xxhash.xxh3_64_intdigest(view[low + left : low + right + length]) or 1) if left >= 0 and low + right + length <= high else 0
                        out.append((row, max(f, left), min(t, right), block, g, same, whole))
            columns = [*zip(*out, strict=True)] or [()] * 7
            take = pa.array(columns[0], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(take), batch.column(1).take(take), *(pa.array(c, pa.int64()) for c in columns[1:5]), *(pa.array(np.array(c, np.uint64).view(np.int64)) for c in columns[5:])],
                ["doc", "hash", "first", "last", "block", "gram", "same", "whole"],
            )

    joined = docs.join(tasks, ["doc", "hash"]).select("doc", "hash", "bytes", "runs")
    return joined.mapInArrow(rows, "doc long, hash long, first long, last long, block long, gram long, same long, whole long")


def single_suffixes(docs: DataFrame, open_blocks: DataFrame, length: int) -> DataFrame:
    """Every suffix of the open blocks, with two hashes of its ``length`` bytes."""
    tasks = open_blocks.groupBy("doc", "hash").agg(F.collect_set(F.struct("first", "last")).alias("runs"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = text_column(batch.column(2))
            view, owner, place, digest = memoryview(data), [], [], []
            for row, (first, last) in enumerate(lists(batch.column(3), ["first", "last"])):
                low = int(offsets[row])
                for f, t in zip(first.tolist(), last.tolist(), strict=True):
                    place += range(f, t + 1)
                    owner += [row] * (t + 1 - f)
                    digest += [xxhash.xxh3_128_digest(view[low + s : low + s + length]) for s in range(f, t + 1)]
            two = np.frombuffer(b"".join(digest), "<i8").reshape(-1, 2)
            take = pa.array(owner, pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(place, pa.int64()), pa.array(two[:, 0].copy()), pa.array(two[:, 1].copy())], ["doc", "hash", "first", "d1", "d2"])

    joined = docs.join(tasks, ["doc", "hash"]).select("doc", "hash", "bytes", "runs")
    return joined.mapInArrow(rows, "doc long, hash long, first long, d1 long, d2 long")


def repeated_suffixes(scratch: Scratch, docs: DataFrame, length: int, q: int) -> DataFrame:
    """``(doc, hash, first, last)``: runs of suffixes whose first ``length`` bytes start elsewhere too."""
    runs = scratch.cut(first_buckets(docs, length, q))
    found, left = shared_buckets(scratch, runs, ["gram"])
    scratch.drop(runs)
    blocks = scratch.cut(split_blocks(docs, left, length))
    more, left = shared_buckets(scratch, blocks, ["gram", "block", "same"])
    scratch.drop(blocks)
    single = scratch.cut(single_suffixes(docs, left, length))
    twice = single.groupBy("d1", "d2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    ends = single.join(twice, ["d1", "d2"]).withColumn("last", F.col("first"))
    columns = ["doc", "hash", "first", "last"]
    return found.select(*columns).unionByName(more.select(*columns)).unionByName(ends.select(*columns))


def covered(first: np.ndarray, last: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal spans of bytes that the strings cover."""
    order = np.argsort(first, kind="stable")
    first, to = first[order], np.maximum.accumulate(last[order] + length)
    fresh = np.flatnonzero(np.concatenate([[True], first[1:] > to[:-1]]))
    return first[fresh], to[np.append(fresh[1:], len(first)) - 1]


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400, q: int = 160) -> DataFrame:
    """Per row: its id, ``n_bytes, n_removed, n_spans, kept_sha256`` and ``kept`` (the remaining bytes, binary).

    Removed is each UTF-8 byte covered by a string of ``length`` bytes that
    also starts at another place of any text, judged on the input. Suffixes
    are bucketed by the q-gram that marks them, a bucket's runs are refined
    by the text at the offsets around the mark, first as whole runs, then in
    blocks, then one by one; a run that is alone drops out of its bucket and
    one that is equal to another throughout is settled, so each round has
    only the edges of repeats and one stand-in for each kind of settled runs left. Buckets are known by 128 bits of hash.

    Null text is empty; texts shorter than ``length`` lose nothing; repeated
    rows are repeats of each other, whatever their ids, null ids included;
    an empty table gives an empty table; other columns are not read. One hot
    string costs one row per occurrence and is never gathered in a task.
    """
    scratch = Scratch(docs.sparkSession, "suffixes")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    keyed = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc"), F.xxhash64(text).alias("hash"), text.cast("binary").alias("bytes"))
    found = repeated_suffixes(scratch, keyed, length, q)
    spans = scratch.keep_only(scratch.cut(found.groupBy("doc", "hash").agg(F.collect_set(F.struct("first", "last")).alias("runs"))))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = text_column(batch.column(1))
            n, removed, n_spans, sha, kept = [], [], [], [], []
            for row, (first, last) in enumerate(lists(batch.column(2), ["first", "last"])):
                text = data[offsets[row] : offsets[row + 1]]
                at, to = covered(first, last, length) if len(first) else (first, last)
                left = b"".join(text[a:b].tobytes() for a, b in zip([0, *to.tolist()], [*at.tolist(), len(text)], strict=True))
                n.append(len(text))
                removed.append(len(text) - len(left))
                n_spans.append(len(at))
                sha.append(hashlib.sha256(left).hexdigest())
                kept.append(left)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in (n, removed, n_spans)), pa.array(sha, pa.string()), pa.array(kept, pa.binary())], ["_doc", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    nothing = F.array().cast("array<struct<first:bigint,last:bigint>>")
    joined = docs.select(F.col(id_col).cast("long").alias("_doc"), F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc"), F.xxhash64(text).alias("hash"), text.cast("binary").alias("bytes"))
    joined = joined.join(spans, ["doc", "hash"], "left").select("_doc", "bytes", F.coalesce("runs", nothing).alias("runs"))
    return joined.mapInArrow(rows, "_doc long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary").withColumnRenamed("_doc", id_col)
