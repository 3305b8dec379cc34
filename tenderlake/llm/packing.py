"""Best-fit packing of tokenised documents into sequences of fixed length."""

from __future__ import annotations

import functools
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tenderlake.llm.bpe import byte_alphabet
from tenderlake.llm.common import Scratch

SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@functools.lru_cache(maxsize=2)
def encoder(path: str):
    """A function from text to ids as the tokenizers library has them.

    If the file's merges are in the order of their ids, ranks are all that
    the merges say, and tiktoken does the same work several times faster.
    """
    import tiktoken
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    slow = Tokenizer.from_file(path)
    vocab, special = spec["model"]["vocab"], {t["content"]: t["id"] for t in spec["added_tokens"]}
    byte = {c: b for b, c in byte_alphabet().items()}
    merged = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in spec["model"]["merges"]]
    if any(a >= b for a, b in zip(merged, merged[1:], strict=False)) or spec["normalizer"]:
        return lambda text: slow.encode(text, add_special_tokens=False).ids
    ranks = {bytes(byte[c] for c in t): i for t, i in vocab.items() if t not in special}
    fast = tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens=special)

    def encode(text: str) -> list[int]:
        try:
            return fast.encode(text, allowed_special="all")
        except Exception:  # its pattern gives up on very long white space
            return slow.encode(text, add_special_tokens=False).ids

    return encode


def cut_pieces(ids: np.ndarray, capacity: int) -> list[tuple[int, np.ndarray]]:
    """``(start, ids)`` of each piece; all but the first of a long document have ``capacity`` tokens."""
    n = len(ids)
    first = n if n <= capacity else (n - 1) % capacity + 1
    return [(0, ids[:first]), *((i, ids[i : i + capacity]) for i in range(first, n, capacity))]


def tokenize_pieces(docs: DataFrame, path: str, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """``(doc, piece, start, length, ids_crc32, ids)`` for each piece; a null or empty text is just ``end_id``."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in batches:
            at, piece, start, length, crc, ids = [], [], [], [], [], []
            for row, text in enumerate(batch.column(1)):
                got = np.array([*encode(text.as_py() or ""), end_id], "<u4")
                for k, (first, part) in enumerate(cut_pieces(got, capacity)):
                    at.append(row)
                    piece.append(k)
                    start.append(first)
                    length.append(len(part))
                    crc.append(zlib.crc32(part.tobytes()))
                    ids.append(part.astype(np.int32) if with_ids else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at, pa.int32())), pa.array(piece, pa.int32()), *(pa.array(c, pa.int64()) for c in (start, length, crc)), pa.array(ids, pa.list_(pa.int32()))],
                ["doc", "piece", "start", "length", "ids_crc32", "ids"],
            )

    own = docs.select(F.col(id_col).cast("long").alias("_doc"), F.col(text_col).cast("string").alias("_text"))
    return own.mapInArrow(rows, "doc long, piece int, start long, length long, ids_crc32 long, ids array<int>")


def best_fit(counts: dict[int, int], capacity: int) -> np.ndarray:
    """Where each run of equally long pieces goes: rows of length, first rank, pieces, first sequence, pieces a sequence, offset.

    One superstep for each length, the longest first. The run sweeps the
    sorted gaps from its successor up: each gap that it reaches takes as many
    of its pieces as fit, rank decides which; what finds no gap opens
    sequences. Then the gaps are updated. State is runs of equal pieces and
    runs of equal gaps, so its size depends on the capacity and never on the
    number of documents.
    """
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap: (first sequence, sequences)
    out, n_seq = [], 0
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]

        def fill(first: int, n: int, gap: int, length: int = length) -> int:
            nonlocal rank, left
            each = gap // length
            full, rest = divmod(min(left, n * each), each)
            for seqs, k, at in ((full, each, first), (int(rest > 0), rest, first + full)):
                if seqs and k:
                    out.append((length, rank, seqs * k, at, k, capacity - gap))
                    rank, left = rank + seqs * k, left - seqs * k
                    if gap - k * length:
                        gaps.setdefault(gap - k * length, []).append((at, seqs))
            return full + int(rest > 0)

        for gap in sorted(g for g in gaps if g >= length):
            runs = gaps.pop(gap)
            while runs and left:
                first, n = runs.pop()
                used = fill(first, n, gap)
                if used < n:
                    runs.append((first + used, n - used))
            if runs:
                gaps.setdefault(gap, []).extend(runs)
            if not left:
                break
        if left:
            opened = -(-left // (capacity // length))
            fill(n_seq, opened, capacity)
            n_seq += opened
    return np.array(out, np.int64).reshape(-1, 6)


def pack(pieces: DataFrame, capacity: int = 1024) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``: best-fit packing of rows with a ``length`` of 1 to ``capacity``.

    Pieces of one length are interchangeable, so the supersteps of
    :func:`best_fit` run on counts by length (at most ``capacity`` rows) and
    pieces find their place by rank. Ranks within a length are dealt over
    slices: a length that a third of all rows share is spread over many tasks.
    Needs columns ``doc`` and ``piece`` for order; others are carried along.
    An empty table gives an empty table.
    """
    counts = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}
    slices = 64 + sum(counts.values()) // 100_000
    sliced = pieces.withColumn("_slice", F.pmod(F.xxhash64("doc", "piece"), F.lit(slices)).cast("int"))
    before = (
        sliced.groupBy("length", "_slice").count()
        .select("length", "_slice", (F.sum("count").over(Window.partitionBy("length").orderBy("_slice")) - F.col("count")).alias("_before"))
    )
    order = Window.partitionBy("length", "_slice").orderBy("doc", "piece")
    ranked = sliced.withColumn("_rank", F.row_number().over(order) - 1).join(before, ["length", "_slice"])
    ranked = ranked.withColumn("_rank", F.col("_rank") + F.col("_before")).drop("_slice", "_before")
    places = best_fit(counts, capacity)
    keys = (places[:, 0] << 44) + places[:, 1]
    order_ = np.argsort(keys)
    keys, places = keys[order_], places[order_]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "_rank"))
            p = places[np.searchsorted(keys, (length << 44) + rank, "right") - 1]
            row = rank - p[:, 1]
            rest = [f.name for f in batch.schema if f.name != "_rank"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in rest), pa.array(p[:, 3] + row // p[:, 4]), pa.array(p[:, 5] + row % p[:, 4] * length)],
                [*rest, "sequence_id", "offset"],
            )

    fields = [f for f in ranked.schema.fields if f.name != "_rank"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    return ranked.mapInArrow(rows, f"{schema}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """Tokenise and pack: one row per piece with its place, checksum and, if asked, its ids.

    Null text counts as empty: one piece with only ``end_id``. Repeated rows
    are packed each; null ids are packed and stay null; other columns are not
    read. The tokens are made once, into a scratch table.
    """
    scratch = Scratch(docs.sparkSession, "packing")
    pieces = tokenize_pieces(docs, path, capacity, end_id, id_col, text_col, with_ids)
    pieces = scratch.cut(pieces if with_ids else pieces.drop("ids"))
    return pack(pieces, capacity).withColumnRenamed("doc", id_col)
