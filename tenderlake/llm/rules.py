"""Quality rules per document, and verdicts per host with a fitted beta prior."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenderlake.llm.common import ROW, SPACES, Scratch, carried, schema_with_row

SYMBOLS = "#*$%&|<>"
WINDOW = 5
#: So many hosts' verdicts are broadcast at most; beyond it they are joined by shuffle.
BROADCAST_HOSTS = 200_000

STATS = (
    "_doc long, _host string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, soft_failed boolean"
)


def window_keys(ids: np.ndarray, n_ids: int) -> np.ndarray:
    """One integer for each window of five word ids; equal integers mean equal windows."""
    bits = max(1, int(n_ids - 1).bit_length())
    if WINDOW * bits <= 63:
        return sum(ids[j : len(ids) - WINDOW + 1 + j] << (bits * j) for j in range(WINDOW))
    two = np.unique(ids[:-1] * n_ids + ids[1:], return_inverse=True)[1].astype(np.int64)
    four = np.unique(two[:-2] * (two.max() + 1) + two[2:], return_inverse=True)[1].astype(np.int64)
    return four[:-1] * n_ids + ids[4:]


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a five-word window found twice or more in the text."""
    n = len(words)
    if n <= WINDOW:
        return 0
    index: dict[bytes, int] = {}
    ids = np.fromiter((index.setdefault(w, len(index)) for w in words), np.int64, n)
    keys = window_keys(ids, len(index))
    order = np.sort(keys)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    starts = np.flatnonzero(np.isin(keys, twice))
    edge = np.zeros(n + 1, np.int64)
    edge[starts] += 1
    edge[starts + WINDOW] -= 1
    return int(np.count_nonzero(np.cumsum(edge[:-1])))


def document_stats(text: str | None) -> tuple[int, int, int, int, int]:
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    return (
        len(words),
        len(text) - sum(text.count(c) for c in SPACES),
        sum(text.count(c) for c in SYMBOLS),
        len(lines) - len(set(lines)),
        repeated_words(words),
    )


def quality_stats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", symbol_share: float = 0.1, line_share: float = 0.3, carry: Sequence[str] = ()) -> DataFrame:
    """The counts of each document and which rules it fails.

    ``base_failed``: under ten words, or over a fifth of the words in repeated
    five-word windows. ``soft_failed``: that, or more than ``symbol_share``
    symbols a word, or more than ``line_share`` of its lines repeat. A null
    text has no words, so it fails; null ids and hosts pass through, and so
    do the columns to ``carry``, as a struct ``_row``.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column(1):
                text = text.as_py() or ""
                n, chars, symbols, dup, rep = document_stats(text)
                base = n < 10 or 100 * rep > 20 * n
                soft = base or symbols > symbol_share * n or dup > line_share * (text.count("\n") + 1)
                out.append((n, chars, symbols, dup, rep, base, soft))
            columns = [*zip(*out, strict=True)] or [()] * 7
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), *(pa.array(c, pa.int64()) for c in columns[:5]), *(pa.array(c, pa.bool_()) for c in columns[5:]), *batch.columns[3:]],
                ["_doc", "_host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "soft_failed", *batch.schema.names[3:]],
            )

    own = docs.select(F.col(id_col).cast("long").alias("_doc"), F.col(text_col).cast("string").alias("_text"), F.col(host_col).cast("string").alias("_host"), *carried(docs, carry))
    return own.mapInArrow(rows, schema_with_row(STATS, own))


def host_counts(stats: DataFrame) -> DataFrame:
    """``(_host, n, failed)``, with a map-side combine: a host with a third of all rows costs one row a task."""
    return stats.where(F.col("_host").isNotNull()).groupBy("_host").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("soft_failed").cast("long")).alias("failed"))


def host_verdicts(hosts: DataFrame, multiple: float = 3.0, sure: float = 1.645) -> DataFrame:
    """``(_host, host_rate, host_bad)``: failure rates shrunk to the fitted beta prior.

    The prior's mean is the rate over all hosts' documents, so that small hosts
    don't move it, and its strength fits the spread of the hosts' rates by
    moments (sums over hosts, one row to the driver). A host is bad if its rate
    is over ``multiple`` times the prior's mean with a chance of 95 %: the
    posterior mean less ``sure`` posterior standard deviations is. A few
    unlucky documents cannot make it so, and where all hosts fail alike none is.
    """
    rate = F.col("failed") / F.col("n")
    fit = hosts.agg(F.count(F.lit(1)).alias("k"), (F.sum("failed") / F.sum("n")).alias("mean"), F.coalesce(F.var_samp(rate), F.lit(0.0)).alias("var"), F.avg(1 / F.col("n")).alias("inv")).first()
    mean = min(max(fit["mean"] if fit["mean"] is not None else 0.5, 1e-3), 1 - 1e-3)
    within = mean * (1 - mean) * (fit["inv"] or 0.0)
    between = max((fit["var"] or 0.0) - within, 1e-6)
    strength = min(max(mean * (1 - mean) / between - 1, 2.0), 1e4)
    shrunk = (F.col("failed") + F.lit(strength * mean)) / (F.col("n") + F.lit(strength))
    deviation = F.sqrt(shrunk * (1 - shrunk) / (F.col("n") + F.lit(strength + 1)))
    return hosts.select("_host", shrunk.alias("host_rate"), (shrunk - sure * deviation > min(multiple * mean, 1.0)).alias("host_bad"))


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", multiple: float = 3.0, carry: Sequence[str] = ()) -> DataFrame:
    """One row per input row: its counts, ``host_rate``, ``base_failed`` and ``kept``.

    A document goes if it fails a base rule, or if its host is bad and it
    fails a soft rule itself; a clean document on a bad host stays, and so do
    documents without a host. Repeated rows are judged alike; an empty table
    gives an empty table. Columns to ``carry`` are passed on in a struct
    ``_row``: the rules then run twice, for the hosts and for the result, and
    texts are neither written nor shuffled. Other columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "rules")
    stats = quality_stats(docs, id_col, text_col, host_col)
    stats = stats if carry else scratch.cut(stats)
    verdicts = scratch.cut(host_verdicts(scratch.cut(host_counts(stats)), multiple))
    if verdicts.count() <= BROADCAST_HOSTS:
        verdicts = F.broadcast(verdicts)
    judged = (quality_stats(docs, id_col, text_col, host_col, carry=carry) if carry else stats).join(verdicts, "_host", "left")
    bad = F.coalesce(F.col("host_bad"), F.lit(False)) & F.col("soft_failed")
    return judged.select(
        F.col("_doc").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & ~bad).alias("kept"), F.col("_host").alias("host"), "host_rate", *([ROW] if carry else []),
    )
