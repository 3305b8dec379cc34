"""A quality classifier: ordinal cumulative-link regression on hashed text."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = re.compile(r"\w+")


def capitals(text: str, lower: str) -> int:
    """How many characters of the whole text differ from their lower case."""
    if len(text) != len(lower):  # a letter whose lower case is two
        return sum(c != c.lower() for c in text)
    a, b = (np.frombuffer(x.encode("utf-32-le", "surrogatepass"), "<u4") for x in (text, lower))
    return int(np.count_nonzero(a != b))


def shape(text: str, lower: str) -> list[str]:
    """What the text looks like, as a few terms: each a property and its bucket."""
    n, words, lines = max(len(text), 1), text.split(), text.split("\n")
    repeat = 1 - len(set(words)) / max(len(words), 1)
    symbols = sum(map(text.count, "#*$%&|<>!")) / max(len(words), 1)
    return [
        f"\0symbols{min(8, int(symbols * 10))}",
        f"\0repeat{int(repeat * 8)}",
        f"\0words{min(14, len(words).bit_length())}",
        f"\0length{min(12, int(n / max(len(words), 1)))}",
        f"\0same{int(8 * (1 - len(set(lines)) / len(lines)))}",
        f"\0upper{int(8 * capitals(text, lower) / n)}",
    ]


def terms(text: str, bits: int) -> np.ndarray:
    """Hash buckets of the distinct words of the whole text and of its shape."""
    lower = text.lower()
    words = set(WORD.findall(lower))
    words.update(shape(text, lower))
    return np.unique(np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in words), np.uint32, len(words)) >> np.uint32(32 - bits))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit(rows: list[np.ndarray], grades: np.ndarray, bits: int, steps: int, ridge: float, sparse: float, min_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Shared weights and ordered thresholds: P(grade <= k) = sigmoid(threshold_k - score).

    Thresholds are the first one plus positive gaps, so they stay ordered.
    Each grade counts the same. Terms in fewer than ``min_docs`` texts get no
    weight, and a soft threshold of ``sparse`` after each step holds most
    others at zero: few words carry the grade.
    """
    n_grades = int(grades.max()) + 1
    size = 1 << bits
    flat, sizes = np.concatenate(rows), np.array([len(r) for r in rows])
    often = np.bincount(flat, minlength=size) >= min_docs
    begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    weight = 1 / np.maximum(np.bincount(grades, minlength=n_grades), 1)[grades] / n_grades
    owner = np.repeat(np.arange(len(rows)), sizes)
    w, raw = np.zeros(size), np.concatenate([[-1.0], np.zeros(n_grades - 2)])
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in (w, raw)]
    for step in range(1, steps + 1):
        cuts = np.cumsum(np.concatenate([raw[:1], np.exp(raw[1:])]))
        score = np.add.reduceat(w[flat], begin)
        below = np.concatenate([np.zeros((len(rows), 1)), sigmoid(cuts - score[:, None]), np.ones((len(rows), 1))], 1)
        high, low = below[np.arange(len(rows)), grades + 1], below[np.arange(len(rows)), grades]
        p = np.maximum(high - low, 1e-9)
        d_high, d_low = high * (1 - high), low * (1 - low)
        d_score = weight * (d_high - d_low) / p  # of the loss -log p
        d_cuts = np.array([(weight * ((grades == k) * -d_high + (grades == k + 1) * d_low) / p).sum() for k in range(n_grades - 1)])
        tail = np.cumsum(d_cuts[::-1])[::-1]
        gradients = np.bincount(flat, d_score[owner], size) * often + ridge * w, tail * np.concatenate([[1.0], np.exp(raw[1:])])
        for param, gradient, m in zip((w, raw), gradients, moments, strict=True):
            m[0] = 0.9 * m[0] + 0.1 * gradient
            m[1] = 0.99 * m[1] + 0.01 * gradient**2
            param -= 0.05 * m[0] / (1 - 0.9**step) / (np.sqrt(m[1] / (1 - 0.99**step)) + 1e-8)
        w[:] = np.sign(w) * np.maximum(np.abs(w) - 0.05 * sparse, 0)
    return w.astype(np.float32), np.cumsum(np.concatenate([raw[:1], np.exp(raw[1:])]))


def grade_probabilities(score: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    below = np.concatenate([np.zeros((len(score), 1)), sigmoid(cuts - score[:, None]), np.ones((len(score), 1))], 1)
    return np.diff(below, axis=1)


def grade_documents(
    docs: DataFrame, ratings: DataFrame, id_col: str = "doc_id", text_col: str = "text", grade_col: str = "grade",
    sample: int = 12_000, bits: int = 18, steps: int = 200, ridge: float = 3e-4, sparse: float = 0.3, min_share: float = 0.005, keep_good: float = 0.97, select_from: int | None = None,
) -> DataFrame:
    """``(id, expected_grade, tail_probability, kept)`` for every row, from its whole text.

    ``ratings`` has an id and an integer grade from 0. About ``sample`` rated
    texts, chosen by a hash of the id, train the model in one task (the bound
    is the model's size, not the data's); a fifth of them, not learned from,
    set the tail probability from which a document is kept, so that
    ``keep_good`` of the good ones are. The tail is grades from ``select_from``, by
    default the top one. Null texts count as empty, null ids are scored,
    repeated rows are scored alike, very long texts whole, an empty table
    gives an empty table, ratings with nulls are ignored; with
    fewer than two grades to learn from everything is kept at a null grade.
    """
    rated = ratings.select(F.col(id_col).cast("long").alias("_doc"), F.col(grade_col).cast("int").alias("_grade")).where("_doc is not null and _grade >= 0").dropDuplicates(["_doc"])
    n = rated.count()
    draw = F.pmod(F.xxhash64(F.lit("grades"), "_doc"), F.lit(1 << 30)) / float(1 << 30)
    own = docs.select(F.col(id_col).cast("long").alias("_doc"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    chosen = own.join(F.broadcast(rated.where(draw < min(1.0, sample / max(n, 1)))), "_doc").select("_text", "_grade")

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, grades, keys = [], [], []
        for batch in batches:
            for text, grade in zip(batch.column(0), batch.column(1), strict=True):
                rows.append(terms(text.as_py(), bits))
                grades.append(grade.as_py())
                keys.append(zlib.crc32(rows[-1].tobytes()))
        if len(set(grades)) < 2:
            return
        order = np.lexsort((grades, keys))  # whatever order the rows come in
        rows, grades, keys = [rows[i] for i in order], np.array(grades)[order], np.array(keys)[order]
        apart = keys % 5 == 0
        if len(set(grades[~apart])) < 2 or grades[~apart].max() < grades.max():
            apart[:] = False
        w, cuts = fit([r for r, x in zip(rows, apart, strict=True) if not x], grades[~apart], bits, steps, ridge, sparse, max(2, int(min_share * (~apart).sum())))
        test = np.flatnonzero(apart) if apart.any() else np.arange(len(rows))
        top = select_from if select_from is not None else int(grades.max())
        tail = grade_probabilities(np.array([w[rows[i]].sum() for i in test]), cuts)[:, top:].sum(1)
        good = grades[test] >= top
        least = float(np.quantile(tail[good], 1 - keep_good)) if good.any() else 0.5
        yield pa.RecordBatch.from_arrays([pa.array([w.tobytes()]), pa.array([cuts.tobytes()]), pa.array([least]), pa.array([top], pa.int32())], ["w", "cuts", "least", "top"])

    model = chosen.repartition(1).mapInArrow(train, "w binary, cuts binary, least double, top int").first()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if model:
            w, cuts = np.frombuffer(model["w"], np.float32), np.frombuffer(model["cuts"], float)
        for batch in batches:
            expected, tail = [None] * len(batch), [1.0] * len(batch)
            if model and len(batch):
                p = grade_probabilities(np.array([w[terms(x.as_py(), bits)].sum(dtype=float) for x in batch.column(1)]), cuts)
                expected, tail = p @ np.arange(p.shape[1]), p[:, model["top"] :].sum(1)
            kept = np.asarray(tail) >= (model["least"] if model else 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(expected, pa.float64()), pa.array(tail, pa.float64()), pa.array(kept)], ["_doc", "expected_grade", "tail_probability", "kept"])

    return own.mapInArrow(rows, "_doc long, expected_grade double, tail_probability double, kept boolean").withColumnRenamed("_doc", id_col)
