"""Language identification with blended-spectrum string kernels."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MULTIPLIER = 0x9E3779B1
BROADCAST_LABELS = 10_000


def grams(text: str, most: int, bits: int) -> np.ndarray:
    """Hash buckets of all n-grams of 1 to ``most`` code points of the whole lower-cased text, with repeats."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    out, rolled = [], np.zeros(len(codes), np.uint32)
    for n in range(min(most, len(codes))):
        last = len(codes) - n
        rolled = rolled[:last] * np.uint32(0x01000193) + codes[n:] * np.uint32(MULTIPLIER)
        out.append((rolled + np.uint32(n * 7919)) * np.uint32(MULTIPLIER) >> np.uint32(32 - bits))
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


def presence(texts: list[str], most: int, bits: int) -> np.ndarray:
    """One row per text: which buckets it has, scaled to length 1; the kernel is the product of two rows."""
    x = np.zeros((len(texts), 1 << bits), np.float32)
    for row, text in zip(x, texts, strict=True):
        row[grams(text, most, bits)] = 1
    return x / np.sqrt(np.maximum(x.sum(1, keepdims=True), 1))


def fit(texts: list[str], langs: list[str], landmarks: int, most: int, bits: int, ridge: float) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Classes, landmark rows and weights: one-versus-rest kernel ridge regression on Nyström features."""
    names = sorted(set(langs))
    by = {name: [i for i, x in enumerate(langs) if x == name] for name in names}
    turn = sorted((k, name, i) for name, rows in by.items() for k, i in enumerate(rows))  # languages in turn
    marks = presence([texts[i] for _, _, i in turn[:landmarks]], most, bits)
    kernel = np.concatenate([presence(texts[i : i + 64], most, bits) @ marks.T for i in range(0, len(texts), 64)]).astype(float)
    values, vectors = np.linalg.eigh((marks @ marks.T).astype(float))
    good = values > 1e-6 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])
    z = kernel @ root
    weight = np.array([1 / len(by[x]) for x in langs])[:, None]  # each language counts the same
    y = np.where(np.array(langs)[:, None] == np.array(names), 1.0, -1.0)
    w = np.linalg.solve(z.T @ (weight * z) + ridge * np.eye(z.shape[1]), z.T @ (weight * y))
    return names, marks, (root @ w).astype(np.float32)


def identify_language(
    docs: DataFrame, learn_from, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    per_lang: int = 800, landmarks: int = 256, most: int = 4, bits: int = 14, ridge: float = 1e-4,
) -> DataFrame:
    """``(id, lang_pred, score)`` for every row, from its whole text alone.

    ``learn_from`` is a condition on rows that may be learned from. About
    ``per_lang`` labelled texts of each language, chosen by a hash of the id,
    train the model in one task; that bound is the model's, not the data's.
    A null text or one without a letter (``str.isalpha``) is ``und`` with score 0, and so is
    every text if there is nothing to learn from. Rows with null ids are judged
    too, repeated rows alike, very long texts whole; an empty table gives an
    empty table; other columns are not read.
    """
    schema = "names array<string>, marks binary, weights binary"
    labelled = docs.where(learn_from & F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    counts = labelled.groupBy(F.col(lang_col).alias("_lang")).agg(F.count(F.lit(1)).alias("_n"))
    if counts.count() <= BROADCAST_LABELS:  # one row a label; texts are then chosen where they are read
        counts = F.broadcast(counts)
    draw = F.pmod(F.xxhash64(F.lit("language"), id_col), F.lit(1 << 30)) / float(1 << 30)
    sample = labelled.select(F.col(text_col).cast("string").alias("_t"), F.col(lang_col).alias("_lang"), draw.alias("_draw")).join(counts, "_lang").where(F.col("_draw") < F.lit(float(per_lang)) / F.col("_n"))

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, langs = [], []
        for batch in batches:
            texts += batch.column(0).to_pylist()
            langs += batch.column(1).to_pylist()
        if texts:
            order = sorted(range(len(texts)), key=lambda i: (langs[i], zlib.crc32(texts[i].encode("utf-8", "surrogatepass")), texts[i]))  # a draw, whatever order the rows come in
            names, marks, weights = fit([texts[i] for i in order], [langs[i] for i in order], landmarks, most, bits, ridge)
            yield pa.RecordBatch.from_arrays([pa.array([names]), pa.array([np.packbits(marks > 0, axis=1).tobytes()]), pa.array([weights.tobytes()])], ["names", "marks", "weights"])

    model = sample.select("_t", F.col("_lang").cast("string")).repartition(1).mapInArrow(train, schema).first()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if model:
            bitmap = np.frombuffer(model["marks"], np.uint8).reshape(-1, (1 << bits) // 8)
            marks = np.unpackbits(bitmap, axis=1).astype(np.float32)
            marks = np.ascontiguousarray((marks / np.sqrt(marks.sum(1, keepdims=True))).T)
            weights = np.frombuffer(model["weights"], np.float32).reshape(len(bitmap), -1)
        for batch in batches:
            texts = [x.as_py() for x in batch.column(1)]
            able = [i for i, x in enumerate(texts) if model and x and any(map(str.isalpha, x))]
            pred, score = ["und"] * len(texts), [0.0] * len(texts)
            for k in range(0, len(able), 64):
                part = able[k : k + 64]
                got = presence([texts[i] for i in part], most, bits) @ marks @ weights
                sure = np.exp(4 * (got - got.max(1, keepdims=True)))
                for i, best, p in zip(part, got.argmax(1), 1 / sure.sum(1), strict=True):
                    pred[i], score[i] = model["names"][best], min(1.0, float(p))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64())], ["_doc", "lang_pred", "score"])

    own = docs.select(F.col(id_col).cast("long").alias("_doc"), F.col(text_col).cast("string").alias("_text"))
    return own.mapInArrow(rows, "_doc long, lang_pred string, score double").withColumnRenamed("_doc", id_col)
