"""Toxicity from confirmed toxic examples and unlabelled text: non-negative positive-unlabelled learning."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = re.compile(r"\w+")
STEM = 4
MODEL = "words binary, weights binary, bias double"


def features(text: str) -> np.ndarray:
    """32-bit checksums, sorted, of the words of the whole text in lower case and of how those of over STEM letters begin: forms of a word share that."""
    words = set(WORD.findall(text.lower()))
    words.update([" " + w[:STEM] for w in words if len(w) > STEM])
    return np.unique(np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in words), np.uint32, len(words)))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def softplus(x: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, x)


class Sparse:
    """Texts as the places of their features in a sorted vocabulary, one flat array."""

    def __init__(self, texts: list[np.ndarray], vocabulary: np.ndarray):
        rows = [places(t, vocabulary) for t in texts]
        self.flat = np.concatenate(rows) if rows else np.zeros(0, np.int64)
        self.owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        self.n, self.size = len(rows), len(vocabulary)

    def score(self, w: np.ndarray, bias: float) -> np.ndarray:
        return bias + np.bincount(self.owner, w[self.flat], self.n)

    def gradient(self, by_row: np.ndarray) -> np.ndarray:
        return np.bincount(self.flat, by_row[self.owner], self.size)


def places(text: np.ndarray, vocabulary: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(vocabulary, text), max(len(vocabulary) - 1, 0))
    return at[vocabulary[at] == text] if len(vocabulary) else np.zeros(0, np.int64)


def fit(positive: Sparse, unlabelled: Sparse, prior: float, steps: int, sparse: np.ndarray, ridge: float) -> tuple[np.ndarray, float]:
    """Weights and bias of least non-negative risk ``prior * R_p(+) + max(0, R_u(-) - prior * R_p(-))`` under logistic loss.

    Unlabelled text stands for all text, so its part of the risk counts
    positives as negatives; what they add is taken off by the positives. Where
    that falls below zero, the model has begun to remember its negatives: the
    step then goes the other way, by that part alone.
    """
    w, bias = np.zeros(positive.size), np.log(prior / (1 - prior))
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for step in range(1, steps + 1):
        p, u = positive.score(w, bias), unlabelled.score(w, bias)
        rest = softplus(u).mean() - prior * softplus(p).mean()
        of_u, of_p = sigmoid(u) / unlabelled.n, -prior * sigmoid(p) / positive.n  # of the negatives' part
        if rest < 0:
            of_u, of_p = -of_u, -of_p
        else:
            of_p = of_p - prior * sigmoid(-p) / positive.n
        gradient = np.append(unlabelled.gradient(of_u) + positive.gradient(of_p) + ridge * w, of_u.sum() + of_p.sum())
        m, v = 0.9 * m + 0.1 * gradient, 0.99 * v + 0.01 * gradient**2
        rate = 0.1 / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        change = rate * m / (1 - 0.9**step)
        w, bias = w - change[:-1], bias - change[-1]
        w = np.sign(w) * np.maximum(np.abs(w) - rate[:-1] * sparse, 0)  # each weight's penalty in its own step
    return w, float(bias)


def boundary(p: np.ndarray, u: np.ndarray, prior: float) -> float:
    """The score from which texts are called toxic: the middle of the widest range of least corrected 0-1 risk on texts not learned from."""
    cuts = np.unique(np.concatenate([p, u]))
    middles = np.concatenate([cuts[:1] - 1, (cuts[1:] + cuts[:-1]) / 2, cuts[-1:] + 1])
    missed = np.searchsorted(np.sort(p), middles) / len(p)
    called = 1 - np.searchsorted(np.sort(u), middles) / len(u)
    risk = prior * missed + np.maximum(0, called - prior * (1 - missed))
    best = np.flatnonzero(risk <= risk.min() + 1e-12)
    gaps = np.diff(np.concatenate([cuts[:1] - 2, cuts, cuts[-1:] + 2]))
    return float(middles[best[np.argmax(gaps[best])]])


def train(texts: list[np.ndarray], confirmed: np.ndarray, apart: np.ndarray, prior: float, most_words: int, min_docs: int, steps: int, sparse: float, ridge: float) -> tuple[np.ndarray, np.ndarray, float]:
    """Vocabulary, weights and bias; the bias is moved so that 0.5 lies where the corrected risk of the texts apart is least."""
    words, counts = np.unique(np.concatenate([t for t, x in zip(texts, apart, strict=True) if not x]), return_counts=True)
    kept = np.sort(np.lexsort((words, -counts))[:most_words])
    words, counts = words[kept][counts[kept] >= min_docs], counts[kept][counts[kept] >= min_docs]
    # What chance does to the share of a word among the confirmed texts (Bernstein's bound, over all words) is what its weight has to overcome.
    n, log = max(int((confirmed & ~apart).sum()), 1), np.log(len(words) + 2)
    penalty = sparse * prior * (np.sqrt(2 * log * counts / max(int((~apart).sum()), 1) / n) + log / (3 * n))
    pick = lambda mask, words: Sparse([t for t, x in zip(texts, mask, strict=True) if x], words)

    def fitted(words: np.ndarray, sparse: np.ndarray) -> tuple[np.ndarray, float]:
        return fit(pick(confirmed & ~apart, words), pick(~confirmed & ~apart, words), prior, steps, sparse, ridge)

    w, _ = fitted(words, penalty)
    words, penalty = words[w != 0], penalty[w != 0]
    w, bias = fitted(words, penalty / 10)
    if (confirmed & apart).any() and (~confirmed & apart).any():
        bias -= boundary(pick(confirmed & apart, words).score(w, bias), pick(~confirmed & apart, words).score(w, bias), prior)
    return words[w != 0], w[w != 0], bias


def score_toxicity(
    docs: DataFrame, labels: DataFrame, learn_from: Column | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", prior: float | None = None,
    positives: int = 6_000, unlabelled: int = 18_000, most_words: int = 60_000, min_docs: int = 3, steps: int = 120, sparse: float = 0.2, ridge: float = 1e-5,
) -> DataFrame:
    """``(id, score, predicted)`` for every row: how likely its whole text is toxic, by its words alone.

    ``labels`` has an id and 1 for a confirmed toxic text; ``learn_from`` is a
    condition on ids whose labels and texts may be learned from. The model is
    fitted in one task on a bounded, documented draw by hash of the id: about
    ``positives`` confirmed texts, and about ``unlabelled`` texts of any kind,
    whose labels are not looked at. ``prior`` is the share of toxic texts; by
    default that of 1 among the labels (or 0.1 if all are 1). A fifth of the
    draw is kept apart to set where 0.5 lies.

    Null and empty texts are scored as texts without words. Repeated rows are
    scored alike, very long texts whole, null ids too; ratings that are null or
    neither 0 nor 1, or of an id rated both ways, teach nothing. Without a confirmed text
    every score is the prior. An empty table gives an empty table; other
    columns are not read.
    """
    allowed = F.lit(True) if learn_from is None else learn_from
    rated = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1) & allowed).groupBy(F.col(id_col).alias("_doc")).agg(F.min(label_col).alias("_least"), F.max(label_col).alias("_most"))
    rated = rated.where("_least = _most").select("_doc", F.col("_most").alias("_label"))
    own = docs.select(F.col(id_col).cast("long").alias("_doc"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    n_rated, n_toxic = rated.agg(F.count(F.lit(1)), F.coalesce(F.sum("_label"), F.lit(0))).first()
    share = prior if prior is not None else n_toxic / n_rated if 0 < n_toxic < n_rated else 0.1
    n_docs = docs.where(allowed).count()
    draw = F.pmod(F.xxhash64(F.lit("toxicity"), "_doc"), F.lit(1 << 30)) / float(1 << 30)
    toxic = rated.where((F.col("_label") == 1) & (draw < min(1.0, positives / max(n_toxic, 1)))).select("_doc")
    other = docs.where(allowed).select(F.col(id_col).cast("long").alias("_doc"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    some = other.where(draw < min(1.0, unlabelled / max(n_docs, 1))).select("_text", F.lit(False).alias("_toxic"))
    chosen = own.join(F.broadcast(toxic), "_doc").select("_text", F.lit(True).alias("_toxic")).unionByName(some)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for batch in batches:
            for text, x in zip(batch.column(0), batch.column(1), strict=True):
                found = features(text.as_py())
                rows.append((zlib.crc32(found.tobytes()), x.as_py(), found))
        rows.sort(key=lambda r: (r[0], r[1], len(r[2])))  # whatever order the rows come in
        confirmed, apart = np.array([r[1] for r in rows], bool), np.array([r[0] % 5 == 0 for r in rows], bool)
        if not (confirmed & ~apart).any() or not (~confirmed & ~apart).any():
            apart[:] = False
        if confirmed.any() and not confirmed.all():
            words, w, bias = train([r[2] for r in rows], confirmed, apart, share, most_words, min_docs, steps, sparse, ridge)
            yield pa.RecordBatch.from_arrays([pa.array([words.tobytes()]), pa.array([w.tobytes()]), pa.array([bias])], ["words", "weights", "bias"])

    model = chosen.repartition(1).mapInArrow(learn, MODEL).first()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if model:
            words, w = np.frombuffer(model["words"], np.uint32), np.frombuffer(model["weights"])
        for batch in batches:
            score = np.full(len(batch), float(share))
            if model:
                score = sigmoid(np.array([model["bias"] + w[places(features(x.as_py()), words)].sum() for x in batch.column(1)], float))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, pa.float64()), pa.array((score >= 0.5).astype(np.int32))], ["_doc", "score", "predicted"])

    return own.mapInArrow(rows, "_doc long, score double, predicted int").withColumnRenamed("_doc", id_col)
