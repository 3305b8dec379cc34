"""Personal data: spans proposed by generators, scored by gradient-boosted trees."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenderlake.llm.common import carried, schema_with_row

KINDS = ("email", "ip", "card", "phone")

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")  # a match can only start where a run of digits does
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")

#: Wider nets than the base forms, by kind. Each is linear in the text.
GENERATORS = (
    ("email", re.compile(r"(?<![\w.%+-])[\w.%+-]{1,64} ?(?:@|\(at\)|\[at\]|\{at\}) ?[\w-]{1,64}(?:(?:\.| \. | ?\(dot\) ?| ?\[dot\] ?| ?\{dot\} ?)[\w-]{1,24}){1,4}", re.I)),
    ("ip", re.compile(r"(?<![\w.])\d{1,3} ?(?:\.|\[\.\]|\(\.\)) ?\d{1,3} ?(?:\.|\[\.\]|\(\.\)) ?\d{1,3} ?(?:\.|\[\.\]|\(\.\)) ?\d{1,3}(?![\w.]\w)")),
    ("card", re.compile(r"(?<![\w-])\d(?:[ ./-]{0,2}\d){12,20}(?![\w-])")),
    ("phone", re.compile(r"(?<![\w+])(?:00\d{1,3}[ .-]?|\d{1,3}[ .-]?(?=\())?\(?\d{2,4}\)?[ .-]\d{3,4}[ .-]\d{3,4}(?!\w)")),
    ("phone", re.compile(r"(?<!\w)\+ ?\d{1,3}[ .()/-]{0,3}\d(?:[ .()/-]{0,2}\d){5,13}(?!\w)")),
)
CONTEXT = {
    "email": ("mail", "contact", "write", "@"), "ip": ("ip", "host", "server", "addr"), "card": ("card", "visa", "pay", "account", "karte", "tarjeta", "carte"),
    "phone": ("phone", "tel", "call", "fax", "mobil"),
}
OTHER_IDS = ("token", "key", "sha", "hash", "id", "ref", "version", "license", "=")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def octets(text: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in text.split("."))


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost, not overlapping; goes from one @ to the next, so a long run of letters costs nothing."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        match = DOMAIN.match(text, at + 1) if start < at else None
        if match:
            yield start, match.end()
            done = match.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Matches of the fixed forms, by kind and then start; matches that fail their test are dropped."""
    out = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    if DIGIT.search(text):
        out += [("ip", *m.span()) for m in IP.finditer(text) if octets(m[0])]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 16 and 16 <= len(digits := re.sub(r"[ -]", "", m[0])) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
        if "+" in text:
            out += [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(re.sub(r"[^0-9]", "", m[0])) <= 15]
    return out


def candidates(text: str) -> list[tuple[str, int, int]]:
    if not DIGIT.search(text) and "@" not in text and "at" not in text:
        return []
    quick = {"email": "@" in text or "(at)" in text.lower() or "[at]" in text.lower() or "{at}" in text.lower()}
    digits = bool(DIGIT.search(text))
    return [(kind, *m.span()) for kind, rx in GENERATORS if quick.get(kind, digits) for m in rx.finditer(text)]


#: Marks that stand for an at sign or a dot.
SPELLED = re.compile(r" ?(?:@|\.|[(\[{](?:at|dot)[)\]}]) ?", re.I)


def named_host(span: str) -> bool:
    """Whether a (spelled out) address ends with a top-level name of letters."""
    last = SPELLED.split(span)[-1]
    return len(last) > 1 and last.isalpha()


N_FEATURES = 21


def features(text: str, kind: str, start: int, end: int) -> list[int]:
    """Format of the span and what stands around it, as small integers; none says whether it has the base form of its kind."""
    span = text[start:end]
    digits = re.sub(r"\D", "", span)
    before, after = text[max(0, start - 24) : start].lower(), text[end : end + 12].lower()
    parts = re.split(r"\D+", span.strip("( +"))
    near = lambda words: sum(w in before for w in words)
    return [
        KINDS.index(kind), min(15, len(span) // 2), min(15, len(digits)), min(15, len(span) - len(digits)),
        min(7, len(parts)), min(7, max(map(len, parts))), min(7, min(map(len, parts))),
        int(digits.isascii() and len(digits) > 1 and luhn(digits)), int(kind == "ip" and all(int(p or 999) <= 255 for p in parts)),
        min(3, span.count(" ")), min(3, span.count("-")), min(4, span.count(".")), min(3, span.count("(")), int(kind == "email" and named_host(span)),
        min(3, near(CONTEXT[kind])), min(3, near(OTHER_IDS)), int(before[-1:].isalnum()) + 2 * int(before[-1:] in "\"'="), int(after[:1].isalnum()) + 2 * int(after[:1] in "\"'="),
        int(bool(re.search(r"\d", before[-4:]))), int(bool(re.search(r"\d", after[:3]))), min(7, len(set(digits))),
    ]


def grow_trees(x: np.ndarray, y: np.ndarray, n: np.ndarray, trees: int = 40, depth: int = 3, rate: float = 0.3, least: float = 4.0) -> np.ndarray:
    """Boosted trees for the logistic loss over integer features under 16: rows of feature, cut and leaf value, by node.

    Each tree is complete: a node sends rows with ``feature > cut`` right. A row counts ``n`` times.
    """
    nodes = 2 ** (depth + 1) - 1
    out = np.zeros((trees, nodes, 3))
    score = np.full(len(y), np.log(((n * y).sum() + 1) / ((n * (1 - y)).sum() + 1)))
    bias = score[0] if len(y) else 0.0
    for tree in out:
        p = 1 / (1 + np.exp(-score))
        g, h = n * (y - p), n * p * (1 - p)
        at = np.zeros(len(y), np.int64)
        for node in range(nodes):
            mine = at == node
            gs, hs = g[mine].sum(), h[mine].sum()
            tree[node] = (0, 99, rate * gs / (hs + 1.0))
            if node >= 2**depth - 1 or not mine.any():
                continue
            best = 1e-6
            for f in range(x.shape[1]):
                left_g, left_h = (np.cumsum(np.bincount(x[mine, f], v[mine], 16))[:-1] for v in (g, h))
                gain = left_g**2 / (left_h + 1) + (gs - left_g) ** 2 / (hs - left_h + 1) - gs**2 / (hs + 1)
                gain[(left_h < least * 0.05) | (hs - left_h < least * 0.05)] = 0
                if gain.max() > best:
                    best = gain.max()
                    tree[node, :2] = f, gain.argmax()
            if tree[node, 1] < 99:
                at[mine] = 2 * node + 1 + (x[mine, int(tree[node, 0])] > tree[node, 1])
        score += tree[at, 2]
    out[0, :, 2] += bias
    return out


def tree_scores(model: np.ndarray, x: np.ndarray) -> np.ndarray:
    score = np.zeros(len(x))
    for tree in model:
        at = np.zeros(len(x), np.int64)
        for _ in range(tree.shape[0].bit_length() - 1):
            split = tree[at, 1] < 99
            at = np.where(split, 2 * at + 1 + (x[np.arange(len(x)), tree[at, 0].astype(int)] > tree[at, 1]), at)
        score += tree[at, 2]
    return 1 / (1 + np.exp(-score))


#: The score from which a candidate is personal data where no threshold could be told.
CAUTIOUS = 0.95


def fit(x: np.ndarray, y: np.ndarray, fold: np.ndarray, precision: float, n: np.ndarray | None = None) -> tuple[np.ndarray, list[float]]:
    """Trees from three quarters of the rows; the last quarter sets each kind's threshold.

    A threshold is the lowest score from which that share of the held-out
    candidates is personal data. A kind with fewer than ten hits to tell it by
    takes that of all kinds together, and ``CAUTIOUS`` if they are too few as well.
    A row counts ``n`` times, once by default.
    """
    n = np.ones(len(y)) if n is None else n
    model = grow_trees(x[fold != 0], y[fold != 0], n[fold != 0])
    p, kinds, hit, times = tree_scores(model, x[fold == 0]), x[fold == 0][:, 0], (n * y)[fold == 0], n[fold == 0]

    def cut(mine: np.ndarray) -> float | None:
        order = np.argsort(-p[mine], kind="stable")
        hits = np.cumsum(hit[mine][order])
        scores = p[mine][order]
        ends = np.append(scores[1:] != scores[:-1], True)[: len(scores)]  # rows of one score are in together
        good = np.flatnonzero(ends & (hits >= precision * np.cumsum(times[mine][order])) & (hits >= 10))
        return max(0.5, float(scores[good[-1]])) if len(good) else None

    together = cut(np.ones(len(p), bool))
    cuts = [cut(kinds == kind) for kind in range(len(KINDS))]
    return model, [c if c is not None else together if together is not None else CAUTIOUS for c in cuts]


def overlap(a: tuple[int, int], b: tuple[int, int]) -> int:
    return min(a[1], b[1]) - max(a[0], b[0])


def proposals(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    base = base_spans(text)
    return base, candidates(text)


def widened(kind: str, span: str) -> list[str]:
    """A base span in forms that the base form does not match."""
    if kind == "email":
        local, _, host = span.partition("@")
        return [local + at + host.replace(".", dot) for at, dot in ((" (at) ", " (dot) "), ("(at)", "(dot)"), (" [at] ", " [dot] "), ("[at]", "."), (" {at} ", " {dot} "), (" (at) ", "."), (" @ ", "."), (" @ ", " . "))]
    if kind == "ip":
        p = span.split(".")
        return [mark.join(p) for mark in ("[.]", "(.)", " . ", ". ", " [.] ")] + [".".join(p[:3]) + "[.]" + p[3], p[0] + "[.]" + ".".join(p[1:])]
    digits = re.sub("[^0-9]", "", span)
    if kind == "card":
        return [mark.join(digits[i : i + 4] for i in range(0, len(digits), 4)) for mark in (".", "/", "  ", "- ", " -", ". ")]
    groups = re.findall("[0-9]+", span)
    code = groups[0] if len(groups) > 1 and len(groups[0]) <= 3 else digits[:1]
    area, mid, end = digits[len(code) : -7], digits[-7:-4], digits[-4:]
    if not 2 <= len(area) <= 4:
        return []
    bare = [f"({area}) {mid}-{end}", *(mark.join((area, mid, end)) for mark in "-. ")]
    return [*bare, f"{code} ({area}) {mid}-{end}", f"00{code} {area} {mid} {end}", f"00{code}-{area}-{mid}-{end}", f"00{code} ({area}) {mid}-{end}", f"00{code}.{area}.{mid}.{end}"]


def spoiled(kind: str, span: str, i: int) -> str:
    """A wide form with evidence against it: no top-level name, an octet over 255, a wrong check digit, or the name of another id before it."""
    if kind == "email":
        return re.sub(r"[A-Za-z]+$", str(10 + i), span)
    if kind == "ip":
        return re.sub("[0-9]+", str(256 + 97 * i), span, count=1)
    if kind == "card":
        return span[:-1] + str((int(span[-1]) + 1 + i) % 10)
    return ("order id=", "ref=", "key=", "version ")[i % 4] + span


def contrary(text: str, kind: str, start: int, end: int) -> bool:
    """Whether a candidate holds or follows evidence that it is something else."""
    span, before = text[start:end], text[max(0, start - 12) : start].lower()
    digits = re.sub(r"\D", "", span)
    if kind == "email":
        return not named_host(span)
    if kind == "card":
        return not luhn(digits)
    if kind == "ip" and any(int(p) > 255 for p in re.findall(r"\d+", span)):
        return True
    return bool(re.search(r"(?:\b(?:version|id|ref|key|token|sha|hash)\b[ :#=]*|=)$", before))


def examples(text: str) -> Iterator[tuple[list[int], bool, str]]:
    """Features, whether it is personal data, and the span that it stems from.

    Personal data are base spans rewritten into wider forms; the rest are such
    forms spoiled, candidates of another kind on them, and candidates of the
    text with evidence against them. Base forms themselves are not learnt
    from, and what nothing is known of is left out.
    """
    base, found = proposals(text)
    for kind, a, b in found:
        if contrary(text, kind, a, b) and not any(overlap((a, b), s[1:]) > 0 for s in base):
            yield features(text, kind, a, b), False, text[a:b]
    for kind, a, b in base:
        for i, wide in enumerate(widened(kind, text[a:b])):
            for form in (wide, spoiled(kind, wide, i)):
                begin, end = min(a, 48), min(a, 48) + len(form)
                around = text[max(0, a - 48) : a] + form + text[b : b + 24]
                if any(overlap((begin, end), s[1:]) > 0 for s in base_spans(around)):
                    continue
                for k, c, d in candidates(around):
                    if overlap((begin, end), (c, d)) > 0:
                        good = form == wide and k == kind and 2 * overlap((begin, end), (c, d)) >= end - begin
                        if good or k != kind or contrary(around, k, c, d):
                            yield features(around, k, c, d), good, text[a:b]


def train_model(docs: DataFrame, precision: float):
    """Trees and thresholds from all texts, or None if they hold no candidates.

    They learn from ``examples``: base spans of the texts in wider forms
    against candidates with contrary evidence. Examples are small integers that
    come again and again, so they are counted by value where the texts are, and
    one task learns from the distinct ones and their counts.
    """

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: Counter = Counter()
            for text in batch.column(1):
                counts.update((bytes(x), y, hashlib.md5(span.encode("utf-8", "surrogatepass")).digest()[0] % 4) for x, y, span in examples(text.as_py() or ""))
            x, y, fold = zip(*counts, strict=True) if counts else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()), pa.array(y, pa.bool_()), pa.array(fold, pa.int32()), pa.array(counts.values(), pa.int64())], ["x", "y", "fold", "n"])

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(np.frombuffer(b"".join(b.column(0).to_pylist()), np.uint8).reshape(-1, N_FEATURES), *(c.to_numpy(zero_copy_only=False) for c in b.columns[1:])) for b in batches if b.num_rows]
        if not parts:
            return
        x, y, fold, n = (np.concatenate(p) for p in zip(*parts, strict=True))
        model, cuts = fit(x, y.astype(float), fold, precision, n.astype(float))
        yield pa.RecordBatch.from_arrays([pa.array([model.tobytes()]), pa.array([cuts])], ["trees", "cuts"])

    found = docs.mapInArrow(describe, "x binary, y boolean, fold int, n long").groupBy("x", "y", "fold").agg(F.sum("n").alias("n"))
    return found.repartition(1).sortWithinPartitions("x", "y", "fold").mapInArrow(train, "trees binary, cuts array<double>").first()


def select(text: str, trees: np.ndarray | None, cuts: list[float]) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans, and those of the candidates that the model adds: best first, none over another span."""
    base, found = proposals(text)
    found = [c for c in found if not any(overlap(c[1:], b[1:]) > 0 for b in base)]
    added: list[tuple[str, int, int]] = []
    if found and trees is not None:
        p = tree_scores(trees, np.array([features(text, *c) for c in found]))
        for score, c in sorted(zip(-p, found, strict=True)):
            if -score >= cuts[KINDS.index(c[0])] and not any(overlap(c[1:], b[1:]) > 0 for b in added):
                added.append(c)
    return base, added


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", precision: float = 0.97, redact: bool = True, carry: Sequence[str] = ()) -> DataFrame:
    """Per row: its id, counts by kind, digest of the base spans, all spans as text, and the redacted text.

    Spans are ``kind:start:end`` in code points, end exclusive, by kind and
    then start. In the redacted text each span (overlapping ones together)
    is its kind in brackets. Null text counts as empty; repeated rows give
    repeated results; null ids pass through, and so do the columns to
    ``carry``, in a struct ``_row``; other columns are not read; an empty
    table gives an empty table. The model learns from all texts; without any
    there is no model, and base spans alone are found.
    """
    own = docs.select(F.col(id_col).cast("long").alias("_doc"), F.col(text_col).cast("string").alias("_text"), *carried(docs, carry))
    model = train_model(own.select("_doc", "_text"), precision)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = np.frombuffer(model["trees"]).reshape(-1, 15, 3) if model else None
        cuts = model["cuts"] if model else []
        for batch in batches:
            counts, digests, listed, clean = [], [], [], []
            for text in batch.column(1):
                text = text.as_py() or ""
                base, added = select(text, trees, cuts)
                spans = sorted({*base, *added}, key=lambda s: (KINDS.index(s[0]), s[1]))
                counts.append([sum(s[0] == k for s in base) for k in KINDS])
                digests.append(hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest())
                listed.append(",".join(f"{k}:{a}:{b}" for k, a, b in spans))
                clean.append(redacted(text, spans) if redact else None)
            n = [pa.array([c[i] for c in counts], pa.int64()) for i in range(4)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *n, *(pa.array(c, pa.string()) for c in (digests, listed, clean)), *batch.columns[2:]], ["_doc", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "redacted", *batch.schema.names[2:]])

    out = own.mapInArrow(rows, schema_with_row("_doc long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, redacted string", own))
    return out.withColumnRenamed("_doc", id_col)


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    out, done = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= done:
            out += [text[done:a], f"[{kind.upper()}]"]
        done = max(done, b)
    return "".join([*out, text[done:]])
