"""Source divergence, Merkle manifest and toxicity: against brute force, and on awkward rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def audit(rows, min_docs, k):
    docs, count, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source, _ in rows:
        lang, source, found = lang or "", source or "", TERM.findall(lower(text or ""))
        groups.add((lang, source))
        docs[lang].update(set(found))
        count[lang, source].update(found)
    out = set()
    for lang in {g[0] for g in groups}:
        kept = sorted(t for t, n in docs[lang].items() if n >= min_docs)
        total = Counter()
        for g in groups:
            if g[0] == lang:
                total.update(count[g])
        share = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c[x] for x in kept) + 5 * len(kept)) for t in kept}
        q, p = share(total), {g: share(count[g]) for g in groups if g[0] == lang}
        for g in p:
            pairs = sorted(((-sum(abs(p[g][t] - p[o][t]) for t in kept), o[1].encode()) for o in p if o != g))
            out |= {(*g, "pair", o.decode(), -v, i + 1) for i, (v, o) in enumerate(pairs)}
            terms = sorted((q[t] - p[g][t], t.encode()) for t in kept if count[g][t] and p[g][t] > q[t])[:k]
            out |= {(*g, "term", t.decode(), -v, i + 1) for i, (v, t) in enumerate(terms)}
    return out


def test_audit_equals_brute_force_with_nulls_ties_and_repeats(spark):
    from tenderlake.llm.divergence import audit_sources

    rng = random.Random(4)
    words = ["shared" + "x" * 40 + chr(97 + i) for i in range(8)] + ["Äx", "äx", "ÉA", "a1b", "日本", "z", "𝒳y", "é́"] + [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(5) for j in range(5)]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(0, 25))), rng.choice(["en", "de", None, ""]), rng.choice(["hot"] * 5 + ["a", "b", "é", None]), 1) for i in range(300)]
    rows += [(None, None, "en", "no text", 1), (1, "", "xx", "alone", 1), (2, "!! 12", "xx", "other", 1), (3, "wab " * 5000 + "Wab,wAB", "en", "long", 1), rows[0], rows[0]]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("_term", F.lit("clash")).withColumn("value", F.lit("clash"))
    for k in (3, 50):
        got = audit_sources(docs, min_docs=12, k=k).collect()
        assert len(got) == len(set(got)) and {tuple(r) for r in got} == audit(rows, 12, k)
    assert audit_sources(docs.limit(0)).count() == 0
    assert {(r.part, r.value) for r in audit_sources(docs, min_docs=1000).collect()} == {("pair", 0)}


def test_a_part_of_a_long_text_is_cut_between_terms():
    from tenderlake.llm import divergence

    text = ("ab cd-EF é " * 30).encode()
    old = divergence.PART
    try:
        divergence.PART = 7
        parts = list(divergence.parts_of(text))
    finally:
        divergence.PART = old
    assert len(parts) > 10 and [t for p in parts for t in p] == [t.encode() for t in TERM.findall(lower(text.decode()))]


@pytest.mark.parametrize(("n", "distinct", "k"), [(4000, 3, 50), (4000, 10**9, 7), (30, 5, 50), (500, 1, 499)])
def test_radix_ranking_equals_a_sort(spark, n, distinct, k):
    from tenderlake.llm.common import Scratch
    from tenderlake.llm.divergence import top_by_radix

    rng = random.Random(n + k)
    rows = [(g, rng.randrange(distinct), f"{'p' * rng.randint(0, 30)}{i}{rng.choice(['', 'é', '日'])}") for i in range(n) for g in ("x", "y") if g == "x" or i % 50 == 0]
    got = top_by_radix(Scratch(spark, "t"), spark.createDataFrame(rows, "g string, v long, t string"), ["g"], "v", "t", k).collect()
    want = set()
    for g in ("x", "y"):
        want |= {(g, v, t, i + 1) for i, (g, v, t) in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1], r[2].encode()))[:k])}
    assert {(r.g, r.v, r.t, r["rank"]) for r in got} == want and len(got) == len(want)


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree(nodes):
    """The root, and for each leaf the siblings by level as (left, right)."""
    at, proofs = list(range(len(nodes))), [[] for _ in nodes]
    while len(nodes) > 1:
        for leaf, i in enumerate(at):
            first = i // 3 * 3
            proofs[leaf].append(("".join(nodes[first:i]), "".join(nodes[i + 1 : first + 3])))
            at[leaf] = i // 3
        nodes = [h(*nodes[i : i + 3]) for i in range(0, len(nodes), 3)]
    return nodes[0], proofs


def manifest(rows):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    by = defaultdict(list)
    for doc, text, lang, source, n in rows:
        by[source].append((doc is not None, doc or 0, h(*map(field, (doc, source, lang, n, text)))))
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    told = {s: tree([x[2] for x in sorted(by[s])]) for s in order}
    root, upper = tree([told[s][0] for s in order])
    return sorted((doc if known else -1, leaf, told[s][0], root, tuple(proof + upper[j])) for j, s in enumerate(order) for (known, doc, leaf), proof in zip(sorted(by[s]), told[s][1], strict=True))


@pytest.mark.parametrize("sources", [["one"], [None, "", "é", "z", "hot", "hot", "hot"]])
def test_manifest_equals_brute_force_over_several_superblocks(spark, sources):
    from tenderlake.llm.manifest import folded, merkle_manifest

    rng = random.Random(len(sources))
    rows = [(i, f"text {i}\n", rng.choice(["en", None]), rng.choice(sources), i % 7 if i % 3 else None) for i in range(5000)]
    rows += [(None, "a", "en", sources[0], 1), (None, "b", "en", sources[0], 1), (7, None, None, sources[-1], None), (7, "", "é", sources[-1], 0), rows[0], rows[0], (8, "y" * 500_000, "en", sources[-1], 5)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("leaf", F.lit("clash")).withColumn("_i", F.lit("clash"))
    out = merkle_manifest(docs).withColumn("again", folded(F.col("leaf"), F.col("proof"))).collect()
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.leaf, r.subroot, r.root, tuple((x.left, x.right) for x in r.proof)) for r in out)
    assert got == manifest(rows)
    assert all(r.again == r.root for r in out)


def test_manifest_of_few_rows_and_of_a_changed_row(spark):
    from tenderlake.llm.manifest import folded, leaf_of, merkle_manifest

    one = spark.createDataFrame([(1, "a\nb", "en", "s", 3)], SCHEMA)
    got = merkle_manifest(one).first()
    assert got.leaf == got.subroot == got.root == h("1:1", "1:s", "2:en", "1:3", "3:a\nb") and not got.proof
    assert merkle_manifest(one.limit(0)).count() == 0
    docs = spark.createDataFrame([(i, f"t{i}", "en", f"s{i % 4}", 2) for i in range(20)], SCHEMA)
    fields = ("doc_id", "source", "lang", "n_chars", "text")
    other = F.when(F.col("doc_id") == 5, leaf_of([F.lit("changed") if c == "text" else F.col(c) for c in fields])).otherwise(leaf_of([F.col(c) for c in fields]))
    bad = merkle_manifest(docs, suspect=other).where(folded(F.col("suspect_leaf"), F.col("proof")) != F.col("root")).collect()
    assert [r.doc_id for r in bad] == [5]


def test_non_negative_risk_stops_where_negatives_are_remembered():
    from tenderlake.llm.toxicity import Sparse, fit

    rng = np.random.default_rng(1)
    words = np.arange(60, dtype=np.uint32)
    text = lambda toxic: np.unique(np.append(rng.integers(3, 60, 8), rng.integers(0, 3) if toxic else rng.integers(3, 60))).astype(np.uint32)
    p, u = Sparse([text(True) for _ in range(200)], words), Sparse([text(rng.random() < 0.2) for _ in range(1000)], words)
    w, bias = fit(p, u, 0.2, 200, 1e-3, 1e-5)
    assert w[:3].min() > 2 and np.abs(w[3:]).max() < w[:3].min() / 2
    assert 0.1 < (u.score(w, bias) > 0).mean() < 0.3  # as many as the prior says, though no negative was ever named


def test_toxicity_held_out_and_awkward_rows(spark):
    from tenderlake.llm.toxicity import score_toxicity

    rng = random.Random(2)
    words = [f"word{i}" for i in range(300)]
    toxic = {i for i in range(1500) if rng.random() < 0.15}
    text = lambda i: " ".join(rng.choices(words, k=40) + ([rng.choice(["vile", "nasty", "awful"])] if i in toxic else []))
    rows = [(i, text(i), "en", "s", 1) for i in range(1500)]
    extra = [(None, "nasty vile awful", None, None, None), (5000, None, None, None, None), (5001, "", None, None, None), (5002, "word1 " * 200_000 + "VILE, nasty", None, None, None), rows[3], rows[3]]
    docs = spark.createDataFrame(rows + extra, SCHEMA).withColumn("score", F.lit("clash")).withColumn("_doc", F.lit("clash"))
    labels = spark.createDataFrame([(i, int(i in toxic)) for i in range(0, 1500, 2)] + [(None, 1), (1, None), (3, 7), (4, 0), (4, 1)], "doc_id long, toxic int")
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0
    out = score_toxicity(docs, labels, ~held_out).collect()
    assert len(out) == len(rows) + len(extra) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out)
    apart = [r for r in out if r.doc_id is not None and r.doc_id < 1500 and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    right = [r.predicted == (r.doc_id in toxic) for r in apart]
    assert len(apart) > 200 and sum(right) >= 0.97 * len(right), (len(right) - sum(right), [(r.score, r.doc_id in toxic) for r in apart if r.predicted != (r.doc_id in toxic)])
    by = defaultdict(set)
    for r in out:
        by[r.doc_id].add((r.score, r.predicted))
    assert {p for _, p in by[None]} == {1} == {p for _, p in by[5002]} and {p for i in (5000, 5001) for _, p in by[i]} == {0} and len(by[3]) == 1
    assert score_toxicity(docs.limit(0), labels).count() == 0
    assert {round(r.score, 6) for r in score_toxicity(docs.limit(5), labels.where("toxic = 0")).collect()} == {0.1}
