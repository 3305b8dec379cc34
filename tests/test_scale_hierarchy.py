import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tenderlake.operators import hierarchy as hi
from tenderlake.operators import incumbents as inc
from tenderlake.operators import scale


def test_quantiles_equal_numpy_with_nulls_ties_and_a_hot_group(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["hot"] * 5 + ["a", None]), rng.choice([None, 1.5, float(rng.randrange(40)), rng.random()])) for _ in range(4000)] + [("empty", None), ("one", 7.0)]
    by = defaultdict(list)
    for g, v in rows:
        by[g] += [v] if v is not None else []
    got = {r.g: r for r in scale.quantiles(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", [0, 0.25, 0.5, 0.9, 1]).collect()}
    assert set(got) == set(by) and got["empty"].n == 0 and got["empty"].q2 is None
    for g, values in by.items():
        if values:
            assert got[g].n == len(values)
            assert [got[g][f"q{i}"] for i in range(5)] == pytest.approx([np.quantile(values, p) for p in (0, 0.25, 0.5, 0.9, 1)], rel=1e-12)


def test_share_greater_equals_counting(spark):
    rng = random.Random(2)
    values = [rng.choice([None, rng.randrange(30)]) for _ in range(500)]
    got = sorted(((-1 if r.v is None else r.v), r.pct_greater) for r in scale.share_greater(spark.createDataFrame([(v,) for v in values], "v int"), "v").collect())
    low = [-1 if v is None else v for v in values]
    assert got == sorted((v, round(100 * sum(x > v for x in low) / len(low), 4)) for v in low)


def test_ranges_of_a_large_group_span_tasks(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = scale.ordered_counts(spark.range(5000).selectExpr("1 as g", "id % 997 as v"), ["g"], "v")
        rows = sorted((r.v, r.n, r.below) for r in got.collect())
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    counts, below = Counter(i % 997 for i in range(5000)), 0
    for v, n, b in rows:
        assert (n, b) == (counts[v], below)
        below += n


def test_ancestors_of_any_depth_and_of_cycles(spark):
    deep = [(i, i - 1) for i in range(1, 70)] + [(100, 101), (101, 102), (102, 100), (103, 100), (5, 5), (7, None), (None, 3)]
    got = defaultdict(dict)
    for r in hi.ancestors(spark.createDataFrame(deep, "c int, p int"), "c", "p").collect():
        got[r.node][r.ancestor] = r.depth
    assert got[69] == {i: 69 - i for i in range(69)} and len(got[1]) == 1
    assert got[100] == {101: 1, 102: 2, 100: 3} and got[103] == {100: 1, 101: 2, 102: 3}
    nodes = spark.createDataFrame([(i, i - 1 if i else None, 1) for i in range(5)] + [(8, 9, 10), (9, 8, 20)], "k int, p int, v int")
    rolled = {r.k: (r.depth, r.n_descendants, r.rolled_up, r.in_cycle) for r in hi.rolled_up(nodes, "k", "p", "v").collect()}
    assert rolled == {0: (0, 4, 5, False), 1: (1, 3, 4, False), 2: (2, 2, 3, False), 3: (3, 1, 2, False), 4: (4, 0, 1, False), 8: (1, 1, 30, True), 9: (1, 1, 30, True)}


def test_ways_of_a_forest_are_made_once(spark, monkeypatch):
    cut, made = hi.cut, []
    monkeypatch.setattr(hi, "cut", lambda df: made.append(cut(df)) or made[-1])
    edges = spark.createDataFrame([(i, i - 1) for i in range(1, 64)], "c int, p int")
    ways = hi.ancestors(edges, "c", "p")
    assert {(r.node, r.ancestor, r.depth) for r in ways.collect()} == {(i, j, i - j) for i in range(64) for j in range(i)}
    assert ways.count() == 2016 and sum(df.count() for df in made) <= 2016 + 6 * 64


def test_nearest_of_several_ways(spark):
    edges = {(i, i - k) for i in range(1, 40) for k in (1, 3, 7) if i >= k and (i * k) % 5} | {(0, 39)}
    want = {}
    for start in range(40):
        at, depth = {start}, 0
        while at:
            depth += 1
            at = {p for c, p in edges if c in at} - {a for n, a in want if n == start}
            want |= {(start, a): depth for a in at}
    got = hi.ancestors(spark.createDataFrame(sorted(edges), "c int, p int"), "c", "p").collect()
    assert len(got) == len(want) and {(r.node, r.ancestor): r.depth for r in got} == want


def test_parent_of_history(spark):
    schema = "kind string, h array<struct<effectivedate:string,fhfullparentpathid:string>>, dept string, injected string"
    rows = [("top", [("2024", "1.2.3")], "9", None), ("sub", [("2020", "1.5.3"), None, ("2024", "1.2.3"), (None, "7.7.7")], "9", None), ("sub", [("2024", "3")], "9", "8"), ("sub", [], "", "8"), ("sub", None, None, None), (None, [("2024", "1.4")], None, None)]
    parent = hi.parent_of_history(F.col("h"), F.col("kind") == "top", [F.col("dept"), F.col("injected")])
    assert [r[0] for r in spark.createDataFrame(rows, schema).select(parent).collect()] == [None, "2", "9", "8", None, "1"]


def test_captured_names_are_screened(spark):
    texts = [
        "The incumbent contractor is Acme Systems, Inc. today", "incumbent: Question(1) Will it", "currently performed by BOP staff", "contract held by The Agency", "current contractor – Blue-Sky & Sons LLC.",
        "awarded to Provide Support and awarded to Delta X5", None, "", "the incumbent is acme", "incumbent: X", "incumbent was Acme", "reincumbent: Acme",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    common = spark.createDataFrame([("provide",), ("support",)], "word string")
    got = sorted((r.id, r.name) for r in inc.capture_names(docs, "id", "text", common=common).collect())
    assert got == [(0, "Acme Systems, Inc"), (4, "Blue-Sky"), (5, "Delta X5"), (10, "Acme")]
    words = Counter(w for t in texts if t for w in set(re.findall(r"\b[a-z]+\b", t)))
    assert {r.word for r in inc.common_words(docs, "text", 3).collect()} == {w for w, n in words.items() if n >= 3} != set()


def test_one_holder_only(spark):
    names = spark.createDataFrame([("Acme",), ("acme x",), ("Zed",), ("5%",), ("ab",), ("",), (None,)], "n string")
    entities = spark.createDataFrame([(1, "ACME Inc"), (2, "New acme X"), (3, "100% of 5% gain"), (4, "AB"), (5, None), (6, "cabin")], "id int, full string")
    got = {r.n: (r.n_holders, r.id) for r in inc.only_holder(names, "n", entities, "id", "full").collect()}
    assert got == {"Acme": (2, None), "acme x": (1, 2), "Zed": (0, None), "5%": (1, 3), "ab": (2, None)}
