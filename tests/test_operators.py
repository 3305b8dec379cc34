from pyspark.sql import functions as F

from tenderlake.functions import columns as c
from tenderlake.operators import changes as ch
from tenderlake.operators import relational as r
from tenderlake.sources import files
from tenderlake.streaming import ingest


def test_merge_twice_changes_nothing(spark):
    base = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    new = spark.createDataFrame([(2, "b"), (3, "c")], "k int, v string")
    once = ch.merge_upsert(base, new, ["k"])
    assert {r_.action for r_ in ch.classify(once, new, ["k"], ["v"]).collect()} == {"unchanged"}
    assert sorted(map(tuple, ch.merge_upsert(once, new, ["k"]).collect())) == sorted(map(tuple, once.collect()))


def test_field_diff_compares_nulls(spark):
    base = spark.createDataFrame([(1, None, "x"), (2, None, "y")], "k int, a string, b string")
    new = spark.createDataFrame([(1, "n", "x"), (2, None, "y")], "k int, a string, b string")
    assert [tuple(x) for x in ch.field_diff(base, new, ["k"], ["a", "b"]).collect()] == [(1, "a", None, "n")]


def test_record_hash_ignores_order_and_null_is_empty(spark):
    df = spark.createDataFrame([("", "x"), (None, "x")], "a string, b string")
    got = df.select(c.record_hash(["a", "b"]).alias("p"), c.record_hash(["b", "a"]).alias("q")).collect()
    assert len({v for row in got for v in row}) == 1


def test_columns(spark):
    row = spark.range(1).select(
        c.norm_id(F.lit("ab-12 ")).alias("i"), c.norm_id(F.lit("--")).alias("n"), c.safe_pct(F.lit(1), F.lit(0)).alias("z"), c.strip_html(F.lit("<p>a<script>x</script> <b>b</b></p>")).alias("h"),
        c.bucket(F.lit(70), [(70, "High"), (40, "Medium")], "Low").alias("b"), c.fiscal_year(F.lit("2024-10-01").cast("date")).alias("f"),
    ).first()
    assert tuple(row) == ("AB12", None, None, "a b", "High", 2025)


def test_asof_join_takes_the_row_at_the_same_time(spark):
    left = spark.createDataFrame([("k", 1), ("k", 5), ("j", 5)], "k string, t int")
    right = spark.createDataFrame([("k", 5, "now"), ("k", 4, "old")], "k string, t int, v string")
    assert sorted((x.k, x.t, x.v or "") for x in r.asof_join(left, right, ["k"], "t", ["v"]).collect()) == [("j", 5, ""), ("k", 1, ""), ("k", 5, "now")]


def test_extract_and_csv(spark, tmp_path):
    p = tmp_path / "x.dat"
    p.write_text("BOF X 2\nk1|a||z\nk1|b|c|z\n|n|n|n\nshort\nk2|\\|q|z\nEOF X\n")
    got = {x.k: (x.a, x.b) for x in files.scan_extract(spark, str(p), ["k", "a", "b"], "k").collect()}
    assert got["k1"] == ("a", "c") and got["k2"][0] is None
    assert files.extract_count(spark, str(p)).first().declared == 2
    q = tmp_path / "x.csv"
    q.write_text('﻿Award ID,Amount\nA,"1.5"\nB,bad\n', encoding="utf-8")
    assert [tuple(x) for x in files.scan_csv(spark, str(q), {"Award ID": "id", "Amount": "amount"}, {"amount": "double"}).collect()] == [("A", 1.5), ("B", None)]


def test_date_windows(spark):
    got = [(str(x[0]), str(x[1])) for x in files.date_windows(spark, "2024-01-01", "2024-01-10", 4).collect()]
    assert got == [("2024-01-01", "2024-01-04"), ("2024-01-05", "2024-01-08"), ("2024-01-09", "2024-01-10")]


def test_ingest_takes_new_files_once(spark, tmp_path):
    src, to, cp = (str(tmp_path / x) for x in ("src", "to", "cp"))
    for rows in ([(1, 1, "a"), (1, 2, "b")], [(1, 3, "c"), (2, 1, "d")]):
        spark.createDataFrame(rows, "k int, t int, v string").coalesce(1).write.mode("append").parquet(src)
        ingest.ingest_changes(spark, src, "k int, t int, v string", to, cp, ["k"], ["t"])
    assert sorted(map(tuple, ingest.current_rows(spark, to, ["k"], ["t"]).collect())) == [(1, 3, "c"), (2, 1, "d")]


def test_similar_topk_is_brute_force_over_all_rows(spark):
    import random

    rng = random.Random(6)
    rows = [(i, *[rng.choice([None, *"xyz"[:n]]) for n in (2, 3, 3)]) for i in range(60)]
    df = spark.createDataFrame(rows, "k long, b string, t string, s string")
    score = lambda p, q: sum(w for x, y, w in zip(p[1:], q[1:], (40, 25, 20), strict=True) if x is not None and x == y)
    want = set()
    for p in rows:
        best = sorted((-score(p, q), q[0]) for q in rows if q is not p and score(p, q))[:4]
        want |= {(p[0], b, -s, i + 1) for i, (s, b) in enumerate(best)}
    assert set(map(tuple, r.similar_topk(df, "k", {"b": 40, "t": 25, "s": 20}, 4).collect())) == want


def test_similar_parts_has_every_part(spark):
    from tenderlake.plans.catalogue import QUERIES

    data = "/root/testdata/sf0.001"
    part = spark.read.parquet(f"{data}/part.parquet").select("p_partkey", "p_brand", "p_type", "p_size").collect()
    points = lambda p, q: sum(w for x, y, w in zip(p[1:], q[1:], (40, 25, 20), strict=True) if x is not None and x == y)
    want = {(p[0], b, -s) for p in part for s, b in sorted((-points(p, q), q[0]) for q in part if p[0] != q[0] and points(p, q))[:10]}
    assert {(x.a_key, x.b_key, x.score) for x in QUERIES["similar_parts"](spark, data).collect()} == want
