import random

from pyspark.sql import functions as F

from tenderlake.operators import estimates as es


def test_early_bounds_lose_nobody(spark):
    rng = random.Random(7)
    notices = [(i, rng.choice("ab"), rng.choice([None, "x", "y"]), rng.randrange(60), rng.randrange(100)) for i in range(400)]
    orgs = [(o, rng.choice("ab"), rng.randrange(3)) for o in range(12)]
    codes = {(o, c): min(s for p, d, s in orgs if (p, d) == (o, c)) for o, c, _ in orgs}
    certs = [(o, rng.choice("xyz")) for o in range(8)] + [(0, "x"), (0, "x")]
    for k in (1, 5, 500):
        got = es.recommend(
            spark.createDataFrame([(o, c, s) for (o, c), s in codes.items()], "org int, code string, standing int"), spark.createDataFrame(notices, "notice int, code string, need string, fixed int, v int"), spark.createDataFrame(certs, "org int, cert string"),
            "org", "code", "notice", "need", k, F.col("fixed"), F.when(F.col("v") > 50, 10).otherwise(0) - F.col("standing"), -2, 10,
        ).collect()
        want = set()
        for o in {o for o, _ in codes}:
            scored = sorted((-(f + (10 if v > 50 else 0) - codes[o, c]), i) for i, c, need, f, v in notices if (o, c) in codes and (need is None or (o, need) in certs))
            want |= {(o, i, -s, r + 1) for r, (s, i) in enumerate(scored[:k])}
        assert {tuple(r) for r in got} == want


def test_codes_count_for_the_first_source(spark):
    a, b = spark.createDataFrame([(1, "x"), (1, None)], "o int, c string"), spark.createDataFrame([(1, "x"), (1, "y"), (2, "x"), (2, "x")], "o int, c string")
    assert sorted(map(tuple, es.candidate_codes([a, b], "o", "c").collect())) == [(1, "x", 0), (1, "y", 1), (2, "x", 1)]


def test_the_newest_notice_stands_for_its_solicitation(spark):
    rows = [(1, "s", 5), (2, "s", 7), (3, "s", 7), (4, None, 1), (5, "", 1), (6, "4", 1)]
    got = es.newest_of(spark.createDataFrame(rows, "n int, sol string, posted int"), "sol", "n", "posted")
    assert got.columns == ["n", "sol", "posted"] and sorted(r.n for r in got.collect()) == [3, 4, 5, 6]


def test_estimates_and_their_ensemble(spark):
    q = spark.createDataFrame([(1, "c", "s1", 6), (2, "d", "s2", None), (3, None, None, None)], "id int, code string, sol string, months int")
    awards = spark.createDataFrame([(i, "c", None, float(i), "2023-01-01") for i in range(1, 13)] + [(90, "c", None, 999.0, "2010-01-01"), (91, "c", None, -5.0, "2023-01-01"), (92, "e", "s1", 300.0, "2023-12-02"), (93, "e", "s1", 1.0, "2022-01-01"), (94, "e", "s2", 9.0, "2024-06-01")], "a int, code string, sol string, v double, starts string")
    now, order = F.lit("2024-01-01").cast("timestamp"), [F.asc("a")]
    analog = es.by_analog(q, awards, "id", "code", "v", "starts", order, now)
    labor = es.by_labor(q, spark.createDataFrame([(1, "w", 10), (1, "none", 99), (2, "none", 9)], "id int, cat string, hours int"), spark.createDataFrame([("w", 10.0), ("w", 20.0), ("w", 0.0)], "cat string, rate double"), "id", "cat", "hours", "rate", "months")
    burn = es.by_burn_rate(q, awards, "id", "sol", "v", "starts", order, "months", now)
    got = sorted(tuple(r) for m in (analog, labor, burn) for r in m.collect())
    assert got == [(1, "analog", 6.5, 0.4, 12), (1, "burn", 1800.0, 0.5, 1), (1, "labor", 75.0, 0.7, 2)]
    out = {r.id: (r.estimate, r.n_methods, r.confidence, r.level) for r in es.ensemble(q, [analog, labor, burn], "id").collect()}
    assert out == {1: (round((6.5 * 0.4 + 900 + 52.5) / 1.6, 2), 3, 0.53, "Medium"), 2: (None, 0, None, "None"), 3: (None, 0, None, "None")}
