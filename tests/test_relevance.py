import random

import pytest

from tenderlake.operators import relevance as rel


@pytest.mark.parametrize("k", [1, 4, 60])
def test_most_relevant_equals_all_pairs(spark, k):
    rng = random.Random(k)
    pick = lambda *x: rng.choice(x)
    past = [(f"p{i}", pick("o1", "o2", "o3"), pick("a", "b", "c", None), pick("X", "Y", None), pick(None, 0.0, *map(float, range(1, 9))), pick(None, 1.0, 3.0, 4.5, 9.0)) for i in range(40)]
    notices = [(i, pick("a", "a", "b", "c", "d", None), pick("X", "Y", "Z", None), pick(None, 0.0, *map(float, range(1, 9)))) for i in range(120)]
    own = [("o1", "a"), ("o1", "d"), ("o2", "b")]
    got = rel.most_relevant(spark.createDataFrame(past, "past_id string, org_id string, code string, agency string, value double, years double"), spark.createDataFrame(notices, "notice_id int, code string, agency string, value double"), spark.createDataFrame(own, "org_id string, code string"), k).collect()
    want = set()
    for p, org, code, agency, value, years in past:
        rows = []
        for n, c, a, v in notices:
            if c is not None and (c == code or (org, c) in own):
                alike = min(v, value) / max(v, value) if v and value else None
                score = (35.0 if c == code else 0.0) + (25.0 if a == agency and a is not None else 0.0) + (alike or 0.0) * 20.0 + (0.0 if years is None else 20.0 if years <= 3 else 10.0 if years <= 5 else 0.0)
                rows.append((-score, n, c == code, a == agency and a is not None, alike))
        want |= {(p, n, c, a, None if alike is None else round(alike + 1e-12, 2), round(-s + 1e-12, 1), i + 1) for i, (s, n, c, a, alike) in enumerate(sorted(rows)[:k])}
    assert {tuple(r) for r in got} == want


def test_ranked_lists_keep_every_value(spark):
    from pyspark.sql import functions as F

    from tenderlake.operators.relational import concat_ranked, count_checks

    df = spark.createDataFrame([("g", "b", 0), ("g", "a", 0), ("g", "a", 0), ("g", "c", 1), ("g", None, 1), ("h", "z", 0)], "g string, v string, lead int")
    got = {r.g: r.listed for r in concat_ranked(df, ["g"], "v", [-F.max("lead"), -F.count(F.lit(1))]).collect()}
    assert got == {"g": "c, a, b", "h": "z"}
    checks = [("1", "a", spark.range(10), "b", spark.range(7)), ("2", "a", spark.range(0), "b", spark.range(0)), ("3", "a", spark.range(1), "b", spark.range(3)), ("4", "a", spark.range(5), "b", spark.range(5))]
    assert sorted((r.check_id, r.difference, r.pct_difference, r.status) for r in count_checks(checks).collect()) == [("1", 3, 30.0, "WARNING"), ("2", 0, 0.0, "OK"), ("3", 2, 66.7, "ERROR"), ("4", 0, 0.0, "OK")]
