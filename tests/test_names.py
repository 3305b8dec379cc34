import random

import pytest

from tenderlake.operators import names as nm


@pytest.mark.parametrize("threshold", [70, 85, 90, 100])
def test_similar_texts_equals_all_pairs(spark, threshold):
    rng = random.Random(threshold)
    words = ["state", "estate", "energy", "of", "department", "dept", "a", "navy", "é", "aa", "office", "labor"]
    spoil = lambda s: "".join(c if rng.random() > 0.06 else rng.choice(["", c + c, "x"]) for c in s)
    make = lambda: spoil(" ".join(rng.choices(words, k=rng.randint(1, 5))))
    a, b = [make() for _ in range(250)] + ["", "a", "ab", "state " * 60], [make() for _ in range(250)] + ["", "a", "ba", "b", "state " * 58]
    got = {(r.a, r.b): round(r.score, 6) for r in nm.similar_texts(spark.createDataFrame([(x,) for x in a], "s string"), spark.createDataFrame([(x,) for x in b], "s string"), threshold).collect()}
    want = {(x, y): round(s, 6) for x in set(a) for y in set(b) if (s := nm.sorted_ratio(x, y)) >= threshold}
    assert got == want and (threshold == 100 or len(want) > 40)


def test_a_threshold_without_a_filter_is_an_error(spark):
    with pytest.raises(ValueError, match="66.7"):
        nm.similar_texts(spark.range(1).selectExpr("'a'"), spark.range(1).selectExpr("'a'"), 60)


def test_names_resolve_exactly_by_variant_or_by_similarity(spark):
    reference = spark.createDataFrame([("Department of State", "019", "dept"), ("NAVY, DEPT OF", "017", "dept"), ("Office of the Clerk", "001", "office"), ("department  of state", "020", "dept"), (None, "9", "dept"), ("General Services Administration", "047", "dept")], "name string, code string, kind string")
    raw = ["department of  STATE", "State, Department of", "Dept. of State", "Department of Navy", "General Servces Administration", "Office of the Clark", "Clerk", " ", None, "STATE,DEPT OF"]
    got = {r.raw: (r.code, r.method) for r in nm.resolve_names(spark.createDataFrame([(x,) for x in raw], "raw string"), "raw", reference, "name", "code", nm.F.col("kind") == "dept").collect()}
    assert got == {
        "department of  STATE": ("019", "exact"), "State, Department of": ("019", "variant"), "Dept. of State": ("019", "variant"), "Department of Navy": ("017", "variant"),
        "General Servces Administration": ("047", "fuzzy"), "Office of the Clark": (None, "unresolved"), "Clerk": (None, "unresolved"), " ": (None, "unresolved"), "STATE,DEPT OF": ("019", "variant"),
    }


def test_match_names_takes_a_table_of_any_size(spark):
    canonical = spark.range(3000).selectExpr("concat('Grade ', id, ' Welder') as name")
    raw = spark.createDataFrame([("grade 17 welder",), ("Weldr Grade 2999",), ("Nurse",)], "raw string")
    got = {r.raw: (r.canonical, r.method) for r in nm.match_names(raw, "raw", canonical, threshold=95.0).collect()}
    assert got == {"grade 17 welder": ("Grade 17 Welder", "EXACT"), "Weldr Grade 2999": ("Grade 2999 Welder", "FUZZY"), "Nurse": (None, "UNMAPPED")}
