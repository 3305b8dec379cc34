"""Operators and column functions that no catalogue query reaches, or only without nulls."""

import json

import pytest
from pyspark.sql import functions as F

from tenderlake.functions import columns as c
from tenderlake.operators import changes as ch
from tenderlake.operators import relational as r
from tenderlake.operators import scoring as s
from tenderlake.sources import files
from tenderlake.streaming import ingest


def test_null_groups_keep_their_rows(spark):
    df = spark.createDataFrame([(1, None, 10.0), (2, None, 30.0), (3, "a", 5.0), (4, "a", None)], "id int, g string, v double")
    assert {x.id: x.share_pct for x in r.share_of_total(df, "v", ["g"]).collect()} == {1: 25.0, 2: 75.0, 3: 100.0, 4: None}
    assert r.percentile_by_greater(df.select("id", "v"), "v").count() == 4
    texts = spark.createDataFrame([(1, None), (2, None), (3, "x"), (4, "x")], "id int, t string")
    assert {x.id: x.canonical for x in ch.hash_dedup(texts, "id", "t").collect()} == {1: 1, 2: 1, 3: 3, 4: 3}


def test_unknown_criteria_are_an_error(spark):
    with pytest.raises(ValueError, match="colour"):
        r.compile_filter({"colour": "red"}, {"name": ("contains", "name")})
    df = spark.createDataFrame([("50% off",), ("500 off",)], "name string")
    assert [x.name for x in df.where(r.compile_filter({"name": "50%"}, {"name": ("contains", "name")})).collect()] == ["50% off"]


def test_schema_drift(spark):
    a, b = spark.createDataFrame([], "x int, y string, z date").schema, spark.createDataFrame([], "x long, y string, w int").schema
    assert [tuple(x) for x in ch.schema_drift(spark, a, b).collect()] == [("w", None, "int", "extra"), ("x", "int", "bigint", "type"), ("z", "date", None, "missing")]


def test_columns_never_raise(spark):
    df = spark.createDataFrame([("1,234.50", "31/12/2020", "123456789", "a~bY~"), ("x", "2020-12-31", "12", ""), (None, None, None, None)], "n string, d string, z string, l string")
    got = df.select(c.parse_decimal(F.col("n")).cast("double"), c.parse_date(F.col("d"), ["dd/MM/yyyy", "yyyy-MM-dd"]).cast("string"), c.zip_code(F.col("z")), c.flagged_codes(F.col("l"))).collect()
    assert [tuple(x)[:3] for x in got] == [(1234.5, "2020-12-31", "12345-6789"), (None, "2020-12-31", None), (None, None, None)]
    assert [tuple(x) for x in got[0][3]] == [("a", None), ("b", "Y")] and got[1][3] == [] and got[2][3] is None


def test_score_edges(spark):
    row = spark.createDataFrame([(1,)], "i int")
    one = lambda col: row.select(col.alias("x")).first().x
    no, yes, none = F.lit(False), F.lit(True), F.lit(None).cast("boolean")
    assert one(s.size_eligibility(yes, yes, F.lit(-20.0))) == -100.0
    assert one(s.size_eligibility(yes, no, F.lit(None).cast("double"))) == 70.0
    assert one(s.size_eligibility(yes, none, F.lit(None).cast("double"))) is None
    assert one(s.incumbent(no, yes, F.lit(5), no, no)) == 65.0
    assert one(s.incumbent(no, no, F.lit(0), no, yes)) == 50.0
    held = F.array(F.lit("A"))
    assert [one(s.set_aside_match(F.lit(k), held, {"X": ["A"], "Y": ["B"]})) for k in ("X", "Y", "Q")] == [100.0, 50.0, None]
    assert one(s.go_no_go_points(F.lit(" wosb "), F.lit(None).cast("int"), yes, F.lit(None).cast("double"))["percent"]) == 70.0
    assert one(s.profile_match(F.lit("primary"), no, no)) == 0.0 and one(s.timeline(F.lit(20))) == 44.0


def test_nested_json(spark, tmp_path):
    path = tmp_path / "a.json"
    path.write_text(json.dumps({"total": 2, "items": [{"id": 1, "who": {"name": "x"}}, {"id": 2, "who": None}]}))
    got = files.scan_json(spark, str(path), "total int, items array<struct<id:int,who:struct<name:string>>>", "items", {"id": "id", "name": "who.name"})
    assert sorted(map(tuple, got.collect())) == [(1, "x"), (2, None)]


def test_windowed_counts(spark):
    rows = [("2024-01-01 00:10:00", "a"), ("2024-01-01 00:50:00", "a"), ("2024-01-01 01:10:00", "b")]
    events = spark.createDataFrame(rows, "t string, k string").select(F.col("t").cast("timestamp").alias("t"), "k")
    got = ingest.windowed_counts(events, "t", "k")
    assert sorted((str(x.start), x.k, x.n) for x in got.collect()) == [("2024-01-01 00:00:00", "a", 2), ("2024-01-01 01:00:00", "b", 1)]


def test_extract_takes_the_first_row_of_a_key(spark, tmp_path):
    path = tmp_path / "x.dat"
    path.write_text("BOF x 3\nk1|a|111Y~222N\nk1||333\nk2|b|\nEOF x 3\n")
    rows = files.scan_extract(spark, str(path), ["k", "a", "codes"], "k", first_row=True)
    assert sorted(map(tuple, rows.collect())) == [("k1", "a", "111Y~222N"), ("k2", "b", None)]
    assert sorted(map(tuple, files.child_rows(rows, "k", "codes").collect())) == [("k1", "111", "Y"), ("k1", "222", "N")]


def test_csv_in_many_tasks(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_text("a,b\n1,x\n2,y\n")
    assert sorted(map(tuple, files.scan_csv(spark, str(path), {"a": "n"}, {"n": "int"}, multi_line=False).collect())) == [(1,), (2,)]
