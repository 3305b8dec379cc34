"""Queries against their SQL on tables as they are only at size: keys that come again, large groups, repeated names."""

from pathlib import Path

import duckdb
import pytest
from test_catalogue import DATA, rows

from tenderlake.plans import catalogue

SMALL = "/root/testdata/sf0.01"


def tables(folder: Path, **changed: str) -> str:
    """A folder of the smallest tables, those in ``changed`` replaced by what their SQL selects."""
    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        con.sql(f"create view {p.stem} as select * from '{p}'")
    for p in Path(DATA).glob("*.parquet"):
        con.sql(f"copy ({changed.get(p.stem, f'select * from {p.stem}')}) to '{folder}/{p.name}'")
    return str(folder)


def same(spark, folder: str, name: str) -> bool:
    con = duckdb.connect()
    for p in Path(folder).glob("*.parquet"):
        con.sql(f"create view {p.stem} as select * from '{p}'")
    got, want = rows(catalogue.QUERIES[name](spark, folder).toPandas()), rows(con.sql(catalogue.SQL[name]).df())
    assert want
    return got == want


@pytest.mark.parametrize("name", ["wage_determinations", "wage_rates"])
def test_numbers_of_determinations_come_again(spark, tmp_path, name):
    orders = "select * replace (o_custkey % 20 + 90000 * (o_orderkey % 4) as o_custkey) from orders"
    folder = tables(tmp_path, orders=orders, lineitem="select * replace (l_partkey % 3 as l_partkey) from lineitem")
    assert same(spark, folder, name)


@pytest.mark.parametrize("name", ["any_key_pairs", "exclusion_scan"])
def test_pairs_are_made_once_and_not_shuffled(spark, tmp_path, name):
    """Keys that come again with other nations, and rows that come twice; what is shuffled are rows, not pairs."""
    again = "select * from {0} union all select * from {0} union all select * replace ({1} % 3 as {1}) from {0}"
    folder = tables(tmp_path, supplier=again.format("supplier", "s_nationkey"), customer=again.format("customer", "c_nationkey"))
    if name == "exclusion_scan":  # the SQL of the other one gives a pair for each pair of rows
        assert same(spark, folder, name)
    assert same(spark, DATA, name)
    plan = catalogue.QUERIES[name](spark, folder)._jdf.queryExecution().optimizedPlan().toString().split("\n")
    joins = [i for i, line in enumerate(plan) if "Join" in line]
    assert not any("Aggregate" in line for line in plan[: joins[0]])


@pytest.mark.parametrize("name", ["incumbent_entity", "incumbent_by_votes", "incumbent_capture"])
def test_incumbents_on_lines_and_names_that_repeat(spark, tmp_path, name):
    """Lines that come twice or twice but for what the text does not tell, and vendors of one name; texts meet in one join, before names are captured."""
    line = "select * from lineitem union all select * from lineitem union all select * replace (l_quantity + 1 as l_quantity) from lineitem where l_quantity > 9"
    part = "select * from part union all select * replace (p_partkey + 1000 as p_partkey) from part where p_partkey % 3 = 0 union all select * from part where p_partkey % 7 = 0 union all select * replace ('Brand#99' as p_brand) from part where p_partkey % 11 = 0"
    folder = tables(tmp_path, lineitem=line, part=part)
    assert same(spark, folder, name)
    plan = catalogue.QUERIES[name](spark, folder)._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("regexp_extract_all") :] if name != "incumbent_entity" else plan[plan.rindex("regexp_extract_all") :]
    above = plan[: plan.index("regexp_extract_all")]
    assert below.count("Join") == 1 and (name == "incumbent_entity" or "Join" not in above)


@pytest.mark.parametrize(("first", "wider"), [(10, 2), (32, 16)])
def test_partners_are_found_without_all_pairs(spark, monkeypatch, first, wider):
    """As from all pairs and as from SQL, also when most requests need several rounds; the pairs scored at first are ``first`` a request and those of subawards."""
    from tenderlake.operators import partners as pa

    find, score, scored = pa.find_partners, pa.score_partners, []
    monkeypatch.setattr(pa, "find_partners", lambda *a: find(*a, first=first, wider=wider))
    monkeypatch.setattr(pa, "score_partners", lambda pairs, *a, **k: scored.append((k.get("alone"), pairs)) or score(pairs, *a, **k))
    assert same(spark, SMALL, "partner_finder")
    pairs = [df for alone, df in scored if not alone]
    assert (len(pairs) > 1) == (first == 10)
    asked = spark.read.parquet(f"{SMALL}/customer.parquet").where("c_acctbal > 0").count()
    assert pairs[0].count() <= (first + 10) * asked


def test_partners_are_joined_without_the_driver(spark, monkeypatch):
    """Tables that are small in files but grow with the input are not broadcast, and what a kind's score settles is not scored for each request."""
    from tenderlake.operators import partners as pa

    cut, score, made, scored = pa.cut, pa.score_partners, [], []
    monkeypatch.setattr(pa, "cut", lambda df: made.append(df) or cut(df))
    monkeypatch.setattr(pa, "score_partners", lambda pairs, *a, **k: scored.append((k.get("alone"), pairs)) or score(pairs, *a, **k))
    made.append(catalogue.QUERIES["partner_finder"](spark, SMALL))
    plans = [df._jdf.queryExecution().executedPlan().toString() for df in made]
    assert any("SortMergeJoin" in p for p in plans) and not any("Broadcast" in p for p in plans)
    asked = spark.read.parquet(f"{SMALL}/customer.parquet").where("c_acctbal > 0").count()
    assert next(df for alone, df in scored if not alone).count() < 20 * asked


def test_pairs_of_a_small_file_are_made_in_many_tasks(spark):
    from pyspark.sql import functions as F

    pairs = catalogue.QUERIES["disjunctive_similarity"](spark, SMALL)
    by_task = pairs.groupBy(F.spark_partition_id().alias("task")).count().toPandas()["count"]
    assert len(by_task) > 12 and by_task.max() < by_task.sum() / 8
    assert same(spark, SMALL, "disjunctive_similarity")


def test_edges_are_aggregated_once(spark, tmp_path):
    """Suppliers and customers of the same keys, of their own, and of none."""
    line = "select * replace (case when l_orderkey % 11 = 0 then null else l_suppkey % 7 end as l_suppkey) from lineitem"
    order = "select * replace (case when o_orderkey % 13 = 0 or o_orderkey % 11 = 0 and o_orderkey % 2 = 0 then null else o_custkey % 9 end as o_custkey) from orders"
    folder = tables(tmp_path, lineitem=line, orders=order)
    assert same(spark, folder, "view_teaming_network")
    plan = catalogue.QUERIES["view_teaming_network"](spark, folder)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 1


def test_similar_parts_are_paired_once(spark, tmp_path):
    """Columns with nulls and with one value; no pair is made twice, so none is made distinct."""
    part = "select p_partkey, p_name, case when p_partkey % 5 = 0 then null else p_brand end as p_brand, case when p_partkey % 3 = 0 then null else 'ONE' end as p_type, p_size % 4 as p_size, p_retailprice from part"
    folder = tables(tmp_path, part=part)
    con = duckdb.connect()
    want = con.sql(f"""select * from (select *, row_number() over (partition by a_key order by score desc, b_key) as rank from (select a.p_partkey as a_key, b.p_partkey as b_key,
        40 * coalesce(a.p_brand = b.p_brand, false)::int + 25 * coalesce(a.p_type = b.p_type, false)::int + 20 * coalesce(a.p_size = b.p_size, false)::int as score from '{folder}/part.parquet' a join '{folder}/part.parquet' b on a.p_partkey <> b.p_partkey) where score > 0) where rank <= 10""").fetchall()
    got = catalogue.QUERIES["similar_parts"](spark, folder)
    assert sorted((r.a_key, r.b_key, r.score, r["rank"]) for r in got.select("a_key", "b_key", "score", "rank").collect()) == sorted(want)
    assert "Aggregate" not in got._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["score_competitor_strength", "score_open_door"])
def test_pairs_with_lines_of_several_years_are_shuffled_once(spark, tmp_path, name):
    """Lines without a date, and customers of many lines; no years are made distinct by pair."""
    line = "select * replace (case when l_partkey % 3 = 0 then null else l_shipdate end as l_shipdate) from lineitem"
    folder = tables(tmp_path, lineitem=line, orders="select * replace (o_custkey % 40 as o_custkey) from orders")
    if name == "score_competitor_strength":  # with years of null the SQL of the other one ranks them first
        assert same(spark, folder, name)
    assert same(spark, DATA, name)
    plan = catalogue.QUERIES[name](spark, folder)._jdf.queryExecution().optimizedPlan().toString()
    assert "count(distinct y" not in plan


@pytest.mark.parametrize("name", ["view_partner_capability_match", "mart_partner_capability_refresh"])
def test_capabilities_of_lines_without_part_order_or_date(spark, tmp_path, name):
    """A side that a line has no partner on takes nothing from the other ones; some vendors have no line since the mart, some have such lines alone."""
    line = """select * replace (case when l_linenumber % 5 = 0 then l_partkey + 100000 else l_partkey end as l_partkey, case when l_linenumber % 4 = 0 then -1 else l_orderkey end as l_orderkey,
        case when l_orderkey % 7 = 0 then null when l_suppkey % 3 = 0 then least(l_shipdate, timestamp '2001-05-01') else l_shipdate end as l_shipdate) from lineitem"""
    folder = tables(tmp_path, lineitem=line)
    assert same(spark, folder, name)
    assert same(spark, SMALL, name)


def test_recommended_notices_are_met_without_all_pairs(spark, tmp_path, monkeypatch):
    """Every part a solicitation of its own, prices that balances fall between, equal prices and none; a code's pairs are at most twice the best."""
    from tenderlake.operators import estimates as es

    top, seen = es.top_k, []
    monkeypatch.setattr(es, "top_k", lambda df, keys, *a: seen.append((keys, df)) or top(df, keys, *a))
    part = """select * replace (p_partkey::varchar as p_name, 'Brand#' || p_partkey % 2 as p_brand, case when p_partkey % 5 = 0 then 'PROMO' else 'SMALL' end as p_type,
        case when p_partkey % 9 > 0 then (p_partkey * 7919 % 101) * 100.0 - 500 end as p_retailprice) from (select * from part union all select * replace (p_partkey + 1000 as p_partkey) from part union all select * replace (p_partkey + 2000 as p_partkey) from part)"""
    folder = tables(tmp_path, part=part, supplier="select * replace (case when s_suppkey % 5 > 0 then s_acctbal end as s_acctbal) from supplier")
    assert same(spark, folder, "recommend_notices")
    pairs = next(df for keys, df in reversed(seen) if keys == ["l_suppkey"])
    assert pairs.count() <= 2 * 10 * 2 * 2 * spark.read.parquet(f"{folder}/supplier.parquet").count()
    assert same(spark, SMALL, "recommend_notices")


def test_second_keys_are_counted_in_one_pass(spark):
    """Lines are read and joined once for all second keys of a vendor."""
    plan = catalogue.QUERIES["score_competitor_strength"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [l_orderkey") == 1
    assert same(spark, SMALL, "score_competitor_strength")


@pytest.mark.parametrize(("name", "key"), [("score_competitor_strength", "l_suppkey"), ("score_open_door", "o_custkey")])
def test_lines_are_dealt_by_key_before_they_are_multiplied(spark, tmp_path, name, key):
    """Lines without a vendor or a part, values of none and a vendor with half of all lines; besides the joins nothing but the lines themselves is shuffled."""
    line = """select * replace (case when l_orderkey % 7 = 0 then null when l_orderkey % 2 = 0 then 3 else l_suppkey end as l_suppkey, case when l_linenumber % 5 = 0 then l_partkey + 100000 else l_partkey end as l_partkey,
        case when l_orderkey % 11 = 0 then null else l_extendedprice end as l_extendedprice) from lineitem"""
    folder = tables(tmp_path, lineitem=line, part="select * replace (case when p_partkey % 4 = 0 then null else p_brand end as p_brand) from part")
    assert same(spark, folder, name)
    assert same(spark, SMALL, name)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = catalogue.QUERIES[name](spark, folder)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    dealt = [row for row in plan.split("\n") if "Exchange hashpartitioning" in row]
    assert len(dealt) == (2 if name == "score_competitor_strength" else 1) and all(f"hashpartitioning({key}" in row for row in dealt)  # the former's vendors too
    assert plan.index("Generate") < plan.index("REPARTITION_BY_NUM")
    assert plan.count("Scan parquet") == (5 if name == "score_competitor_strength" else 4)


def test_past_performance_joins_lines_to_parts_once(spark):
    got = catalogue.QUERIES["view_past_performance_match"](spark, DATA)
    assert "Relation [l_orderkey" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert same(spark, DATA, "view_past_performance_match")
