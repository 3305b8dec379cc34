"""Named queries over the test tables, each with the SQL that must give the same rows.

The tables stand in for procurement data: order lines are awards, suppliers
vendors, customers contracting offices, parts categories, nations and regions
the hierarchy, events the notices. "Today" is a constant, never the clock.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tenderlake.functions import columns as c
from tenderlake.operators import changes as ch
from tenderlake.operators import relational as r

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
AS_OF = "1999-01-01"


class Tables:
    """``t.orders`` is the table of that name."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self._spark, self._dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self._spark.read.parquet(f"{self._dir}/{name}.parquet")


def query(sql: str | None):
    def register(f: Callable[[Tables], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["market_share_topn"](spark, sf_dir)


def awards(t: Tables) -> DataFrame:
    return t.lineitem.withColumn("value", c.money(F.col("l_extendedprice")))


def n_rows():
    return F.count(F.lit(1))


@query("""WITH v AS (SELECT p_brand, l_suppkey, sum(CAST(l_extendedprice AS DECIMAL(15,2))) AS value FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
s AS (SELECT *, round(100.0 * CAST(value AS DOUBLE) / CAST(sum(value) OVER (PARTITION BY p_brand) AS DOUBLE), 4) AS share_pct, row_number() OVER (PARTITION BY p_brand ORDER BY value DESC, l_suppkey) AS rank FROM v)
SELECT p_brand, s_name, CAST(value AS DOUBLE) AS value, share_pct, rank FROM s JOIN supplier ON l_suppkey = s_suppkey WHERE rank <= 10""")
def market_share_topn(t):
    line = awards(t).select("l_partkey", "l_suppkey", "value").join(t.part.select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    by = line.groupBy("p_brand", "l_suppkey").agg(F.sum("value").alias("exact")).withColumn("value", F.col("exact").cast("double"))
    total = by.groupBy("p_brand").agg(F.sum("exact").cast("double").alias("total"))
    top = r.join_null_safe(r.top_k(by, ["p_brand"], [F.desc("exact"), F.asc("l_suppkey")], 10), total, ["p_brand"])
    named = top.join(t.supplier.select("s_suppkey", "s_name"), F.col("l_suppkey") == F.col("s_suppkey"))
    return named.select("p_brand", "s_name", "value", F.round(100.0 * F.col("value") / F.col("total"), 4).alias("share_pct"), "rank")


@query("""SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1""")
def latest_per_key(t):
    return r.latest_per_key(t.events.select("user_id", "event_id", "event_type", "ts"), ["user_id"], [F.desc("ts"), F.desc("event_id")]).drop("ts")


@query("""WITH u AS (SELECT o_orderkey AS k, 0 AS source FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT DISTINCT l_orderkey, 1 FROM lineitem)
SELECT k, CAST(min(source) AS BIGINT) AS source FROM u GROUP BY k""")
def priority_union_dedup(t):
    first = t.orders.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("k"))
    return r.union_priority([first, t.lineitem.select(F.col("l_orderkey").alias("k")).distinct()], ["k"])


@query(f"""SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus <> 'F' AND o_orderdate >= TIMESTAMP '{AS_OF}' AND o_orderdate < TIMESTAMP '1999-07-01' AND o_totalprice BETWEEN 1000 AND 150000""")
def active_filter(t):
    day = F.col("o_orderdate")
    return t.orders.where((F.col("o_orderstatus") != "F") & (day >= F.lit(AS_OF).cast("timestamp")) & (day < F.lit("1999-07-01").cast("timestamp")) & F.col("o_totalprice").between(1000, 150000)).select("o_orderkey", "o_orderstatus")


@query("""SELECT o_orderkey, c_name, CAST(o_totalprice AS DOUBLE) AS price FROM orders JOIN customer ON o_custkey = c_custkey
WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND c_mktsegment = 'BUILDING' ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 20""")
def search_paged(t):
    found = t.orders.where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).join(t.customer.where("c_mktsegment = 'BUILDING'"), F.col("o_custkey") == F.col("c_custkey"))
    return r.page(found.select("o_orderkey", "c_name", F.col("o_totalprice").alias("price")), "price", "o_orderkey", 2, 20, ["price", "o_orderkey"])


@query("""SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)""")
def semi_exists(t):
    return t.customer.join(t.orders.where("o_totalprice > 200000"), F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("c_custkey")


@query("""SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 250000)""")
def anti_exists(t):
    return r.minus_by_key(t.customer, t.orders.where("o_totalprice > 250000"), F.col("o_custkey") == F.col("c_custkey")).select("c_custkey", "c_name")


@query("""SELECT p_partkey FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 45)""")
def in_subquery(t):
    return t.part.join(t.lineitem.where("l_quantity >= 45"), F.col("p_partkey") == F.col("l_partkey"), "left_semi").select("p_partkey")


@query("""SELECT o_orderkey, o_custkey FROM orders o WHERE o_orderdate = (SELECT max(o_orderdate) FROM orders i WHERE i.o_custkey = o.o_custkey)""")
def correlated_latest(t):
    last = t.orders.groupBy("o_custkey").agg(F.max("o_orderdate").alias("o_orderdate"))
    return t.orders.join(last, ["o_custkey", "o_orderdate"]).select("o_orderkey", "o_custkey")


@query("""SELECT o_orderkey, c_name, n_name, r_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey WHERE o_orderstatus = 'P'""")
def lookup_enrich(t):
    out = t.orders.where("o_orderstatus = 'P'").join(t.customer, F.col("o_custkey") == F.col("c_custkey"), "left")
    out = out.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"), "left").join(t.region, F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return out.select("o_orderkey", "c_name", "n_name", "r_name")


@query("""WITH b AS (SELECT DISTINCT substr(p_brand, 1, 7) AS prefix FROM part WHERE p_size > 45) SELECT prefix, count(*) AS n FROM part JOIN b ON substr(p_brand, 1, 7) = prefix GROUP BY prefix""")
def prefix_join(t):
    key = F.substring("p_brand", 1, 7)
    sectors = t.part.where("p_size > 45").select(key.alias("prefix")).distinct()
    return t.part.select(key.alias("prefix")).join(sectors, "prefix").groupBy("prefix").agg(n_rows().alias("n"))


@query("""SELECT s_suppkey, s_name, coalesce(n_lines, 0) AS n_lines, CAST(coalesce(value, 0) AS DOUBLE) AS value FROM supplier LEFT JOIN
(SELECT l_suppkey, count(*) AS n_lines, sum(CAST(l_extendedprice AS DECIMAL(15,2))) AS value FROM lineitem GROUP BY 1) ON l_suppkey = s_suppkey""")
def preagg_join(t):
    sums = awards(t).groupBy("l_suppkey").agg(n_rows().alias("n_lines"), F.sum("value").alias("value"))
    joined = t.supplier.join(sums, F.col("l_suppkey") == F.col("s_suppkey"), "left")
    return joined.select("s_suppkey", "s_name", F.coalesce("n_lines", F.lit(0)).cast("long").alias("n_lines"), F.coalesce(F.col("value").cast("double"), F.lit(0.0)).alias("value"))


@query("""SELECT o.o_orderkey, (SELECT max(i.o_orderkey) FROM orders i WHERE i.o_custkey = o.o_custkey AND i.o_orderstatus = 'F' AND i.o_orderdate = (SELECT max(j.o_orderdate) FROM orders j WHERE j.o_custkey = o.o_custkey AND j.o_orderstatus = 'F' AND j.o_orderdate <= o.o_orderdate)) AS predecessor FROM orders o WHERE o.o_orderstatus = 'O'""")
def asof_predecessor(t):
    done = t.orders.where("o_orderstatus = 'F'").groupBy("o_custkey", "o_orderdate").agg(F.max("o_orderkey").alias("predecessor"))
    return r.asof_join(t.orders.where("o_orderstatus = 'O'").select("o_orderkey", "o_custkey", "o_orderdate"), done, ["o_custkey"], "o_orderdate", ["predecessor"]).select("o_orderkey", "predecessor")


@query("""SELECT a.p_partkey AS a_key, b.p_partkey AS b_key, CAST(40 * CAST(a.p_brand = b.p_brand AS INT) + 25 * CAST(a.p_type = b.p_type AS INT) + 20 * CAST(a.p_size = b.p_size AS INT) AS BIGINT) AS score
FROM part a JOIN part b ON a.p_partkey <> b.p_partkey AND (a.p_brand = b.p_brand OR a.p_type = b.p_type OR a.p_size = b.p_size) WHERE a.p_partkey % 100 = 0""")
def disjunctive_similarity(t):
    """A search: its queries are the parts whose key is divisible by 100, against all parts; all partners are listed."""
    part = t.part.select("p_partkey", "p_brand", "p_type", "p_size")
    pairs = r.disjunctive_join(part.where("p_partkey % 100 = 0"), part, ["p_brand", "p_type", "p_size"], F.col("a.p_partkey") != F.col("b.p_partkey"))
    points = [w * c.eq_nullsafe_false(F.col(f"a_{x}"), F.col(f"b_{x}")).cast("int") for x, w in (("p_brand", 40), ("p_type", 25), ("p_size", 20))]
    return pairs.select(F.col("a_p_partkey").alias("a_key"), F.col("b_p_partkey").alias("b_key"), (points[0] + points[1] + points[2]).cast("long").alias("score"))


@query(None)  # in SQL every pair would be made first
def similar_parts(t):
    """The ten most similar partners of every part."""
    return r.similar_topk(t.part, "p_partkey", {"p_brand": 40, "p_type": 25, "p_size": 20}, 10)


@query("""SELECT c_custkey, o.o_orderkey FROM customer LEFT JOIN LATERAL (SELECT o_orderkey FROM orders WHERE o_custkey = c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 1) o ON true""")
def lateral_top1(t):
    best = r.latest_per_key(t.orders.select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")])
    return t.customer.select("c_custkey").join(best, F.col("o_custkey") == F.col("c_custkey"), "left").select("c_custkey", "o_orderkey")


@query("""SELECT o_orderkey, count(l_orderkey) AS n_lines FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1 HAVING count(l_orderkey) <> 4""")
def cross_source_validation(t):
    lines = t.lineitem.groupBy("l_orderkey").agg(n_rows().alias("n"))
    return t.orders.select("o_orderkey").join(lines, F.col("l_orderkey") == F.col("o_orderkey"), "left").select("o_orderkey", F.coalesce("n", F.lit(0)).cast("long").alias("n_lines")).where("n_lines <> 4")


@query("""WITH e AS (SELECT DISTINCT l_suppkey AS src, p_brand AS b FROM lineitem JOIN part ON l_partkey = p_partkey),
h1 AS (SELECT DISTINCT y.src AS node FROM e x JOIN e y ON x.b = y.b WHERE x.src = 1), n AS (SELECT 1 AS node, 0 AS hops UNION ALL SELECT node, 1 FROM h1)
SELECT CAST(node AS BIGINT) AS node, CAST(min(hops) AS BIGINT) AS hops FROM n GROUP BY 1""")
def teaming_hops(t):
    works = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_suppkey").alias("s"), F.concat(F.lit("b"), "p_brand").alias("b")).distinct()
    node = F.concat(F.lit("s"), F.col("s").cast("string"))
    edges = works.select(node.alias("src"), F.col("b").alias("dst")).unionByName(works.select(F.col("b").alias("src"), node.alias("dst")))
    seed = t.supplier.where("s_suppkey = 1").select(F.lit("s1").alias("node"))
    near = r.k_hop(edges, seed, 2).where("node like 's%'")
    return near.select(F.expr("cast(substring(node, 2) as long)").alias("node"), F.expr("hops div 2").alias("hops"))


@query("""SELECT l_suppkey, count(DISTINCT l_partkey) AS n_parts, count(*) FILTER (l_returnflag = 'R') AS n_returned, CAST(sum(CASE WHEN l_returnflag = 'R' THEN CAST(l_extendedprice AS DECIMAL(15,2)) ELSE 0 END) AS DOUBLE) AS returned FROM lineitem GROUP BY 1 HAVING count(*) >= 10""")
def conditional_counts(t):
    flag = F.col("l_returnflag") == "R"
    return awards(t).groupBy("l_suppkey").agg(F.countDistinct("l_partkey").alias("n_parts"), F.count_if(flag).alias("n_returned"), F.coalesce(F.sum(F.when(flag, F.col("value"))).cast("double"), F.lit(0.0)).alias("returned"), n_rows().alias("n")).where("n >= 10").drop("n")


@query("""SELECT o_orderpriority, o_orderstatus, CAST(grouping(o_orderpriority, o_orderstatus) AS BIGINT) AS level, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(15,2))) AS DOUBLE) AS total FROM orders GROUP BY ROLLUP (o_orderpriority, o_orderstatus)""")
def rollup_summary(t):
    return r.rollup_summary(t.orders.select("o_orderpriority", "o_orderstatus", c.money(F.col("o_totalprice")).alias("v")), ["o_orderpriority", "o_orderstatus"], [n_rows().alias("n"), F.sum("v").cast("double").alias("total")])


@query("""SELECT o_custkey, string_agg(DISTINCT o_orderpriority, ', ' ORDER BY o_orderpriority) AS listed FROM orders GROUP BY 1""")
def concat_distinct(t):
    return r.concat_distinct(t.orders, ["o_custkey"], "o_orderpriority")


@query("""WITH n AS (SELECT l_suppkey, p_brand, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY n DESC, p_brand) AS rank FROM n)
SELECT l_suppkey, string_agg(p_brand, ', ' ORDER BY rank) AS listed FROM k WHERE rank <= 5 GROUP BY 1""")
def concat_top5(t):
    return r.concat_top(t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select("l_suppkey", "p_brand"), ["l_suppkey"], "p_brand", 5)


@query("""SELECT CAST(year(o_orderdate) + CASE WHEN month(o_orderdate) >= 10 THEN 1 ELSE 0 END AS BIGINT) AS fiscal_year, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(15,2))) AS DOUBLE) AS total FROM orders GROUP BY 1""")
def fiscal_year_trend(t):
    return t.orders.groupBy(c.fiscal_year(F.col("o_orderdate")).alias("fiscal_year")).agg(n_rows().alias("n"), F.sum(c.money(F.col("o_totalprice"))).cast("double").alias("total"))


@query("""SELECT strftime(o_orderdate, '%Y-%m') AS month, CAST(sum(CAST(o_totalprice AS DECIMAL(15,2))) AS DOUBLE) AS spend FROM orders GROUP BY 1""")
def monthly_spend(t):
    return t.orders.groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.sum(c.money(F.col("o_totalprice"))).cast("double").alias("spend"))


@query("""SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.25), 4) AS p25, round(quantile_cont(l_extendedprice, 0.5), 4) AS p50, round(quantile_cont(l_extendedprice, 0.75), 4) AS p75, count(*) AS n FROM lineitem GROUP BY 1""")
def percentile_rates(t):
    return r.percentiles(t.lineitem, ["l_returnflag"], "l_extendedprice", [0.25, 0.5, 0.75])


@query("""WITH k AS (SELECT p_brand, l_extendedprice, row_number() OVER (PARTITION BY p_brand ORDER BY l_shipdate DESC, l_orderkey, l_linenumber) AS rn FROM lineitem JOIN part ON l_partkey = p_partkey)
SELECT p_brand, round(quantile_cont(l_extendedprice, 0.25), 4) AS p25, round(quantile_cont(l_extendedprice, 0.5), 4) AS p50, round(quantile_cont(l_extendedprice, 0.75), 4) AS p75, count(*) AS n FROM k WHERE rn <= 500 GROUP BY 1""")
def capped_percentile(t):
    line = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select("p_brand", "l_extendedprice", "l_shipdate", "l_orderkey", "l_linenumber")
    return r.capped_percentiles(line, ["p_brand"], [F.desc("l_shipdate"), F.asc("l_orderkey"), F.asc("l_linenumber")], 500, "l_extendedprice", [0.25, 0.5, 0.75])


@query("""WITH y AS (SELECT DISTINCT o_custkey, year(o_orderdate) AS y FROM orders) SELECT CAST(a.y AS BIGINT) AS year, count(*) AS n, count(b.o_custkey) AS stayed, round(100.0 * count(b.o_custkey) / count(*), 2) AS stayed_pct FROM y a LEFT JOIN y b ON b.o_custkey = a.o_custkey AND b.y = a.y + 1 GROUP BY 1""")
def retention_by_year(t):
    seen = t.orders.select("o_custkey", F.year("o_orderdate").cast("long").alias("year")).distinct()
    after = seen.select(F.col("o_custkey"), (F.col("year") - 1).alias("year"), F.lit(1).alias("again"))
    return seen.join(after, ["o_custkey", "year"], "left").groupBy("year").agg(n_rows().alias("n"), F.count("again").alias("stayed")).withColumn("stayed_pct", F.round(100.0 * F.col("stayed") / F.col("n"), 2))


@query("""WITH m AS (SELECT l_returnflag, year(l_shipdate) AS y, CAST(sum(CAST(l_extendedprice AS DECIMAL(15,2))) AS DOUBLE) / count(*) AS price FROM lineitem GROUP BY 1, 2)
SELECT l_returnflag, round(regr_slope(price, y), 3) AS slope, count(*) AS n, round(regr_intercept(price, y) + regr_slope(price, y) * 2003, 2) AS forecast FROM m GROUP BY 1""")
def regression_forecast(t):
    means = awards(t).groupBy("l_returnflag", F.year("l_shipdate").alias("y")).agg((F.sum("value").cast("double") / n_rows()).alias("price"))
    out = r.forecast(means, ["l_returnflag"], "y", "price", 2003)
    return out.select("l_returnflag", F.round("slope", 3).alias("slope"), "n", F.round("forecast", 2).alias("forecast"))


@query("""SELECT o_orderkey, previous, coalesce(o_orderpriority <> previous, false) AS changed FROM (SELECT *, lag(o_orderpriority) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS previous FROM orders)""")
def recompete_lag(t):
    return r.lag_compare(t.orders.select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority"), ["o_custkey"], [F.asc("o_orderdate"), F.asc("o_orderkey")], "o_orderpriority").select("o_orderkey", "previous", "changed")


@query("""WITH v AS (SELECT o_custkey, o_orderpriority, sum(CAST(o_totalprice AS DECIMAL(15,2))) AS v FROM orders GROUP BY 1, 2), k AS (SELECT *, sum(v) OVER (PARTITION BY o_custkey) AS total, row_number() OVER (PARTITION BY o_custkey ORDER BY v DESC, o_orderpriority) AS rn FROM v)
SELECT o_custkey, o_orderpriority, round(100.0 * CAST(v AS DOUBLE) / CAST(total AS DOUBLE), 3) AS share_pct FROM k WHERE rn = 1""")
def concentration_top1(t):
    by = t.orders.groupBy("o_custkey", "o_orderpriority").agg(F.sum(c.money(F.col("o_totalprice"))).alias("v"))
    total = by.groupBy("o_custkey").agg(F.sum("v").cast("double").alias("total"))
    top = r.join_null_safe(r.latest_per_key(by, ["o_custkey"], [F.desc("v"), F.asc("o_orderpriority")]), total, ["o_custkey"])
    return top.select("o_custkey", "o_orderpriority", F.round(100.0 * F.col("v").cast("double") / F.col("total"), 3).alias("share_pct"))


@query("""WITH v AS (SELECT o_orderstatus, CAST(year(o_orderdate) AS BIGINT) AS year, CAST(sum(CAST(o_totalprice AS DECIMAL(15,2))) AS DOUBLE) AS value FROM orders GROUP BY 1, 2)
SELECT a.o_orderstatus, a.year, a.value, b.value AS before, CASE WHEN b.value <> 0 THEN round(100.0 * (a.value - b.value) / b.value, 3) END AS change_pct FROM v a LEFT JOIN v b ON b.o_orderstatus = a.o_orderstatus AND b.year = a.year - 1""")
def yoy_change(t):
    by = t.orders.groupBy("o_orderstatus", F.year("o_orderdate").cast("long").alias("year")).agg(F.sum(c.money(F.col("o_totalprice"))).cast("double").alias("value"))
    return r.year_over_year(by, ["o_orderstatus"], "year", "value").withColumn("change_pct", c.safe_pct(F.col("value") - F.col("before"), F.col("before"), 3))


@query("""SELECT event_id, CAST(epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS BIGINT) AS elapsed_us FROM events""")
def status_elapsed(t):
    ts = t.events.select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    return r.lag_compare(ts, ["user_id"], [F.asc("us"), F.asc("event_id")], "us").select("event_id", (F.col("us") - F.col("previous")).alias("elapsed_us"))


@query("""SELECT a.user_id, a.event_id AS from_id, min(b.event_id) AS to_id FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'signup' AND b.event_type = 'purchase' AND b.ts > a.ts GROUP BY 1, 2""")
def pairs_lifecycle(t):
    """Each signup with the least later purchase of its user: one sort by time and a running minimum, no pairs."""
    rows = t.events.where("event_type in ('signup', 'purchase')").select("user_id", "event_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    later = Window.partitionBy("user_id").orderBy(F.desc("us")).rangeBetween(Window.unboundedPreceding, -1)
    least = F.min(F.when(F.col("event_type") == "purchase", F.col("event_id"))).over(later)
    return rows.withColumn("to_id", least).where("event_type = 'signup' and to_id is not null").select("user_id", F.col("event_id").alias("from_id"), "to_id")


@query("""SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier""")
def set_union_distinct(t):
    return t.customer.select(F.col("c_nationkey").alias("k")).union(t.supplier.select("s_nationkey")).distinct()


@query("""SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal < 0""")
def set_difference(t):
    return t.nation.select(F.col("n_nationkey").alias("k")).subtract(t.supplier.where("s_acctbal < 0").select("s_nationkey"))


@query("""SELECT 'lang' AS column_name, count(*) AS rows, count(lang) AS filled, round(100.0 * count(lang) / count(*), 2) AS filled_pct FROM documents UNION ALL SELECT 'source', count(*), count(source), round(100.0 * count(source) / count(*), 2) FROM documents""")
def completeness_profile(t):
    return r.completeness(t.documents, ["lang", "source"])


@query("""SELECT page_id, lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]+)', 1)) AS host FROM pages""")
def url_hosts(t):
    return t.pages.select("page_id", c.url_host(F.col("url")).alias("host"))


@query("""SELECT p_partkey, upper(regexp_replace(p_brand, '[^A-Za-z0-9]', '', 'g')) AS brand_id FROM part""")
def identifier_normalise(t):
    return t.part.select("p_partkey", c.norm_id(F.col("p_brand")).alias("brand_id"))


@query("""SELECT o_orderkey, sha256(concat_ws('|', CAST(o_custkey AS VARCHAR), coalesce(o_orderpriority, ''), coalesce(o_orderstatus, ''))) AS record_hash FROM orders""")
def record_hash(t):
    return t.orders.select("o_orderkey", c.record_hash(["o_orderstatus", "o_custkey", "o_orderpriority"]).alias("record_hash"))


def changed_customers(t: Tables) -> DataFrame:
    """A second snapshot of all customers: those of high balance have another segment, those of some nations new keys."""
    moved = t.customer.withColumn("c_mktsegment", F.expr("if(c_acctbal > 8000, 'MOVED', c_mktsegment)"))
    return moved.withColumn("c_custkey", F.expr("if(c_nationkey < 4, c_custkey + 1000000000, c_custkey)"))


CHANGED = "(SELECT CASE WHEN c_nationkey < 4 THEN c_custkey + 1000000000 ELSE c_custkey END AS c_custkey, c_name, c_nationkey, c_acctbal, CASE WHEN c_acctbal > 8000 THEN 'MOVED' ELSE c_mktsegment END AS c_mktsegment FROM customer)"


@query(f"""SELECT n.c_custkey, CASE WHEN b.c_custkey IS NULL THEN 'insert' WHEN b.c_name = n.c_name AND b.c_mktsegment = n.c_mktsegment THEN 'unchanged' ELSE 'update' END AS action FROM {CHANGED} n LEFT JOIN customer b ON b.c_custkey = n.c_custkey""")
def change_classify(t):
    return ch.classify(t.customer, changed_customers(t), ["c_custkey"], ["c_name", "c_mktsegment"]).select("c_custkey", "action")


@query(f"""SELECT n.c_custkey, 'c_mktsegment' AS field, b.c_mktsegment AS old_value, n.c_mktsegment AS new_value FROM {CHANGED} n JOIN customer b ON b.c_custkey = n.c_custkey WHERE b.c_mktsegment IS DISTINCT FROM n.c_mktsegment""")
def field_diff(t):
    return ch.field_diff(t.customer, changed_customers(t), ["c_custkey"], ["c_name", "c_mktsegment"])


@query(f"""SELECT c_custkey, c_mktsegment FROM {CHANGED} UNION ALL SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM {CHANGED})""")
def merge_upsert(t):
    return ch.merge_upsert(t.customer, changed_customers(t), ["c_custkey"]).select("c_custkey", "c_mktsegment")


@query(f"""SELECT c_custkey, c_mktsegment FROM customer UNION ALL SELECT c_custkey, c_mktsegment FROM {CHANGED} WHERE c_custkey NOT IN (SELECT c_custkey FROM customer)""")
def insert_ignore(t):
    return ch.insert_ignore(t.customer, changed_customers(t), ["c_custkey"]).select("c_custkey", "c_mktsegment")


@query(f"""WITH d AS (SELECT *, CASE WHEN c_acctbal < 0 THEN 'D' ELSE 'C' END AS flag FROM {CHANGED})
SELECT c.c_custkey, c.c_mktsegment, d.c_custkey IS NOT NULL AS deleted FROM customer c LEFT JOIN d ON d.c_custkey = c.c_custkey WHERE d.flag IS NULL OR d.flag = 'D' UNION ALL SELECT c_custkey, c_mktsegment, false FROM d WHERE flag <> 'D'""")
def delta_soft_delete(t):
    delta = changed_customers(t).withColumn("flag", F.expr("if(c_acctbal < 0, 'D', 'C')"))
    return ch.apply_delta(t.customer, delta, ["c_custkey"], "flag").select("c_custkey", "c_mktsegment", "deleted")


@query("""SELECT 'positive_balance' AS rule, count(*) FILTER (NOT coalesce(c_acctbal >= 0, false)) AS failed FROM customer UNION ALL SELECT 'known_segment', count(*) FILTER (NOT coalesce(c_mktsegment IN ('BUILDING', 'MACHINERY'), false)) FROM customer""")
def quality_counts(t):
    return ch.quality_counts(t.customer, {"positive_balance": "c_acctbal >= 0", "known_segment": "c_mktsegment in ('BUILDING', 'MACHINERY')"})


@query("""SELECT doc_id, min(doc_id) OVER (PARTITION BY sha256(text)) AS canonical, doc_id = min(doc_id) OVER (PARTITION BY sha256(text)) AS is_canonical FROM documents""")
def text_exact_dedup(t):
    return ch.hash_dedup(t.documents, "doc_id", "text")


@query("""SELECT doc_id, regexp_matches(lower(text), 'password|secret|token|license') AS flagged FROM documents""")
def keyword_flag(t):
    return t.documents.select("doc_id", F.lower("text").rlike("password|secret|token|license").alias("flagged"))


@query("""SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '[A-Za-z0-9._-]+@[A-Za-z0-9-]+[.][a-z]+'))) AS identifier FROM documents""")
def identifier_extract(t):
    found = F.array_distinct(F.regexp_extract_all("text", F.lit(r"[A-Za-z0-9._-]+@[A-Za-z0-9-]+[.][a-z]+"), F.lit(0)))
    return t.documents.select("doc_id", F.explode(found).alias("identifier"))


@query("""SELECT source, CAST(max(quality) AS BIGINT) AS any_good, CAST(max(toxic) AS BIGINT) AS any_toxic, max_by(d.doc_id, n_chars * 100000 + d.doc_id) AS longest FROM documents d JOIN labels l ON l.doc_id = d.doc_id GROUP BY 1""")
def wins_and_longest(t):
    joined = t.documents.select("doc_id", "source", "n_chars").join(t.labels, "doc_id")
    return joined.groupBy("source").agg(F.max("quality").cast("long").alias("any_good"), F.max("toxic").cast("long").alias("any_toxic"), F.max_by("doc_id", F.struct("n_chars", "doc_id")).alias("longest"))


@query("""WITH s AS (SELECT user_id, epoch_us(ts) AS us, event_id, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS d FROM events),
i AS (SELECT *, sum(CASE WHEN d IS NULL OR d > 43200000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY us, event_id) AS island FROM s)
SELECT user_id, CAST(island AS BIGINT) AS island, min(us) AS first_at, max(us) AS last_at, count(*) AS n FROM i GROUP BY 1, 2""")
def passage_merge(t):
    at = t.events.select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    return r.islands(at, ["user_id"], "at", 43_200_000_000, ["event_id"])


@query("""SELECT event_type, count(*) AS n, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS total FROM events GROUP BY 1""")
def json_totals(t):
    return t.events.groupBy("event_type").agg(n_rows().alias("n"), F.sum(c.json_number(F.col("props"), "k")).alias("total"))


@query(f"""SELECT o_orderstatus, count(*) AS n, count(*) FILTER (o_orderdate < TIMESTAMP '{AS_OF}' - INTERVAL 365 DAY) AS stale, CAST(sum(CAST(o_totalprice AS DECIMAL(15,2))) AS DOUBLE) AS value FROM orders GROUP BY 1""")
def pipeline_funnel(t):
    old = F.col("o_orderdate") < F.expr(f"timestamp '{AS_OF}' - interval 365 days")
    return t.orders.groupBy("o_orderstatus").agg(n_rows().alias("n"), F.count_if(old).alias("stale"), F.sum(c.money(F.col("o_totalprice"))).cast("double").alias("value"))


@query("""WITH g AS (SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN 10 WHEN o_orderpriority = '2-HIGH' THEN 7 WHEN o_orderpriority IS NULL THEN 0 ELSE 3 END + CASE WHEN o_totalprice >= 200000 THEN 10 WHEN o_totalprice >= 100000 THEN 8 WHEN o_totalprice >= 50000 THEN 5 ELSE 2 END AS score FROM orders)
SELECT o_orderkey, CAST(score AS BIGINT) AS score, CASE WHEN score >= 17 THEN 'Go' WHEN score >= 10 THEN 'Review' ELSE 'NoGo' END AS verdict FROM g""")
def go_no_go(t):
    prio = F.when(F.col("o_orderpriority") == "1-URGENT", 10).when(F.col("o_orderpriority") == "2-HIGH", 7).when(F.col("o_orderpriority").isNull(), 0).otherwise(3)
    value = F.when(F.col("o_totalprice") >= 200000, 10).when(F.col("o_totalprice") >= 100000, 8).when(F.col("o_totalprice") >= 50000, 5).otherwise(2)
    out = t.orders.select("o_orderkey", (prio + value).cast("long").alias("score"))
    return out.withColumn("verdict", c.bucket(F.col("score"), [(17, "Go"), (10, "Review")], "NoGo"))


@query("""WITH f AS (SELECT s_suppkey, least(100.0, count(l_orderkey) / 10.0) AS experience, CASE WHEN s_acctbal >= 0 THEN 100.0 * exp(-0.5 * s_acctbal / 10000.0) END AS fit FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey GROUP BY s_suppkey, s_acctbal)
SELECT s_suppkey, round((experience * 0.6 + coalesce(fit * 0.4, 0)) / (0.6 + CASE WHEN fit IS NULL THEN 0 ELSE 0.4 END), 2) AS score FROM f""")
def partner_score(t):
    lines = t.lineitem.groupBy("l_suppkey").agg(n_rows().alias("n"))
    f = t.supplier.join(lines, F.col("l_suppkey") == F.col("s_suppkey"), "left").select(
        "s_suppkey", F.least(F.lit(100.0), F.coalesce("n", F.lit(0)) / 10.0).alias("experience"), F.when(F.col("s_acctbal") >= 0, 100.0 * F.exp(-0.5 * F.col("s_acctbal") / 10000.0)).alias("fit"),
    )
    return f.select("s_suppkey", ch.weighted_score([("experience", 0.6), ("fit", 0.4)]).alias("score"))


@query("""SELECT p_partkey, round(100.0 * (SELECT count(*) FROM part q WHERE q.p_retailprice > p.p_retailprice) / (SELECT count(*) FROM part), 4) AS pct_greater FROM part p""")
def percentile_by_greater(t):
    return r.percentile_by_greater(t.part.select("p_partkey", "p_retailprice"), "p_retailprice").select("p_partkey", "pct_greater")
