"""More named views and the two marts over the test tables, registered in the catalogue with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tenderlake.functions import columns as c
from tenderlake.operators import relational as r
from tenderlake.plans.catalogue import AS_OF, awards, n_rows, query

PRICE = "CAST(l_extendedprice AS DECIMAL(15,2))"
TOTAL = "CAST(o_totalprice AS DECIMAL(15,2))"
NOW = f"TIMESTAMP '{AS_OF}'"


def now():
    return F.lit(AS_OF).cast("timestamp")


def order_value():
    return c.money(F.col("o_totalprice"))


def total(value):
    return F.sum(value).cast("double")


@query("""SELECT doc_id, source, lang FROM (SELECT *, row_number() OVER (PARTITION BY coalesce(nullif(source, ''), CAST(doc_id AS VARCHAR)) ORDER BY n_chars DESC, doc_id DESC) AS rn FROM documents) WHERE rn = 1""")
def view_opportunity_latest(t):
    """The latest row of each key; a row without a key stands for itself."""
    keyed = t.documents.select("doc_id", "source", "lang", "n_chars").withColumn("key", F.coalesce(F.nullif("source", F.lit("")), F.col("doc_id").cast("string")))
    return r.latest_per_key(keyed, ["key"], [F.desc("n_chars"), F.desc("doc_id")]).select("doc_id", "source", "lang")


@query(f"""SELECT o_orderkey, c_name, n_name, r_name, s.n_small FROM orders JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey LEFT JOIN (SELECT s_nationkey, count(*) AS n_small FROM supplier GROUP BY 1) s ON s.s_nationkey = c_nationkey
    WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderdate >= {NOW} AND o_orderstatus <> 'F'""")
def view_target_opportunities(t):
    rows = t.orders.where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH") & (F.col("o_orderdate") >= now()) & (F.col("o_orderstatus") != "F"))
    out = rows.join(t.customer, F.col("c_custkey") == F.col("o_custkey")).join(t.nation, F.col("n_nationkey") == F.col("c_nationkey"), "left").join(t.region, F.col("r_regionkey") == F.col("n_regionkey"), "left")
    small = t.supplier.groupBy(F.col("s_nationkey").alias("c_nationkey")).agg(n_rows().alias("n_small"))
    return out.join(small, "c_nationkey", "left").select("o_orderkey", "c_name", "n_name", "r_name", "n_small")


@query(f"""SELECT s_suppkey, s_name, types, n_awards, value FROM supplier LEFT JOIN (SELECT l_suppkey, string_agg(DISTINCT p_type, ', ' ORDER BY p_type) AS types FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1) a ON a.l_suppkey = s_suppkey LEFT JOIN (SELECT l_suppkey, count(*) AS n_awards, CAST(sum({PRICE}) AS DOUBLE) AS value FROM lineitem GROUP BY 1) b ON b.l_suppkey = s_suppkey""")
def view_competitor_analysis(t):
    named = t.lineitem.join(t.part, F.col("p_partkey") == F.col("l_partkey")).select(F.col("l_suppkey").alias("s_suppkey"), "p_type")
    types = r.concat_distinct(named, ["s_suppkey"], "p_type").withColumnRenamed("listed", "types")
    sums = awards(t).groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(n_rows().alias("n_awards"), total("value").alias("value"))
    return t.supplier.select("s_suppkey", "s_name").join(types, "s_suppkey", "left").join(sums, "s_suppkey", "left")


@query(f"""SELECT o.o_orderkey, date_diff('day', CAST(o_orderdate AS DATE), DATE '{AS_OF}') AS days_open, coalesce(nullif(c_mktsegment, ''), 'none') AS segment, l.n AS n_lines FROM orders o JOIN customer ON c_custkey = o_custkey LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_linenumber = 1 GROUP BY 1) l ON l.l_orderkey = o.o_orderkey""")
def view_procurement_intelligence(t):
    base = t.lineitem.where("l_linenumber = 1").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(n_rows().alias("n_lines"))
    out = t.orders.join(t.customer, F.col("c_custkey") == F.col("o_custkey")).join(base, "o_orderkey", "left")
    days = F.date_diff(F.lit(AS_OF).cast("date"), F.col("o_orderdate").cast("date")).cast("long")
    return out.select("o_orderkey", days.alias("days_open"), F.coalesce(F.nullif("c_mktsegment", F.lit("")), F.lit("none")).alias("segment"), "n_lines")


@query(f"""SELECT s_suppkey, n, value, last_at FROM supplier JOIN (SELECT l_suppkey, count(DISTINCT l_orderkey) AS n, CAST(sum({PRICE}) AS DOUBLE) AS value, max(l_shipdate) AS last_at FROM lineitem WHERE l_shipdate >= {NOW} - INTERVAL 1825 DAY GROUP BY 1) a ON a.l_suppkey = s_suppkey""")
def view_incumbent_profile(t):
    recent = awards(t).where(F.col("l_shipdate") >= now() - F.expr("interval 1825 days"))
    sums = recent.groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count_distinct("l_orderkey").alias("n"), total("value").alias("value"), F.max("l_shipdate").alias("last_at"))
    return t.supplier.select("s_suppkey").join(sums, "s_suppkey")


@query(f"""SELECT CAST(year(o_orderdate) + CASE WHEN month(o_orderdate) >= 10 THEN 1 ELSE 0 END AS BIGINT) AS fiscal_year, o_orderpriority, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS awarded, CAST(sum({TOTAL}) AS DOUBLE) AS value FROM orders GROUP BY 1, 2""")
def view_set_aside_trend(t):
    return t.orders.groupBy(c.fiscal_year(F.col("o_orderdate")).alias("fiscal_year"), "o_orderpriority").agg(n_rows().alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("awarded"), total(order_value()).alias("value"))


@query("""SELECT l_returnflag, p_type, count(*) AS n, min(p_retailprice) AS lowest, max(p_retailprice) AS highest, round(avg(p_retailprice), 4) AS mean FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2""")
def view_rate_heatmap(t):
    rows = t.lineitem.join(t.part, F.col("p_partkey") == F.col("l_partkey"))
    return rows.groupBy("l_returnflag", "p_type").agg(n_rows().alias("n"), F.min("p_retailprice").alias("lowest"), F.max("p_retailprice").alias("highest"), F.round(F.avg("p_retailprice"), 4).alias("mean"))


@query(f"""SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem WHERE l_extendedprice > 0 AND l_quantity IS NOT NULL AND l_shipdate >= {NOW} - INTERVAL 1825 DAY AND l_returnflag <> 'R'""")
def view_comparable_prices(t):
    keep = (F.col("l_extendedprice") > 0) & F.col("l_quantity").isNotNull() & (F.col("l_shipdate") >= now() - F.expr("interval 1825 days")) & (F.col("l_returnflag") != "R")
    return t.lineitem.where(keep).select("l_orderkey", "l_linenumber", "l_extendedprice")


@query(f"""SELECT p_brand, l_returnflag, count(*) AS n, count(DISTINCT l_suppkey) AS vendors, CAST(sum({PRICE}) AS DOUBLE) AS value, min(l_extendedprice) AS lowest, max(l_extendedprice) AS highest FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2""")
def view_sub_cost_benchmark(t):
    rows = awards(t).join(t.part.select("p_partkey", "p_brand"), F.col("p_partkey") == F.col("l_partkey"))
    return rows.groupBy("p_brand", "l_returnflag").agg(n_rows().alias("n"), F.count_distinct("l_suppkey").alias("vendors"), total("value").alias("value"), F.min("l_extendedprice").alias("lowest"), F.max("l_extendedprice").alias("highest"))


@query("""SELECT p.p_type, p.p_partkey FROM part p JOIN (SELECT p_type, max(p_size) AS m FROM part GROUP BY 1) x ON x.p_type = p.p_type AND x.m = p.p_size""")
def view_code_latest(t):
    """Ties stay: every row of a code's last version."""
    last = t.part.groupBy("p_type").agg(F.max("p_size").alias("p_size"))
    return t.part.join(last, ["p_type", "p_size"]).select("p_type", "p_partkey")


@query(f"""WITH u AS (SELECT o_orderkey AS k, o_orderdate + INTERVAL 450 DAY AS ends, o_totalprice AS value, 0 AS source FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT l_orderkey, max(l_shipdate) + INTERVAL 450 DAY, max(l_extendedprice), 1 FROM lineitem GROUP BY 1), k AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY source) AS rn FROM u)
    SELECT k, value, CAST(source AS BIGINT) AS source, date_diff('day', DATE '{AS_OF}', CAST(ends AS DATE)) AS days_left FROM k WHERE rn = 1 AND value >= 10000 AND ends >= {NOW} + INTERVAL 365 DAY AND ends < {NOW} + INTERVAL 548 DAY""")
def view_recompete_candidate(t):
    later = F.expr("interval 450 days")
    a = t.orders.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("k"), (F.col("o_orderdate") + later).alias("ends"), F.col("o_totalprice").alias("value"))
    b = t.lineitem.groupBy(F.col("l_orderkey").alias("k")).agg((F.max("l_shipdate") + later).alias("ends"), F.max("l_extendedprice").alias("value"))
    soon = (F.col("value") >= 10000) & (F.col("ends") >= now() + F.expr("interval 365 days")) & (F.col("ends") < now() + F.expr("interval 548 days"))
    days = F.date_diff(F.col("ends").cast("date"), F.lit(AS_OF).cast("date")).cast("long")
    return r.union_priority([a, b], ["k"]).where(soon).select("k", "value", "source", days.alias("days_left"))


@query(f"""WITH b AS (SELECT o_custkey, l_suppkey, count(*) AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, l_suppkey) AS rank FROM b), top AS (SELECT o_custkey, string_agg(CAST(l_suppkey AS VARCHAR), ', ' ORDER BY rank) AS vendors FROM k WHERE rank <= 5 GROUP BY 1)
    SELECT c_custkey, n, value, urgent_pct, vendors FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, CAST(sum({TOTAL}) AS DOUBLE) AS value, round(100.0 * count(*) FILTER (o_orderpriority = '1-URGENT') / count(*), 1) AS urgent_pct FROM orders GROUP BY 1) a ON a.o_custkey = c_custkey LEFT JOIN top ON top.o_custkey = c_custkey""")
def view_contracting_office_profile(t):
    sums = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(n_rows().alias("n"), total(order_value()).alias("value"), c.safe_pct(F.count_if(F.col("o_orderpriority") == "1-URGENT"), n_rows()).alias("urgent_pct"))
    rows = t.lineitem.select("l_orderkey", "l_suppkey").join(t.orders.select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey")), "l_orderkey")
    counts = rows.groupBy("c_custkey", "l_suppkey").agg(n_rows().alias("k"))
    best = r.top_k(counts, ["c_custkey"], [F.desc("k"), F.asc("l_suppkey")], 5)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("rank", "l_suppkey"))), lambda x: x["l_suppkey"].cast("string"))
    top = best.groupBy("c_custkey").agg(F.array_join(listed, ", ").alias("vendors"))
    return t.customer.select("c_custkey").join(sums, "c_custkey", "left").join(top, "c_custkey", "left")


@query("""SELECT a AS src, b AS dst, count(*) AS n FROM (SELECT l_suppkey AS a, o_custkey AS b FROM lineitem JOIN orders ON o_orderkey = l_orderkey UNION ALL SELECT o_custkey, l_suppkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey) GROUP BY 1, 2""")
def view_teaming_network(t):
    """Edges in both directions, which have equal counts: counted by the pair without its direction, then mirrored; no edge is aggregated twice."""
    rows = t.lineitem.join(t.orders, F.col("o_orderkey") == F.col("l_orderkey")).select("l_suppkey", "o_custkey")
    turn = F.col("l_suppkey").isNotNull() & F.coalesce(F.col("l_suppkey") > F.col("o_custkey"), F.lit(True))  # null is the least
    pair = rows.groupBy(F.when(turn, F.col("o_custkey")).otherwise(F.col("l_suppkey")).alias("p"), F.when(turn, F.col("l_suppkey")).otherwise(F.col("o_custkey")).alias("q")).agg(n_rows().alias("n"))
    loop = F.col("p").eqNullSafe(F.col("q"))
    edge = lambda src, dst, n: F.struct(F.col(src).alias("src"), F.col(dst).alias("dst"), n.alias("n"))
    ways = F.when(loop, F.array(edge("p", "q", 2 * F.col("n")))).otherwise(F.array(edge("p", "q", F.col("n")), edge("q", "p", F.col("n"))))
    return pair.select(F.inline(ways))


@query(f"""SELECT o_orderkey, c_name, strftime(o_orderdate, '%Y-%m-%d') AS due, date_diff('day', DATE '{AS_OF}', CAST(o_orderdate AS DATE)) AS days_left FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus IN ('O', 'P') AND o_orderdate >= {NOW} AND o_orderdate < {NOW} + INTERVAL 90 DAY""")
def view_pipeline_calendar(t):
    due = F.col("o_orderdate").cast("date")
    rows = t.orders.where(F.col("o_orderstatus").isin("O", "P") & (F.col("o_orderdate") >= now()) & (F.col("o_orderdate") < now() + F.expr("interval 90 days")))
    return rows.join(t.customer, F.col("c_custkey") == F.col("o_custkey")).select("o_orderkey", "c_name", due.cast("string").alias("due"), F.date_diff(due, F.lit(AS_OF).cast("date")).cast("long").alias("days_left"))


@query(f"""SELECT user_id, max(ts) AS last_at, date_diff('day', CAST(max(ts) AS DATE), DATE '2024-02-10') AS days FROM events GROUP BY 1 HAVING date_diff('day', CAST(max(ts) AS DATE), DATE '2024-02-10') >= 11""")
def view_stale_prospect(t):
    last = t.events.groupBy("user_id").agg(F.max("ts").alias("last_at"))
    return last.withColumn("days", F.date_diff(F.lit("2024-02-10").cast("date"), F.col("last_at").cast("date")).cast("long")).where("days >= 11")


@query(f"""SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n, CAST(sum({TOTAL}) AS DOUBLE) AS value, CAST(sum({TOTAL} * CASE o_orderstatus WHEN 'F' THEN 1.00 WHEN 'P' THEN 0.50 ELSE 0.25 END) AS DOUBLE) AS weighted FROM orders GROUP BY 1""")
def view_revenue_forecast(t):
    chance = F.when(F.col("o_orderstatus") == "F", F.lit("1.00")).when(F.col("o_orderstatus") == "P", F.lit("0.50")).otherwise(F.lit("0.25")).cast("decimal(3,2)")
    return t.orders.groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(n_rows().alias("n"), total(order_value()).alias("value"), total(order_value() * chance).alias("weighted"))


@query("""SELECT d.doc_id, CAST((text IS NOT NULL)::INT + (lang IS NOT NULL)::INT + (source IS NOT NULL)::INT + (quality IS NOT NULL)::INT AS BIGINT) AS filled, concat_ws(', ', CASE WHEN text IS NULL THEN 'text' END, CASE WHEN lang IS NULL THEN 'lang' END, CASE WHEN source IS NULL THEN 'source' END, CASE WHEN quality IS NULL THEN 'quality' END) AS missing FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""")
def view_profile_completeness(t):
    fields = ["text", "lang", "source", "quality"]
    joined = t.documents.select("doc_id", "text", "lang", "source").join(t.labels.select("doc_id", "quality"), "doc_id", "left")
    filled = sum((F.col(x).isNotNull().cast("long") for x in fields), F.lit(0).cast("long"))
    return joined.select("doc_id", filled.alias("filled"), F.concat_ws(", ", *[F.when(F.col(x).isNull(), x) for x in fields]).alias("missing"))


@query(f"""WITH u AS (SELECT o_orderkey AS k, 'order' AS kind, o_orderdate AS ends FROM orders UNION SELECT l_orderkey, 'line', l_shipdate FROM lineitem)
    SELECT k, kind, ends, CASE WHEN ends < {NOW} THEN 'EXPIRED' WHEN ends < {NOW} + INTERVAL 30 DAY THEN 'CRITICAL' WHEN ends < {NOW} + INTERVAL 90 DAY THEN 'WARNING' ELSE 'OK' END AS level FROM u WHERE ends < {NOW} + INTERVAL 90 DAY""")
def view_expiration_alert(t):
    within = lambda days: F.col("ends") < now() + F.expr(f"interval {days} days")
    a = t.orders.select(F.col("o_orderkey").alias("k"), F.lit("order").alias("kind"), F.col("o_orderdate").alias("ends"))
    b = t.lineitem.select(F.col("l_orderkey").alias("k"), F.lit("line").alias("kind"), F.col("l_shipdate").alias("ends"))
    rows = a.unionByName(b).where(within(90)).distinct()
    return rows.withColumn("level", F.when(within(0), "EXPIRED").when(within(30), "CRITICAL").otherwise("WARNING"))


@query("""SELECT c_custkey, c_mktsegment, round(100.0 * c_acctbal / CASE c_mktsegment WHEN 'BUILDING' THEN 10000 WHEN 'MACHINERY' THEN 9500 ELSE 9900 END, 1) AS used_pct FROM customer WHERE 100.0 * c_acctbal / CASE c_mktsegment WHEN 'BUILDING' THEN 10000 WHEN 'MACHINERY' THEN 9500 ELSE 9900 END >= 80""")
def view_size_standard_monitor(t):
    limit = F.when(F.col("c_mktsegment") == "BUILDING", 10000).when(F.col("c_mktsegment") == "MACHINERY", 9500).otherwise(9900)
    used = 100.0 * F.col("c_acctbal") / limit
    return t.customer.where(used >= 80).select("c_custkey", "c_mktsegment", F.round(used, 1).alias("used_pct"))


@query("""WITH w AS (SELECT p_partkey, 35.0 * CAST(p_brand = 'Brand#5' AS INT) + 25.0 * CAST(p_type = 'ECONOMY' AS INT) + 20.0 * CASE WHEN p_retailprice > 0 THEN least(p_retailprice, 1000.0) / greatest(p_retailprice, 1000.0) ELSE 0 END + 20.0 * CASE WHEN p_size <= 10 THEN 1.0 WHEN p_size <= 30 THEN 0.5 ELSE 0 END AS score FROM part)
    SELECT p_partkey, round(score, 4) AS score FROM w WHERE score >= 20""")
def view_past_performance_relevance(t):
    same = lambda x, v, w: w * F.coalesce((F.col(x) == v).cast("int"), F.lit(0))
    near = 20.0 * F.coalesce(c.value_ratio(F.col("p_retailprice"), F.lit(1000.0)), F.lit(0.0))
    recent = 20.0 * F.when(F.col("p_size") <= 10, 1.0).when(F.col("p_size") <= 30, 0.5).otherwise(0.0)
    out = t.part.withColumn("score", same("p_brand", "Brand#5", 35.0) + same("p_type", "ECONOMY", 25.0) + near + recent).where("score >= 20")
    return out.select("p_partkey", F.round("score", 4).alias("score"))


@query(f"""SELECT c_custkey, o.o_orderkey AS latest, a.n, a.value FROM customer LEFT JOIN LATERAL (SELECT o_orderkey FROM orders WHERE o_custkey = c_custkey ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1) o ON true LEFT JOIN LATERAL (SELECT count(*) AS n, CAST(sum({TOTAL}) AS DOUBLE) AS value FROM orders WHERE o_custkey = c_custkey) a ON true""")
def view_prospect_competitor_summary(t):
    """Both lateral lookups in one aggregate."""
    sums = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("latest"), n_rows().alias("n"), total(order_value()).alias("value"))
    return t.customer.select("c_custkey").join(sums, "c_custkey", "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))


@query(f"""SELECT o_orderpriority, o_orderstatus, count(*) AS n, count(DISTINCT o_custkey) AS offices, CAST(sum({TOTAL}) AS DOUBLE) AS value FROM orders GROUP BY ROLLUP (o_orderpriority, o_orderstatus) HAVING grouping(o_orderpriority) = 0 AND o_orderpriority IS NOT NULL AND NOT (grouping(o_orderstatus) = 0 AND o_orderstatus IS NULL)""")
def mart_award_summary(t):
    """Subtotals by category; the grand total and groups without a key are left out."""
    level = [F.grouping(x).alias(f"_{x}") for x in ("o_orderpriority", "o_orderstatus")]
    out = t.orders.rollup("o_orderpriority", "o_orderstatus").agg(n_rows().alias("n"), F.count_distinct("o_custkey").alias("offices"), total(order_value()).alias("value"), *level)
    return out.where("_o_orderpriority = 0 and o_orderpriority is not null and not (_o_orderstatus = 0 and o_orderstatus is null)").drop("_o_orderpriority", "_o_orderstatus")


@query("""SELECT p_type, l_returnflag, count(*) AS n, round(avg(p_retailprice), 4) AS mean, round(quantile_cont(p_retailprice, 0.25), 4) AS p25, round(quantile_cont(p_retailprice, 0.5), 4) AS p50, round(quantile_cont(p_retailprice, 0.75), 4) AS p75 FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_retailprice > 0 GROUP BY 1, 2""")
def mart_labor_rate_summary(t):
    rows = t.lineitem.join(t.part, F.col("p_partkey") == F.col("l_partkey")).where("p_retailprice > 0").select("p_type", "l_returnflag", "p_retailprice")
    mean = rows.groupBy("p_type", "l_returnflag").agg(F.round(F.avg("p_retailprice"), 4).alias("mean"))
    return r.percentiles(rows, ["p_type", "l_returnflag"], "p_retailprice", [0.25, 0.5, 0.75]).join(mean, ["p_type", "l_returnflag"])
