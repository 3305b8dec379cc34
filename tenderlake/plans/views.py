"""Named views, scores and text queries over the test tables, registered in the catalogue with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tenderlake.functions import columns as c
from tenderlake.operators import relational as r
from tenderlake.operators import scoring as s
from tenderlake.operators import text as tx
from tenderlake.plans.catalogue import AS_OF, awards, n_rows, query

DEC = "CAST(l_extendedprice AS DECIMAL(15,2))"


def total(column: str):
    return F.sum(column).cast("double")


@query(f"""SELECT o_custkey AS office, l_suppkey AS vendor, count(*) AS n, CAST(sum({DEC}) AS DOUBLE) AS value, min(o_orderdate) AS first_at, max(o_orderdate) AS last_at, string_agg(DISTINCT l_returnflag, ', ' ORDER BY l_returnflag) AS flags
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2""")
def view_prime_sub_relationship(t):
    rows = awards(t).join(t.orders.select("o_orderkey", F.col("o_custkey").alias("office"), "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    flags = F.array_join(F.array_sort(F.collect_set("l_returnflag")), ", ").alias("flags")
    return rows.groupBy("office", F.col("l_suppkey").alias("vendor")).agg(n_rows().alias("n"), total("value").alias("value"), F.min("o_orderdate").alias("first_at"), F.max("o_orderdate").alias("last_at"), flags)


@query(f"""WITH b AS (SELECT l_suppkey, p_brand, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY n DESC, p_brand) AS rank FROM b),
    top AS (SELECT l_suppkey, string_agg(p_brand, ', ' ORDER BY rank) AS brands FROM k WHERE rank <= 3 GROUP BY 1),
    v AS (SELECT l_suppkey, count(*) AS n, CAST(sum({DEC}) AS DOUBLE) AS value, max(l_shipdate) AS last_at, count(*) FILTER (l_shipdate >= TIMESTAMP '{AS_OF}' - INTERVAL 365 DAY) AS n_recent FROM lineitem GROUP BY 1)
    SELECT s_suppkey, s_name, coalesce(n, 0) AS n, coalesce(n_recent, 0) AS n_recent, value, last_at, brands FROM supplier LEFT JOIN v ON v.l_suppkey = s_suppkey LEFT JOIN top ON top.l_suppkey = s_suppkey""")
def view_competitor_dossier(t):
    recent = F.count_if(F.col("l_shipdate") >= F.lit(AS_OF).cast("timestamp") - F.expr("interval 365 days"))
    value = awards(t).groupBy("l_suppkey").agg(n_rows().alias("n"), total("value").alias("value"), F.max("l_shipdate").alias("last_at"), recent.alias("n_recent"))
    brands = t.lineitem.select("l_suppkey", "l_partkey").join(t.part.select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    top = r.concat_top(brands, ["l_suppkey"], "p_brand", 3).withColumnRenamed("listed", "brands")
    out = t.supplier.join(value.join(top, "l_suppkey"), F.col("s_suppkey") == F.col("l_suppkey"), "left")
    return out.select("s_suppkey", "s_name", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("n_recent", F.lit(0)).alias("n_recent"), "value", "last_at", "brands")


@query("""SELECT o_orderpriority, CAST(year(o_orderdate) AS BIGINT) AS year, CAST(quarter(o_orderdate) AS BIGINT) AS quarter, count(*) AS n, round(100.0 * count(*) FILTER (o_orderstatus = 'F') / count(*), 1) AS pct_f, round(100.0 * count(*) FILTER (o_orderstatus = 'O') / count(*), 1) AS pct_o FROM orders GROUP BY 1, 2, 3""")
def view_agency_buying_pattern(t):
    pct = lambda v: c.safe_pct(F.count_if(F.col("o_orderstatus") == v), n_rows())
    by = ["o_orderpriority", F.year("o_orderdate").cast("long").alias("year"), F.quarter("o_orderdate").cast("long").alias("quarter")]
    return t.orders.groupBy(*by).agg(n_rows().alias("n"), pct("F").alias("pct_f"), pct("O").alias("pct_o"))


@query("""WITH f AS (SELECT c_nationkey AS office, l_suppkey AS vendor, min(year(o_orderdate)) AS y FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
    a AS (SELECT DISTINCT c_nationkey AS office, l_suppkey AS vendor, year(o_orderdate) AS y FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey)
    SELECT a.office, CAST(a.y AS BIGINT) AS year, count(*) AS vendors, count(*) FILTER (f.y = a.y) AS entrants, round(100.0 * count(*) FILTER (f.y = a.y) / count(*), 1) AS entrant_pct FROM a JOIN f USING (office, vendor) GROUP BY 1, 2""")
def view_agency_recompete_pattern(t):
    """A vendor is an entrant in its first year at an office; a window over the distinct years marks it, with no second join."""
    orders = t.orders.join(t.customer.select("c_custkey", F.col("c_nationkey").alias("office")), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "office", F.year("o_orderdate").cast("long").alias("year"))
    seen = t.lineitem.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select("office", F.col("l_suppkey").alias("vendor"), "year").distinct()
    first = F.min("year").over(Window.partitionBy("office", "vendor"))
    marked = seen.withColumn("fresh", F.col("year") == first)
    return marked.groupBy("office", "year").agg(n_rows().alias("vendors"), F.count_if("fresh").alias("entrants"), c.safe_pct(F.count_if("fresh"), n_rows()).alias("entrant_pct"))


@query(f"""WITH g AS (SELECT l_suppkey, o_custkey, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2), k AS (SELECT *, sum(n) OVER (PARTITION BY l_suppkey) AS total, row_number() OVER (PARTITION BY l_suppkey ORDER BY n DESC, o_custkey) AS rn FROM g)
    SELECT l_suppkey, o_custkey AS top_office, CAST(total AS BIGINT) AS total, round(100.0 * n / total, 2) AS top_pct, CASE WHEN 100.0 * n / total >= 50 THEN 'High' WHEN 100.0 * n / total >= 5 THEN 'Medium' ELSE 'Low' END AS risk FROM k WHERE rn = 1""")
def view_partner_risk_assessment(t):
    """The greatest office's share of a vendor's awards: two aggregates, so no vendor's rows meet in one task."""
    g = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("l_suppkey", "o_custkey").agg(n_rows().alias("n"))
    top = g.groupBy("l_suppkey").agg(F.max(F.struct("n", -F.col("o_custkey"))).alias("m"), F.sum("n").alias("total"))
    share = 100.0 * F.col("m.n") / F.col("total")
    return top.select("l_suppkey", (-F.col("m")["col2"]).alias("top_office"), "total", F.round(share, 2).alias("top_pct"), c.bucket(share, [(50, "High"), (5, "Medium")], "Low").alias("risk"))


@query(f"""WITH w AS (SELECT s_suppkey, s_nationkey, count(l_orderkey) AS n FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey GROUP BY 1, 2), p AS (SELECT p.s_suppkey AS protege, m.s_suppkey AS mentor, m.n - p.n AS lead, row_number() OVER (PARTITION BY p.s_suppkey ORDER BY m.n DESC, m.s_suppkey) AS rank FROM w p JOIN w m ON p.s_nationkey = m.s_nationkey AND m.n > p.n)
    SELECT protege, mentor, lead, rank FROM p WHERE rank <= 10""")
def view_mentor_protege_candidate(t):
    n = t.lineitem.groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(n_rows().alias("n"))
    w = t.supplier.join(n, "s_suppkey", "left").select("s_suppkey", "s_nationkey", F.coalesce("n", F.lit(0)).alias("n"))
    largest = r.top_k(w, ["s_nationkey"], [F.desc("n"), F.asc("s_suppkey")], 10).drop("rank")  # nobody needs another mentor
    pairs = w.alias("p").join(largest.alias("m"), (F.col("p.s_nationkey") == F.col("m.s_nationkey")) & (F.col("m.n") > F.col("p.n")))
    shaped = pairs.select(F.col("p.s_suppkey").alias("protege"), F.col("m.s_suppkey").alias("mentor"), (F.col("m.n") - F.col("p.n")).alias("lead"), F.col("m.n").alias("_n"))
    return r.top_k(shaped, ["protege"], [F.desc("_n"), F.asc("mentor")], 10).drop("_n")


@query(f"""WITH u AS (SELECT o_orderkey AS k, o_orderdate + INTERVAL 365 DAY AS ends, 0 AS source FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT l_orderkey, max(l_shipdate) + INTERVAL 365 DAY, 1 FROM lineitem GROUP BY 1), k AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY source) AS rn FROM u)
    SELECT k, ends, CAST(source AS BIGINT) AS source FROM k WHERE rn = 1 AND ends >= TIMESTAMP '{AS_OF}' AND ends < TIMESTAMP '{AS_OF}' + INTERVAL 365 DAY""")
def view_expiring_contracts(t):
    year, now = F.expr("interval 365 days"), F.lit(AS_OF).cast("timestamp")
    a = t.orders.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("k"), (F.col("o_orderdate") + year).alias("ends"))
    b = t.lineitem.groupBy(F.col("l_orderkey").alias("k")).agg((F.max("l_shipdate") + year).alias("ends"))
    return r.union_priority([a, b], ["k"]).where((F.col("ends") >= now) & (F.col("ends") < now + year)).select("k", "ends", "source")


@query("""WITH p AS (SELECT *, lag(o_orderpriority) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS before FROM orders)
    SELECT coalesce(before, 'none') AS before, o_orderpriority AS now, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(15,2))) AS DOUBLE) AS value FROM p WHERE before IS NULL OR before <> o_orderpriority GROUP BY 1, 2""")
def view_set_aside_shift(t):
    rows = r.lag_compare(t.orders, ["o_custkey"], [F.asc("o_orderdate"), F.asc("o_orderkey")], "o_orderpriority")
    shifts = rows.where("previous is null or changed").withColumn("value", c.money(F.col("o_totalprice")))
    return shifts.groupBy(F.coalesce("previous", F.lit("none")).alias("before"), F.col("o_orderpriority").alias("now")).agg(n_rows().alias("n"), total("value").alias("value"))


@query("""SELECT l_suppkey AS vendor, l_partkey AS part FROM lineitem WHERE l_quantity > 25 EXCEPT SELECT l_suppkey, l_partkey FROM lineitem WHERE l_returnflag = 'R'""")
def view_portfolio_gap_analysis(t):
    """The set difference as one aggregate with two marks, so the table is read and shuffled once."""
    marks = t.lineitem.groupBy(F.col("l_suppkey").alias("vendor"), F.col("l_partkey").alias("part")).agg(F.max((F.col("l_quantity") > 25).cast("int")).alias("wanted"), F.max((F.col("l_returnflag") == "R").cast("int")).alias("held"))
    return marks.where("wanted = 1 and held = 0").select("vendor", "part")


@query("""SELECT event_type, count(*) AS n, max(event_id) AS last_id, max(ts) AS last_at, count(DISTINCT user_id) AS users FROM events GROUP BY 1""")
def view_data_freshness(t):
    return t.events.groupBy("event_type").agg(n_rows().alias("n"), F.max("event_id").alias("last_id"), F.max("ts").alias("last_at"), F.count_distinct("user_id").alias("users"))


FACTORS = f"""WITH v AS (SELECT l_suppkey, count(*) AS n, max(l_shipdate) AS last_at, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY 1),
    f AS (SELECT s_suppkey, s_acctbal, n, parts, date_diff('day', CAST(last_at AS DATE), DATE '{AS_OF}') / 365.25 AS years FROM supplier LEFT JOIN v ON l_suppkey = s_suppkey),
    x AS (SELECT s_suppkey, CASE WHEN coalesce(n, 0) = 0 THEN 10.0 ELSE greatest(10.0, least(100.0, least(100.0, 20.0 + 16.0 * n) * CASE WHEN years <= 2 THEN 1.0 WHEN years <= 5 THEN 0.5 ELSE 0.25 END)) END AS experience,
        CASE WHEN parts >= 3 THEN 100.0 WHEN parts >= 1 THEN 60.0 WHEN parts IS NOT NULL THEN 30.0 END AS teaming,
        CASE WHEN s_acctbal >= 0 THEN greatest(10.0, least(100.0, 100.0 * exp(-0.5 * greatest(0.0, s_acctbal / 2000.0 - 1.0)))) END AS value_fit FROM f),
    w AS (SELECT s_suppkey, round((coalesce(CAST(experience AS DOUBLE), 0) * 0.18 + coalesce(CAST(teaming AS DOUBLE), 0) * 0.1 + coalesce(value_fit, 0) * 0.1) / (CAST(0.18 AS DOUBLE) + CASE WHEN teaming IS NULL THEN 0.0 ELSE 0.1 END + CASE WHEN value_fit IS NULL THEN 0.0 ELSE 0.1 END), 2) AS win, value_fit FROM x)"""


def win_scores(t):
    v = t.lineitem.groupBy("l_suppkey").agg(n_rows().alias("n"), F.max("l_shipdate").alias("last_at"), F.count_distinct("l_partkey").alias("parts"))
    f = t.supplier.join(v, F.col("s_suppkey") == F.col("l_suppkey"), "left")
    years = F.date_diff(F.lit(AS_OF).cast("date"), F.col("last_at").cast("date")) / 365.25
    no = F.lit(False)
    f = f.select("s_suppkey", s.experience(F.col("n"), years, no, no).alias("experience"), s.teaming(F.col("parts")).alias("teaming"), s.value_fit(F.when(F.col("s_acctbal") >= 0, F.col("s_acctbal") / 2000.0)).alias("value_fit"))
    return f.select("*", s.combine({k: F.col(k) for k in ("experience", "teaming", "value_fit")}).alias("win"))


@query(FACTORS + """ SELECT s_suppkey, win, CASE WHEN win >= 70 THEN 'High' WHEN win >= 40 THEN 'Medium' WHEN win >= 15 THEN 'Low' WHEN win IS NULL THEN 'InsufficientData' ELSE 'VeryLow' END AS level FROM w""")
def score_win(t):
    return win_scores(t).select("s_suppkey", "win", s.win_level(F.col("win")).alias("level"))


@query(FACTORS + """, p AS (SELECT s_suppkey, win, value_fit, round((win * 0.6 + coalesce(value_fit, 0) * 0.4) * CASE WHEN value_fit IS NULL THEN 0.85 ELSE 1.0 END, 1) AS score FROM w)
    SELECT s_suppkey, score, concat(CASE WHEN win >= 50 THEN 'High' ELSE 'Low' END, 'PWin_', CASE WHEN value_fit >= 50 THEN 'High' ELSE 'Low' END, 'OQS') AS quadrant, CASE WHEN score >= 75 THEN 'MustPursue' WHEN score >= 50 THEN 'ShouldPursue' WHEN score >= 30 THEN 'Consider' ELSE 'Skip' END AS category FROM p""")
def score_pursuit(t):
    win, quality = F.col("win"), F.col("value_fit")
    out = win_scores(t).select("s_suppkey", s.pursuit(win, quality, quality.isNull()).alias("score"), s.pursuit_quadrant(win, quality).alias("quadrant"))
    return out.withColumn("category", s.pursuit_category(F.col("score")))


RULES = [
    tx.Rule("secrets", "password", r"password", "password", "high"),
    tx.Rule("secrets", "token", r"api[_-]?key|token", None, "high"),
    tx.Rule("license", "license", r"licen[sc]e", "license", "medium"),
    tx.Rule("contact", "mail", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+[.][A-Za-z]+", None, "low"),
]
HITS = "".join(f"{' UNION ALL ' if i else ''}SELECT doc_id, '{x.name}' AS rule, '{x.category}' AS category, len(regexp_extract_all(text, '(?i){x.pattern}')) AS n FROM documents WHERE text IS NOT NULL" for i, x in enumerate(RULES))


@query(f"SELECT doc_id, category, rule, CAST(n AS BIGINT) AS n FROM ({HITS}) WHERE n > 0")
def pattern_scan(t):
    return tx.scan_patterns(t.documents, RULES).groupBy("doc_id", "category", "rule").agg(n_rows().alias("n"))


@query("""SELECT d.doc_id, CASE WHEN p.item_id IS NOT NULL THEN 'benchmark' WHEN l.doc_id IS NOT NULL THEN 'labels' END AS target, coalesce(CAST(p.item_id AS VARCHAR), CAST(l.doc_id AS VARCHAR)) AS target_id
    FROM documents d LEFT JOIN benchmark p ON p.item_id = d.doc_id LEFT JOIN labels l ON l.doc_id = d.doc_id""")
def cross_reference(t):
    targets = [("benchmark", t.benchmark.select(F.col("item_id").alias("key"), F.col("item_id").alias("target_id"))), ("labels", t.labels.select(F.col("doc_id").alias("key"), F.col("doc_id").alias("target_id")))]
    return tx.cross_reference(t.documents.select("doc_id"), "doc_id", targets)
