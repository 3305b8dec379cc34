"""Scores over the test tables, registered in the catalogue with their SQL: go or no-go, the opportunity score, all eight win factors."""

from __future__ import annotations

from pyspark.sql import functions as F

from tenderlake.functions import columns as c
from tenderlake.operators import estimates as es
from tenderlake.operators import partners as pa
from tenderlake.operators import scoring as s
from tenderlake.operators.scale import cut
from tenderlake.plans.catalogue import AS_OF, n_rows, query

#: Order priorities stand for set-asides, customer segments for certificates.
CODES = {"1-URGENT": "WOSB", "2-HIGH": "8A", "3-MEDIUM": "HZC"}
REQUIRED = {"WOSB": ["BUILDING"], "8A": ["MACHINERY", "FURNITURE"], "HZC": ["AUTOMOBILE"]}
CODE = "CASE o_orderpriority WHEN '1-URGENT' THEN 'WOSB' WHEN '2-HIGH' THEN '8A' WHEN '3-MEDIUM' THEN 'HZC' END"
DAYS = f"date_diff('day', DATE '{AS_OF}', CAST(o_orderdate AS DATE))"
FACTS = f"""WITH u AS (SELECT o_custkey, avg(o_totalprice) AS usual, count(*) AS n, count(DISTINCT o_orderpriority) AS kinds FROM orders GROUP BY 1),
    x AS (SELECT o_orderkey, {CODE} AS code, c_mktsegment AS held, o_totalprice AS value, u.usual, u.n, u.kinds, {DAYS} AS days, o_orderstatus AS status, c_nationkey AS nation, c_acctbal AS balance FROM orders JOIN customer ON c_custkey = o_custkey JOIN u ON u.o_custkey = c_custkey)"""
MATCH = """CASE code WHEN 'WOSB' THEN CASE WHEN held = 'BUILDING' THEN 100.0 WHEN held IN ('MACHINERY', 'FURNITURE', 'AUTOMOBILE') THEN 50.0 ELSE 0.0 END WHEN '8A' THEN CASE WHEN held IN ('MACHINERY', 'FURNITURE') THEN 100.0 WHEN held IN ('BUILDING', 'AUTOMOBILE') THEN 50.0 ELSE 0.0 END
    WHEN 'HZC' THEN CASE WHEN held = 'AUTOMOBILE' THEN 100.0 WHEN held IN ('MACHINERY', 'FURNITURE', 'BUILDING') THEN 50.0 ELSE 0.0 END END"""


def facts(t):
    u = t.orders.groupBy("o_custkey").agg(F.avg("o_totalprice").alias("usual"), n_rows().alias("n"), F.count_distinct("o_orderpriority").alias("kinds"))
    code = F.coalesce(*[F.when(F.col("o_orderpriority") == k, v) for k, v in CODES.items()])
    rows = t.orders.join(t.customer.withColumnRenamed("c_custkey", "o_custkey"), "o_custkey").join(u, "o_custkey")
    days = F.date_diff(F.col("o_orderdate").cast("date"), F.lit(AS_OF).cast("date"))
    return rows.select("o_orderkey", code.alias("code"), F.col("c_mktsegment").alias("held"), F.col("o_totalprice").alias("value"), "usual", "n", "kinds", days.alias("days"), F.col("o_orderstatus").alias("status"), F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance"))


@query(f"""{FACTS}, p AS (SELECT o_orderkey, CASE code WHEN 'WOSB' THEN 10 WHEN '8A' THEN 8 WHEN 'HZC' THEN 5 ELSE 0 END AS a, CASE WHEN days < 0 THEN 0 WHEN days < 7 THEN 1 WHEN days < 14 THEN 4 WHEN days <= 30 THEN 7 ELSE 10 END AS b, CASE WHEN nation < 10 THEN 10 ELSE 0 END AS c,
    CASE WHEN value >= 1000000 THEN 10 WHEN value >= 500000 THEN 8 WHEN value >= 100000 THEN 6 WHEN value >= 50000 THEN 4 ELSE 2 END AS d FROM x) SELECT o_orderkey, CAST(a + b + c + d AS BIGINT) AS points, round((a + b + c + d) / 40.0 * 100.0, 1) AS percent FROM p""")
def score_go_no_go(t):
    p = s.go_no_go_points(F.col("code"), F.col("days"), F.col("nation") < 10, F.col("value"))
    points = p["set_aside"] + p["time"] + p["category"] + p["value"]
    return facts(t).select("o_orderkey", points.cast("long").alias("points"), p["percent"].alias("percent"))


@query(f"""{FACTS}, f AS (SELECT o_orderkey,
    CASE WHEN nation < 5 THEN CASE WHEN code IS NULL OR ({MATCH}) = 100 THEN 100.0 ELSE 80.0 END WHEN nation < 10 THEN CASE WHEN code IS NULL OR ({MATCH}) = 100 THEN 60.0 ELSE 30.0 END WHEN nation < 15 THEN CASE WHEN code IS NULL OR ({MATCH}) = 100 THEN 50.0 ELSE 30.0 END ELSE CASE WHEN code IS NULL OR ({MATCH}) = 100 THEN 60.0 ELSE 30.0 END END AS profile,
    CASE WHEN value > 0 AND usual > 0 THEN CASE WHEN greatest(value / usual, usual / value) <= 2 THEN 100.0 WHEN greatest(value / usual, usual / value) <= 4 THEN 70.0 WHEN greatest(value / usual, usual / value) <= 10 THEN 40.0 ELSE 20.0 END END AS fit,
    CASE WHEN n > 3 THEN floor(greatest(10.0, 100.0 * exp(-0.15 * (n - 1)))) WHEN n > 0 THEN 100.0 END AS competition, CASE WHEN days <= 0 THEN 0.0 ELSE least(100.0, round_even(days / 45.0 * 100.0, 0)) END AS timeline,
    CASE WHEN kinds >= 3 AND nation < 12 THEN 100.0 WHEN kinds >= 3 THEN 60.0 WHEN nation < 12 THEN 40.0 ELSE 10.0 END AS reuse, CASE WHEN NOT nation < 12 THEN 80.0 WHEN NOT kinds >= 3 THEN 60.0 ELSE 20.0 END AS growth, CASE WHEN status <> 'F' THEN 60.0 WHEN balance > 0 THEN 50.0 END AS recompete FROM x),
    g AS (SELECT o_orderkey, round((profile * 0.2 + coalesce(fit, 0) * 0.15 + coalesce(competition, 0) * 0.1 + timeline * 0.15 + reuse * 0.1 + growth * 0.15 + coalesce(recompete, 0) * 0.15) / (CAST(0.2 AS DOUBLE) + CASE WHEN fit IS NULL THEN 0 ELSE 0.15 END + CASE WHEN competition IS NULL THEN 0 ELSE 0.1 END + 0.15 + 0.1 + 0.15 + CASE WHEN recompete IS NULL THEN 0 ELSE 0.15 END), 1) AS score FROM f)
    SELECT count(*) AS n, CASE WHEN score >= 70 THEN 'High' WHEN score >= 40 THEN 'Medium' WHEN score >= 15 THEN 'Low' ELSE 'VeryLow' END AS level, round(avg(score), 1) AS mean FROM g GROUP BY 2""")
def score_opportunity(t):
    """Opportunities by level of their score, over seven factors."""
    nation, kinds = F.col("nation"), F.col("kinds")
    match = s.set_aside_match(F.col("code"), F.array("held"), REQUIRED)
    certified = F.col("code").isNull() | (match == 100.0)
    tier = F.when(nation < 5, "primary").when(nation < 10, "secondary").when(nation < 15, "associated").otherwise("other")
    factors = {
        "profile": s.profile_match(tier, certified, F.lit(True)), "value": s.value_alignment(F.col("value"), F.col("usual")), "competition": s.few_vendors(F.col("n")), "timeline": s.timeline(F.col("days")),
        "reuse": s.reuse(kinds >= 3, nation < 12, F.lit(True)), "growth": s.growth(kinds >= 3, nation < 12, F.lit(True)), "recompete": s.recompete_advantage(F.col("status") == "F", F.col("balance") > 0),
    }
    scored = facts(t).select(s.opportunity_score(factors).alias("score"))
    return scored.groupBy(s.win_level(F.col("score")).alias("level")).agg(n_rows().alias("n"), F.round(F.avg("score"), 1).alias("mean"))


@query(f"""{FACTS} SELECT o_orderkey, {MATCH} AS set_aside, CASE WHEN nation = 3 THEN 100.0 WHEN status = 'F' AND kinds > 2 THEN least(65.0, 30.0 + 10.0 * (kinds - 2)) WHEN status = 'F' THEN 20.0 WHEN status = 'P' THEN 30.0 WHEN balance < 0 THEN 50.0 END AS incumbent,
    CASE WHEN balance > 9000 AND code IS NOT NULL THEN -100.0 WHEN balance <= 9000 AND code IS NOT NULL THEN round(greatest(70.0, least(100.0, 70.0 + 0.6 * (100.0 - balance / 90.0))), 1) WHEN balance > 9000 THEN 45.0 ELSE 60.0 END AS size FROM x""")
def score_win_factors(t):
    """The three win factors that `score_win` has no data for: set-aside, incumbent and size, with its penalty."""
    out = facts(t).withColumn("big", F.col("balance") > 9000).withColumn("aside", F.col("code").isNotNull())
    done = F.col("status") == "F"
    incumbent = s.incumbent(F.col("nation") == 3, done, F.col("kinds") - 2, F.col("status") == "P", F.col("balance") < 0)
    return out.select("o_orderkey", s.set_aside_match(F.col("code"), F.array("held"), REQUIRED).alias("set_aside"), incumbent.alias("incumbent"), s.size_eligibility(F.col("aside"), F.col("big"), 100.0 - F.col("balance") / 90.0).alias("size"))


@query("""WITH m AS (SELECT o_orderpriority, o_totalprice AS price, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate DESC, o_orderkey) AS rn FROM orders)
    SELECT o_orderpriority, count(*) AS n, round(quantile_cont(price, 0.25), 4) AS p25, round(quantile_cont(price, 0.5), 4) AS p50, round(quantile_cont(price, 0.75), 4) AS p75, CASE WHEN count(*) >= 500 THEN 0.9 WHEN count(*) >= 100 THEN 0.7 ELSE 0.3 END AS confidence FROM m WHERE rn <= 500 GROUP BY 1""")
def price_to_win(t):
    """Quartiles of the newest 500 comparable prices of a category, with a confidence by their number."""
    from tenderlake.operators import relational as r

    rows = t.orders.select("o_orderpriority", F.col("o_totalprice").alias("price"), "o_orderdate", "o_orderkey")
    out = r.capped_percentiles(rows, ["o_orderpriority"], [F.desc("o_orderdate"), F.asc("o_orderkey")], 500, "price", [0.25, 0.5, 0.75])
    return out.select("*", F.when(F.col("n") >= 500, 0.9).when(F.col("n") >= 100, 0.7).otherwise(0.3).alias("confidence"))


@query("""WITH a AS (SELECT l_suppkey, l_partkey, count(*) AS n FROM lineitem GROUP BY 1, 2) SELECT l_partkey, round(avg(n), 4) AS mean_offers, round(quantile_cont(n, 0.5), 2) AS median_offers, round(100.0 * count(*) FILTER (n = 1) / count(*), 1) AS solo_pct FROM a GROUP BY 1""")
def competition_statistics(t):
    offers = t.lineitem.groupBy("l_suppkey", "l_partkey").agg(n_rows().alias("n"))
    return offers.groupBy("l_partkey").agg(F.round(F.avg("n"), 4).alias("mean_offers"), F.round(F.percentile("n", F.lit(0.5)), 2).alias("median_offers"), c.safe_pct(F.count_if(F.col("n") == 1), n_rows()).alias("solo_pct"))


LINES = """WITH l AS (SELECT l_suppkey, l_partkey, p_brand, o_custkey, c_nationkey, CAST(year(l_shipdate) AS BIGINT) AS y, CAST(l_extendedprice AS DECIMAL(15,2)) AS v, l_returnflag FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN part ON p_partkey = l_partkey)"""


def lines(t):
    """Lines with their part's brand and their order's customer; orders meet customers first, so lines are dealt by order once."""
    line = t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey", F.year("l_shipdate").alias("y"), c.money(F.col("l_extendedprice")).alias("v"), "l_returnflag")
    owners = t.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey").join(t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")
    rows = line.join(t.part.select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey").join(owners, "l_orderkey")
    return rows.select("l_suppkey", "l_partkey", "p_brand", "o_custkey", "c_nationkey", F.col("y").cast("long").alias("y"), "v", "l_returnflag")


def whole(hundredths):
    return (hundredths.cast("decimal(20,0)") * F.lit("0.01").cast("decimal(2,2)")).cast("double")


def by_second_keys(rows, key, sides):
    """Rows counted by ``key``, where it is known, and each of several second keys: for each of ``sides``, of a number or a text and the columns it takes, its groups with the first and last ``y``, ``n`` and the sum of ``v``, in hundredths.

    Rows are dealt by ``key`` once, as they are, and made into one for each
    side after that, so neither the sides nor what is aggregated from them by
    ``key`` is shuffled.
    """
    kinds = {"number": "bigint", "text": "string", "y": "int", "v": "bigint"}
    taken = [F.struct(F.lit(i).alias("side"), *[(side[x] if x in side else F.lit(None)).cast(kind).alias(x) for x, kind in kinds.items()]) for i, side in enumerate(sides)]
    slices = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = rows.where(F.col(key).isNotNull()).repartition(slices, key).select(key, F.inline(F.array(*taken)))
    return out.groupBy(key, "side", "number", "text").agg(F.min("y").alias("first"), F.max("y").alias("last"), n_rows().alias("n"), F.sum("v").alias("v"))


@query(f"""{LINES}, y AS (SELECT l_suppkey, o_custkey, count(DISTINCT y) AS years FROM l GROUP BY 1, 2), r AS (SELECT l_suppkey, 100.0 * count(*) FILTER (years >= 2) / count(*) AS kept FROM y GROUP BY 1),
    b AS (SELECT l_suppkey, p_brand, count(*) AS n FROM l GROUP BY 1, 2), k AS (SELECT l_suppkey, 100.0 * max(n) / sum(n) AS top, max(n) AS m FROM b GROUP BY 1),
    a AS (SELECT l_suppkey, CAST(sum(v) AS DOUBLE) AS value, count(DISTINCT c_nationkey) AS nations, bool_or(c_nationkey = 3) AS knows, count(DISTINCT l_returnflag) AS kinds, bool_or(l_returnflag = 'R') AS asked FROM l GROUP BY 1)
    SELECT s_suppkey, round(0.25 * CASE WHEN value >= 50000000 THEN 100.0 WHEN value > 0 THEN floor(least(100.0, 13.0 * log10(value + 1))) ELSE 0.0 END + 0.2 * CASE WHEN nations > 0 THEN least(100.0, greatest(10.0, least(100.0, 10.0 * nations)) + CASE WHEN knows THEN 10 ELSE 0 END) ELSE 0.0 END
    + 0.2 * CASE WHEN kinds > 0 THEN least(100.0, 20.0 * kinds + CASE WHEN asked THEN 20 ELSE 0 END) ELSE 0.0 END + 0.15 * coalesce(CASE WHEN kept >= 80 THEN 90.0 WHEN kept >= 60 THEN 70.0 WHEN kept >= 40 THEN 50.0 WHEN kept IS NOT NULL THEN 30.0 END, 0)
    + 0.2 * coalesce(least(100.0, CASE WHEN top > 50 THEN 90.0 WHEN top > 30 THEN 70.0 WHEN top > 10 THEN 50.0 WHEN top IS NOT NULL THEN 30.0 END + CASE WHEN m >= 10 THEN 10 WHEN m >= 5 THEN 5 ELSE 0 END), 0), 2) AS strength
    FROM supplier LEFT JOIN a ON a.l_suppkey = s_suppkey LEFT JOIN r ON r.l_suppkey = s_suppkey LEFT JOIN k ON k.l_suppkey = s_suppkey""")
def score_competitor_strength(t):
    """All is aggregated by vendor and a second key first, in one pass over the lines."""
    year, nation, flag = F.col("y"), F.col("c_nationkey"), F.col("l_returnflag")
    groups = by_second_keys(lines(t), "l_suppkey", [{"number": F.col("o_custkey"), "y": year}, {"text": F.col("p_brand")}, {"number": nation}, {"text": flag, "v": F.col("v") * 100}])
    of = lambda side, x: F.when(F.col("side") == side, x)
    sums = groups.groupBy("l_suppkey").agg(
        (100.0 * F.count_if((F.col("side") == 0) & (F.col("first") < F.col("last"))) / F.count_if(F.col("side") == 0)).alias("kept"), (100.0 * F.max(of(1, F.col("n"))) / F.sum(of(1, F.col("n")))).alias("top"), F.max(of(1, F.col("n"))).alias("m"), whole(F.sum("v")).alias("value"),
        F.count(of(2, F.col("number"))).alias("nations"), F.bool_or(of(2, F.col("number") == 3)).alias("knows"), F.count(of(3, F.col("text"))).alias("kinds"), F.bool_or(of(3, F.col("text") == "R")).alias("asked"),
    )
    out = t.supplier.select(F.col("s_suppkey"), F.col("s_suppkey").alias("l_suppkey")).join(sums, "l_suppkey", "left")
    factors = {
        "revenue": s.revenue_strength(F.col("value")), "penetration": s.agency_penetration(F.col("nations"), F.col("knows")), "certificates": s.certificate_strength(F.col("kinds"), F.col("asked")),
        "retention": s.retention_strength(F.col("kept"), F.lit(0)), "concentration": s.concentration_strength(F.col("top"), F.col("m")),
    }
    return out.select("s_suppkey", s.total_points(factors, s.STRENGTH_WEIGHTS, 2).alias("strength"))


@query(f"""{LINES}, y AS (SELECT o_custkey, l_suppkey, count(DISTINCT y) AS years, sum(v) AS v, bool_or(l_suppkey < 50) AS small FROM l GROUP BY 1, 2), a AS (SELECT o_custkey, count(*) AS subs, 100.0 * count(*) FILTER (years >= 2) / count(*) AS kept, 100.0 * CAST(coalesce(sum(v) FILTER (small), 0) AS DOUBLE) / CAST(sum(v) AS DOUBLE) AS small FROM y GROUP BY 1),
    b AS (SELECT o_custkey, count(DISTINCT p_brand) AS brands, CAST(sum(v) AS DOUBLE) / count(*) AS mean FROM l GROUP BY 1), g AS (SELECT o_custkey, y, count(*) AS n, row_number() OVER (PARTITION BY o_custkey ORDER BY y DESC) AS rank FROM l GROUP BY 1, 2),
    h AS (SELECT o_custkey, max(n) FILTER (rank = 1) AS n1, max(n) FILTER (rank = 2) AS n2 FROM g GROUP BY 1), p AS (SELECT a.o_custkey, round(0.25 * CASE WHEN small > 50 THEN 100.0 WHEN small >= 30 THEN 75.0 WHEN small >= 15 THEN 50.0 WHEN small >= 5 THEN 30.0 ELSE 10.0 END + 0.15 * greatest(10.0, least(100.0, 5.0 * subs))
    + 0.15 * CASE WHEN mean >= 100000 THEN 100.0 WHEN mean >= 50000 THEN 80.0 WHEN mean >= 25000 THEN 60.0 WHEN mean >= 10000 THEN 40.0 ELSE 20.0 END + 0.15 * CASE WHEN kept >= 60 THEN 100.0 WHEN kept >= 40 THEN 70.0 WHEN kept >= 20 THEN 40.0 ELSE 20.0 END + 0.15 * greatest(10.0, least(100.0, 20.0 * brands))
    + 0.15 * CASE WHEN n2 IS NULL THEN 50.0 WHEN 100.0 * (n1 - n2) / n2 >= 20 THEN 100.0 WHEN 100.0 * (n1 - n2) / n2 >= -20 THEN 60.0 ELSE 20.0 END, 2) AS score FROM a JOIN b ON b.o_custkey = a.o_custkey JOIN h ON h.o_custkey = a.o_custkey)
    SELECT o_custkey, score, CASE WHEN score >= 80 THEN 'Champion' WHEN score >= 60 THEN 'Engaged' WHEN score >= 40 THEN 'Minimal' ELSE 'Closed' END AS level FROM p""")
def score_open_door(t):
    """Customers stand for primes, suppliers for subcontractors; those with keys under 50 are the small ones."""
    groups = by_second_keys(lines(t), "o_custkey", [{"number": F.col("l_suppkey"), "y": F.col("y"), "v": F.col("v") * 100}, {"text": F.col("p_brand")}, {"number": F.col("y")}])
    of = lambda side, x: F.when(F.col("side") == side, x)
    subs, value, year = F.count_if(F.col("side") == 0), whole(F.sum("v")), of(2, F.struct("number", "n"))
    small = F.coalesce(whole(F.sum(of(0, F.when(F.col("number") < 50, F.col("v"))))), F.lit(0.0))
    a = groups.groupBy("o_custkey").agg(
        subs.alias("subs"), (100.0 * F.count_if((F.col("side") == 0) & (F.col("first") < F.col("last"))) / subs).alias("kept"), (100.0 * small / value).alias("small"),
        F.count(of(1, F.col("text"))).alias("brands"), (value / F.sum(of(0, F.col("n")))).alias("mean"), F.sort_array(F.collect_list(year), False).alias("years"),
    )
    a = a.select("*", *[F.get("years", F.lit(i))["n"].alias(f"n{i + 1}") for i in range(2)])
    f = s.open_door_factors(F.col("small"), F.col("subs"), F.col("mean"), F.col("kept"), F.col("brands"), 100.0 * (F.col("n1") - F.col("n2")) / F.col("n2"))
    out = a.select("o_custkey", s.total_points(f, s.OPEN_DOOR_WEIGHTS, 2).alias("score"))
    return out.withColumn("level", c.bucket(F.col("score"), s.OPEN_DOOR_LEVELS, "Closed"))


@query(f"""WITH v AS (SELECT l_orderkey, count(*) AS n, count(DISTINCT l_suppkey) AS vendors, CAST(sum(CAST(l_extendedprice AS DECIMAL(15,2))) AS DOUBLE) AS spent, count(*) FILTER (l_returnflag = 'A') AS a FROM lineitem GROUP BY 1),
    x AS (SELECT o_orderkey, date_diff('day', CAST(o_orderdate AS DATE), DATE '2002-01-01') / 365.25 AS years, a / n AS options, CASE WHEN o_totalprice > 0 THEN spent / o_totalprice END AS spend, n, vendors, c_acctbal FROM orders JOIN customer ON c_custkey = o_custkey LEFT JOIN v ON l_orderkey = o_orderkey),
    p AS (SELECT o_orderkey, least(100.0, greatest(0.0, round(0.15 * floor(greatest(10.0, least(100.0, 10.0 + 15.0 * years))) + 0.25 * coalesce(CASE WHEN options < 0.5 THEN 90.0 WHEN options < 0.8 THEN 60.0 WHEN options IS NOT NULL THEN 30.0 END, 0) + 0.15 * coalesce(CASE WHEN spend < 0.5 THEN 80.0 WHEN spend > 1.2 THEN 70.0 WHEN spend IS NOT NULL THEN 20.0 END, 0)
    + 0.15 * CASE WHEN c_acctbal < 0 THEN 100.0 ELSE 0.0 END + 0.15 * coalesce(CASE WHEN n > 0 THEN floor(greatest(10.0, least(100.0, 100.0 * vendors / n))) END, 0) + 0.15 * CASE WHEN vendors IS NULL THEN 0 ELSE greatest(10.0, least(100.0, 10.0 + 18.0 * vendors)) END, 2))) AS score FROM x)
    SELECT o_orderkey, score, CASE WHEN score >= 75 THEN 'HighlyVulnerable' WHEN score >= 50 THEN 'Vulnerable' WHEN score >= 25 THEN 'Stable' ELSE 'Entrenched' END AS level FROM p""")
def score_incumbent_vulnerability(t):
    v = awards_by_order(t)
    x = t.orders.join(t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_acctbal"), "o_custkey").join(v, "o_orderkey", "left")
    years = F.date_diff(F.lit("2002-01-01").cast("date"), F.col("o_orderdate").cast("date")) / 365.25
    factors = {
        "age": s.contract_age(years), "options": s.options_left(F.col("a") / F.col("n")), "spend": s.spend_anomaly(F.when(F.col("o_totalprice") > 0, F.col("spent") / F.col("o_totalprice"))), "registration": F.when(F.col("c_acctbal") < 0, 100.0).otherwise(0.0),
        "turnover": s.vendor_turnover(F.col("vendors"), F.col("n")), "offers": s.offer_pressure(F.col("vendors")),
    }
    out = x.select("o_orderkey", s.clamp(s.total_points(factors, s.VULNERABILITY_WEIGHTS, 2), 0, 100).alias("score"))
    return out.withColumn("level", c.bucket(F.col("score"), s.VULNERABILITY_LEVELS, "Entrenched"))


def awards_by_order(t):
    rows = t.lineitem.withColumn("v", c.money(F.col("l_extendedprice")))
    return rows.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(n_rows().alias("n"), F.count_distinct("l_suppkey").alias("vendors"), F.sum("v").cast("double").alias("spent"), F.count_if(F.col("l_returnflag") == "A").alias("a"))


IGCE_AWARD = "o_orderkey, o_orderpriority AS code, o_custkey AS sol, o_totalprice AS price, o_orderdate AS starts"


@query(f"""WITH q AS (SELECT c_custkey AS id, c_custkey AS sol, CASE WHEN c_nationkey > 3 THEN CASE c_nationkey % 3 WHEN 0 THEN '1-URGENT' WHEN 1 THEN '5-LOW' ELSE 'none' END END AS code, CASE WHEN c_acctbal > 0 THEN CAST(c_nationkey AS BIGINT) END AS months FROM customer),
    a AS (SELECT {IGCE_AWARD} FROM orders), h AS (SELECT code, round(avg(price), 2) AS e, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY starts DESC, o_orderkey) AS r FROM a WHERE starts >= TIMESTAMP '{AS_OF}' - INTERVAL 60 MONTH AND price > 0) WHERE r <= 500 GROUP BY 1),
    m AS (SELECT p_brand, quantile_cont(p_retailprice, 0.5) AS med, count(*) AS n FROM part GROUP BY 1), x AS (SELECT o_custkey AS id, p_brand, sum(CAST(l_quantity AS BIGINT)) AS hours FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey WHERE l_returnflag = 'R' GROUP BY 1, 2),
    l AS (SELECT id, sum(med * hours) AS s, CAST(sum(n) AS BIGINT) AS n FROM x JOIN m ON m.p_brand = x.p_brand GROUP BY 1), b AS (SELECT sol, price, date_diff('day', CAST(starts AS DATE), DATE '{AS_OF}') / 30.0 AS mo FROM (SELECT *, row_number() OVER (PARTITION BY sol ORDER BY starts DESC, o_orderkey) AS r FROM a) WHERE r = 1),
    u AS (SELECT id, e, CASE WHEN n >= 50 THEN 0.8 WHEN n >= 20 THEN 0.6 WHEN n >= 10 THEN 0.4 ELSE 0.2 END::DOUBLE AS c FROM q JOIN h ON h.code = q.code UNION ALL SELECT q.id, round(s * CASE WHEN months > 0 THEN months / 12.0::DOUBLE ELSE 1.0 END, 2), 0.7 FROM q JOIN l ON l.id = q.id UNION ALL SELECT id, round(price / mo::DOUBLE * coalesce(months, 12), 2), 0.5 FROM q JOIN b ON b.sol = q.sol WHERE mo > 0),
    s AS (SELECT id, sum(e * c) / sum(c) AS e, avg(c) AS c, count(*) AS n FROM u GROUP BY 1)
    SELECT q.id, round(round(e, 2), 0) AS estimate, coalesce(n, 0) AS n_methods, CASE WHEN round(c, 6) >= 0.7 THEN 'High' WHEN round(c, 6) >= 0.4 THEN 'Medium' WHEN c IS NOT NULL THEN 'Low' ELSE 'None' END AS level FROM q LEFT JOIN s ON s.id = q.id""")
def igce_ensemble(t):
    """An estimate for each customer as a request, by analogous awards, by labour and by the burn rate of its last award."""
    code = "CASE WHEN c_nationkey > 3 THEN CASE c_nationkey % 3 WHEN 0 THEN '1-URGENT' WHEN 1 THEN '5-LOW' ELSE 'none' END END AS code"
    q = t.customer.selectExpr("c_custkey AS id", "c_custkey AS sol", code, "CASE WHEN c_acctbal > 0 THEN CAST(c_nationkey AS BIGINT) END AS months")
    a, now = t.orders.selectExpr(*IGCE_AWARD.split(", ")), F.lit(AS_OF).cast("timestamp")
    wide = t.lineitem.where("l_returnflag = 'R'").join(t.orders, F.col("o_orderkey") == F.col("l_orderkey")).join(t.part, F.col("p_partkey") == F.col("l_partkey"))
    mix = wide.groupBy(F.col("o_custkey").alias("id"), "p_brand").agg(F.sum(F.col("l_quantity").cast("long")).alias("hours"))
    methods = [
        es.by_analog(q, a, "id", "code", "price", "starts", [F.asc("o_orderkey")], now), es.by_labor(q, mix, t.part, "id", "p_brand", "hours", "p_retailprice", "months"),
        es.by_burn_rate(q, a, "id", "sol", "price", "starts", [F.asc("o_orderkey")], "months", now),
    ]
    return es.ensemble(q, methods, "id").select("id", F.round("estimate", 0).alias("estimate"), "n_methods", "level")


FIXED = "CASE WHEN p_size > 40 THEN 30 WHEN p_size > 20 THEN 20 WHEN p_size > 5 THEN 10 ELSE 0 END + CAST(p_partkey % 11 AS INT)"
VARYING = "CASE standing WHEN 0 THEN 40 WHEN 1 THEN 30 ELSE 15 END + CASE WHEN p_retailprice < s_acctbal THEN 10 ELSE 0 END"
NEED = "CASE p_type WHEN 'PROMO' THEN 'A' WHEN 'ECONOMY' THEN 'B' WHEN 'LARGE' THEN 'C' END"


@query(f"""WITH d AS (SELECT *, {NEED} AS need FROM (SELECT *, row_number() OVER (PARTITION BY p_name, p_brand, p_type ORDER BY p_retailprice DESC, p_partkey DESC) AS r FROM part) WHERE r = 1),
    c AS (SELECT l_suppkey, p_brand, min(standing) AS standing FROM (SELECT l_suppkey, p_brand, CASE WHEN l_quantity = 50 THEN 0 WHEN l_quantity = 49 THEN 1 WHEN l_discount > 0.09 THEN 2 END AS standing FROM lineitem JOIN part ON p_partkey = l_partkey) WHERE standing IS NOT NULL GROUP BY 1, 2),
    h AS (SELECT DISTINCT l_suppkey, l_returnflag AS cert FROM lineitem WHERE l_tax > 0.079), m AS (SELECT c.l_suppkey, p_partkey, {FIXED} + {VARYING} AS score FROM c JOIN supplier ON s_suppkey = c.l_suppkey JOIN d ON d.p_brand = c.p_brand WHERE need IS NULL OR EXISTS (SELECT 1 FROM h WHERE h.l_suppkey = c.l_suppkey AND h.cert = need)),
    k AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY score DESC, p_partkey) AS rank FROM m) SELECT l_suppkey, p_partkey, score, rank FROM k WHERE rank <= 10""")
def recommend_notices(t):
    """The ten best parts, as notices, for each supplier: codes from three sources, the newest of each solicitation, certificates, scores."""
    notices = es.newest_of(t.part.withColumn("sol", F.concat_ws("|", "p_name", "p_brand", "p_type")), "sol", "p_partkey", "p_retailprice").withColumn("need", F.expr(NEED))
    line = t.lineitem.join(t.part.select("p_partkey", "p_brand"), F.col("p_partkey") == F.col("l_partkey"))
    codes = es.candidate_codes([line.where("l_quantity = 50"), line.where("l_quantity = 49"), line.where("l_discount > 0.09")], "l_suppkey", "p_brand").join(t.supplier, F.col("s_suppkey") == F.col("l_suppkey"))
    certs = t.lineitem.where("l_tax > 0.079").select("l_suppkey", "l_returnflag")
    return es.recommend(codes, notices, certs, "l_suppkey", "p_brand", "p_partkey", "need", 10, F.expr(FIXED), F.expr(VARYING), 15, 50, ("p_retailprice", "s_acctbal"))


P_CODE = "concat(lpad(CAST(p_size AS STRING), 2, '0'), p_brand)"
LINES = f"(SELECT l_suppkey AS partner, o_custkey AS org, o_orderpriority AS agency, o_orderdate AS signed, l_quantity AS q, l_returnflag AS flag, l_linestatus AS stat, l_tax, {P_CODE} AS code FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey)"
REQUESTS = "SELECT c_custkey AS request, c_custkey AS org, CASE WHEN c_nationkey > 2 THEN concat(lpad(CAST(1 + c_custkey % 50 AS STRING), 2, '0'), 'Brand#', 1 + c_custkey % 25) END AS code, CASE c_custkey % 3 WHEN 0 THEN '1-URGENT' WHEN 1 THEN '5-LOW' END AS agency, CASE WHEN c_nationkey % 2 = 0 THEN 'SB' END AS set_aside FROM customer WHERE c_acctbal > 0"
TYPE = "CASE WHEN s_nationkey % 4 = 1 THEN 'a2' WHEN s_nationkey % 4 = 2 THEN 'ZZ' WHEN s_nationkey % 4 = 3 THEN 'YY' END"


@query(f"""WITH f AS {LINES}, q AS ({REQUESTS}), t AS (SELECT s_suppkey AS partner, {TYPE} AS type FROM supplier WHERE {TYPE} IS NOT NULL), g AS (SELECT c_custkey AS org, CASE WHEN c_acctbal > 5000 THEN 'zz' ELSE 'Q' END AS type FROM customer),
    s AS (SELECT DISTINCT partner, org FROM f WHERE q = 50), pc AS (SELECT DISTINCT partner, code FROM f WHERE q >= 48), oc AS (SELECT DISTINCT org, code FROM f WHERE q = 47), aw AS (SELECT partner, agency, count(*) AS n FROM f WHERE signed >= TIMESTAMP '{AS_OF}' - INTERVAL 60 MONTH AND flag = 'R' GROUP BY 1, 2), tm AS (SELECT org, partner, count(*) AS n FROM f WHERE q = 50 GROUP BY 1, 2),
    x AS (SELECT s_suppkey AS partner, bool_or(s_acctbal < -900 OR s_nationkey % 7 = 0) AS barred FROM supplier WHERE s_acctbal < 1000 GROUP BY 1), ov AS (SELECT DISTINCT org, partner FROM pc JOIN oc ON oc.code = pc.code),
    m AS (SELECT DISTINCT request, partner FROM (SELECT request, partner FROM q JOIN s ON s.org = q.org UNION ALL SELECT request, f.partner FROM q JOIN f ON f.code = q.code WHERE f.q = 49 UNION ALL SELECT request, f.partner FROM q JOIN f ON f.agency = q.agency WHERE f.q = 46 AND f.l_tax > 0.079) z WHERE partner <> request % 50),
    r AS (SELECT m.request, m.partner, EXISTS (SELECT 1 FROM pc WHERE pc.partner = m.partner) AS anyc, EXISTS (SELECT 1 FROM pc WHERE pc.partner = m.partner AND pc.code = q.code) AS p1, EXISTS (SELECT 1 FROM oc WHERE oc.org = q.org AND oc.code = q.code) AS o1,
      EXISTS (SELECT 1 FROM pc WHERE pc.partner = m.partner AND left(pc.code, 2) = left(q.code, 2)) AS p2, EXISTS (SELECT 1 FROM oc WHERE oc.org = q.org AND left(oc.code, 2) = left(q.code, 2)) AS o2, ov.org IS NOT NULL AS ov, coalesce(aw.n, 0) AS na, coalesce(tm.n, 0) AS nt, t.type, upper(t.type) = upper(g.type) AS same, barred, q.agency, q.set_aside, s_nationkey <> 5 AS active
      FROM m JOIN q ON q.request = m.request JOIN supplier ON s_suppkey = m.partner JOIN g ON g.org = q.org LEFT JOIN t ON t.partner = m.partner LEFT JOIN aw ON aw.partner = m.partner AND aw.agency = q.agency LEFT JOIN tm ON tm.org = q.org AND tm.partner = m.partner LEFT JOIN ov ON ov.org = q.org AND ov.partner = m.partner LEFT JOIN x ON x.partner = m.partner),
    k AS (SELECT request, partner, CASE WHEN NOT anyc THEN 40 WHEN p1 AND NOT o1 THEN 100 WHEN p2 AND NOT o2 THEN 60 WHEN ov THEN 30 ELSE 60 END AS a, CASE WHEN agency IS NULL THEN 50 ELSE least(greatest(20 * na, 10), 100) END AS b, CASE WHEN nt >= 3 THEN 100 WHEN nt = 2 THEN 80 WHEN nt = 1 THEN 60 ELSE 20 END AS c,
      CASE WHEN set_aside IS NULL THEN 80 WHEN type IS NULL THEN 50 WHEN type = 'a2' THEN 70 ELSE 40 END AS d, CASE WHEN type IS NULL THEN 20 WHEN same THEN 40 ELSE 100 END AS e, CASE WHEN coalesce(barred, false) THEN 0 WHEN NOT active THEN 20 WHEN barred IS NOT NULL THEN 30 ELSE 100 END AS f,
      CAST(anyc AS INT) + CAST(agency IS NOT NULL AND na > 0 AS INT) + CAST(nt > 0 AS INT) + CAST(set_aside IS NULL OR type IS NOT NULL AS INT) + CAST(type IS NOT NULL AS INT) + 1 AS known FROM r),
    w AS (SELECT *, CAST(round_even((25 * a + 25 * b + 15 * c + 15 * d + 10 * e + 10 * f) / 100.0, 0) AS INT) AS score FROM k), z AS (SELECT *, row_number() OVER (PARTITION BY request ORDER BY score DESC, partner) AS rank FROM w)
    SELECT request, partner, score, CASE WHEN score >= 80 THEN 'Ideal' WHEN score >= 60 THEN 'Strong' WHEN score >= 40 THEN 'Acceptable' ELSE 'Poor' END AS category, CASE WHEN known >= 5 THEN 'High' WHEN known >= 3 THEN 'Medium' ELSE 'Low' END AS confidence, rank FROM z WHERE rank <= 10""")
def partner_finder(t):
    """The ten best partners for a request of each customer in credit, by all six factors."""
    f = t.lineitem.join(t.orders, F.col("o_orderkey") == F.col("l_orderkey")).join(t.part, F.col("p_partkey") == F.col("l_partkey"))
    f = f.selectExpr("l_suppkey AS partner", "o_custkey AS org", "o_orderpriority AS agency", "o_orderdate AS signed", "l_quantity AS q", "l_returnflag AS flag", "l_tax", f"{P_CODE} AS code")
    requests = t.customer.where("c_acctbal > 0").selectExpr("c_custkey AS request", "c_custkey AS org", "CASE WHEN c_nationkey > 2 THEN concat(lpad(CAST(1 + c_custkey % 50 AS STRING), 2, '0'), 'Brand#', 1 + c_custkey % 25) END AS code", "CASE c_custkey % 3 WHEN 0 THEN '1-URGENT' WHEN 1 THEN '5-LOW' END AS agency", "CASE WHEN c_nationkey % 2 = 0 THEN 'SB' END AS set_aside")
    own = requests.select("org", (F.col("org") % 50).alias("partner"))
    f = cut(f.where("q >= 46 or flag = 'R'"))
    now = F.lit(AS_OF).cast("timestamp")
    exclusions = t.supplier.where("s_acctbal < 1000").select(F.col("s_suppkey").alias("partner"), F.when(F.expr("NOT (s_acctbal < -900 OR s_nationkey % 7 = 0)"), now - F.expr("interval 1 day")).alias("ends"))
    facts = {
        "partner_codes": f.where("q >= 48").select("partner", "code"), "org_codes": f.where("q = 47").select("org", "code"), "awards": f.where("flag = 'R'").select("partner", "agency", "signed"), "subawards": f.where("q = 50").select("org", "partner"),
        "partner_types": t.supplier.selectExpr("s_suppkey AS partner", f"{TYPE} AS type"), "org_types": t.customer.selectExpr("c_custkey AS org", "CASE WHEN c_acctbal > 5000 THEN 'zz' ELSE 'Q' END AS type"), "exclusions": exclusions,
        "entities": t.supplier.selectExpr("s_suppkey AS partner", "s_nationkey <> 5 AS active"), "since": F.add_months(now, -60), "now": now,
    }
    best = pa.find_partners(requests, f.where("q = 50").select("org", "partner"), f.where("q = 49").select("code", "partner"), f.where("q = 46 and l_tax > 0.079").select("agency", "partner"), own, facts, 10)
    return best.select("request", "partner", "score", "category", "confidence", "rank")
