"""Views in full: patterns of re-compete by office, capabilities of partners and their mart, identifiers of notices and their predecessors."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tenderlake.functions import columns as c
from tenderlake.operators import changes as ch
from tenderlake.operators import identifiers as ids
from tenderlake.operators import relational as r
from tenderlake.operators import relevance as rel
from tenderlake.operators.scale import cut
from tenderlake.plans.catalogue import AS_OF, Tables, query

AWARD = "o_custkey AS office, p_size AS naics, p_size // 10 AS sector, l_suppkey AS vendor, l_returnflag AS aside, o_orderpriority AS competed, o_orderdate AS signed, l_shipdate AS done, l_shipdate + CASE WHEN l_quantity > 40 THEN INTERVAL 30 DAY ELSE INTERVAL 0 DAY END AS ultimate, o_orderkey, l_linenumber, l_extendedprice AS price"
LAST = "signed, o_orderkey, l_linenumber, vendor, aside, price"


@query(f"""WITH a AS (SELECT {AWARD} FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey WHERE o_orderdate >= TIMESTAMP '{AS_OF}' - INTERVAL 10 YEAR),
    w AS (SELECT *, lag(vendor) OVER x AS pv, lag(aside) OVER x AS pa, lag(naics) OVER (PARTITION BY office, sector ORDER BY {LAST}, naics) AS pn FROM a WINDOW x AS (PARTITION BY office, naics ORDER BY {LAST})),
    f AS (SELECT office, count(*) AS vendors, count(*) FILTER (first >= TIMESTAMP '{AS_OF}' - INTERVAL 5 YEAR) AS fresh FROM (SELECT office, vendor, min(signed) AS first FROM a GROUP BY 1, 2) GROUP BY 1),
    l AS (SELECT o_custkey AS office, avg(date_diff('day', o_orderdate, s)) AS lead FROM orders JOIN (SELECT l_orderkey, min(l_shipdate) AS s FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey GROUP BY 1),
    g AS (SELECT office, count(*) AS n, count(pv) AS kept_of, count(*) FILTER (vendor = pv) AS kept, count(pa) AS shift_of, count(*) FILTER (aside <> pa) AS shift, count(pn) AS moved_of, count(*) FILTER (naics <> pn) AS moved,
      count(*) FILTER (ultimate > done) AS bridged, count(*) FILTER (competed IN ('1-URGENT', '5-LOW')) AS sole FROM w GROUP BY 1)
    SELECT g.office, coalesce(round(100.0 * kept / nullif(kept_of, 0), 1), 0.0) AS retention_pct, round(100.0 * fresh / vendors, 1) AS entrant_pct, coalesce(round(100.0 * shift / nullif(shift_of, 0), 1), 0.0) AS shift_pct, round(coalesce(lead, 0), 1) AS lead_days,
      round(100.0 * bridged / n, 1) AS bridge_pct, round(100.0 * sole / n, 1) AS sole_pct, coalesce(round(100.0 * moved / nullif(moved_of, 0), 1), 0.0) AS moved_pct, n FROM g JOIN f ON f.office = g.office LEFT JOIN l ON l.office = g.office""")
def view_recompete_pattern(t):
    """One shuffle of the awards by office and sector serves both windows, since a code's sector follows from it; then sums by vendor, then by office."""
    joined = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    a = joined.where(F.col("o_orderdate") >= F.lit(AS_OF).cast("timestamp") - F.expr("interval 10 years")).selectExpr(*[x.strip().replace("//", "div") for x in AWARD.replace("INTERVAL 30 DAY", "INTERVAL 30 DAYS").replace("INTERVAL 0 DAY", "INTERVAL 0 DAYS").split(", ")])
    order = LAST.split(", ")
    code, sector = Window.partitionBy("office", "sector", "naics").orderBy(*order), Window.partitionBy("office", "sector").orderBy(*order, "naics")
    w = a.repartition("office", "sector").withColumn("pv", F.lag("vendor").over(code)).withColumn("pa", F.lag("aside").over(code)).withColumn("pn", F.lag("naics").over(sector))
    marks = {
        "n": F.lit(True), "kept_of": F.col("pv").isNotNull(), "kept": F.col("vendor") == F.col("pv"), "shift_of": F.col("pa").isNotNull(), "shift": F.col("aside") != F.col("pa"),
        "moved_of": F.col("pn").isNotNull(), "moved": F.col("naics") != F.col("pn"), "bridged": F.col("ultimate") > F.col("done"), "sole": F.col("competed").isin("1-URGENT", "5-LOW"),
    }
    by_vendor = w.groupBy("office", "vendor").agg(F.min("signed").alias("first"), *[F.count_if(v).alias(k) for k, v in marks.items()])
    fresh = F.col("first") >= F.lit(AS_OF).cast("timestamp") - F.expr("interval 5 years")
    g = by_vendor.groupBy("office").agg(F.count(F.lit(1)).alias("vendors"), F.count_if(fresh).alias("fresh"), *[F.sum(k).alias(k) for k in marks])
    first = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("l_shipdate").alias("s"))
    lead = t.orders.join(first, "o_orderkey").groupBy(F.col("o_custkey").alias("office")).agg(F.avg(F.datediff("s", "o_orderdate")).alias("lead"))
    pct = lambda part, whole: F.coalesce(c.safe_pct(F.col(part), F.col(whole)), F.lit(0.0))
    return g.join(lead, "office", "left").select(
        "office", pct("kept", "kept_of").alias("retention_pct"), pct("fresh", "vendors").alias("entrant_pct"), pct("shift", "shift_of").alias("shift_pct"), F.round(F.coalesce("lead", F.lit(0.0)), 1).alias("lead_days"),
        pct("bridged", "n").alias("bridge_pct"), pct("sole", "n").alias("sole_pct"), pct("moved", "moved_of").alias("moved_pct"), "n",
    )


CHANGED_FROM = "2001-06-01"
CAPABILITY = f"""n AS (SELECT l_suppkey, string_agg(DISTINCT p_brand, ', ' ORDER BY p_brand) AS codes FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_quantity > 45 GROUP BY 1), p AS (SELECT l_suppkey, string_agg(DISTINCT p_type, ', ' ORDER BY p_type) AS products FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1),
    s AS (SELECT l_suppkey, string_agg(DISTINCT l_returnflag || l_linestatus, ', ' ORDER BY l_returnflag || l_linestatus) AS programs FROM lineitem WHERE l_shipdate > TIMESTAMP '{AS_OF}' GROUP BY 1),
    h AS (SELECT l_suppkey, count(*) AS n, sum(CAST(l_extendedprice AS DECIMAL(15,2))) AS value, string_agg(DISTINCT o_orderpriority, ', ' ORDER BY o_orderpriority) AS agencies FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1)
    SELECT s_suppkey, s_name, s_nationkey, codes, products, programs, coalesce(agencies, '') AS agencies, coalesce(h.n, 0) AS n_contracts, CAST(coalesce(value, 0) AS DOUBLE) AS value FROM supplier
      LEFT JOIN n ON n.l_suppkey = s_suppkey LEFT JOIN p ON p.l_suppkey = s_suppkey LEFT JOIN s ON s.l_suppkey = s_suppkey LEFT JOIN h ON h.l_suppkey = s_suppkey WHERE s_acctbal > 0"""


def capabilities(t: Tables, lines: DataFrame, vendors: DataFrame) -> DataFrame:
    """A row for each active vendor. Lines meet parts and orders apart, with no more columns than each side takes, and are summed by vendor before the sides meet, so children never multiply each other."""
    listed = lambda x: F.array_join(F.array_sort(F.collect_set(x)), ", ")
    filled = lambda x: F.when(x != "", x)
    vendor = F.col("l_suppkey").alias("s_suppkey")
    made = lines.select(vendor, "l_partkey", (F.col("l_quantity") > 45).alias("large")).join(t.part.select("p_partkey", "p_brand", "p_type"), F.col("p_partkey") == F.col("l_partkey"))
    made = made.groupBy("s_suppkey").agg(listed(F.when(F.col("large"), F.col("p_brand"))).alias("codes"), listed("p_type").alias("products"))
    held = lines.where(F.col("l_shipdate") > F.lit(AS_OF).cast("timestamp")).select(vendor, F.concat("l_returnflag", "l_linestatus").alias("program")).groupBy("s_suppkey").agg(listed("program").alias("programs"))
    won = lines.select(vendor, "l_orderkey", "l_extendedprice").join(t.orders.select("o_orderkey", "o_orderpriority"), F.col("o_orderkey") == F.col("l_orderkey"))
    won = won.groupBy("s_suppkey").agg(listed("o_orderpriority").alias("agencies"), F.count(F.lit(1)).alias("n_contracts"), F.sum(c.money(F.col("l_extendedprice"))).alias("value"))
    out = vendors.where("s_acctbal > 0").join(made, "s_suppkey", "left").join(held, "s_suppkey", "left").join(won, "s_suppkey", "left")
    return out.select("s_suppkey", "s_name", "s_nationkey", *[filled(F.col(x)).alias(x) for x in ("codes", "products", "programs")], F.coalesce("agencies", F.lit("")).alias("agencies"), F.coalesce("n_contracts", F.lit(0)).alias("n_contracts"), F.coalesce("value", F.lit(0)).cast("double").alias("value"))


@query("WITH " + CAPABILITY)
def view_partner_capability_match(t):
    return capabilities(t, t.lineitem, t.supplier)


@query("WITH " + CAPABILITY)
def mart_partner_capability_refresh(t):
    """The mart as of a day, brought up to date by the lines since: only vendors that have any are computed again, and the result is the whole mart.

    Of the mart as it was only the vendors that stay are made, so a line is read for one of the two alone.
    """
    new = F.coalesce(F.col("l_shipdate") >= F.lit(CHANGED_FROM).cast("timestamp"), F.lit(False))
    changed = t.lineitem.where(new).select(F.col("l_suppkey").alias("s_suppkey")).distinct()
    of = lambda df, key, how: df.join(F.broadcast(changed.select(F.col("s_suppkey").alias("_changed"))), F.col(key) == F.col("_changed"), how)
    mart, fresh = (capabilities(t, of(t.lineitem, "l_suppkey", how), of(t.supplier, "s_suppkey", how)) for how in ("left_anti", "left_semi"))
    return ch.refresh_rows(mart, changed, fresh, ["s_suppkey"])


NUMBER = "concat('W91QF', right(CAST(year({0}date) AS STRING), 2), {1}, lpad(CAST({0}key AS STRING), 7, '0'))"
NOTICES = f"""SELECT o_orderkey, o_custkey, {NUMBER.format('before_', "'C'")} AS prior, o_orderkey % 5 AS form FROM (SELECT o_orderkey, o_custkey, lag(o_orderkey) OVER w AS before_key, lag(o_orderdate) OVER w AS before_date FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)) WHERE before_key IS NOT NULL"""
DASHED = "concat(left(prior, 5), '-', substring(prior, 6, 2), '-C-', right(prior, 7))"
FAR = "repeat('no number here at all, ', 12)"
NOTICE_TEXT = f"""CASE form WHEN 0 THEN concat('It follows contract ', {DASHED}, ' and ', prior, '.') WHEN 1 THEN concat(prior, ' ends. UEI: CUST', lpad(CAST(o_custkey AS STRING), 8, '0'), ', CAGE 1AB', o_custkey % 10, '5; ', {FAR}, 'CUST99999999')
    WHEN 2 THEN concat({DASHED}, ' ', {FAR}, 'under a contract. DUNS ', lpad(CAST(o_custkey AS STRING), 9, '0')) WHEN 3 THEN concat('Wage determination 2015-', 1000 + o_custkey % 9000, ' under GS-35F-12', 10 + o_custkey % 90, 'A, award CONT_AWD_', o_orderkey, ' 52.212-4 252.204-7012') ELSE concat('RFQ ', replace(prior, 'C', 'Q'), ' and ', prior, ' and again ', prior) END"""
EXPECTED = f"""x AS ({NOTICES}), e AS (SELECT o_orderkey, 'PIID' AS kind, prior AS value, 'medium' AS confidence FROM x WHERE form IN (0, 1, 4) UNION ALL SELECT o_orderkey, 'SOLICITATION', replace(prior, 'C', 'Q'), 'medium' FROM x WHERE form = 4
    UNION ALL SELECT o_orderkey, 'UEI', concat('CUST', lpad(CAST(o_custkey AS STRING), 8, '0')), 'medium' FROM x WHERE form = 1 UNION ALL SELECT o_orderkey, 'CAGE', concat('1AB', o_custkey % 10, '5'), 'high' FROM x WHERE form = 1
    UNION ALL SELECT o_orderkey, 'DUNS', lpad(CAST(o_custkey AS STRING), 9, '0'), 'medium' FROM x WHERE form = 2 UNION ALL SELECT o_orderkey, 'WAGE_DET', concat('2015-', 1000 + o_custkey % 9000), 'medium' FROM x WHERE form = 3 UNION ALL SELECT o_orderkey, 'GSA_SCHEDULE', concat('GS35F12', 10 + o_custkey % 90, 'A'), 'high' FROM x WHERE form = 3
    UNION ALL SELECT o_orderkey, 'USASPENDING_ID', concat('CONT_AWD_', o_orderkey), 'high' FROM x WHERE form = 3 UNION ALL SELECT o_orderkey, 'FAR_CLAUSE', '52.212-4', 'high' FROM x WHERE form = 3 UNION ALL SELECT o_orderkey, 'DFARS_CLAUSE', '252.204-7012', 'high' FROM x WHERE form = 3)"""


def notices(t: Tables) -> DataFrame:
    """A text for each order that tells of the customer's order before, in one of five forms."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    before = t.orders.withColumn("before_key", F.lag("o_orderkey").over(w)).withColumn("before_date", F.lag("o_orderdate").over(w)).where("before_key is not null")
    rows = before.selectExpr("o_orderkey", "o_custkey", f"{NUMBER.format('before_', chr(39) + 'C' + chr(39))} AS prior", "o_orderkey % 5 AS form")
    return rows.selectExpr("o_orderkey", "o_custkey", f"{NOTICE_TEXT} AS text")


@query(f"WITH {EXPECTED} SELECT o_orderkey, kind, value, confidence FROM e")
def identifiers_in_notices(t):
    return ids.extract_identifiers(notices(t), "o_orderkey", "text").select("o_orderkey", "kind", "value", "confidence")


@query(f"WITH {EXPECTED} SELECT o_custkey, kind, value, confidence, count(*) AS mention_count FROM e JOIN orders ON orders.o_orderkey = e.o_orderkey GROUP BY ALL")
def view_identifier_refs(t):
    """Each customer as a notice whose documents are those of its orders."""
    found = ids.extract_identifiers(notices(t), "o_orderkey", "text")
    return ids.notice_refs(found, "o_orderkey", t.orders, "o_custkey", ["kind", "value", "confidence"])


@query(f"""WITH {EXPECTED}, a AS (SELECT {NUMBER.format('o_order', "'C'")} AS value, o_orderkey AS award, o_orderpriority, o_totalprice FROM orders)
    SELECT orders.o_custkey, e.value, award, a.o_orderpriority, a.o_totalprice, confidence, count(DISTINCT e.o_orderkey) AS document_mentions FROM e JOIN orders ON orders.o_orderkey = e.o_orderkey JOIN a ON a.value = e.value WHERE kind IN ('PIID', 'SOLICITATION') GROUP BY ALL""")
def view_predecessor_candidates(t):
    awards = t.orders.selectExpr(f"{NUMBER.format('o_order', chr(39) + 'C' + chr(39))} AS value", "o_orderkey AS award", "o_orderpriority", "o_totalprice")
    found = ids.extract_identifiers(notices(t), "o_orderkey", "text")
    return ids.predecessors(found, "o_orderkey", t.orders, "o_custkey", awards, "value", ["award", "o_orderpriority", "o_totalprice"])


PAST = f"""SELECT concat(l_suppkey, '|', p_brand, '|', p_type) AS past_id, l_suppkey AS org_id, p_brand AS code, CASE WHEN p_type <> 'PROMO' THEN p_type END AS agency, CASE WHEN max(l_discount) > 0.01 THEN max(l_extendedprice) / 50.0 END AS value, date_diff(DAY, max(l_shipdate), TIMESTAMP '{AS_OF}') / 365.25 AS years FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_quantity = 50 AND l_tax > 0.07 GROUP BY l_suppkey, p_brand, p_type"""
WANTED = "SELECT p_partkey AS notice_id, p_brand AS code, p_type AS agency, CASE WHEN p_size % 5 > 0 THEN p_retailprice END AS value FROM part WHERE p_size > 10"
OWN_CODES = "SELECT DISTINCT l_suppkey AS org_id, p_brand AS code FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_quantity = 50 AND l_tax < 0.01"


@query(f"""WITH p AS ({PAST.replace('date_diff(DAY, ', "date_diff('day', ")}), o AS ({WANTED}), n AS ({OWN_CODES}), m AS (SELECT past_id, notice_id, p.code IS NOT DISTINCT FROM o.code AS code_match, coalesce(p.agency = o.agency, false) AS agency_match,
      CASE WHEN p.value > 0 AND o.value > 0 THEN least(p.value, o.value) / greatest(p.value, o.value) END AS alike, years FROM p JOIN o ON o.code = p.code OR EXISTS (SELECT 1 FROM n WHERE n.org_id = p.org_id AND n.code = o.code)),
    s AS (SELECT *, CASE WHEN code_match THEN 35.0::DOUBLE ELSE 0.0 END + CASE WHEN agency_match THEN 25.0::DOUBLE ELSE 0.0 END + coalesce(alike, 0.0) * 20.0::DOUBLE + CASE WHEN years <= 3 THEN 20.0::DOUBLE WHEN years <= 5 THEN 10.0 ELSE 0.0 END AS score FROM m),
    k AS (SELECT *, row_number() OVER (PARTITION BY past_id ORDER BY score DESC, notice_id) AS rank FROM s) SELECT past_id, notice_id, code_match, agency_match, round(alike, 2) AS value_similarity, round(score, 1) AS score, rank FROM k WHERE rank <= 100""")
def view_past_performance_match(t):
    """The hundred most relevant parts, as notices, for each past contract, through its own code or any of its supplier's."""
    line = t.lineitem.join(t.part, F.col("p_partkey") == F.col("l_partkey")).where("l_quantity = 50 and (l_tax > 0.07 or l_tax < 0.01)")
    line = cut(line.select("l_suppkey", "l_tax", "l_shipdate", "l_discount", "l_extendedprice", "p_brand", "p_type"))  # else each of the joins below sends the parts again
    day = F.datediff(F.lit(AS_OF).cast("date"), F.max("l_shipdate"))
    value = F.when(F.max("l_discount") > 0.01, F.max("l_extendedprice") / 50.0)
    past = line.where("l_tax > 0.07").groupBy("l_suppkey", "p_brand", "p_type").agg(value.alias("value"), (day / 365.25).alias("years"))
    past = past.select(F.concat_ws("|", "l_suppkey", "p_brand", "p_type").alias("past_id"), F.col("l_suppkey").alias("org_id"), F.col("p_brand").alias("code"), F.when(F.col("p_type") != "PROMO", F.col("p_type")).alias("agency"), "value", "years")
    notices = t.part.where("p_size > 10").select(F.col("p_partkey").alias("notice_id"), F.col("p_brand").alias("code"), F.col("p_type").alias("agency"), F.when(F.col("p_size") % 5 > 0, F.col("p_retailprice")).alias("value"))
    own = line.where("l_tax < 0.01").select(F.col("l_suppkey").alias("org_id"), F.col("p_brand").alias("code")).distinct()
    return rel.most_relevant(past, notices, own, 100)


@query("""WITH g AS (SELECT l_suppkey, p_brand, max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS lead, count(*) AS n FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2)
    SELECT l_suppkey, string_agg(p_brand, ', ' ORDER BY lead DESC, n DESC, p_brand) AS listed FROM g GROUP BY 1""")
def listed_by_rank(t):
    """Every brand of a vendor, those with a mark first, then the most frequent."""
    lines = t.lineitem.join(t.part, F.col("p_partkey") == F.col("l_partkey")).select("l_suppkey", "p_brand", "l_returnflag")
    return r.concat_ranked(lines, ["l_suppkey"], "p_brand", [-F.max(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)), -F.count(F.lit(1))])


CHECKS = (
    ("XSV-001", "suppliers", "SELECT s_suppkey FROM supplier", "suppliers in lines", "SELECT DISTINCT l_suppkey FROM lineitem"), ("XSV-002", "orders open", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O'", "orders closed", "SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'O'"),
    ("XSV-003", "orders", "SELECT o_orderkey FROM orders", "orders in lines", "SELECT DISTINCT l_orderkey FROM lineitem"), ("XSV-004", "customers", "SELECT c_custkey FROM customer", "customers in orders", "SELECT DISTINCT o_custkey FROM orders"),
    ("XSV-005", "lines without order", "SELECT l_orderkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)", "lines without part", "SELECT l_partkey FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part)"),
)
COUNTS = " UNION ALL ".join(f"SELECT '{i}' AS check_id, '{a}' AS source_a, (SELECT count(*) FROM ({x})) AS n_a, '{b}' AS source_b, (SELECT count(*) FROM ({y})) AS n_b" for i, a, x, b, y in CHECKS)


@query(f"""WITH c AS ({COUNTS}), d AS (SELECT *, abs(n_a - n_b) AS difference, CASE WHEN greatest(n_a, n_b) > 0 THEN abs(n_a - n_b)::DOUBLE / greatest(n_a, n_b) ELSE 0 END AS share FROM c)
    SELECT check_id, source_a, n_a, source_b, n_b, difference, round(100.0::DOUBLE * share, 1) AS pct_difference, CASE WHEN share > 0.5 THEN 'ERROR' WHEN share > 0.2 THEN 'WARNING' ELSE 'OK' END AS status FROM d""")
def view_cross_source_checks(t):
    """Five checks of counts against each other; rows without a partner by anti-joins."""
    lines, orders, parts = t.lineitem, t.orders, t.part
    sides = [
        (t.supplier, lines.select("l_suppkey").distinct()), (orders.where("o_orderstatus = 'O'"), orders.where("o_orderstatus <> 'O'")), (orders, lines.select("l_orderkey").distinct()), (t.customer, orders.select("o_custkey").distinct()),
        (lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"), "left_anti"), lines.join(parts, F.col("l_partkey") == F.col("p_partkey"), "left_anti")),
    ]
    return r.count_checks([(i, a, x, b, y) for (i, a, _, b, _), (x, y) in zip(CHECKS, sides, strict=True)])
