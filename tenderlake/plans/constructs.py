"""Named queries for filters, joins, orders, votes and column functions, registered in the catalogue with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tenderlake.functions import columns as c
from tenderlake.operators import changes as ch
from tenderlake.operators import relational as r
from tenderlake.plans.catalogue import AS_OF, awards, n_rows, query

PRICE = "CAST(l_extendedprice AS DECIMAL(15,2))"
CRITERIA = {"priorities": ["1-URGENT", "2-HIGH"], "status": "O", "least_value": 50000, "most_value": 200000, "from": "1996-01-01", "until": "2001-01-01", "named": "", "pattern": None}
SPEC = {
    "priorities": ("in", "o_orderpriority"), "status": ("equals", "o_orderstatus"), "least_value": ("least", "o_totalprice"), "most_value": ("most", "o_totalprice"), "from": ("after", "o_orderdate"), "until": ("before", "o_orderdate"),
    "named": ("contains", "o_orderpriority"), "pattern": ("like", "o_orderpriority"),
}


@query("""SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'widget')""")
def contains_search(t):
    return t.part.where(c.contains_text(F.col("p_name"), "WIDGET")).select("p_partkey", "p_name")


@query("""SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority LIKE '%NOT%FIED%'""")
def wildcard_search(t):
    return t.orders.where(F.col("o_orderpriority").like("%NOT%FIED%")).select("o_orderkey", "o_orderpriority")


@query("""SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderstatus = 'O' AND o_totalprice >= 50000 AND o_totalprice <= 200000 AND o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '2001-01-01'""")
def criteria_filter(t):
    return t.orders.where(r.compile_filter(CRITERIA, SPEC)).select("o_orderkey")


@query("""SELECT o_orderkey, o_totalprice, (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS total FROM orders WHERE o_orderstatus = 'F' ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 50""")
def page_with_total(t):
    found = t.orders.where("o_orderstatus = 'F'").select("o_orderkey", "o_totalprice")
    return r.page_with_total(found, [F.desc("o_totalprice"), F.asc("o_orderkey")], 3, 25)


@query("""SELECT d.doc_id, quality FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id ORDER BY quality IS NOT NULL, quality, d.doc_id LIMIT 100""")
def order_unset_first(t):
    joined = t.documents.select("doc_id").join(t.labels.select("doc_id", "quality"), "doc_id", "left")
    return joined.orderBy(F.col("quality").isNotNull(), F.asc("quality"), F.asc("doc_id")).limit(100)


@query("""SELECT o_orderkey, CAST(CASE o_orderstatus WHEN 'P' THEN 1 WHEN 'O' THEN 2 ELSE 0 END AS BIGINT) AS place FROM orders ORDER BY place, o_orderkey LIMIT 100""")
def order_by_list(t):
    return t.orders.select("o_orderkey", c.enum_rank(F.col("o_orderstatus"), ["P", "O"]).alias("place")).orderBy("place", "o_orderkey").limit(100)


@query("""SELECT d.doc_id, quality FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id ORDER BY quality DESC NULLS LAST, d.doc_id LIMIT 100""")
def order_score_nulls_last(t):
    joined = t.documents.select("doc_id").join(t.labels.select("doc_id", "quality"), "doc_id", "left")
    return joined.orderBy(F.desc_nulls_last("quality"), F.asc("doc_id")).limit(100)


@query("""SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 280000""")
def left_join_filtered(t):
    large = t.orders.where("o_totalprice > 280000").select("o_custkey", "o_orderkey")
    return t.customer.select("c_custkey").join(large, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "o_orderkey")


@query("""SELECT s_suppkey, c_custkey FROM supplier JOIN customer ON c_acctbal > 9000 AND s_acctbal < 3000 AND (c_nationkey = s_nationkey OR EXISTS (SELECT 1 FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey = s_nationkey AND b.n_nationkey = c_nationkey))""")
def any_key_pairs(t):
    """A supplier meets customers of its nation and of the nations of its region: its keys are widened, then joined once."""
    suppliers = t.supplier.where("s_acctbal < 3000").select("s_suppkey", "s_nationkey")
    near = t.nation.alias("a").join(t.nation.alias("b"), F.col("a.n_regionkey") == F.col("b.n_regionkey")).select(F.col("a.n_nationkey").alias("s_nationkey"), F.col("b.n_nationkey").alias("nation"))
    keys = [suppliers.select("s_suppkey", F.col("s_nationkey").alias("nation")), suppliers.join(near, "s_nationkey").select("s_suppkey", "nation")]
    customers = t.customer.where("c_acctbal > 9000").select("c_custkey", F.col("c_nationkey").alias("nation"))
    return r.any_key_join(suppliers.select("s_suppkey"), customers, "s_suppkey", keys, "nation")


@query("""SELECT c_custkey, o.n, o.value FROM customer LEFT JOIN LATERAL (SELECT count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(15,2))) AS DOUBLE) AS value FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') o ON true""")
def lateral_aggregate(t):
    sums = t.orders.where("o_orderstatus = 'F'").groupBy("o_custkey").agg(n_rows().alias("n"), F.sum(c.money(F.col("o_totalprice"))).cast("double").alias("value"))
    joined = t.customer.select("c_custkey").join(sums, F.col("c_custkey") == F.col("o_custkey"), "left")
    return joined.select("c_custkey", F.coalesce("n", F.lit(0)).cast("long").alias("n"), "value")


@query("""SELECT (SELECT count(*) FROM documents) AS documents, (SELECT count(lang) FROM documents) AS with_lang, (SELECT count(*) FROM labels) AS labels, (SELECT count(*) FROM labels WHERE toxic = 1) AS toxic""")
def one_row_totals(t):
    docs = t.documents.agg(n_rows().alias("documents"), F.count("lang").alias("with_lang"))
    return docs.crossJoin(F.broadcast(t.labels.agg(n_rows().alias("labels"), F.count_if(F.col("toxic") == 1).alias("toxic"))))


@query(f"""SELECT s_suppkey, n_lines, value, n_customers, n_nation FROM supplier
    LEFT JOIN (SELECT l_suppkey, count(*) AS n_lines, CAST(sum({PRICE}) AS DOUBLE) AS value FROM lineitem GROUP BY 1) a ON a.l_suppkey = s_suppkey
    LEFT JOIN (SELECT l_suppkey, count(DISTINCT o_custkey) AS n_customers FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1) b ON b.l_suppkey = s_suppkey
    LEFT JOIN (SELECT s_nationkey AS k, count(*) AS n_nation FROM supplier GROUP BY 1) n ON n.k = s_nationkey""")
def children_aggregated(t):
    line = awards(t).select(F.col("l_suppkey").alias("s_suppkey"), "value", "l_orderkey")
    orders = line.join(t.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    children = [(line, [n_rows().alias("n_lines"), F.sum("value").cast("double").alias("value")]), (orders, [F.count_distinct("o_custkey").alias("n_customers")])]
    out = r.with_children(t.supplier.select("s_suppkey", "s_nationkey"), "s_suppkey", children)
    return out.join(t.supplier.groupBy("s_nationkey").agg(n_rows().alias("n_nation")), "s_nationkey", "left").drop("s_nationkey")


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_suppkey IN (1, 2, 3) THEN l_partkey ELSE l_suppkey END AS partner FROM lineitem WHERE l_suppkey IN (1, 2, 3) OR l_partkey IN (1, 2, 3)""")
def partner_select(t):
    own = [1, 2, 3]
    rows = t.lineitem.where(F.col("l_suppkey").isin(own) | F.col("l_partkey").isin(own))
    return rows.select("l_orderkey", "l_linenumber", r.partner_of("l_suppkey", "l_partkey", own).alias("partner"))


@query("""SELECT l_suppkey, string_agg(DISTINCT concat(p_brand, ': ', p_type), '; ' ORDER BY concat(p_brand, ': ', p_type)) AS listed FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1""")
def concat_pairs(t):
    named = t.lineitem.join(t.part, F.col("p_partkey") == F.col("l_partkey")).select("l_suppkey", F.concat_ws(": ", "p_brand", "p_type").alias("pair"))
    return r.concat_distinct(named, ["l_suppkey"], "pair", "; ")


@query("""WITH k AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders WHERE o_orderstatus = 'F')
    SELECT o.o_custkey, bool_or(o.o_orderpriority = '1-URGENT') AS ever_urgent, max(k.o_totalprice) AS last_final FROM orders o LEFT JOIN k ON k.o_custkey = o.o_custkey AND rn = 1 GROUP BY 1""")
def conditional_latest(t):
    final = F.col("o_orderstatus") == "F"
    last = F.max_by("o_totalprice", F.when(final, F.struct("o_orderdate", "o_orderkey")))
    return t.orders.groupBy("o_custkey").agg(F.bool_or(F.col("o_orderpriority") == "1-URGENT").alias("ever_urgent"), F.when(F.count_if(final) > 0, last).alias("last_final"))


@query("""WITH x AS (SELECT p_brand, l_extendedprice / (l_quantity * p_retailprice) AS ratio FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_quantity > 0 AND p_retailprice > 0)
    SELECT p_brand, count(*) AS n, round(avg(ratio), 6) AS mean, round(quantile_cont(ratio, 0.5), 6) AS median FROM x GROUP BY 1 HAVING count(*) >= 3""")
def ratio_statistics(t):
    rows = t.lineitem.join(t.part, F.col("p_partkey") == F.col("l_partkey")).where("l_quantity > 0 and p_retailprice > 0")
    ratios = rows.select("p_brand", (F.col("l_extendedprice") / (F.col("l_quantity") * F.col("p_retailprice"))).alias("ratio"))
    return ratios.groupBy("p_brand").agg(n_rows().alias("n"), F.round(F.avg("ratio"), 6).alias("mean"), F.round(F.percentile("ratio", F.lit(0.5)), 6).alias("median")).where("n >= 3")


@query("""WITH v AS (SELECT o_custkey, o_orderpriority, count(*) AS votes, max(o_totalprice) AS best FROM orders GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY votes DESC, best DESC, o_orderpriority) AS rn FROM v)
    SELECT o_custkey, o_orderpriority, votes, best FROM k WHERE rn = 1""")
def majority_vote(t):
    return r.vote(t.orders.select("o_custkey", "o_orderpriority", "o_totalprice"), ["o_custkey"], "o_orderpriority", "o_totalprice")


@query("""SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, l_suppkey LIMIT 20""")
def value_frequency(t):
    return r.value_frequency(t.lineitem, "l_suppkey", 20)


@query("""SELECT o_orderkey, lag(o_totalprice) OVER (PARTITION BY substr(o_orderpriority, 1, 1), o_custkey ORDER BY o_orderdate, o_orderkey) AS previous FROM orders""")
def lag_by_prefix(t):
    keyed = t.orders.select("o_orderkey", "o_totalprice", "o_orderdate", "o_custkey", F.substring("o_orderpriority", 1, 1).alias("prefix"))
    return r.lag_compare(keyed, ["prefix", "o_custkey"], [F.asc("o_orderdate"), F.asc("o_orderkey")], "o_totalprice").select("o_orderkey", "previous")


@query("""SELECT o_orderkey, count(*) FILTER (o_orderstatus = 'F') OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) AS wins FROM orders""")
def running_wins(t):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(Window.unboundedPreceding, 0)
    return t.orders.select("o_orderkey", F.count_if(F.col("o_orderstatus") == "F").over(w).alias("wins"))


@query("""SELECT event_id, coalesce(CAST(json_extract(props, '$.k') AS BIGINT) > 50, false) AS is_high, substr(event_type, 1, 4) AS short_type FROM events""")
def generated_columns(t):
    return t.events.select("event_id", F.coalesce(c.json_number(F.col("props"), "k") > 50, F.lit(False)).alias("is_high"), c.truncated(F.col("event_type"), 4).alias("short_type"))


@query("""SELECT DISTINCT lower(regexp_replace(concat(p_type, CASE p_size % 4 WHEN 0 THEN ' II' WHEN 1 THEN ' iv' WHEN 2 THEN ' X' ELSE '' END), ' (X|IX|VIII|VII|VI|V|IV|III|II|I)$', '', 'i')) AS category FROM part""")
def strip_numerals(t):
    """Of a category's levels the name remains."""
    suffix = F.expr("case p_size % 4 when 0 then ' II' when 1 then ' iv' when 2 then ' X' else '' end")
    return t.part.select(F.lower(c.strip_numeral(F.concat("p_type", suffix))).alias("category")).distinct()


@query("""SELECT o_orderkey, unnest([o_orderstatus, o_orderpriority]) AS code, unnest([CASE WHEN o_totalprice > 100000 THEN 'Y' ELSE 'N' END, NULL]) AS flag FROM orders""")
def flagged_code_list(t):
    listed = F.concat("o_orderstatus", F.when(F.col("o_totalprice") > 100000, "Y").otherwise("N"), F.lit("~ ~"), "o_orderpriority", F.lit("~"))
    return t.orders.select("o_orderkey", F.inline(c.flagged_codes(listed)))


@query("""SELECT c_custkey, CASE WHEN length(z) >= 9 THEN substr(z, 1, 5) || '-' || substr(z, 6, 4) WHEN length(z) >= 5 THEN substr(z, 1, 5) END AS zip FROM (SELECT c_custkey, CAST(c_custkey * 7919 AS VARCHAR) AS z FROM customer)""")
def zip_codes(t):
    raw = F.concat(F.lit(" "), (F.col("c_custkey") * 7919).cast("string"), F.lit("-"))
    return t.customer.select("c_custkey", c.zip_code(raw).alias("zip"))


@query("""SELECT o_orderkey, strftime(CASE WHEN o_orderstatus IN ('F', 'O') OR o_totalprice > 100000 THEN o_orderdate END, '%Y-%m-%d') AS day FROM orders""")
def parse_dates(t):
    """Dates in three notations and one that is none: what cannot be read is null."""
    text = F.when(F.col("o_orderstatus") == "F", F.date_format("o_orderdate", "MM/dd/yyyy")).when(F.col("o_orderstatus") == "O", F.date_format("o_orderdate", "yyyyMMdd")).when(F.col("o_totalprice") > 100000, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(F.lit("soon"))
    return t.orders.select("o_orderkey", c.parse_date(text, ["MM/dd/yyyy", "yyyyMMdd", "yyyy-MM-dd"]).cast("string").alias("day"))


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN CAST(CAST(o_totalprice AS DECIMAL(15,2)) AS DOUBLE) END AS price FROM orders""")
def parse_decimals(t):
    text = F.when(F.col("o_orderstatus") == "P", F.lit("n/a")).otherwise(F.concat(F.lit(" $"), F.format_number("o_totalprice", 2)))
    return t.orders.select("o_orderkey", c.parse_decimal(text).cast("double").alias("price"))


@query("""SELECT l_orderkey, l_linenumber, CAST((year(l_shipdate) - year(o_orderdate)) * 12 + month(l_shipdate) - month(o_orderdate) AS BIGINT) AS months, CAST((year(l_shipdate) - year(o_orderdate)) * 12 + month(l_shipdate) - month(o_orderdate) + 1 AS BIGINT) AS months_inclusive FROM lineitem JOIN orders ON o_orderkey = l_orderkey""")
def months_apart(t):
    rows = t.lineitem.join(t.orders, F.col("o_orderkey") == F.col("l_orderkey"))
    ends = F.col("o_orderdate"), F.col("l_shipdate")
    return rows.select("l_orderkey", "l_linenumber", c.months_apart(*ends).alias("months"), c.months_apart(*ends, inclusive=True).alias("months_inclusive"))


@query("""SELECT o_orderkey, unnest(list_filter([CASE WHEN o_totalprice > 150000 THEN 'large' END, CASE WHEN o_orderpriority = '1-URGENT' THEN 'urgent' END], lambda x: x IS NOT NULL)) AS flag FROM orders""")
def json_true_keys(t):
    flags = F.to_json(F.struct((F.col("o_totalprice") > 150000).alias("large"), (F.col("o_orderpriority") == "1-URGENT").alias("urgent"), F.lit(False).alias("never")))
    return t.orders.select("o_orderkey", F.explode(c.true_keys(flags)).alias("flag"))


@query("""SELECT p_partkey, CAST(length(CAST(p_partkey + 100 AS VARCHAR)) - 1 AS BIGINT) AS level, CASE WHEN length(CAST(p_partkey + 100 AS VARCHAR)) > 2 THEN substr(CAST(p_partkey + 100 AS VARCHAR), 1, length(CAST(p_partkey + 100 AS VARCHAR)) - 1) END AS parent FROM part""")
def code_hierarchy(t):
    place = c.industry_level(F.concat((F.col("p_partkey") + 100).cast("string"), F.lit("a")))
    return t.part.select("p_partkey", place["level"].alias("level"), place["parent"].alias("parent"))


@query("""SELECT page_id, split_part(regexp_extract(url, '^[A-Za-z]+://([^/?#]+)', 1), '.', 1) AS label, md5(url) AS resource FROM pages""")
def url_parts(t):
    marked = F.concat(F.lit("https://files.example.org/api/"), F.upper(F.md5("url")), F.lit("/download"))
    return t.pages.select("page_id", F.substring_index(c.url_host(F.col("url")), ".", 1).alias("label"), c.guid(marked).alias("resource"))


@query("""SELECT o_orderkey, CASE WHEN o_totalprice > 0 AND c_acctbal > 0 THEN round(least(o_totalprice, c_acctbal) / greatest(o_totalprice, c_acctbal), 8) END AS ratio FROM orders JOIN customer ON c_custkey = o_custkey""")
def value_similarity(t):
    rows = t.orders.join(t.customer, F.col("c_custkey") == F.col("o_custkey"))
    return rows.select("o_orderkey", F.round(c.value_ratio(F.col("o_totalprice"), F.col("c_acctbal")), 8).alias("ratio"))


@query("""WITH k AS (SELECT d.doc_id, sha256(text) AS h, (quality IS NOT NULL)::INT + (toxic IS NOT NULL)::INT AS evidence FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)
    SELECT doc_id, first_value(doc_id) OVER (PARTITION BY h ORDER BY evidence DESC, doc_id) AS canonical FROM k""")
def canonical_choice(t):
    """Of equal texts the one with most labels is canonical, then the least id; one aggregate chooses."""
    marked = t.documents.select("doc_id", F.coalesce(F.sha2("text", 256), F.lit("")).alias("h")).join(t.labels, "doc_id", "left")
    evidence = F.col("quality").isNotNull().cast("int") + F.col("toxic").isNotNull().cast("int")
    marked = marked.select("doc_id", "h", evidence.alias("evidence"))
    best = marked.groupBy("h").agg(F.min(F.struct(-F.col("evidence"), F.col("doc_id").alias("id")))["id"].alias("canonical"))
    return marked.join(best, "h").select("doc_id", "canonical")


@query("""SELECT o_orderkey, o_custkey, o_orderdate = max(o_orderdate) OVER (PARTITION BY o_custkey) AS is_current FROM orders""")
def current_revision(t):
    return ch.current_flag(t.orders.select("o_orderkey", "o_custkey", "o_orderdate"), ["o_custkey"], "o_orderdate").select("o_orderkey", "o_custkey", "is_current")


@query(f"""SELECT o_orderkey FROM orders WHERE CAST(o_orderdate AS DATE) >= DATE '{AS_OF}' - INTERVAL 730 DAY""")
def retention_delete(t):
    return ch.retain(t.orders, "o_orderdate", 730, AS_OF).select("o_orderkey")


@query("""SELECT l_orderkey, l_linenumber, l_suppkey FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = l.l_orderkey AND o.o_totalprice > 250000) UNION ALL SELECT o_orderkey, 1, 0 FROM orders WHERE o_totalprice > 250000""")
def child_replace(t):
    fresh = t.orders.where("o_totalprice > 250000").select(F.col("o_orderkey").alias("l_orderkey"), F.lit(1).alias("l_linenumber"), F.lit(0).cast("long").alias("l_suppkey"))
    return ch.child_sync(t.lineitem.select("l_orderkey", "l_linenumber", "l_suppkey"), fresh, "l_orderkey")


@query("""SELECT d.doc_id, coalesce(lang, CASE WHEN quality = 1 THEN 'rated' END) AS lang, source FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""")
def detail_enrichment(t):
    detail = t.labels.select("doc_id", F.when(F.col("quality") == 1, "rated").alias("lang"))
    return ch.enrich_missing(t.documents.select("doc_id", "lang", "source"), detail, ["doc_id"], ["lang"])


@query("""SELECT e.event_type, e.hours, round(date_diff('second', l.at, TIMESTAMP '2024-02-01 00:00:00') / 3600.0, 6) AS age_hours, CASE WHEN l.at IS NULL THEN 'NEVER' WHEN date_diff('second', l.at, TIMESTAMP '2024-02-01 00:00:00') / 3600.0 > e.hours THEN 'STALE' WHEN date_diff('second', l.at, TIMESTAMP '2024-02-01 00:00:00') / 3600.0 > 0.8 * e.hours THEN 'WARNING' ELSE 'OK' END AS status
    FROM (VALUES ('click', 24.0::DOUBLE), ('view', 2.0::DOUBLE), ('purchase', 1000.0::DOUBLE), ('refund', 5.0::DOUBLE)) e(event_type, hours) LEFT JOIN (SELECT event_type, date_trunc('second', max(ts)) AS at FROM events GROUP BY 1) l ON l.event_type = e.event_type""")
def freshness_status(t):
    limits = t.events.sparkSession.createDataFrame([("click", 24.0), ("view", 2.0), ("purchase", 1000.0), ("refund", 5.0)], "event_type string, hours double")
    return ch.freshness(t.events, limits, "event_type", "ts", "2024-02-01 00:00:00").withColumn("age_hours", F.round("age_hours", 6))


@query("""SELECT lang, CAST(sum(least(length(text), 2000)) AS BIGINT) AS chars, count(*) AS n FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id) GROUP BY 1""")
def cost_estimate(t):
    """Capped text lengths of what has no labels yet: the cap is the feature."""
    open_ = t.documents.join(t.labels.select("doc_id"), "doc_id", "left_anti")
    return open_.groupBy("lang").agg(F.sum(F.least(F.length("text"), F.lit(2000))).cast("long").alias("chars"), n_rows().alias("n"))


@query("""SELECT o_custkey, count(DISTINCT year(o_orderdate)) AS years, count(DISTINCT year(o_orderdate)) >= 2 AS retained FROM orders GROUP BY 1""")
def distinct_years(t):
    by = t.orders.groupBy("o_custkey").agg(F.count_distinct(F.year("o_orderdate")).alias("years"))
    return by.withColumn("retained", F.col("years") >= 2)


@query("""WITH m AS (SELECT l_returnflag, CAST(year(l_shipdate) AS DOUBLE) AS y, CAST(sum(CAST(l_extendedprice AS DECIMAL(15,2))) AS DOUBLE) / count(*) AS price FROM lineitem GROUP BY 1, 2),
    f AS (SELECT l_returnflag, regr_slope(price, y) AS s, regr_intercept(price, y) AS i, count(*) AS n, max(y) AS last, sqrt(greatest(regr_syy(price, y) - regr_slope(price, y) * regr_slope(price, y) * regr_sxx(price, y), 0) / (count(*) - 2)) AS se FROM m GROUP BY 1 HAVING count(*) >= 3)
    SELECT l_returnflag, CAST(step AS BIGINT) AS step, round(i + s * (last + step), 1) AS expected, round(i + s * (last + step) - 1.96 * (1 + 0.1 * step) * se, 1) AS low, round(i + s * (last + step) + 1.96 * (1 + 0.1 * step) * se, 1) AS high FROM f, (VALUES (1), (2), (3)) x(step)""")
def forecast_band(t):
    means = awards(t).groupBy("l_returnflag", F.year("l_shipdate").cast("double").alias("y")).agg((F.sum("value").cast("double") / n_rows()).alias("price"))
    out = r.forecast_band(means, ["l_returnflag"], "y", "price", 3)
    return out.select("l_returnflag", "step", *[F.round(x, 1).alias(x) for x in ("expected", "low", "high")])


@query("""WITH c AS (SELECT o_orderkey AS id, o_custkey AS k, 0 AS tag FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_orderkey, o_custkey, 1 FROM orders WHERE o_orderpriority = '1-URGENT' UNION ALL SELECT o_orderkey, o_custkey, 2 FROM orders WHERE o_totalprice > 200000)
    SELECT k, CASE min(tag) WHEN 0 THEN 'final' WHEN 1 THEN 'urgent' ELSE 'large' END AS source FROM c GROUP BY 1""")
def tagged_sources(t):
    """Keys of three sources with the tag of the first that has them."""
    parts = [t.orders.where(cond).select(F.col("o_custkey").alias("k")).distinct() for cond in ("o_orderstatus = 'F'", "o_orderpriority = '1-URGENT'", "o_totalprice > 200000")]
    names = F.array(*map(F.lit, ("final", "urgent", "large")))
    return r.union_priority(parts, ["k"]).select("k", F.get(names, F.col("source").cast("int")).alias("source"))
