"""Service and load queries over the test tables, registered in the catalogue with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tenderlake.functions import columns as c
from tenderlake.operators import changes as ch
from tenderlake.operators import relational as r
from tenderlake.plans.catalogue import AS_OF, awards, n_rows, query

PRICE = "CAST(l_extendedprice AS DECIMAL(15,2))"


@query("""SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey = 3 OR contains(lower(s_name), '00000001')""")
def exclusion_check(t):
    """By key, or by a part of the name."""
    return t.supplier.where((F.col("s_suppkey") == 3) | c.contains_text(F.col("s_name"), "00000001")).select("s_suppkey", "s_name")


@query("""SELECT DISTINCT c_custkey, s_suppkey FROM customer JOIN supplier ON s_nationkey = c_nationkey WHERE s_acctbal < 5000 AND c_acctbal > 9000""")
def exclusion_scan(t):
    """Team members that are on a list: all pairs of a nation, each made once."""
    listed = t.supplier.where("s_acctbal < 5000").select(F.col("s_nationkey").alias("nation"), "s_suppkey")
    team = t.customer.where("c_acctbal > 9000").select("c_custkey", F.col("c_nationkey").alias("nation"))
    return r.any_key_join(team.select("c_custkey"), listed, "c_custkey", [team], "nation")


@query(f"""SELECT l_suppkey, count(*) AS n, count(DISTINCT l_partkey) AS parts, CAST(sum({PRICE}) AS DOUBLE) AS value, string_agg(DISTINCT l_returnflag, ', ' ORDER BY l_returnflag) AS flags FROM lineitem GROUP BY 1 HAVING count(*) >= 2 ORDER BY value DESC, l_suppkey LIMIT 25""")
def partner_page(t):
    flags = F.array_join(F.array_sort(F.collect_set("l_returnflag")), ", ").alias("flags")
    sums = awards(t).groupBy("l_suppkey").agg(n_rows().alias("n"), F.count_distinct("l_partkey").alias("parts"), F.sum("value").cast("double").alias("value"), flags).where("n >= 2")
    return r.page(sums, "value", "l_suppkey", 1, 25, ["value"])


@query("""SELECT n_nationkey AS id, n_name AS name, r_name AS parent, 2 AS level FROM nation JOIN region ON r_regionkey = n_regionkey UNION ALL SELECT r_regionkey, r_name, NULL, 1 FROM region""")
def hierarchy_levels(t):
    top = t.region.select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name"), F.lit(None).cast("string").alias("parent"), F.lit(1).alias("level"))
    below = t.nation.join(t.region, F.col("r_regionkey") == F.col("n_regionkey")).select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.col("r_name").alias("parent"), F.lit(2).alias("level"))
    return top.unionByName(below)


@query("""SELECT p_partkey, unnest([substr(k, 1, 2), substr(k, 1, 3), k]) AS ancestor FROM (SELECT p_partkey, lpad(CAST(p_partkey AS VARCHAR), 6, '1') AS k FROM part)""")
def code_ancestors(t):
    """The chain of a hierarchical code, from two digits on."""
    code = F.lpad(F.col("p_partkey").cast("string"), 6, "1")
    return t.part.select("p_partkey", F.explode(F.array(F.substring(code, 1, 2), F.substring(code, 1, 3), code)).alias("ancestor"))


@query("""SELECT identifier, count(*) AS mentions, count(DISTINCT doc_id) AS documents, min(doc_id) AS first_doc FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9._-]+@[A-Za-z0-9-]+[.][a-z]+')) AS identifier FROM documents) GROUP BY 1""")
def identifier_mentions(t):
    found = F.regexp_extract_all("text", F.lit(r"[A-Za-z0-9._-]+@[A-Za-z0-9-]+[.][a-z]+"), F.lit(0))
    rows = t.documents.select("doc_id", F.explode(found).alias("identifier"))
    return rows.groupBy("identifier").agg(n_rows().alias("mentions"), F.count_distinct("doc_id").alias("documents"), F.min("doc_id").alias("first_doc"))


@query("""SELECT event_type, max(ts) FILTER (value > 50) AS last_success, count(*) FILTER (NOT value > 50) AS failures, max_by(event_id, CASE WHEN value > 50 THEN ts END) AS last_id FROM events GROUP BY 1""")
def source_status(t):
    good = F.col("value") > 50
    return t.events.groupBy("event_type").agg(F.max(F.when(good, F.col("ts"))).alias("last_success"), F.count_if(~good).alias("failures"), F.max_by("event_id", F.when(good, F.col("ts"))).alias("last_id"))


@query("""WITH x AS (SELECT doc_id, source, md5(text) AS h, n_chars FROM documents d WHERE text IS NOT NULL AND NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id))
    SELECT h, min(doc_id) AS doc_id, count(*) AS copies FROM x WHERE n_chars > 500 GROUP BY 1""")
def missing_only_candidates(t):
    """What is not there yet, one for each content."""
    rows = t.documents.where("text is not null and n_chars > 500").join(t.labels.select("doc_id"), "doc_id", "left_anti")
    return rows.groupBy(F.md5("text").alias("h")).agg(F.min("doc_id").alias("doc_id"), n_rows().alias("copies"))


@query("""SELECT o_orderkey FROM orders ORDER BY CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 0 ELSE 1 END, o_orderdate DESC, o_orderkey LIMIT 200""")
def priority_budget(t):
    """Preferred ones first, then the rest, up to the budget."""
    rank = F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), 0).otherwise(1)
    return t.orders.orderBy(rank, F.desc("o_orderdate"), F.asc("o_orderkey")).limit(200).select("o_orderkey")


@query("""SELECT o.o_orderkey, p.o_orderkey AS incumbent FROM orders o LEFT JOIN (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey DESC) AS rn FROM orders WHERE o_orderstatus = 'F') p ON p.o_custkey = o.o_custkey AND rn = 1 WHERE o.o_orderstatus = 'O'""")
def incumbent_lookup(t):
    """The largest finished award of the same office."""
    best = t.orders.where("o_orderstatus = 'F'").groupBy("o_custkey").agg(F.max(F.struct("o_totalprice", "o_orderkey"))["o_orderkey"].alias("incumbent"))
    return t.orders.where("o_orderstatus = 'O'").join(best, "o_custkey", "left").select("o_orderkey", "incumbent")


@query(f"""SELECT o_orderkey, CAST(sum({PRICE}) AS DOUBLE) AS spent, CAST((year(max(l_shipdate)) - year(o_orderdate)) * 12 + month(max(l_shipdate)) - month(o_orderdate) + 1 AS BIGINT) AS months,
    CASE WHEN (year(max(l_shipdate)) - year(o_orderdate)) * 12 + month(max(l_shipdate)) - month(o_orderdate) + 1 > 0 THEN round(CAST(sum({PRICE}) AS DOUBLE) / ((year(max(l_shipdate)) - year(o_orderdate)) * 12 + month(max(l_shipdate)) - month(o_orderdate) + 1), 6) END AS monthly
    FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_orderdate""")
def burn_rate(t):
    spent = awards(t).groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("value").cast("double").alias("spent"), F.max("l_shipdate").alias("last"))
    out = t.orders.select("o_orderkey", "o_orderdate").join(spent, "o_orderkey").withColumn("months", c.months_apart(F.col("o_orderdate"), F.col("last"), inclusive=True))
    return out.select("o_orderkey", "spent", "months", F.when(F.col("months") > 0, F.round(F.col("spent") / F.col("months"), 6)).alias("monthly"))


@query("""SELECT concat_ws('|', l_orderkey, l_linenumber) AS key, l_suppkey FROM lineitem""")
def composite_key(t):
    return t.lineitem.select(F.concat_ws("|", "l_orderkey", "l_linenumber").alias("key"), "l_suppkey")


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'done' WHEN n >= 5 THEN 'skipped' ELSE 'retry' END AS state FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""")
def retry_state(t):
    tries = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(n_rows().alias("n"))
    state = F.when(F.col("o_orderstatus") == "F", "done").when(F.col("n") >= 5, "skipped").otherwise("retry")
    return t.orders.join(tries, "o_orderkey", "left").select("o_orderkey", state.alias("state"))


@query("""SELECT d.doc_id FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND quality IS NOT NULL) AND NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND toxic = 1)""")
def cleanup_eligible(t):
    done = t.labels.groupBy("doc_id").agg(F.bool_or(F.col("quality").isNotNull()).alias("rated"), F.max("toxic").alias("toxic"))
    return t.documents.select("doc_id").join(done.where("rated and coalesce(toxic, 0) <> 1"), "doc_id", "left_semi")


@query("""WITH k AS (SELECT c_nationkey, c_mktsegment, c_name, row_number() OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS rn FROM customer) SELECT c_nationkey, c_mktsegment, c_name FROM k WHERE rn = 1""")
def contact_dedup(t):
    return r.latest_per_key(t.customer, ["c_nationkey", "c_mktsegment"], [F.desc("c_acctbal"), F.asc("c_custkey")]).select("c_nationkey", "c_mktsegment", "c_name")


@query(f"""SELECT o_orderkey, o_totalprice, count(*) OVER () AS total, count(*) FILTER (o_orderdate >= TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY) OVER () AS fresh FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderdate < TIMESTAMP '{AS_OF}' ORDER BY o_orderdate DESC, o_orderkey LIMIT 200""")
def saved_search_run(t):
    """The newest 200 rows with the counts of all and of those since the last run; the counts are one row."""
    found = t.orders.where((F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderdate") < F.lit(AS_OF).cast("timestamp")))
    counts = found.agg(n_rows().alias("total"), F.count_if(F.col("o_orderdate") >= F.lit(AS_OF).cast("timestamp") - F.expr("interval 30 days")).alias("fresh"))
    return found.orderBy(F.desc("o_orderdate"), F.asc("o_orderkey")).limit(200).select("o_orderkey", "o_totalprice").crossJoin(F.broadcast(counts))


@query("""SELECT doc_id, text_hash, doc_id = canonical AS keeps FROM (SELECT doc_id, md5(coalesce(text, '')) AS text_hash, min(doc_id) OVER (PARTITION BY md5(coalesce(text, ''))) AS canonical, count(*) OVER (PARTITION BY md5(coalesce(text, ''))) AS n FROM documents) WHERE n > 1""")
def duplicate_groups(t):
    """Groups of more than one row of a content, and who stays: aggregated by hash, then joined back."""
    hashed = t.documents.select("doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("text_hash"))
    groups = hashed.groupBy("text_hash").agg(F.min("doc_id").alias("canonical"), n_rows().alias("n")).where("n > 1")
    return hashed.join(groups, "text_hash").select("doc_id", "text_hash", (F.col("doc_id") == F.col("canonical")).alias("keeps"))


@query("""WITH k AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY CASE role WHEN 'assistant' THEN 1 WHEN 'user' THEN 2 ELSE 3 END, turn DESC) AS rn FROM conversations) SELECT conv_id, turn, role FROM k WHERE rn = 1""")
def canonical_by_rank(t):
    """By a fixed order of kinds, then the newest."""
    rank = c.enum_rank(F.col("role"), ["assistant", "user"])
    order = [F.asc(F.when(rank == 0, 3).otherwise(rank)), F.desc("turn")]
    return r.latest_per_key(t.conversations.select("conv_id", "turn", "role"), ["conv_id"], order)


@query("""SELECT o_custkey, o_orderkey, o_totalprice, sum(CAST(o_totalprice AS DECIMAL(15,2))) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING)::DOUBLE AS running FROM orders""")
def transaction_history(t):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(Window.unboundedPreceding, 0)
    return t.orders.select("o_custkey", "o_orderkey", "o_totalprice", F.sum(c.money(F.col("o_totalprice"))).over(w).cast("double").alias("running"))


@query("""SELECT c_custkey, coalesce(c_mktsegment, 'none') AS segment, c_nationkey FROM customer WHERE c_acctbal >= 0 UNION ALL SELECT c_custkey, 'debt', c_nationkey FROM customer WHERE NOT coalesce(c_acctbal >= 0, false)""")
def profile_import(t):
    """Only what is missing is filled in; the rest stays."""
    base = t.customer.withColumn("segment", F.when(F.col("c_acctbal") >= 0, F.coalesce("c_mktsegment", F.lit("none"))))
    detail = t.customer.select("c_custkey", F.lit("debt").alias("segment"))
    return ch.enrich_missing(base.select("c_custkey", "segment", "c_nationkey"), detail, ["c_custkey"], ["segment"])
