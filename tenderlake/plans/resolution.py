"""Queries that resolve: names to codes, notices to incumbents, organisations to parents, ancestors and affiliates."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tenderlake.operators import hierarchy as hi
from tenderlake.operators import incumbents as inc
from tenderlake.operators import names as nm
from tenderlake.plans.catalogue import Tables, query

VENDOR = "upper(concat(p_name, ' ', p_type, ' ', replace(p_brand, '#', '-')))"
INTRO = "CASE l_returnflag WHEN 'R' THEN 'currently performed by ' WHEN 'A' THEN 'known; incumbent contractor: ' ELSE 'new, and the incumbent is ' END"
TAIL = "CASE WHEN l_tax < 0.01 THEN '(1) of it' WHEN l_tax < 0.02 THEN ' staff on site' WHEN l_linestatus = 'O' THEN ', Inc. since then' ELSE '.' END"
SHORT = "upper(concat(p_name, ' ', p_type))"
TEXT = f"""concat('The work is ', {INTRO},
    CASE WHEN l_quantity < 3 THEN 'The Best Vendor' WHEN l_quantity < 5 THEN 'Question' WHEN l_discount > 0.07 THEN {SHORT} ELSE {VENDOR} END,
    {TAIL}, ' It will be awarded to Whoever is cheapest.')"""
KEYS = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


def attachments(t: Tables):
    """``(doc, l_orderkey, l_linenumber, text)``: a document for each order line, once, which tells of the vendor of its part; the order is the notice.

    Lines and vendors are made distinct by what a text takes from them, so no texts are shuffled.
    """
    kind = "CASE WHEN l_quantity < 3 THEN 0 WHEN l_quantity < 5 THEN 1 WHEN l_discount > 0.07 THEN 2 ELSE 3 END AS kind"
    lines = t.lineitem.selectExpr(*KEYS, kind, f"{INTRO} AS intro", f"{TAIL} AS tail").distinct()
    names = F.array(*[F.struct(F.lit(i).alias("kind"), F.expr(v).alias("vendor")) for i, v in enumerate(("'The Best Vendor'", "'Question'", SHORT, VENDOR))])
    vendors = t.part.select(F.col("p_partkey").alias("l_partkey"), F.inline(names)).distinct()
    return lines.join(vendors, ["l_partkey", "kind"]).selectExpr("concat(l_orderkey, '-', l_linenumber, '-', l_partkey, '-', l_suppkey) AS doc", "l_orderkey", "l_linenumber", "concat('The work is ', intro, vendor, tail, ' It will be awarded to Whoever is cheapest.') AS text")


PATTERN = inc.Capture().pattern().replace("'", "''")
STOPS = ", ".join(f"'{w}'" for w in inc.STOPS)
STAFF = ", ".join(f"'{w}'" for w in inc.Capture().staff)
CAPTURED = f"""d AS (SELECT DISTINCT concat(l_orderkey, '-', l_linenumber, '-', l_partkey, '-', l_suppkey) AS doc, l_orderkey, l_linenumber, {TEXT} AS text FROM lineitem JOIN part ON l_partkey = p_partkey),
    h AS (SELECT doc, l_orderkey, l_linenumber, unnest(regexp_extract_all(text, '{PATTERN}')) AS hit FROM d),
    c AS (SELECT doc, l_orderkey, l_linenumber, regexp_replace(trim(regexp_extract(hit, '{PATTERN}', 1)), '[.,;:]+$', '') AS name, lower(trim(regexp_extract(hit, '{PATTERN}', 2))) AS nxt FROM h),
    k AS (SELECT *, list_filter(regexp_split_to_array(lower(name), '\\s+'), lambda x: x NOT IN ({STOPS})) AS rare FROM c),
    n AS (SELECT doc, l_orderkey, l_linenumber, name FROM k WHERE length(name) BETWEEN 2 AND 100 AND regexp_split_to_array(lower(name), '\\s+')[1] NOT IN ({STOPS}) AND NOT regexp_matches(nxt, '^\\(\\d') AND nxt NOT IN ({STAFF}) AND len(rare) > 0)"""


def captured(t: Tables):
    return inc.capture_names(attachments(t), "doc", "text", carry=("l_orderkey", "l_linenumber"))


@query(f"WITH {CAPTURED} SELECT doc, name, count(*) AS n FROM n GROUP BY ALL")
def incumbent_capture(t):
    return inc.capture_names(attachments(t), "doc", "text").groupBy("doc", "name").agg(F.count(F.lit(1)).alias("n"))


SETTLED = """v AS (SELECT l_orderkey, lower(trim(name)) AS key, count(*) AS votes, sum(CASE WHEN l_linenumber = 1 THEN 3 ELSE 1 END) AS weight, min(name) AS name FROM n GROUP BY 1, 2),
    w AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY votes DESC, weight DESC, key) AS r, count(*) OVER (PARTITION BY l_orderkey) AS n_names FROM v)"""


@query(f"WITH {CAPTURED}, {SETTLED} SELECT l_orderkey, name, votes, CAST(weight AS BIGINT) AS weight, n_names FROM w WHERE r = 1")
def incumbent_by_votes(t):
    return inc.settle_names(captured(t), "l_orderkey", "name", F.when(F.col("l_linenumber") == 1, 3).otherwise(1))


@query(f"""WITH {CAPTURED}, {SETTLED}, u AS (SELECT DISTINCT name FROM w WHERE r = 1),
    p AS (SELECT u.name, count(*) AS n_holders, min(p_partkey) AS p_partkey FROM u JOIN part ON contains(lower({VENDOR}), lower(u.name)) GROUP BY 1)
    SELECT u.name, coalesce(n_holders, 0) AS n_holders, CASE WHEN n_holders = 1 THEN p_partkey END AS p_partkey FROM u LEFT JOIN p ON p.name = u.name""")
def incumbent_entity(t):
    settled = inc.settle_names(captured(t), "l_orderkey", "name", F.when(F.col("l_linenumber") == 1, 3).otherwise(1))
    return inc.only_holder(settled, "name", t.part.selectExpr("p_partkey", f"{VENDOR} AS vendor"), "p_partkey", "vendor")


@query(None)  # SQL has no such similarity
def resolve_agency_names(t):
    """Part names as agencies, told of with words turned, short kinds, slips of the pen, or not at all; codes are the least part keys."""
    parts = t.part.selectExpr("p_partkey", "p_size", "upper(concat(p_name, ' ', p_type)) AS own")
    reference = parts.selectExpr("concat('Department of ', own) AS agency", "p_partkey AS code", "p_size % 2 = 0 AS top")
    form = F.expr("CASE p_partkey % 5 WHEN 0 THEN concat(own, ', DEPT OF') WHEN 1 THEN concat('department  of ', lower(own)) WHEN 2 THEN replace(concat('DEPARTMENT OF ', own), 'A', 'AA') WHEN 3 THEN concat(substring_index(own, ' ', -1), ' DEPARTMNT OF ', substring_index(own, ' ', 2)) ELSE concat('BUREAU ', own) END")
    return nm.resolve_names(parts.select(form.alias("raw")), "raw", reference, "agency", "code", F.col("top"))


TREE = "SELECT p_partkey AS node, CASE WHEN p_partkey > 0 THEN p_partkey // 3 END AS parent, CAST(p_size AS BIGINT) AS size FROM part"


@query(f"""WITH RECURSIVE e AS ({TREE}), w AS (SELECT node, parent AS ancestor, 1 AS depth FROM e WHERE parent IS NOT NULL UNION ALL SELECT w.node, e.parent, depth + 1 FROM w JOIN e ON e.node = w.ancestor WHERE e.parent IS NOT NULL),
    b AS (SELECT ancestor, count(*) AS n, sum(size) AS s FROM w JOIN e ON e.node = w.node GROUP BY 1), a AS (SELECT node, max(depth) AS depth FROM w GROUP BY 1)
    SELECT e.node, e.parent, e.size, coalesce(a.depth, 0) AS depth, coalesce(b.n, 0) AS n_descendants, CAST(e.size + coalesce(b.s, 0) AS BIGINT) AS rolled_up, false AS in_cycle FROM e LEFT JOIN a ON a.node = e.node LEFT JOIN b ON b.ancestor = e.node""")
def hierarchy_rollup(t):
    """Parts as a tree of three children each, as deep as the table asks for."""
    nodes = t.part.selectExpr("p_partkey AS node", "CASE WHEN p_partkey > 0 THEN p_partkey div 3 END AS parent", "CAST(p_size AS BIGINT) AS size")
    return hi.rolled_up(nodes, "node", "parent", "size")


CHAIN = "SELECT o_orderkey AS node, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS parent FROM orders"


@query(f"""WITH RECURSIVE e AS ({CHAIN}), r AS (SELECT node, CAST(node AS VARCHAR) AS path, 0 AS depth FROM e WHERE parent IS NULL UNION ALL SELECT e.node, path || '.' || e.node, depth + 1 FROM r JOIN e ON e.parent = r.node)
    SELECT node, path, CAST(depth AS BIGINT) AS depth FROM r WHERE depth > 0""")
def revision_chain(t):
    """Each order as the revision of its customer's order before: all that went before it, first to last."""
    before = F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    ways = hi.ancestors(t.orders.select(F.col("o_orderkey").alias("node"), before.alias("parent")), "node", "parent")
    return hi.chain(ways)


@query("""WITH h AS (SELECT o_custkey, arg_max(CASE WHEN o_orderstatus = 'P' THEN CAST(o_custkey AS VARCHAR) ELSE concat('1.', o_orderkey % 7, '.', o_custkey) END, strftime(o_orderdate, '%Y-%m-%d') || lpad(CAST(o_orderkey AS VARCHAR), 12, '0')) AS path FROM orders GROUP BY 1)
    SELECT c_custkey, CASE WHEN c_mktsegment = 'MACHINERY' THEN NULL WHEN len(string_split(path, '.')) >= 2 THEN string_split(path, '.')[-2] ELSE coalesce(CASE WHEN c_acctbal > 0 THEN CAST(c_nationkey AS VARCHAR) END, 'injected') END AS parent FROM customer LEFT JOIN h ON o_custkey = c_custkey""")
def parent_from_history(t):
    """The parent of each customer by the newest entry of its nested history, here made of its orders."""
    entry = F.expr("named_struct('effectivedate', concat(date_format(o_orderdate, 'yyyy-MM-dd'), lpad(cast(o_orderkey as string), 12, '0')), 'fhfullparentpathid', CASE WHEN o_orderstatus = 'P' THEN cast(o_custkey as string) ELSE concat('1.', o_orderkey % 7, '.', o_custkey) END)")
    history = t.orders.groupBy("o_custkey").agg(F.collect_list(entry).alias("history"))
    orgs = t.customer.join(history, F.col("c_custkey") == F.col("o_custkey"), "left")
    fallbacks = [F.when(F.col("c_acctbal") > 0, F.col("c_nationkey").cast("string")), F.lit("injected")]
    return orgs.select("c_custkey", hi.parent_of_history(F.col("history"), F.col("c_mktsegment") == "MACHINERY", fallbacks).alias("parent"))


LINK = "CASE l_returnflag WHEN 'R' THEN 'SISTER_SUBSIDIARY' WHEN 'A' THEN 'JV_PARTNER' ELSE 'TEAMING' END"


@query(f"""WITH l AS (SELECT l_suppkey AS s_suppkey, {LINK} AS rel, l_linestatus = 'O' AS mpa, CASE WHEN l_tax > 0 THEN CAST(l_quantity AS BIGINT) END AS size FROM lineitem),
    a AS (SELECT s_suppkey, count(*) FILTER (rel = 'SISTER_SUBSIDIARY' OR (rel = 'JV_PARTNER' AND NOT mpa)) AS n, count(*) FILTER ((rel = 'SISTER_SUBSIDIARY' OR (rel = 'JV_PARTNER' AND NOT mpa)) AND size IS NULL) AS u,
      count(*) FILTER (rel = 'TEAMING' OR (rel = 'JV_PARTNER' AND mpa)) AS x, sum(size) FILTER (rel = 'SISTER_SUBSIDIARY' OR (rel = 'JV_PARTNER' AND NOT mpa)) AS m FROM l GROUP BY 1),
    o AS (SELECT s_suppkey, CASE WHEN s_acctbal > 0 THEN CAST(floor(s_acctbal) AS BIGINT) END AS size, CASE WHEN s_nationkey > 0 THEN CAST(12000 AS BIGINT) END AS threshold FROM supplier)
    SELECT o.s_suppkey, size, threshold, coalesce(n, 0) AS n_affiliates, coalesce(u, 0) AS n_unknown, coalesce(x, 0) AS n_excluded, CAST(size + coalesce(m, 0) AS BIGINT) AS combined_size, size <= threshold AS small_alone,
      size + coalesce(m, 0) <= threshold AS small_combined, coalesce(size <= threshold AND size + coalesce(m, 0) > threshold, false) AS flipped, sign(threshold - size - coalesce(m, 0)) * ((abs(threshold - size - coalesce(m, 0)) * 20000 + threshold) // (2 * threshold)) / 100.0 AS headroom_pct FROM o LEFT JOIN a ON a.s_suppkey = o.s_suppkey""")
def affiliate_size(t):
    links = t.lineitem.selectExpr("l_suppkey AS s_suppkey", f"{LINK} AS relationship", "CASE WHEN l_linestatus = 'O' THEN 'Y' END AS mpa_approved", "CASE WHEN l_tax > 0 THEN CAST(l_quantity AS BIGINT) END AS affiliate_size")
    orgs = t.supplier.selectExpr("s_suppkey", "CASE WHEN s_acctbal > 0 THEN CAST(floor(s_acctbal) AS BIGINT) END AS size", "CASE WHEN s_nationkey > 0 THEN CAST(12000 AS BIGINT) END AS threshold")
    return hi.affiliate_size(orgs, links, "s_suppkey", "size", "threshold")
