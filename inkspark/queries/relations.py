"""Joins, groupings, paging and set operations over the star schema."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from inkspark.operators import relations as r
from inkspark.queries import query
from inkspark.sources.tables import table


@query("s01_table_scan", "SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING'")
def table_scan(spark, sf_dir):
    return table(spark, sf_dir, "customer").where(F.col("c_mktsegment") == "BUILDING").select("c_custkey", "c_name")


@query("s02_full_scan", "SELECT count(*)::BIGINT AS n, sum(l_orderkey)::BIGINT AS keys FROM lineitem")
def full_scan(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").agg(F.count("*").alias("n"), F.sum("l_orderkey").alias("keys"))


@query("s05_content_dedupe", "SELECT sha256(text) AS digest, source, min(doc_id) AS doc_id, count(*)::BIGINT AS uploads FROM documents GROUP BY text, source")
def content_dedupe(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("digest", F.sha2("text", 256))
    return docs.groupBy("digest", "source").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("uploads"))


@query("j01_inner_composite", """
SELECT n_name, r_name, count(*)::BIGINT AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY n_name, r_name""")
def inner_composite(spark, sf_dir):
    t = lambda name: table(spark, sf_dir, name)
    places = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    # Orders are summed by customer before they meet the dimension tables.
    sums = t("orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("total"))
    joined = sums.join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(places, F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.groupBy("n_name", "r_name").agg(F.sum("n").alias("n"), F.round(F.sum("total"), 2).alias("total"))


@query("j02_left_outer", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'P'")
def left_outer(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'")
    return table(spark, sf_dir, "customer").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "o_orderkey")


@query("j03_latest_per_key", "SELECT o_custkey, o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders) WHERE k = 1")
def latest_per_key(spark, sf_dir):
    return r.latest(table(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "o_orderstatus")


@query("j04_semi_exists", """
SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')
OR EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') OR c_acctbal < 0""")
def semi_exists(spark, sf_dir):
    flags = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(
        F.bool_or((F.col("o_orderpriority") == "1-URGENT") | (F.col("o_orderstatus") == "P")).alias("has"))
    joined = table(spark, sf_dir, "customer").join(flags, F.col("c_custkey") == F.col("o_custkey"), "left")
    return joined.where(F.coalesce("has", F.lit(False)) | (F.col("c_acctbal") < 0)).select("c_custkey")


@query("j05_uncovered", """
WITH spans AS (SELECT l_orderkey, min(l_linenumber) AS a, max(l_linenumber) - 1 AS b FROM lineitem WHERE l_returnflag = 'N' GROUP BY l_orderkey)
SELECT l.l_orderkey, l.l_linenumber FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM spans s WHERE s.l_orderkey = l.l_orderkey AND l.l_linenumber BETWEEN a AND b)""")
def uncovered(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    spans = lines.where("l_returnflag = 'N'").groupBy(F.col("l_orderkey").alias("k")).agg(F.min("l_linenumber").alias("a"), (F.max("l_linenumber") - 1).alias("b"))
    return lines.join(spans, (F.col("l_orderkey") == F.col("k")) & F.col("l_linenumber").between(F.col("a"), F.col("b")), "left_anti").select("l_orderkey", "l_linenumber")


@query("j06_range_containment", """
WITH nodes AS (SELECT l_orderkey AS k, l_linenumber AS node, l_linenumber AS a, l_linenumber + (l_quantity % 4)::INTEGER AS b FROM lineitem)
SELECT k, node, count(*)::BIGINT AS held FROM nodes JOIN lineitem ON k = l_orderkey AND l_linenumber >= a AND l_linenumber <= b GROUP BY k, node""")
def range_containment(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    nodes = r.line_nodes(lines)
    return r.contained(nodes, lines, ["k", "l_orderkey"], ["a", "b"], "l_linenumber").groupBy("k", "node").agg(F.count("*").alias("held"))


@query("j07_deepest_node", """
WITH nodes AS (SELECT l_orderkey AS k, l_linenumber AS node, l_linenumber AS a, l_linenumber + (l_quantity % 4)::INTEGER AS b FROM lineitem),
held AS (SELECT k, l_linenumber AS item, node, row_number() OVER (PARTITION BY k, l_linenumber ORDER BY b - a, node DESC) AS o,
  string_agg(node::VARCHAR, '/') OVER (PARTITION BY k, l_linenumber ORDER BY a, b DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS path
  FROM nodes JOIN lineitem ON k = l_orderkey AND l_linenumber >= a AND l_linenumber <= b)
SELECT k, item, node, path FROM held WHERE o = 1""")
def deepest_node(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    held = r.contained(r.line_nodes(lines), lines, ["k", "l_orderkey"], ["a", "b"], "l_linenumber")
    best = F.min_by("node", F.struct(F.col("b") - F.col("a"), -F.col("node")))
    path = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("a", (-F.col("b")).alias("b"), "node"))), lambda x: x["node"].cast("string")), "/")
    return held.groupBy("k", F.col("l_linenumber").alias("item")).agg(best.alias("node"), path.alias("path"))


@query("j08_self_join", """
WITH items AS (SELECT p_partkey AS id, p_brand AS kind FROM part),
edges AS (SELECT l_orderkey, l_linenumber, l_partkey AS from_id, 1 + (l_partkey + l_suppkey) % (SELECT count(*) FROM part) AS to_id FROM lineitem),
ends AS (SELECT from_id AS own, to_id AS other FROM edges UNION ALL SELECT to_id, from_id FROM edges WHERE from_id <> to_id)
SELECT own, count(*)::BIGINT AS relations, count(DISTINCT other)::BIGINT AS others, count(*) FILTER (a.kind = b.kind)::BIGINT AS alike
FROM ends JOIN items a ON a.id = own JOIN items b ON b.id = other GROUP BY own""")
def self_join(spark, sf_dir):
    """Every relation seen from either end, with both items; an item's relations and its other ends."""
    parts = table(spark, sf_dir, "part")
    items, n = parts.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("kind")), parts.agg(F.count("*").alias("n"))
    edges = table(spark, sf_dir, "lineitem").join(F.broadcast(n)).select(F.col("l_partkey").alias("from_id"), (1 + (F.col("l_partkey") + F.col("l_suppkey")) % F.col("n")).alias("to_id"))  # one row
    return r.from_either_end(edges, items, "kind").groupBy("own").agg(
        F.count("*").alias("relations"), F.count_distinct("other").alias("others"), F.count_if(F.col("kind") == F.col("other_kind")).alias("alike"))


@query("j10_null_safe", """
WITH v AS (SELECT user_id, event_type, CASE WHEN event_id % 3 > 0 THEN json_extract_string(props, '$.k') END AS k FROM events)
SELECT x.event_type, count(*)::BIGINT AS n FROM (SELECT DISTINCT event_type, k FROM v) x JOIN (SELECT DISTINCT user_id, k FROM v) y ON x.k IS NOT DISTINCT FROM y.k GROUP BY x.event_type""")
def null_safe(spark, sf_dir):
    v = table(spark, sf_dir, "events").select("user_id", "event_type", F.when(F.col("event_id") % 3 > 0, F.get_json_object("props", "$.k")).alias("k"))
    x, y = v.select("event_type", "k").distinct().alias("x"), v.select("user_id", "k").distinct().groupBy("k").agg(F.count("*").alias("n")).alias("y")
    return x.join(y, F.col("x.k").eqNullSafe(F.col("y.k"))).groupBy("event_type").agg(F.sum("n").alias("n"))


@query("j11_ownership_union", """
WITH scopes AS (SELECT o_orderkey AS id, 'order' AS scope FROM orders UNION ALL SELECT p_partkey, 'part' FROM part UNION ALL SELECT c_custkey, 'customer' FROM customer)
SELECT l_suppkey AS id, count(scope)::BIGINT AS owners, CASE WHEN count(scope) = 1 THEN min(scope) END AS scope
FROM (SELECT DISTINCT l_suppkey FROM lineitem) LEFT JOIN scopes ON l_suppkey = id GROUP BY l_suppkey""")
def ownership_union(spark, sf_dir):
    one = lambda name, key, scope: table(spark, sf_dir, name).select(F.col(key).alias("id"), F.lit(scope).alias("scope"))
    scopes = one("orders", "o_orderkey", "order").unionByName(one("part", "p_partkey", "part")).unionByName(one("customer", "c_custkey", "customer"))
    ids = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("id")).distinct()
    n = F.count("scope")
    return ids.join(scopes, "id", "left").groupBy("id").agg(n.alias("owners"), F.when(n == 1, F.min("scope")).alias("scope"))


@query("j12_pricing_lookup", "SELECT l_partkey, p_brand, count(*)::BIGINT AS n FROM lineitem LEFT JOIN part ON l_partkey = p_partkey AND p_size < 25 GROUP BY l_partkey, p_brand")
def pricing_lookup(spark, sf_dir):
    sums = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n"))
    listed = table(spark, sf_dir, "part").where("p_size < 25").select("p_partkey", "p_brand")
    return sums.join(listed, F.col("l_partkey") == F.col("p_partkey"), "left").select("l_partkey", "p_brand", "n")


@query("j13_island_cover", """
WITH e AS (SELECT user_id, (epoch_us(ts) // 1000) AS a, (epoch_us(ts) // 1000) + 3600000 AS b FROM events),
m AS (SELECT *, max(b) OVER (PARTITION BY user_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM e),
i AS (SELECT *, sum(CASE WHEN seen IS NULL OR a > seen THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS island FROM m)
SELECT user_id, min(a)::BIGINT AS start_ms, max(b)::BIGINT AS end_ms, count(*)::BIGINT AS n FROM i GROUP BY user_id, island""")
def island_cover(spark, sf_dir):
    start = F.unix_millis(F.col("ts").cast("timestamp"))
    spans = table(spark, sf_dir, "events").select("user_id", start.alias("a"), (start + 3_600_000).alias("b"))
    return r.islands(spans, ["user_id"], "a", "b").select("user_id", F.col("a").alias("start_ms"), F.col("b").alias("end_ms"), "n")


@query("j14_overlay", """
SELECT p_partkey, coalesce(n, p_name) AS name FROM part LEFT JOIN (SELECT l_partkey, 'revised ' || max(l_returnflag) AS n FROM lineitem WHERE l_quantity > 45 GROUP BY l_partkey) ON p_partkey = l_partkey""")
def overlay(spark, sf_dir):
    revised = table(spark, sf_dir, "lineitem").where("l_quantity > 45").groupBy("l_partkey").agg(F.concat(F.lit("revised "), F.max("l_returnflag")).alias("n"))
    return table(spark, sf_dir, "part").join(revised, F.col("p_partkey") == F.col("l_partkey"), "left").select("p_partkey", F.coalesce("n", "p_name").alias("name"))


@query("j15_context_join", """
SELECT l_orderkey, count(*) FILTER (p_partkey IS NULL)::BIGINT AS unknown_part, count(*) FILTER (s_suppkey IS NULL)::BIGINT AS unknown_supplier
FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_size <> 1) ON l_partkey = p_partkey LEFT JOIN (SELECT * FROM supplier WHERE s_acctbal > 0) ON l_suppkey = s_suppkey GROUP BY l_orderkey""")
def context_join(spark, sf_dir):
    part = table(spark, sf_dir, "part").where("p_size <> 1").select("p_partkey")
    supplier = table(spark, sf_dir, "supplier").where("s_acctbal > 0").select("s_suppkey")
    joined = table(spark, sf_dir, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"), "left").join(supplier, F.col("l_suppkey") == F.col("s_suppkey"), "left")
    return joined.groupBy("l_orderkey").agg(F.count_if(F.col("p_partkey").isNull()).alias("unknown_part"), F.count_if(F.col("s_suppkey").isNull()).alias("unknown_supplier"))


@query("f14_tenant_gate", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3)")
def tenant_gate(spark, sf_dir):
    members = table(spark, sf_dir, "customer").where("c_nationkey = 3")
    return table(spark, sf_dir, "orders").join(members, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("o_orderkey")


@query("f04_lineage_current", """
SELECT o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
WHERE o_orderkey = (SELECT max(o2.o_orderkey) FROM orders o2 WHERE o2.o_custkey = orders.o_custkey) AND NOT regexp_matches(n_name, '(?i)^(unit|chin)')""")
def lineage_current(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    current = orders.groupBy("o_custkey").agg(F.max("o_orderkey").alias("o_orderkey"))
    nations = table(spark, sf_dir, "nation").where(~F.col("n_name").rlike("(?i)^(unit|chin)"))
    people = table(spark, sf_dir, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    return current.join(people, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey")


@query("f06_library_search", "SELECT p_partkey FROM part WHERE (contains(lower(p_name), lower('AL')) OR contains(lower(p_type), lower('al'))) AND p_brand <> 'Brand#11'")
def library_search(spark, sf_dir):
    return r.search(table(spark, sf_dir, "part"), "AL", ["p_name", "p_type"]).where("p_brand <> 'Brand#11'").select("p_partkey")


@query("a01_status_counts", """
SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F')::BIGINT AS done, count(*) FILTER (o_orderstatus = 'O')::BIGINT AS queued, count(*) FILTER (o_orderstatus = 'P')::BIGINT AS running
FROM orders GROUP BY o_orderpriority""")
def status_counts(spark, sf_dir):
    counts = table(spark, sf_dir, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).count().fillna(0)
    return counts.select("o_orderpriority", F.col("F").alias("done"), F.col("O").alias("queued"), F.col("P").alias("running"))


@query("a03_global_aggregates", "SELECT count(*)::BIGINT AS n, round(sum(o_totalprice), 2) AS total, (max(o_orderkey) + 1)::BIGINT AS next_ordinal FROM orders")
def global_aggregates(spark, sf_dir):
    return table(spark, sf_dir, "orders").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"), (F.max("o_orderkey") + 1).alias("next_ordinal"))


@query("a05_distinct_users", "SELECT event_type, count(DISTINCT user_id)::BIGINT AS users FROM events GROUP BY event_type")
def distinct_users(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count_distinct("user_id").alias("users"))


@query("a06_distinct_rows", "SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem")
def distinct_rows(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey").distinct()


@query("a07_distinct_on", "SELECT DISTINCT ON (user_id) user_id, event_id, event_type FROM events ORDER BY user_id, ts DESC, event_id DESC")
def distinct_on(spark, sf_dir):
    return r.latest(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@query("a36_active_leases", "SELECT count(*)::BIGINT AS active, count(*) < 100000 AS below_cap FROM orders WHERE o_orderstatus = 'O' AND o_orderdate > TIMESTAMP '1996-06-01'")
def active_leases(spark, sf_dir):
    n = F.count("*")
    return table(spark, sf_dir, "orders").where("o_orderstatus = 'O' and o_orderdate > timestamp'1996-06-01'").agg(n.alias("active"), (n < 100000).alias("below_cap"))


@query("l02_keyset_page", """
SELECT o_orderkey, (SELECT count(*) > 20 FROM orders WHERE (o_orderdate, o_orderkey) < (TIMESTAMP '1996-01-01', 500)) AS has_next FROM orders
WHERE (o_orderdate, o_orderkey) < (TIMESTAMP '1996-01-01', 500) ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 20""")
def keyset_page(spark, sf_dir):
    return r.keyset_page(table(spark, sf_dir, "orders"), ["o_orderdate", "o_orderkey"], ["timestamp_ntz'1996-01-01'", "500L"], 20).select("o_orderkey", "has_next")


@query("l03_keyset_frontier", """
SELECT o_orderkey FROM orders WHERE (o_orderdate > TIMESTAMP '1995-01-01' OR o_orderdate = TIMESTAMP '1995-01-01' AND o_orderkey > 10) AND o_orderdate < TIMESTAMP '1995-03-01'
ORDER BY o_orderdate, o_orderkey LIMIT 50""")
def keyset_frontier(spark, sf_dir):
    key = F.struct("o_orderdate", "o_orderkey")
    orders = table(spark, sf_dir, "orders").where((key > r.bound(["timestamp_ntz'1995-01-01'", "10L"])) & (key <= r.bound(["timestamp_ntz'1995-03-01'", "0L"])))
    return orders.orderBy("o_orderdate", "o_orderkey").limit(50).select("o_orderkey")


@query("l04_offset_page", "SELECT c_custkey FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 26 OFFSET 50")
def offset_page(spark, sf_dir):
    return table(spark, sf_dir, "customer").orderBy(F.desc("c_acctbal"), "c_custkey").offset(50).limit(26).select("c_custkey")


@query("l11_batch_claim", """
SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' OR (o_orderstatus = 'P' AND o_orderdate < TIMESTAMP '1996-01-01') ORDER BY o_orderdate, o_orderkey LIMIT 25""")
def batch_claim(spark, sf_dir):
    free = "o_orderstatus = 'O' or (o_orderstatus = 'P' and o_orderdate < timestamp'1996-01-01')"
    return table(spark, sf_dir, "orders").where(free).orderBy("o_orderdate", "o_orderkey").limit(25).select("o_orderkey")


@query("l10_capped_details", """
SELECT l_orderkey, string_agg(l_partkey::VARCHAR, ',' ORDER BY k) AS parts FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS k FROM lineitem) WHERE k <= 3 GROUP BY l_orderkey""")
def capped_details(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    ranked = lines.withColumn("k", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))).where("k <= 3")
    listed = F.transform(F.sort_array(F.collect_list(F.struct("k", "l_partkey"))), lambda x: x["l_partkey"].cast("string"))
    return ranked.groupBy("l_orderkey").agg(F.array_join(listed, ",").alias("parts"))


@query("u01_union_all", "SELECT 'part' AS kind, count(*)::BIGINT AS n FROM part UNION ALL SELECT 'supplier', count(*) FROM supplier")
def union_all(spark, sf_dir):
    one = lambda name: table(spark, sf_dir, name).agg(F.lit(name).alias("kind"), F.count("*").alias("n"))
    return one("part").unionByName(one("supplier"))


@query("u02_union_distinct", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def union_distinct(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")).union(table(spark, sf_dir, "supplier").select("s_nationkey")).distinct()


@query("u03_difference", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders")
def difference(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")).subtract(table(spark, sf_dir, "orders").select("o_custkey"))


@query("u04_intersection", "SELECT c_custkey AS k FROM customer INTERSECT SELECT o_custkey FROM orders")
def intersection(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")).intersect(table(spark, sf_dir, "orders").select("o_custkey"))
