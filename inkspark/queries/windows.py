"""Ordinals, quotas and running windows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from inkspark.queries import query
from inkspark.sources.tables import table


@query("w01_running_ordinal", "SELECT o_custkey, o_orderkey, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1)::BIGINT AS ordinal FROM orders")
def running_ordinal(spark, sf_dir):
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    return table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", (place - 1).cast("long").alias("ordinal"))


@query("w08_cumulative_start", """
SELECT conv_id, turn, coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM conversations""")
def cumulative_start(spark, sf_dir):
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce(F.sum(F.length("text")).over(before), F.lit(0)).alias("start"))


@query("w10_next_ordinal", "SELECT l_orderkey, (max(l_linenumber) + 1)::BIGINT AS next FROM lineitem GROUP BY l_orderkey")
def next_ordinal(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg((F.max("l_linenumber") + 1).cast("long").alias("next"))


@query("w11_quota", """
WITH r AS (SELECT o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders)
SELECT o_orderkey FROM r ORDER BY k > 2, o_totalprice DESC, o_orderkey LIMIT 200""")
def quota(spark, sf_dir):
    """Two of each customer first, then the rest in order."""
    rank = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    return table(spark, sf_dir, "orders").withColumn("k", rank).orderBy(F.col("k") > 2, F.desc("o_totalprice"), "o_orderkey").limit(200).select("o_orderkey")


@query("w12_latest_flag", "SELECT o_orderkey, o_orderdate = max(o_orderdate) OVER (PARTITION BY o_custkey) AS latest FROM orders")
def latest_flag(spark, sf_dir):
    newest = F.max("o_orderdate").over(Window.partitionBy("o_custkey"))
    return table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderdate") == newest).alias("latest"))


@query("w13_timeline_rebase", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN bool_and(l_quantity > 0) OVER o THEN
  (coalesce(sum(l_quantity::BIGINT) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * 1000)::BIGINT END AS start_ms
FROM lineitem WINDOW o AS (PARTITION BY l_orderkey)""")
def timeline_rebase(spark, sf_dir):
    by = Window.partitionBy("l_orderkey")
    before = by.orderBy("l_linenumber", "l_partkey", "l_suppkey").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.col("l_quantity").cast("long")).over(before), F.lit(0)) * 1000
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.when(F.min("l_quantity").over(by) > 0, start).alias("start_ms"))


@query("w07_heading_jump", """
WITH b AS (SELECT doc_id, generate_subscripts(l, 1) AS o, length(regexp_extract(unnest(l), '^#{0,6}')) + length(unnest(l)) % 5 AS level FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))
SELECT doc_id, count(*) FILTER (level > prev + 1)::BIGINT AS jumps FROM (SELECT *, lag(level) OVER (PARTITION BY doc_id ORDER BY o) AS prev FROM b) GROUP BY doc_id""")
def heading_jump(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("o", "line"))
    level = F.length(F.regexp_extract("line", "^#{0,6}", 0)) + F.length("line") % 5
    leveled = lines.select("doc_id", "o", level.alias("level"))
    before = F.lag("level").over(Window.partitionBy("doc_id").orderBy("o"))
    return leveled.withColumn("prev", before).groupBy("doc_id").agg(F.count_if(F.col("level") > F.col("prev") + 1).alias("jumps"))


@query("r03_rate_window", "SELECT user_id, (epoch_us(ts) // 3600000000)::BIGINT AS bucket, count(*)::BIGINT AS n, count(*) > 2 AS over_limit FROM events GROUP BY 1, 2")
def rate_window(spark, sf_dir):
    bucket = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 3_600_000_000)
    return table(spark, sf_dir, "events").groupBy("user_id", bucket.alias("bucket")).agg(F.count("*").alias("n"), (F.count("*") > 2).alias("over_limit"))


@query("r01_dedupe", """
SELECT event_id, first_id, event_id <> first_id AS duplicate FROM (SELECT event_id, first_value(event_id) OVER (PARTITION BY user_id, event_type, json_extract_string(props, '$.k') ORDER BY ts, event_id) AS first_id FROM events)""")
def dedupe(spark, sf_dir):
    """The first event of a key wins; later ones name it."""
    key = Window.partitionBy("user_id", "event_type", F.get_json_object("props", "$.k")).orderBy("ts", "event_id")
    first = F.first("event_id").over(key)
    return table(spark, sf_dir, "events").select("event_id", first.alias("first_id"), (F.col("event_id") != first).alias("duplicate"))


@query("r04_concurrency", """
WITH e AS (SELECT epoch_us(ts) AS t FROM events),
p AS (SELECT t FROM e UNION ALL SELECT DISTINCT d * 86400000000 FROM (SELECT t // 86400000000 AS d FROM e UNION ALL SELECT (t + 60000000) // 86400000000 FROM e)),
n AS (SELECT p.t, count(e.t) AS open FROM (SELECT DISTINCT t FROM p) p LEFT JOIN e ON e.t <= p.t AND e.t > p.t - 60000000 GROUP BY p.t)
SELECT t // 86400000000 AS user_bucket, max(open)::BIGINT AS most FROM n GROUP BY 1""")
def concurrency(spark, sf_dir):
    """The most leases of a minute that are open at once, by day; a lease that ends frees its place first.

    A lease is open in the minute it starts in and the next one, so minutes are counted by themselves, each from the
    leases of the minute before. A day begins with those still open at midnight.
    """
    minute, day = 60_000_000, 86_400_000_000
    starts = table(spark, sf_dir, "events").select(F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    steps = starts.select("t", F.lit(1).alias("d")).union(starts.select(F.col("t") + minute, F.lit(-1)))
    midnights = steps.select((F.floor(F.col("t") / day) * day).alias("t"), F.lit(0).alias("d")).distinct()
    steps = steps.union(midnights).withColumn("m", F.floor(F.col("t") / minute))
    carried = starts.groupBy((F.floor(F.col("t") / minute) + 1).alias("m")).agg(F.count("*").alias("carried"))
    running = F.sum("d").over(Window.partitionBy("m").orderBy("t", "d").rowsBetween(Window.unboundedPreceding, 0))
    opened = steps.withColumn("open", running).join(carried, "m", "left").withColumn("open", F.col("open") + F.coalesce("carried", F.lit(0)))
    return opened.where("d >= 0").groupBy(F.floor(F.col("t") / day).alias("user_bucket")).agg(F.max("open").alias("most"))


@query("r08_delivery_repair", """
SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' AND l.k IS NULL THEN 'ENQUEUE' WHEN o_orderstatus = 'P' AND n < 4 THEN 'RETRY' WHEN o_orderstatus = 'P' THEN 'FAIL' ELSE 'KEEP' END AS action
FROM orders LEFT JOIN (SELECT l_orderkey AS k, count(*) AS n FROM lineitem WHERE l_quantity > 5 GROUP BY l_orderkey) l ON o_orderkey = l.k""")
def delivery_repair(spark, sf_dir):
    attempts = table(spark, sf_dir, "lineitem").where("l_quantity > 5").groupBy(F.col("l_orderkey").alias("k")).agg(F.count("*").alias("n"))
    state = F.col("o_orderstatus")
    action = F.when((state == "O") & F.col("k").isNull(), "ENQUEUE").when((state == "P") & (F.col("n") < 4), "RETRY").when(state == "P", "FAIL").otherwise("KEEP")
    return table(spark, sf_dir, "orders").join(attempts, F.col("o_orderkey") == F.col("k"), "left").select("o_orderkey", action.alias("action"))
