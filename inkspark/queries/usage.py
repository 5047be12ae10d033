"""Usage, prices, budgets and run timings over line items and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkspark.operators import usage as u
from inkspark.operators.ordering import admitted
from inkspark.queries import query
from inkspark.sources.tables import millis, prices, table, usage

USAGE = """
WITH usage AS (
  SELECT l_orderkey AS invocation_id, l_linenumber AS attempt_number, l_partkey AS model_id,
    CASE WHEN l_linestatus = 'F' THEN 'SUCCEEDED' ELSE 'FAILED' END AS status,
    CASE WHEN l_returnflag <> 'N' THEN (l_quantity * 1000)::BIGINT END AS input_tokens,
    CASE WHEN l_linenumber <> 3 THEN (l_linenumber * 7000)::BIGINT END AS cached_tokens,
    CASE WHEN l_returnflag <> 'N' THEN (l_quantity * 10)::BIGINT END AS output_tokens,
    CASE WHEN l_linenumber <> 5 THEN (l_quantity * 20 + l_linenumber)::BIGINT END AS latency_ms, l_shipdate AS created_at
  FROM lineitem),
prices AS (
  SELECT p_partkey AS model_id, 1000000::BIGINT AS input_rate, CASE WHEN p_size % 5 <> 0 THEN 250000::BIGINT END AS cached_rate, 2000000::BIGINT AS output_rate
  FROM part WHERE p_size % 7 <> 0),
costs AS (
  SELECT *, CASE WHEN quality = 'ACTUAL' THEN ((i - c) * input_rate // 1000000) + coalesce(c * cached_rate // 1000000, 0) + (o * output_rate // 1000000) END::BIGINT AS cost
  FROM (SELECT u.*, p.input_rate, p.cached_rate, p.output_rate, coalesce(input_tokens, 0) AS i, coalesce(cached_tokens, 0) AS c, coalesce(output_tokens, 0) AS o,
      CASE WHEN p.model_id IS NULL THEN 'UNPRICED'
           WHEN input_tokens IS NULL AND cached_tokens IS NULL AND output_tokens IS NULL THEN 'MISSING_USAGE'
           WHEN coalesce(cached_tokens, 0) > coalesce(input_tokens, 0) THEN 'INVALID_METERING'
           WHEN coalesce(cached_tokens, 0) > 0 AND cached_rate IS NULL THEN 'UNPRICED' ELSE 'ACTUAL' END AS quality
    FROM usage u LEFT JOIN prices p ON u.model_id = p.model_id))
"""


def costs(spark, sf_dir):
    return u.costed(usage(table(spark, sf_dir, "lineitem")), prices(table(spark, sf_dir, "part")), ["model_id"])


@query("a19_cost_per_event", USAGE + "SELECT invocation_id, attempt_number, quality, cost FROM costs")
def cost_per_event(spark, sf_dir):
    return costs(spark, sf_dir).select("invocation_id", "attempt_number", "quality", "cost")


@query("a20_usage_summary", USAGE + """
SELECT count(DISTINCT invocation_id)::BIGINT AS invocations, count(*)::BIGINT AS attempts, count(*) FILTER (status = 'SUCCEEDED')::BIGINT AS succeeded,
  (SELECT count(*) FILTER (n > 1) / count(*) FROM (SELECT count(*) AS n FROM usage GROUP BY invocation_id)) AS retry_rate,
  sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens,
  quantile_disc(latency_ms, 0.5)::BIGINT AS latency_p50, quantile_disc(latency_ms, 0.95)::BIGINT AS latency_p95,
  sum(cost)::BIGINT AS cost, count(cost) / count(*) AS coverage FROM costs""")
def usage_summary(spark, sf_dir):
    return u.summary(costs(spark, sf_dir))


@query("a20_quality_histogram", USAGE + "SELECT quality, count(*)::BIGINT AS n FROM costs GROUP BY quality")
def quality_histogram(spark, sf_dir):
    return costs(spark, sf_dir).groupBy("quality").agg(F.count("*").alias("n"))


@query("a21_duplicate_operations", USAGE + """
SELECT count(*)::BIGINT AS priced, (count(*) - count(DISTINCT concat_ws(':', invocation_id, status)))::BIGINT AS duplicates
FROM costs WHERE cost IS NOT NULL AND status = 'SUCCEEDED'""")
def duplicate_operations(spark, sf_dir):
    paid = costs(spark, sf_dir).where((F.col("status") == "SUCCEEDED") & F.col("cost").isNotNull())
    return paid.agg(F.count("*").alias("priced"), (F.count("*") - F.count_distinct(F.concat_ws(":", "invocation_id", "status"))).alias("duplicates"))


@query("a22_run_timing", """
WITH r AS (
  SELECT o_orderkey, o_orderdate AS created_at, min(l_shipdate) AS started_at, CASE WHEN o_orderstatus <> 'O' THEN max(l_shipdate) END AS completed_at
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey, o_orderdate, o_orderstatus),
t AS (
  SELECT completed_at IS NULL AS open, greatest(0, (epoch_us(started_at) // 1000) - (epoch_us(created_at) // 1000)) AS queue,
    CASE WHEN completed_at IS NOT NULL THEN greatest(0, (epoch_us(completed_at) // 1000) - (epoch_us(started_at) // 1000)) END AS run,
    CASE WHEN completed_at IS NOT NULL THEN greatest(0, (epoch_us(completed_at) // 1000) - (epoch_us(created_at) // 1000)) END AS total FROM r)
SELECT count(*)::BIGINT AS runs, count(*) FILTER (open)::BIGINT AS incomplete, quantile_disc(queue, 0.5)::BIGINT AS queue_p50, quantile_disc(queue, 0.95)::BIGINT AS queue_p95,
  quantile_disc(run, 0.5)::BIGINT AS run_p50, quantile_disc(run, 0.95)::BIGINT AS run_p95, quantile_disc(total, 0.5)::BIGINT AS total_p50, quantile_disc(total, 0.95)::BIGINT AS total_p95 FROM t""")
def run_timing(spark, sf_dir):
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    ships = lines.groupBy("l_orderkey").agg(F.min("l_shipdate").alias("started_at"), F.max("l_shipdate").alias("last"))
    runs = orders.join(ships, orders.o_orderkey == ships.l_orderkey).select(
        F.col("o_orderdate").alias("created_at"), "started_at", F.when(F.col("o_orderstatus") != "O", F.col("last")).alias("completed_at"))
    return u.timing(runs)


@query("a02_filtered_sums", """
SELECT coalesce(sum(l_extendedprice) FILTER (date_trunc('day', l_shipdate) = (SELECT date_trunc('day', max(l_shipdate)) FROM lineitem)), 0)::DOUBLE AS day_units,
  round(coalesce(sum(l_extendedprice) FILTER (l_returnflag = 'R'), 0), 2)::DOUBLE AS scope_units, count(*)::BIGINT AS n FROM lineitem""")
def filtered_sums(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_shipdate", "l_extendedprice", "l_returnflag")
    last = lines.agg(F.date_trunc("day", F.max("l_shipdate")).alias("day"))
    price = F.col("l_extendedprice")
    return lines.join(F.broadcast(last)).agg(  # one row
        F.coalesce(F.sum(F.when(F.date_trunc("day", "l_shipdate") == F.col("day"), price)), F.lit(0.0)).alias("day_units"),
        F.round(F.coalesce(F.sum(F.when(F.col("l_returnflag") == "R", price)), F.lit(0.0)), 2).alias("scope_units"), F.count("*").alias("n"))


@query("a04_scalar_arithmetic", """
SELECT (SELECT sum(n_chars) FROM documents)::BIGINT + 2 * (SELECT count(*) FROM events WHERE event_type = 'error')::BIGINT AS used_bytes,
  (SELECT count(*) FROM orders WHERE o_orderstatus = 'O')::BIGINT AS open_sessions""")
def scalar_arithmetic(spark, sf_dir):
    stored = table(spark, sf_dir, "documents").agg(F.sum("n_chars").alias("stored"))
    errors = table(spark, sf_dir, "events").where("event_type = 'error'").agg(F.count("*").alias("uploads"))
    opened = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").agg(F.count("*").alias("open_sessions"))
    return stored.join(errors).join(opened).select((F.col("stored") + 2 * F.col("uploads")).alias("used_bytes"), "open_sessions")  # three single rows


@query("f03_usage_filter", USAGE + """
SELECT model_id, count(*)::BIGINT AS n FROM usage WHERE created_at >= TIMESTAMP '1994-01-01' AND created_at <= TIMESTAMP '1995-12-31' AND status = 'SUCCEEDED' GROUP BY model_id""")
def usage_filter(spark, sf_dir):
    """The window is closed at both ends; further conditions are joined as given."""
    wanted = {"status": "SUCCEEDED", "model_id": None}
    rows = usage(table(spark, sf_dir, "lineitem")).where("created_at >= timestamp'1994-01-01' and created_at <= timestamp'1995-12-31'")
    for column, value in wanted.items():
        rows = rows if value is None else rows.where(F.col(column) == value)
    return rows.groupBy("model_id").agg(F.count("*").alias("n"))


@query("p22_budget_admission", """
WITH RECURSIVE o AS (
  SELECT o_custkey, date_trunc('month', o_orderdate) AS day, o_orderkey, o_totalprice AS p,
    row_number() OVER (PARTITION BY o_custkey, date_trunc('month', o_orderdate) ORDER BY o_orderdate, o_orderkey) AS k FROM orders),
f AS (
  SELECT o_custkey, day, o_orderkey, k, p <= 300000 AS fits, CASE WHEN p > 0 AND p <= 300000 THEN p ELSE 0 END AS used FROM o WHERE k = 1
  UNION ALL
  SELECT o.o_custkey, o.day, o.o_orderkey, o.k, o.p <= 0 OR f.used + o.p <= 300000, f.used + CASE WHEN o.p > 0 AND f.used + o.p <= 300000 THEN o.p ELSE 0 END
  FROM f JOIN o ON o.o_custkey = f.o_custkey AND o.day = f.day AND o.k = f.k + 1)
SELECT o_custkey, day, o_orderkey, fits AS within_limit FROM f""")
def budget_within(spark, sf_dir):
    """Requests of a period in order; each that fits with those admitted before is admitted itself."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", F.date_trunc("month", "o_orderdate").cast("timestamp_ntz").alias("day"), "o_orderdate", "o_orderkey", "o_totalprice")
    return admitted(orders, ["o_custkey", "day"], ["o_orderdate", "o_orderkey"], "o_totalprice", 300_000).select("o_custkey", "day", "o_orderkey", "within_limit")


@query("d04_stuck", """
SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' AND age > 15 * 86400000 THEN 'STUCK' WHEN o_orderstatus = 'P' THEN 'RUNNING' WHEN o_orderstatus = 'O' THEN 'QUEUED' ELSE 'DONE' END AS state
FROM (SELECT *, (SELECT (epoch_us(max(o_orderdate)) // 1000) FROM orders) - (epoch_us(o_orderdate) // 1000) AS age FROM orders)""")
def stuck(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    clock = orders.agg(F.max("o_orderdate").alias("now"))
    age = millis("now") - millis("o_orderdate")
    queued = F.col("o_orderstatus") == "O"
    return orders.join(F.broadcast(clock)).select(  # one row
        "o_orderkey", F.when(queued & (age > 15 * 86_400_000), "STUCK").when(F.col("o_orderstatus") == "P", "RUNNING").when(queued, "QUEUED").otherwise("DONE").alias("state"))


@query("d03_day_truncation", "SELECT date_trunc('day', l_shipdate)::TIMESTAMP AS day, count(*)::BIGINT AS n FROM lineitem GROUP BY 1")
def day_truncation(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy(F.date_trunc("day", "l_shipdate").cast("timestamp_ntz").alias("day")).agg(F.count("*").alias("n"))
