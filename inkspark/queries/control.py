"""Streams, and checks of state that is kept in tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkspark.operators import admission
from inkspark.queries import query
from inkspark.sources.tables import table
from inkspark.streaming import events as e
from inkspark.streaming import outbox


@query("r01_stream_dedupe", "SELECT user_id, event_type, count(*)::BIGINT AS n FROM (SELECT DISTINCT user_id, event_type FROM events) GROUP BY user_id, event_type")
def stream_dedupe(spark, sf_dir):
    """All files fit one watermark's span here, so each key comes once."""
    stream = e.deduplicated(e.event_stream(spark, sf_dir), ["user_id", "event_type"], "3650 days")
    return e.run_once(stream.select("user_id", "event_type")).groupBy("user_id", "event_type").agg(F.count("*").alias("n"))


@query("r03_stream_rates", """
WITH w AS (SELECT event_type, epoch_us(ts) // 86400000000 AS d, count(*) AS n FROM events GROUP BY 1, 2)
SELECT event_type, d::BIGINT AS day, n::BIGINT AS n, n > 40 AS over_limit FROM w WHERE (d + 1) * 86400000000 <= (SELECT max(epoch_us(ts)) - 999 FROM events)""")
def stream_rates(spark, sf_dir):
    """Days that are over by the last event."""
    days = e.run_once(e.rates(e.event_stream(spark, sf_dir), ["event_type"], "1 day", 40))
    return days.select("event_type", F.floor(F.unix_seconds("start") / 86400).alias("day"), "n", "over_limit")


@query("r05_circuit_breaker")
def circuit_breaker(spark, sf_dir):
    return e.run_once(e.broken(e.event_stream(spark, sf_dir)))


@query("r02_outbox_merge", "SELECT user_id, count(DISTINCT event_type)::BIGINT AS kinds FROM events GROUP BY user_id")
def outbox_merge(spark, sf_dir):
    """Two runs of an insert-only sink; the second adds nothing."""
    folder = e.shared_folder(spark)
    stream = e.event_stream(spark, sf_dir).select("user_id", "event_type")
    for _ in range(2):
        run = stream.writeStream.foreachBatch(e.merge_batch(f"{folder}/out", ["user_id", "event_type"])).option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start()
        run.awaitTermination()
    return spark.read.parquet(f"{folder}/out").groupBy("user_id").agg(F.count("*").alias("kinds"))


@query("r02_outbox_dispatch")
def outbox_dispatch(spark, sf_dir):
    """Each user's events as an outbox entry: sign-ups add it, views and clicks claim it for a day, purchases send it, errors give it back."""
    kind = F.when(F.col("event_type") == "signup", "ADD").when(F.col("event_type") == "purchase", "SENT").when(F.col("event_type") == "error", "ERROR").otherwise("CLAIM")
    stream = e.event_stream(spark, sf_dir).select(F.col("user_id").alias("entry"), "at", F.col("event_id").alias("number"), kind.alias("kind"), F.lit(None).cast("string").alias("error"))
    return e.run_once(outbox.dispatched(stream, 86_400_000))


@query("r12_heartbeats", """
SELECT user_id, CASE WHEN count(*) FILTER (json_extract_string(props, '$.k') IS NULL) > 0 THEN 'UNKNOWN' WHEN count(*) FILTER (event_type = 'error') > 0 THEN 'DEGRADED' ELSE 'AVAILABLE' END AS state FROM events GROUP BY user_id""")
def heartbeats(spark, sf_dir):
    read = F.from_json("props", "k string")
    state = F.when(F.count_if(read["k"].isNull()) > 0, "UNKNOWN").when(F.count_if(F.col("event_type") == "error") > 0, "DEGRADED").otherwise("AVAILABLE")
    return table(spark, sf_dir, "events").groupBy("user_id").agg(state.alias("state"))


@query("r13_deferred_work", """
SELECT o_orderkey FROM orders JOIN (SELECT l_orderkey, count(*) FILTER (l_linestatus = 'O') AS pending, count(*) FILTER (l_returnflag = 'R') AS failed FROM lineitem GROUP BY l_orderkey) ON o_orderkey = l_orderkey
WHERE pending = 1 AND failed = 0 ORDER BY o_orderdate, o_orderkey LIMIT 25""")
def deferred_work(spark, sf_dir):
    receipts = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count_if(F.col("l_linestatus") == "O").alias("pending"), F.count_if(F.col("l_returnflag") == "R").alias("failed"))
    ready = receipts.where("pending = 1 and failed = 0")
    return table(spark, sf_dir, "orders").join(ready, F.col("o_orderkey") == F.col("l_orderkey")).orderBy("o_orderdate", "o_orderkey").limit(25).select("o_orderkey")


@query("p24_capacity", "SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'P')::BIGINT AS active, count(*) FILTER (o_orderstatus = 'P') < 16 AS admits FROM orders GROUP BY o_orderpriority")
def capacity(spark, sf_dir):
    active = F.count_if(F.col("o_orderstatus") == "P")
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(active.alias("active"), (active < 16).alias("admits"))


@query("p25_grounding", """
WITH u AS (SELECT conv_id AS run, turn, text, turn % 3 <> 0 AS substantive, turn % 4 = 1 AS direct, length(text) AS n FROM conversations),
e AS (SELECT *, CASE WHEN turn % 11 = 5 THEN n - 3 ELSE 0 END AS a, CASE WHEN turn % 11 = 5 THEN n + 2 WHEN turn % 11 = 7 THEN 0 ELSE least(n, 12) END AS b,
    CASE WHEN turn % 7 <> 2 THEN substr(text, 1, 12) || CASE WHEN turn % 13 = 6 THEN '?' ELSE '' END END AS quote FROM u WHERE turn % 5 <> 4),
f AS (
  SELECT run, 'UNSUPPORTED' AS code FROM u WHERE substantive AND turn % 5 = 4
  UNION ALL SELECT run, 'QUOTE_EVIDENCE_TEXT_MISSING' FROM u LEFT JOIN (SELECT run AS r, turn AS t, quote FROM e) ON r = run AND t = turn WHERE direct AND coalesce(quote, '') = ''
  UNION ALL SELECT run, 'INVALID_OFFSETS' FROM e WHERE a < 0 OR b <= a OR b > n
  UNION ALL SELECT run, 'QUOTE_EVIDENCE_MISMATCH' FROM e WHERE quote IS NOT NULL AND substr(text, (greatest(a, 0) + 1)::BIGINT, greatest(0, least(b, n) - greatest(a, 0))::BIGINT) <> quote
  UNION ALL SELECT run, 'QUOTE_NOT_EXACT' FROM e WHERE direct AND quote <> '' AND NOT contains(text, quote)
  UNION ALL SELECT run, 'FABRICATED_BIOGRAPHY' FROM u WHERE regexp_matches(text, '(?i)I once worked at|when I worked at'))
SELECT run, code, count(*)::BIGINT AS n FROM f GROUP BY run, code""")
def grounding(spark, sf_dir):
    """Turns as utterances that cite themselves, with faults by their numbers."""
    turns = table(spark, sf_dir, "conversations")
    turn, n, key = F.col("turn"), F.length("text"), F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    said = turns.select(F.col("conv_id").alias("run"), key.alias("utterance"), "text", (turn % 3 != 0).alias("substantive"), (turn % 4 == 1).alias("direct"))
    evidence = turns.where("turn % 5 <> 4").select(
        key.alias("evidence"), key.alias("utterance"), key.alias("block"), F.when(turn % 11 == 5, n - 3).otherwise(0).alias("first"),
        F.when(turn % 11 == 5, n + 2).when(turn % 11 == 7, 0).otherwise(F.least(n, F.lit(12))).alias("last"),
        F.when(turn % 7 != 2, F.concat(F.substring("text", 1, 12), F.when(turn % 13 == 6, "?").otherwise(""))).alias("quote"))
    failures = admission.podcast_grounding(said, evidence, turns.select(key.alias("block"), F.col("text").alias("content")))
    return failures.groupBy("run", "code").agg(F.count("*").alias("n"))


@query("p26_scene_gate", """
SELECT conv_id, max(turn) + 1 = count(*) AND min(turn) = 0 AS contiguous, sum(length(text)) * 60 <= 1.15 * 400000 AS within_total FROM conversations GROUP BY conv_id""")
def scene_gate(spark, sf_dir):
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(
        ((F.max("turn") + 1 == F.count("*")) & (F.min("turn") == 0)).alias("contiguous"), (F.sum(F.length("text")) * 60 <= 1.15 * 400000).alias("within_total"))


@query("p09_relations", """
WITH e AS (SELECT DISTINCT a.l_orderkey AS run, a.l_partkey AS x, b.l_partkey AS y FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 WHERE a.l_partkey <> b.l_partkey)
SELECT run, count(*)::BIGINT AS edges FROM e GROUP BY run""")
def relations(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("run"), F.col("l_linenumber").alias("k"), F.col("l_partkey").alias("x"))
    after = lines.select("run", (F.col("k") - 1).alias("k"), F.col("x").alias("y"))
    return lines.join(after, ["run", "k"]).where("x <> y").select("run", "x", "y").distinct().groupBy("run").agg(F.count("*").alias("edges"))
