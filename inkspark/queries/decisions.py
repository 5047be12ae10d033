"""Decision tables over the driver's tables in the roles of runs, pages, reviews and edits."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from inkspark.operators import admission
from inkspark.operators import decisions as d
from inkspark.queries import query
from inkspark.sources.tables import table

STATE = "CASE o_custkey % 4 WHEN 0 THEN 'UNASSESSED' WHEN 1 THEN 'NEEDS_REVIEW' WHEN 2 THEN 'DEVELOPING' ELSE 'DEMONSTRATED' END"
DAYS = "[" + ", ".join(str(days) for days in d.REVIEW_DAYS.values()) + "]"
MARKS = "WITH m AS (SELECT l_orderkey, l_linenumber, CASE l_returnflag WHEN 'A' THEN 'MET' WHEN 'R' THEN CASE WHEN l_quantity < 10 THEN 'NOT_MET' ELSE 'PARTIAL' END ELSE 'MET' END AS mark FROM lineitem)"


def mastery_of(column):
    k = F.col(column) % 4
    return F.when(k == 0, "UNASSESSED").when(k == 1, "NEEDS_REVIEW").when(k == 2, "DEVELOPING").otherwise("DEMONSTRATED")


def reviews(spark, sf_dir):
    """Customers' orders as reviews of a memory: (o_custkey, mastery, n, last)."""
    orders = table(spark, sf_dir, "orders").groupBy("o_custkey").agg((F.count("*") - 1).alias("n"), F.max("o_orderdate").alias("last"))
    return orders.withColumn("mastery", mastery_of("o_custkey"))


def marks(spark, sf_dir):
    flag = F.col("l_returnflag")
    mark = F.when(flag != "R", "MET").when(F.col("l_quantity") < 10, "NOT_MET").otherwise("PARTIAL")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", mark.alias("mark"))


REVIEWS = f"WITH r AS (SELECT o_custkey, {STATE} AS mastery, count(*) - 1 AS n, max(o_orderdate) AS last FROM orders GROUP BY o_custkey), s AS (SELECT *, {DAYS}[(o_custkey % 4 + 1)::INTEGER][(least(n, 5) + 1)::INTEGER] AS days FROM r)"


@query("d02_schedule", REVIEWS + "SELECT o_custkey, mastery, days::BIGINT AS days, last + to_days(days::INTEGER) AS due FROM s")
def schedule(spark, sf_dir):
    days = d.review_days(F.col("mastery"), F.col("n"))
    return reviews(spark, sf_dir).withColumn("days", days.cast("long")).select("o_custkey", "mastery", "days", (F.col("last") + F.make_dt_interval(days)).alias("due"))


@query("l06_recommendations", REVIEWS + """
SELECT o_custkey FROM s ORDER BY CASE WHEN last + to_days(days::INTEGER) <= TIMESTAMP '1998-07-01' THEN CASE mastery WHEN 'NEEDS_REVIEW' THEN 0 WHEN 'DEVELOPING' THEN 1 WHEN 'UNASSESSED' THEN 2 ELSE 3 END ELSE 4 END,
  last + to_days(days::INTEGER), o_custkey LIMIT 50""")
def recommendations(spark, sf_dir):
    due = F.col("last") + F.make_dt_interval(d.review_days(F.col("mastery"), F.col("n")))
    rows = reviews(spark, sf_dir).withColumn("due", due)
    return rows.orderBy(d.due_bucket(F.col("mastery"), F.col("due"), F.expr("timestamp_ntz'1998-07-01'")), "due", "o_custkey").limit(50).select("o_custkey")


@query("a24_mastery_overview", REVIEWS + "SELECT mastery, count(*)::BIGINT AS n, count(*) FILTER (last + to_days(days::INTEGER) <= TIMESTAMP '1998-07-01')::BIGINT AS due_now, count(*) FILTER (n > 0)::BIGINT AS reviewed FROM s GROUP BY mastery")
def mastery_overview(spark, sf_dir):
    due = F.col("last") + F.make_dt_interval(d.review_days(F.col("mastery"), F.col("n")))
    return reviews(spark, sf_dir).groupBy("mastery").agg(
        F.count("*").alias("n"), F.count_if(due <= F.expr("timestamp_ntz'1998-07-01'")).alias("due_now"), F.count_if(F.col("n") > 0).alias("reviewed"))


@query("n07_mastery", MARKS + "SELECT l_orderkey, CASE WHEN bool_or(mark = 'NOT_MET') THEN 'NEEDS_REVIEW' WHEN bool_and(mark = 'MET') THEN 'DEMONSTRATED' ELSE 'DEVELOPING' END AS mastery FROM m GROUP BY l_orderkey")
def mastery(spark, sf_dir):
    return marks(spark, sf_dir).groupBy("l_orderkey").agg(F.collect_set("mark").alias("m")).select("l_orderkey", d.mastery(F.col("m")).alias("mastery"))


@query("a25_weak_points", MARKS + """
SELECT l_linenumber, count(*) FILTER (mark = 'NOT_MET')::BIGINT AS not_met, count(*) FILTER (mark = 'PARTIAL')::BIGINT AS partial, count(DISTINCT l_orderkey)::BIGINT AS memories
FROM m GROUP BY l_linenumber ORDER BY 2 DESC, 3 DESC, 1""")
def weak_points(spark, sf_dir):
    rows = marks(spark, sf_dir).groupBy("l_linenumber").agg(
        F.count_if(F.col("mark") == "NOT_MET").alias("not_met"), F.count_if(F.col("mark") == "PARTIAL").alias("partial"), F.count_distinct("l_orderkey").alias("memories"))
    return rows.orderBy(F.desc("not_met"), F.desc("partial"), "l_linenumber")


PAGES = """
WITH p AS (SELECT doc_id, ordinal, CASE WHEN length(line) > 150 THEN 'TEXT' WHEN length(line) % 3 > 0 THEN 'OCR' ELSE 'EMPTY' END AS route, CASE WHEN length(line) % 11 = 0 THEN 0 ELSE 1 END AS usable
  FROM (SELECT doc_id, generate_subscripts(l, 1) AS ordinal, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)))
"""


def routed(spark, sf_dir):
    """Lines of documents as pages."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("ordinal", "line"))
    n = F.length("line")
    route = d.page_route(F.when(n > 150, n).otherwise(0), F.lit(1), n % 3, F.lit(0), F.lit(0))
    return lines.select("doc_id", "ordinal", route.alias("route"), F.when(n % 11 == 0, 0).otherwise(1).alias("usable"))


@query("p13_routing_plan", PAGES + "SELECT doc_id, string_agg(substr(route, 1, 1), '' ORDER BY ordinal) AS plan, count(*) FILTER (route = 'OCR')::BIGINT AS ocr FROM p GROUP BY doc_id")
def routing_plan(spark, sf_dir):
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("ordinal", "route"))), lambda x: F.substring(x["route"], 1, 1))
    return routed(spark, sf_dir).groupBy("doc_id").agg(F.array_join(ordered, "").alias("plan"), F.count_if(F.col("route") == "OCR").alias("ocr"))


@query("p15_extraction_quality", PAGES + """
SELECT doc_id, CASE WHEN count(*) FILTER (usable > 0) = 0 THEN 'REJECTED' WHEN count(*) FILTER (route <> 'EMPTY' AND usable = 0) > 0 THEN 'REQUIRES_FALLBACK'
  WHEN count(*) FILTER (route = 'OCR') > 0 THEN 'DEGRADED' ELSE 'ACCEPTED' END AS decision FROM p GROUP BY doc_id""")
def extraction_quality(spark, sf_dir):
    return d.extraction_quality(routed(spark, sf_dir))


@query("p14_plan_replay", PAGES + ", q AS (SELECT * FROM p WHERE (doc_id + ordinal) % 50 <> 3) SELECT count(*)::BIGINT AS differences FROM p FULL JOIN q ON p.doc_id = q.doc_id AND p.ordinal = q.ordinal WHERE p.route IS DISTINCT FROM q.route")
def plan_replay(spark, sf_dir):
    plan = routed(spark, sf_dir).select("doc_id", (F.col("ordinal") + 1).alias("ordinal"), "route")
    stored = plan.where((F.col("doc_id") + F.col("ordinal")) % 50 != 3).withColumnRenamed("route", "stored")
    return plan.join(stored, ["doc_id", "ordinal"], "full").where(~F.col("route").eqNullSafe(F.col("stored"))).agg(F.count("*").alias("differences"))


@query("a29_mixed_pages", PAGES + "SELECT doc_id, count(*)::BIGINT AS pages, count(*) FILTER (route = 'TEXT')::BIGINT AS native, count(*) FILTER (route = 'TEXT' AND usable = 0)::BIGINT AS mixed FROM p GROUP BY doc_id")
def mixed_pages(spark, sf_dir):
    native = F.col("route") == "TEXT"
    return routed(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("pages"), F.count_if(native).alias("native"), F.count_if(native & (F.col("usable") == 0)).alias("mixed"))


@query("d05_processing_state", """
SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' AND o_totalprice > 100000 THEN 'SUCCEEDED' WHEN o_orderpriority = '5-LOW' THEN 'NOT_STARTED' WHEN o_orderstatus = 'F' THEN 'FAILED'
  WHEN o_orderdate < TIMESTAMP '1997-01-01' THEN 'DEGRADED' WHEN o_orderstatus = 'P' THEN 'RUNNING' ELSE 'QUEUED' END AS state FROM orders""")
def processing_state(spark, sf_dir):
    status = F.col("o_orderstatus")
    state = d.first_of(
        ((status == "F") & (F.col("o_totalprice") > 100000), "SUCCEEDED"), (F.col("o_orderpriority") == "5-LOW", "NOT_STARTED"), (status == "F", "FAILED"),
        (F.col("o_orderdate") < F.expr("timestamp_ntz'1997-01-01'"), "DEGRADED"), (status == "P", "RUNNING"), otherwise="QUEUED")
    return table(spark, sf_dir, "orders").select("o_orderkey", state.alias("state"))


@query("p33_status_groups", """
SELECT grouped, count(*)::BIGINT AS n FROM (SELECT CASE o_orderstatus WHEN 'F' THEN CASE WHEN o_orderpriority LIKE '1%' THEN 'ATTENTION' ELSE 'READY' END WHEN 'P' THEN 'ACTIVE' ELSE 'WAITING' END AS grouped FROM orders) GROUP BY grouped""")
def status_groups(spark, sf_dir):
    status = F.col("o_orderstatus")
    state = d.first_of(((status == "F") & F.col("o_orderpriority").startswith("1"), "ATTENTION"), (status == "F", "READY"), (status == "P", "ACTIVE"), otherwise="WAITING")
    return table(spark, sf_dir, "orders").groupBy(state.alias("grouped")).agg(F.count("*").alias("n"))


@query("p21_failover", """
WITH x AS (
  SELECT o_orderkey AS k, o_orderkey % 29 AS a, (o_orderkey // 29) % 7 AS e, (o_orderkey // 203) % 5 AS s, o_custkey % 4 AS o FROM orders),
y AS (
  SELECT *, ['TIMEOUT', 'RATE_LIMITED', 'CONTENT_REJECTED', 'CANCELLED', 'OUTPUT_TRUNCATED', 'QUOTA_EXCEEDED', 'OTHER'][(e + 1)::INTEGER] AS error,
    ['NOT_SENT', 'PROVIDER_CONFIRMED_UNBILLED', 'PAID_AND_RECONCILED', 'UNKNOWN'][(o + 1)::INTEGER] AS outcome FROM x)
SELECT k AS o_orderkey, CASE
  WHEN a IN (0, 1) THEN 'NOT_ENABLED' WHEN a IN (2, 3) THEN 'UNSEALED_PLAN' WHEN a IN (4, 5) THEN 'IN_FLIGHT' WHEN error = 'CONTENT_REJECTED' THEN 'CONTENT_POLICY_REVIEW_REQUIRED'
  WHEN error = 'CANCELLED' THEN 'UNSAFE_FAILURE_CLASS' WHEN outcome = 'UNKNOWN' THEN 'UNKNOWN_BILLING' WHEN a = 6 THEN 'NO_PAID_CALL_AUTHORIZATION' WHEN a = 7 THEN 'BUDGET_EXHAUSTED'
  WHEN a = 8 THEN 'ATTEMPT_LIMIT_REACHED' WHEN a = 9 THEN 'NO_BACKUP' WHEN a = 10 THEN 'ATTEMPT_LIMIT_REACHED' WHEN a = 11 THEN 'REPEATED_MODEL' WHEN a IN (12, 13) THEN 'UNPINNED_ROUTE'
  WHEN NOT (outcome = 'PAID_AND_RECONCILED' AND error = 'OUTPUT_TRUNCATED' OR outcome IN ('NOT_SENT', 'PROVIDER_CONFIRMED_UNBILLED') AND error IN ('TIMEOUT', 'RATE_LIMITED', 'QUOTA_EXCEEDED')) THEN 'UNSAFE_FAILURE_CLASS'
  WHEN s = 0 THEN 'EMBEDDING_REINDEX_REQUIRED' WHEN s = 1 THEN 'VISION_PROVIDER_CONSENT_REQUIRED' WHEN s = 2 AND a < 20 THEN 'INDEPENDENT_REVIEW_REQUIRED' WHEN s = 3 AND a < 20 THEN 'SPEECH_VOICE_MAPPING_REQUIRED'
  WHEN a = 28 OR s = 2 AND a = 27 THEN 'INCOMPATIBLE_CAPABILITY' END AS hold FROM y""")
def failover(spark, sf_dir):
    """Orders as failed calls: their keys' remainders say which of the conditions of a switch doesn't hold."""
    a, pick = F.col("a"), lambda names, c: F.element_at(F.array(*map(F.lit, names.split())), (F.col(c) + 1).cast("int"))
    calls = table(spark, sf_dir, "orders").select(
        "o_orderkey", (F.col("o_orderkey") % 29).alias("a"), (F.floor(F.col("o_orderkey") / 29) % 7).alias("e"), (F.floor(F.col("o_orderkey") / 203) % 5).alias("s"), (F.col("o_custkey") % 4).alias("o"))

    def candidate(k: int):
        model = F.when((a == 11) & F.lit(k == 1), "m0").otherwise(f"m{k}")
        return F.struct(
            F.lit("p").alias("provider"), model.alias("model"), F.when(a != 12, "c").alias("connection"), F.lit("v").alias("credential"),
            F.when(a == 13, "PLATFORM").otherwise("WORKSPACE").alias("source"), (a != 28).alias("capable"), (a != 27).alias("structured"))

    typed = calls.select(
        "o_orderkey", (a != 0).alias("enabled"), F.when(a == 1, 0).when(a == 8, 3).otherwise(2).alias("most"), (a != 2).alias("authority"), (a != 3).alias("sealed"), (a != 4).alias("terminal"),
        F.when(a != 5, True).alias("unclaimed"), pick("TIMEOUT RATE_LIMITED CONTENT_REJECTED CANCELLED OUTPUT_TRUNCATED QUOTA_EXCEEDED OTHER", "e").alias("error"),
        pick("NOT_SENT PROVIDER_CONFIRMED_UNBILLED PAID_AND_RECONCILED UNKNOWN", "o").alias("outcome"), (a != 6).alias("may_pay"), (a != 7).alias("has_budget"),
        F.when(a == 10, 1).otherwise(0).alias("switches"), F.when(a == 9, 2).otherwise(0).alias("at"), F.array(*map(candidate, range(3))).alias("candidates"),
        pick("EMBEDDING PDF_VISUAL_STRUCTURE BOOK_SEMANTIC_REVIEW SPEECH CHAT", "s").alias("slot"), (a >= 20).alias("independent"), (a >= 20).alias("voice"))
    return typed.select("o_orderkey", admission.failover_hold().alias("hold"))


@query("p19_identity_promotion", """
SELECT p_partkey, CASE WHEN p_size % 10 = 0 THEN 'SUPERSEDED' WHEN s_suppkey IS NULL THEN 'BLOCKED' WHEN p_size % 3 = 1 AND p_name <> s_name THEN 'CONFLICT' WHEN p_size % 3 = 2 THEN 'NO_OP' ELSE 'APPLIED' END AS outcome
FROM part LEFT JOIN supplier ON p_partkey = s_suppkey""")
def identity_promotion(spark, sf_dir):
    joined = table(spark, sf_dir, "part").join(table(spark, sf_dir, "supplier"), F.col("p_partkey") == F.col("s_suppkey"), "left")
    outcome = d.first_of(
        (F.col("p_size") % 10 == 0, "SUPERSEDED"), (F.col("s_suppkey").isNull(), "BLOCKED"), ((F.col("p_size") % 3 == 1) & (F.col("p_name") != F.col("s_name")), "CONFLICT"),
        (F.col("p_size") % 3 == 2, "NO_OP"), otherwise="APPLIED")
    return joined.select("p_partkey", outcome.alias("outcome"))


@query("f10_response_validation", """
SELECT event_id, CASE WHEN event_type NOT IN ('view', 'click', 'purchase') OR event_type IS NULL THEN 'TYPE' WHEN props IS NULL OR trim(props) = '' THEN 'BLANK' WHEN length(props) > 20000 THEN 'LENGTH' END AS error FROM events""")
def response_validation(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", d.response_error(F.col("event_type"), F.col("props"), ["view", "click", "purchase"]).alias("error"))


@query("f12_event_schema", """
SELECT event_id, CASE WHEN event_type NOT IN ('signup', 'view', 'click', 'purchase') THEN 'NAME' WHEN json_extract_string(props, '$.k') IS NULL THEN 'ENTITY' WHEN octet_length(encode(props)) > 2048 THEN 'SIZE' END AS error FROM events""")
def event_schema(spark, sf_dir):
    error = d.first_of(
        (~F.col("event_type").isin("signup", "view", "click", "purchase"), "NAME"), (F.get_json_object("props", "$.k").isNull(), "ENTITY"), (F.octet_length("props") > 2048, "SIZE"))
    return table(spark, sf_dir, "events").select("event_id", error.alias("error"))


@query("n08_figure_graph", """
WITH g AS (SELECT l_orderkey, list(l_partkey % 40 ORDER BY l_linenumber, l_partkey) AS nodes FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, CASE WHEN len(nodes) > 32 THEN 'SIZE' WHEN len(list_distinct(nodes)) <> len(nodes) THEN 'DUPLICATE' WHEN NOT list_contains(nodes, l_orderkey % 40) THEN 'ENDPOINT' END AS error FROM g""")
def figure_graph(spark, sf_dir):
    graphs = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.col("l_partkey") % 40).alias("nodes"))
    edges = F.array(F.struct((F.col("l_orderkey") % 40).alias("source"), (F.col("l_orderkey") % 40).alias("target")))
    return graphs.select("l_orderkey", d.graph_error(F.col("nodes"), edges).alias("error"))


@query("n09_byte_range", """
WITH r AS (SELECT doc_id, n_chars AS size, doc_id * 3 AS a FROM documents)
SELECT doc_id, CASE WHEN a < size THEN a END::BIGINT AS "first", CASE WHEN a < size THEN least(a + 99, size - 1) END::BIGINT AS "last" FROM r""")
def byte_range(spark, sf_dir):
    header = F.concat(F.lit("bytes="), (F.col("doc_id") * 3).cast("string"), F.lit("-"), (F.col("doc_id") * 3 + 99).cast("string"))
    return table(spark, sf_dir, "documents").select("doc_id", d.byte_range(header, F.col("n_chars")).alias("r")).select("doc_id", "r.first", "r.last")


@query("n03_json_path", "SELECT json_extract_string(props, '$.k') AS k, count(*)::BIGINT AS n FROM events GROUP BY 1")
def json_path(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.get_json_object("props", "$.k").alias("k")).agg(F.count("*").alias("n"))


@query("n04_json_size", "SELECT r_regionkey, octet_length(encode('{\"r_regionkey\":' || r_regionkey || ',\"r_name\":\"' || r_name || '\"}'))::BIGINT AS bytes FROM region")
def json_size(spark, sf_dir):
    return table(spark, sf_dir, "region").select("r_regionkey", F.octet_length(F.to_json(F.struct("r_regionkey", "r_name"))).cast("long").alias("bytes"))


@query("n05_map_build", "SELECT o_custkey, count(*) FILTER (o_orderstatus = 'F')::BIGINT AS f, count(*) FILTER (o_orderstatus = 'O')::BIGINT AS o FROM orders GROUP BY o_custkey")
def map_build(spark, sf_dir):
    counts = table(spark, sf_dir, "orders").groupBy("o_custkey", "o_orderstatus").agg(F.count("*").alias("n"))
    maps = counts.groupBy("o_custkey").agg(F.map_from_entries(F.collect_list(F.struct("o_orderstatus", "n"))).alias("m"))
    return maps.select("o_custkey", *(F.coalesce(F.try_element_at("m", F.lit(k.upper())), F.lit(0)).alias(k) for k in "fo"))


@query("n02_explode_collect", "SELECT l_orderkey, string_agg(l_partkey::VARCHAR, ',' ORDER BY l_partkey) AS parts FROM lineitem GROUP BY l_orderkey")
def explode_collect(spark, sf_dir):
    """An order's lines as one array, taken apart with their places and gathered again."""
    grouped = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list("l_partkey")).alias("k"))
    again = grouped.select("l_orderkey", F.posexplode("k").alias("place", "id")).groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("place", "id"))).alias("k"))
    return again.select("l_orderkey", F.array_join(F.transform("k", lambda x: x["id"].cast("string")), ",").alias("parts"))


@query("a32_progress", "SELECT o_custkey, CASE WHEN count(*) > 0 THEN least(100, floor(count(*) FILTER (o_orderstatus = 'F') / count(*) * 1000 + 0.5) / 10) END::DOUBLE AS percent FROM orders GROUP BY o_custkey")
def progress(spark, sf_dir):
    done, total = F.count_if(F.col("o_orderstatus") == "F"), F.count("*")
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.when(total > 0, F.least(F.lit(100.0), F.floor(done / total * 1000 + 0.5) / 10)).alias("percent"))


@query("p31_caption_gate", """
WITH c AS (SELECT conv_id, turn, coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * 60 - (turn % 3) AS a,
  sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) * 60 AS b FROM conversations)
SELECT conv_id, count(*) FILTER (b - a < 1000)::BIGINT AS too_short, count(*) FILTER (a < e)::BIGINT AS overlaps FROM (SELECT *, lag(b) OVER (PARTITION BY conv_id ORDER BY turn) AS e FROM c) GROUP BY conv_id""")
def caption_gate(spark, sf_dir):
    by = Window.partitionBy("conv_id").orderBy("turn")
    total = F.sum(F.length("text")).over(by.rowsBetween(Window.unboundedPreceding, 0)) * 60
    before = F.coalesce(F.sum(F.length("text")).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) * 60
    cues = table(spark, sf_dir, "conversations").select("conv_id", "turn", (before - F.col("turn") % 3).alias("a"), total.alias("b"))
    return cues.withColumn("e", F.lag("b").over(by)).groupBy("conv_id").agg(F.count_if(F.col("b") - F.col("a") < 1000).alias("too_short"), F.count_if(F.col("a") < F.col("e")).alias("overlaps"))


@query("p30_job_diagnostics", """
SELECT o_orderkey, coalesce(n, 0)::BIGINT AS attempts, o_orderstatus = 'O' AND coalesce(n, 0) > 5 AS is_stuck FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_linestatus = 'O' GROUP BY l_orderkey) ON o_orderkey = l_orderkey
WHERE o_orderstatus <> 'F' ORDER BY o_orderdate, o_orderkey LIMIT 100""")
def job_diagnostics(spark, sf_dir):
    n = table(spark, sf_dir, "lineitem").where("l_linestatus = 'O'").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    first = table(spark, sf_dir, "orders").where("o_orderstatus <> 'F'").orderBy("o_orderdate", "o_orderkey").limit(100)
    attempts = F.coalesce("n", F.lit(0))
    return first.join(n, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", attempts.alias("attempts"), ((F.col("o_orderstatus") == "O") & (attempts > 5)).alias("is_stuck"))
