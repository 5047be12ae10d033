"""Activation, retention and other product metrics over events."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkspark.operators import metrics as m
from inkspark.operators.ordering import nearest_ranks
from inkspark.queries import query
from inkspark.sources.tables import ANALYSIS, MEANINGFUL, SESSION, as_of, hours, millis, participants, table

BASE = """
WITH clock AS (SELECT max(ts) AS as_of FROM events),
people AS (
  SELECT user_id, min(ts) AS enrolled_at, user_id % 2 AS cohort FROM events WHERE event_type = 'signup' GROUP BY user_id),
acts AS (
  SELECT e.user_id, e.ts, e.event_type, e.props FROM events e JOIN people p ON e.user_id = p.user_id, clock
  WHERE e.ts >= p.enrolled_at AND e.ts <= as_of),
firsts AS (
  SELECT user_id, min(ts) FILTER (event_type = 'view') AS a, min(ts) FILTER (event_type = 'purchase') AS b FROM acts GROUP BY user_id),
activated AS (
  SELECT p.*, CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN greatest(a, b) END AS activated_at
  FROM people p LEFT JOIN firsts f ON p.user_id = f.user_id)
"""


def frames(spark, sf_dir):
    """(people with as_of, their valid activity)."""
    events = table(spark, sf_dir, "events").select("user_id", "ts", "event_type", "props", "value")
    people = participants(events).join(F.broadcast(as_of(events)))  # one row
    activity = events.join(people.select("user_id", "enrolled_at", "as_of"), "user_id").where(m.valid("ts"))
    return people, activity


def activated(spark, sf_dir):
    people, activity = frames(spark, sf_dir)
    return m.activation(people, activity, [ANALYSIS], [MEANINGFUL]), activity


@query("a08_first_meaningful", BASE + "SELECT user_id, (epoch_us(min(ts)) // 1000)::BIGINT AS first_ms FROM acts WHERE event_type IN ('purchase', 'click') GROUP BY user_id")
def first_meaningful(spark, sf_dir):
    _, activity = frames(spark, sf_dir)
    return m.first_per_user(activity, [MEANINGFUL, SESSION], "first").select("user_id", millis("first").alias("first_ms"))


@query("a09_activation", BASE + "SELECT count(*)::BIGINT AS enrolled, count(activated_at)::BIGINT AS activated, CASE WHEN count(*) > 0 THEN count(activated_at) / count(*) END AS rate FROM activated")
def activation(spark, sf_dir):
    done, _ = activated(spark, sf_dir)
    n, d = F.count("activated_at"), F.count("*")
    return done.agg(d.alias("enrolled"), n.alias("activated"), m.rate(n, d).alias("rate"))


@query("a10_activation_24h", BASE + """
SELECT count(*)::BIGINT AS eligible, count(*) FILTER (activated_at <= enrolled_at + INTERVAL 24 HOUR)::BIGINT AS activated
FROM activated, clock WHERE enrolled_at + INTERVAL 24 HOUR <= as_of""")
def activation_24h(spark, sf_dir):
    done, _ = activated(spark, sf_dir)
    limit = F.col("enrolled_at") + hours(24)
    return done.where(limit <= F.col("as_of")).agg(
        F.count("*").alias("eligible"), F.count_if(F.col("activated_at") <= limit).alias("activated"))


@query("a11_time_to_activation", BASE + """
, t AS (SELECT (epoch_us(activated_at) // 1000) - (epoch_us(enrolled_at) // 1000) AS ms FROM activated WHERE activated_at IS NOT NULL)
SELECT count(*)::BIGINT AS n, quantile_disc(ms, 0.5)::BIGINT AS p50, quantile_disc(ms, 0.95)::BIGINT AS p95, count(*) FILTER (ms < 0)::BIGINT AS negative FROM t""")
def time_to_activation(spark, sf_dir):
    done, _ = activated(spark, sf_dir)
    times = done.where("activated_at is not null").select(m.elapsed("activated_at", "enrolled_at").alias("ms"))
    counts = times.agg(F.count("*").alias("n"), F.count_if(F.col("ms") < 0).alias("negative"))
    return counts.join(nearest_ranks(times, ["ms"], [0.5, 0.95])).select("n", F.col("ms_p50").alias("p50"), F.col("ms_p95").alias("p95"), "negative")  # single rows


def retention_sql(kinds: str, start: int) -> str:
    return BASE + f"""
, r AS (
  SELECT a.user_id, activated_at + INTERVAL {start + 24} HOUR <= as_of AS eligible,
         EXISTS (SELECT 1 FROM acts e WHERE e.user_id = a.user_id AND e.event_type IN ({kinds})
                 AND e.ts >= activated_at + INTERVAL {start} HOUR AND e.ts < activated_at + INTERVAL {start + 24} HOUR) AS back
  FROM activated a, clock WHERE activated_at IS NOT NULL)
SELECT count(*) FILTER (eligible)::BIGINT AS eligible, count(*) FILTER (eligible AND back)::BIGINT AS retained,
       CASE WHEN count(*) FILTER (eligible) > 0 THEN count(*) FILTER (eligible AND back) / count(*) FILTER (eligible) END AS rate FROM r"""


def retained(spark, sf_dir, kinds, start):
    done, activity = activated(spark, sf_dir)
    n, d = F.count_if("retained"), F.count_if("eligible")
    return m.retention(done, activity, kinds, start).agg(d.alias("eligible"), n.alias("retained"), m.rate(n, d).alias("rate"))


@query("a12_retention_d1", retention_sql("'click'", 24))
def retention_d1(spark, sf_dir):
    return retained(spark, sf_dir, [SESSION], 24)


@query("a12_retention_d7", retention_sql("'click'", 168))
def retention_d7(spark, sf_dir):
    return retained(spark, sf_dir, [SESSION], 168)


@query("a13_meaningful_retention_d1", retention_sql("'purchase', 'click'", 24))
def meaningful_d1(spark, sf_dir):
    return retained(spark, sf_dir, [MEANINGFUL, SESSION], 24)


@query("a13_meaningful_retention_d7", retention_sql("'purchase', 'click'", 168))
def meaningful_d7(spark, sf_dir):
    return retained(spark, sf_dir, [MEANINGFUL, SESSION], 168)


@query("a14_cohort_breakdown", BASE + """
SELECT cohort, count(*)::BIGINT AS enrolled, count(activated_at)::BIGINT AS activated, count(activated_at) / count(*) AS rate
FROM activated GROUP BY cohort ORDER BY cohort""")
def cohort_breakdown(spark, sf_dir):
    done, _ = activated(spark, sf_dir)
    n, d = F.count("activated_at"), F.count("*")
    return done.groupBy("cohort").agg(d.alias("enrolled"), n.alias("activated"), m.rate(n, d).alias("rate")).orderBy("cohort")


@query("a15_ordered_pairs", BASE + """
, pairs AS (SELECT user_id, json_extract_string(props, '$.k') AS k, ts, event_type FROM acts),
s AS (SELECT user_id, k, min(ts) AS first FROM pairs WHERE event_type = 'view' AND k IS NOT NULL GROUP BY user_id, k),
f AS (SELECT user_id, k, max(ts) AS last FROM pairs WHERE event_type = 'purchase' GROUP BY user_id, k)
SELECT count(*)::BIGINT AS pairs, count(*) FILTER (last >= first)::BIGINT AS completed FROM s LEFT JOIN f ON s.user_id = f.user_id AND s.k = f.k""")
def ordered_pairs(spark, sf_dir):
    _, activity = frames(spark, sf_dir)
    keyed = activity.select("user_id", F.get_json_object("props", "$.k").alias("k"), "ts", "event_type").where("k is not null")
    pairs = m.ordered_pairs(keyed.where(F.col("event_type") == ANALYSIS), keyed.where(F.col("event_type") == MEANINGFUL), ["user_id", "k"])
    return pairs.agg(F.count("*").alias("pairs"), F.count_if("completed").alias("completed"))


@query("a16_rating_summary", """
WITH r AS (SELECT (1 + floor(abs(value)) % 5)::BIGINT AS rating FROM events WHERE value IS NOT NULL)
SELECT count(rating)::BIGINT AS n, quantile_disc(rating, 0.5)::BIGINT AS median, count(*) FILTER (rating = 1)::BIGINT AS rated_1,
       count(*) FILTER (rating = 2)::BIGINT AS rated_2, count(*) FILTER (rating = 3)::BIGINT AS rated_3,
       count(*) FILTER (rating = 4)::BIGINT AS rated_4, count(*) FILTER (rating = 5)::BIGINT AS rated_5 FROM r""")
def rating_summary(spark, sf_dir):
    events = table(spark, sf_dir, "events").where("value is not null")
    return m.rating_summary(events.select((F.lit(1) + F.floor(F.abs("value")) % 5).alias("rating")))


@query("a17_safe_rates", """
SELECT event_type, CASE WHEN count(*) FILTER (user_id < 0) > 0 THEN 1.0 END AS metric_rate, coalesce(CASE WHEN count(*) FILTER (user_id < 0) > 0 THEN 1.0 END, 0.0) AS usage_rate
FROM events GROUP BY event_type""")
def safe_rates(spark, sf_dir):
    none = F.count_if(F.col("user_id") < 0)
    return table(spark, sf_dir, "events").groupBy("event_type").agg(
        m.rate(none, none).cast("double").alias("metric_rate"), m.rate(none, none, 0.0).cast("double").alias("usage_rate"))


@query("a18_excluded_events", BASE + "SELECT (SELECT count(*) FROM events)::BIGINT AS raw, (SELECT count(*) FROM acts)::BIGINT AS valid, ((SELECT count(*) FROM events) - (SELECT count(*) FROM acts))::BIGINT AS excluded")
def excluded_events(spark, sf_dir):
    _, activity = frames(spark, sf_dir)
    raw = table(spark, sf_dir, "events").agg(F.count("*").alias("raw"))
    kept = activity.agg(F.count("*").alias("valid"))
    return raw.join(kept).select("raw", "valid", (F.col("raw") - F.col("valid")).alias("excluded"))


@query("a00_flagship", BASE + """
, r AS (
  SELECT a.*, as_of, activated_at + INTERVAL 48 HOUR <= as_of AS e1, activated_at + INTERVAL 192 HOUR <= as_of AS e7,
    EXISTS (SELECT 1 FROM acts e WHERE e.user_id = a.user_id AND e.event_type = 'click' AND e.ts >= activated_at + INTERVAL 24 HOUR AND e.ts < activated_at + INTERVAL 48 HOUR) AS b1,
    EXISTS (SELECT 1 FROM acts e WHERE e.user_id = a.user_id AND e.event_type = 'click' AND e.ts >= activated_at + INTERVAL 168 HOUR AND e.ts < activated_at + INTERVAL 192 HOUR) AS b7
  FROM activated a, clock)
SELECT cohort, count(*)::BIGINT AS enrolled, count(activated_at)::BIGINT AS activated, count(*) FILTER (e1)::BIGINT AS d1_eligible,
       count(*) FILTER (e7)::BIGINT AS d7_eligible, count(*) FILTER (e1 AND b1)::BIGINT AS d1_retained, count(*) FILTER (e7 AND b7)::BIGINT AS d7_retained
FROM r GROUP BY cohort""")
def flagship(spark, sf_dir):
    """One row per cohort: enrolment, activation and retention."""
    done, activity = activated(spark, sf_dir)
    days = [m.retention(done, activity, [SESSION], start).select("user_id", F.col("eligible").alias(f"e{d}"), F.col("retained").alias(f"r{d}")) for d, start in ((1, 24), (7, 168))]
    return done.join(days[0], "user_id", "left").join(days[1], "user_id", "left").groupBy("cohort").agg(
        F.count("*").alias("enrolled"), F.count("activated_at").alias("activated"), F.count_if("e1").alias("d1_eligible"),
        F.count_if("e7").alias("d7_eligible"), F.count_if("r1").alias("d1_retained"), F.count_if("r7").alias("d7_retained"))


@query("f01_cohort_validity", BASE + "SELECT event_type, count(*)::BIGINT AS n FROM acts GROUP BY event_type")
def cohort_validity(spark, sf_dir):
    _, activity = frames(spark, sf_dir)
    return activity.groupBy("event_type").agg(F.count("*").alias("n"))


@query("f02_enrolment_filter", """
SELECT count(*)::BIGINT AS enrolled FROM (
  SELECT c_custkey, min(o_orderdate) AS d FROM customer JOIN orders ON c_custkey = o_custkey WHERE c_mktsegment IN ('BUILDING', 'AUTOMOBILE') GROUP BY c_custkey)
WHERE d <= TIMESTAMP '1995-06-17'""")
def enrolment_filter(spark, sf_dir):
    people = table(spark, sf_dir, "customer").where(F.col("c_mktsegment").isin("BUILDING", "AUTOMOBILE"))
    first = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min("o_orderdate").alias("d"))
    return people.join(first, F.col("c_custkey") == F.col("o_custkey")).where("d <= timestamp'1995-06-17'").agg(F.count("*").alias("enrolled"))


@query("r11_late_activity", BASE + """
SELECT e.event_type, count(*) FILTER (e.ts < p.enrolled_at)::BIGINT AS before_enrolment, count(*) FILTER (p.user_id IS NULL)::BIGINT AS unknown_person,
       count(*) FILTER (e.ts >= p.enrolled_at)::BIGINT AS counted
FROM events e LEFT JOIN people p ON e.user_id = p.user_id GROUP BY e.event_type""")
def late_activity(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", "ts", "event_type")
    joined = events.join(participants(events), "user_id", "left")
    return joined.groupBy("event_type").agg(
        F.count_if(F.col("ts") < F.col("enrolled_at")).alias("before_enrolment"), F.count_if(F.col("enrolled_at").isNull()).alias("unknown_person"),
        F.count_if(F.col("ts") >= F.col("enrolled_at")).alias("counted"))


@query("a35_onboarding_checklist", BASE + """
SELECT p.user_id, coalesce(bool_or(event_type = 'view'), false) AS has_view, coalesce(bool_or(event_type = 'click'), false) AS has_click,
       coalesce(bool_or(event_type = 'purchase'), false) AS has_purchase, coalesce(bool_or(event_type = 'error'), false) AS has_error
FROM people p LEFT JOIN acts a ON p.user_id = a.user_id GROUP BY p.user_id""")
def onboarding(spark, sf_dir):
    people, activity = frames(spark, sf_dir)
    flags = activity.groupBy("user_id").agg(*(F.bool_or(F.col("event_type") == k).alias(f"has_{k}") for k in ("view", "click", "purchase", "error")))
    return people.select("user_id").join(flags, "user_id", "left").fillna(False)
