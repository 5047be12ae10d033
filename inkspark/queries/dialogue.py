"""Dialogue windows over conversations: role is the host, turn the order."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkspark.functions.text import units
from inkspark.operators import dialogue as d
from inkspark.queries import query
from inkspark.sources.tables import table

SETS = r"""
WITH c AS (SELECT conv_id, turn, role, text, list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS w FROM conversations),
adj AS (SELECT *, lag(w) OVER t AS b, lag(length(text)) OVER t AS bl FROM c WINDOW t AS (PARTITION BY conv_id ORDER BY turn)),
sim AS (SELECT *, CASE WHEN b IS NULL THEN NULL WHEN len(list_distinct(list_concat(w, b))) > 0 THEN len(list_intersect(w, b)) / len(list_distinct(list_concat(w, b))) ELSE 0 END AS s FROM adj)
"""
ALT = """
WITH l AS (SELECT conv_id, role, lag(role, 1) OVER t AS a, lag(role, 2) OVER t AS b, lag(role, 3) OVER t AS c FROM conversations WINDOW t AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, count(c)::BIGINT AS windows, count(*) FILTER (c IS NOT NULL AND role = b AND a = c AND role <> a)::BIGINT AS abab FROM l GROUP BY conv_id"""


def turns(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")


@query("w02_abab", ALT)
def abab(spark, sf_dir):
    return d.alternation(turns(spark, sf_dir))


@query("w03_cyclic", "WITH l AS (SELECT conv_id, " + ", ".join(f"role = lag(role, {p}) OVER t AS p{p}" for p in range(2, 13)) + " FROM conversations WINDOW t AS (PARTITION BY conv_id ORDER BY turn)) SELECT conv_id, round(greatest("
       + ", ".join(f"coalesce(count(*) FILTER (p{p}) / nullif(count(p{p}), 0), 0)" for p in range(2, 13)) + "), 6) AS rate FROM l GROUP BY conv_id")
def cyclic(spark, sf_dir):
    return d.cyclic(turns(spark, sf_dir)).select("conv_id", F.round("rate", 6).alias("rate"))


@query("w04_adjacent_jaccard", SETS + "SELECT conv_id, turn, round(s, 6) AS similarity, coalesce(s >= 0.62, false) AS restates, coalesce(abs(length(text) - bl) <= 8, false) AS same_length FROM sim")
def adjacent_jaccard(spark, sf_dir):
    return d.adjacent(turns(spark, sf_dir)).withColumn("similarity", F.round("similarity", 6))


@query("w05_follow_through", """
WITH l AS (SELECT conv_id, contains(text, 'th') AS ask, coalesce(lead(role, 1) OVER t <> role, false) OR coalesce(lead(role, 2) OVER t <> role, false) OR coalesce(lead(role, 3) OVER t <> role, false) AS ans
FROM conversations WINDOW t AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, count(*) FILTER (ask)::BIGINT AS asked, count(*) FILTER (ask AND ans)::BIGINT AS answered FROM l GROUP BY conv_id""")
def follow_through(spark, sf_dir):
    return d.follow_through(turns(spark, sf_dir), F.contains(F.col("text"), F.lit("th")))


@query("w06_callbacks", SETS + """
SELECT x.conv_id, x.turn, coalesce(bool_or(CASE WHEN y.turn IS NOT NULL AND len(list_distinct(list_concat(x.w, y.w))) > 0 THEN len(list_intersect(x.w, y.w)) / len(list_distinct(list_concat(x.w, y.w))) >= 0.2 END), false) AS called_back
FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM c) x LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM c) y ON x.conv_id = y.conv_id AND y.k <= x.k - 2
GROUP BY x.conv_id, x.turn""")
def callbacks(spark, sf_dir):
    return d.callbacks(turns(spark, sf_dir))


@query("a26_speakers", """
SELECT conv_id, role, count(*)::BIGINT AS turns, round(avg(length(text)), 6) AS mean_length, round(count(*) FILTER (contains(text, '?')) / count(*), 6) AS question_rate,
  round(count(*) / sum(count(*)) OVER (PARTITION BY conv_id), 6) AS share FROM conversations GROUP BY conv_id, role""")
def speakers(spark, sf_dir):
    rows = d.speakers(turns(spark, sf_dir))
    return rows.select("conv_id", "role", "turns", *(F.round(c, 6).alias(c) for c in ("mean_length", "question_rate", "share")))


@query("a27_variance", "SELECT conv_id, round(var_pop(length(text)), 4) AS variance FROM conversations GROUP BY conv_id")
def variance(spark, sf_dir):
    return turns(spark, sf_dir).groupBy("conv_id").agg(F.round(F.var_pop(units(F.col("text"))), 4).alias("variance"))


@query("x20_naturalness", SETS + """
, a AS (""" + ALT.strip().replace("WITH l AS", "WITH l AS") + """),
p AS (SELECT conv_id, avg(CASE WHEN coalesce(s >= 0.62, false) THEN 1.0 ELSE 0.0 END)::DOUBLE AS r, avg(CASE WHEN coalesce(abs(length(text) - bl) <= 8, false) THEN 1.0 ELSE 0.0 END)::DOUBLE AS e, stddev_pop(length(text)) AS sd FROM sim GROUP BY conv_id)
SELECT p.conv_id, round(greatest(0, least(100, 92 - 22 * CASE WHEN windows >= 5 THEN abab / windows ELSE 0 END - 20 * r - 12 * e + least(7, sd / 4))), 4)::DOUBLE AS score FROM p JOIN a ON p.conv_id = a.conv_id""")
def naturalness(spark, sf_dir):
    return d.naturalness(turns(spark, sf_dir)).select("conv_id", F.round("score", 4).alias("score"))
