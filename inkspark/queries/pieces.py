"""Splits and layouts that follow a text from its start, and what is built on them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from inkspark.functions import pieces as p
from inkspark.functions import text as t
from inkspark.plans.structure import greedy, soft_split
from inkspark.queries import query
from inkspark.queries.documents import GREEDY
from inkspark.sources.tables import table

PIECE = {"piece": ("string", pa.string())}


def docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "text")


@query("x03_soft_split")
def soft(spark, sf_dir):
    return p.over_texts(docs(spark, sf_dir), "doc_id", "text", lambda x: soft_split(x, 1600), {"start": ("int", pa.int32()), "finish": ("int", pa.int32())})


@query("x04_speech_split")
def speech(spark, sf_dir):
    return p.over_texts(docs(spark, sf_dir), "doc_id", "text", lambda x: [(s,) for s in p.speech_pieces(x)], PIECE)


@query("x05_narration_split")
def narration(spark, sf_dir):
    return p.over_texts(docs(spark, sf_dir), "doc_id", "text", lambda x: [(s,) for s in p.narration_pieces(x)], PIECE)


@query("x07_reading_layout")
def layout(spark, sf_dir):
    return p.over_texts(docs(spark, sf_dir), "doc_id", "text", p.reading_layout, {"kind": ("string", pa.string()), **PIECE})


@query("x25_card_wrapping")
def cards(spark, sf_dir):
    """Lines of each turn on a card of 24 by 40; turns that don't fit have one row without a line."""
    turns = table(spark, sf_dir, "conversations").select(F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), "text")
    return p.over_texts(turns, "id", "text", lambda x: [(s,) for s in p.wrapped(x, 24, 40) or [None]], {"line": ("string", pa.string())})


@query("x29_cross_format", r"""
SELECT doc_id, sha256(trim(regexp_replace(replace(replace(nfc_normalize(coalesce(text, '')), chr(160), ' '), chr(173), ''), '[ \t\r\n\f\v]+', ' ', 'g'))) AS digest FROM documents""")
def cross_format(spark, sf_dir):
    rows = p.over_texts(docs(spark, sf_dir), "doc_id", "text", lambda x: [(p.comparable(x),)], PIECE)
    return rows.select("doc_id", F.sha2("piece", 256).alias("digest"))


@query("m04_fake_embedding")
def embedding(spark, sf_dir):
    return p.over_texts(docs(spark, sf_dir), "doc_id", "text", lambda x: [(p.fake_embedding(x),)], {"vector": ("array<double>", pa.list_(pa.float64()))}).drop("ordinal")


@query("m09_rescale")
def rescale(spark, sf_dir):
    """Each conversation's turns as scenes of 60 ms a character, brought to 60 s."""
    scenes = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", (F.length("text") * 60).alias("ms")))).alias("s"))
    lists = scenes.select("conv_id", F.transform("s", lambda x: x["ms"]).alias("ms"))
    return p.over_texts(lists, "conv_id", "ms", lambda x: [(ms,) for ms in p.rescaled(list(x), 60_000)], {"ms": ("int", pa.int32())})


@query("a34_gain", """
SELECT vec_id, round(CASE WHEN rms > 0 THEN least(0.1 / rms, 0.98 / peak) ELSE 1 END, 6)::DOUBLE AS gain FROM (
  SELECT vec_id, sqrt(list_avg(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS rms, list_max(list_transform(embedding, lambda x: abs(x::DOUBLE))) AS peak FROM embeddings)""")
def gain(spark, sf_dir):
    return p.over_texts(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", lambda x: [(p.gained(np.array(list(x), float)),)], {"gain": ("double", pa.float64())}).select("vec_id", F.round("gain", 6).alias("gain"))


@query("p08_evidence", r"""
WITH b AS (SELECT doc_id, generate_subscripts(l, 1) - 1 AS o, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)),
c AS (SELECT doc_id, o, substr(line, 3, 8) AS quote, CASE WHEN o % 3 = 0 THEN 4 ELSE 2 END AS a, line FROM b WHERE length(line) >= 20)
SELECT doc_id, count(*)::BIGINT AS candidates, count(*) FILTER (substr(line, a + 1, 8) = quote)::BIGINT AS accepted FROM c GROUP BY doc_id""")
def evidence(spark, sf_dir):
    """A span counts if it lies in the block and reads as its quote."""
    lines = docs(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("o", "line")).where(F.length("line") >= 20)
    start = F.when(F.col("o") % 3 == 0, 4).otherwise(2)
    error = t.span_error(F.col("line"), start, start + 8, F.substring("line", 3, 8))
    return lines.groupBy("doc_id").agg(F.count("*").alias("candidates"), F.count_if(error.isNull()).alias("accepted"))


@query("p12_context_pack", GREEDY.format(items="""
  SELECT request, id, score, cost FROM (
    SELECT b.label AS request, b.vec_id AS id, round(list_dot_product(a.e::DOUBLE[], b.embedding::DOUBLE[]) / (sqrt(list_dot_product(a.e::DOUBLE[], a.e::DOUBLE[])) * sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[]))), 6) AS score,
      1 + b.vec_id % 7 AS cost, row_number() OVER (PARTITION BY b.label ORDER BY score DESC, b.vec_id) AS place
    FROM embeddings b JOIN (SELECT label, arg_min(embedding, vec_id) AS e FROM embeddings GROUP BY label) a ON a.label = b.label) WHERE place <= 100""", limit=40, name="label"))
def context_pack(spark, sf_dir):
    """The vectors next to the first of each document by cosine, as many as a budget of 40 takes."""
    from inkspark.functions import vectors as v

    rows = table(spark, sf_dir, "embeddings")
    first = rows.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("e"))
    scored = rows.join(first, "label").select("label", F.col("vec_id").alias("id"), F.round(v.cosine(F.col("e"), F.col("embedding")), 6).alias("score"), (1 + F.col("vec_id") % 7).alias("cost"))
    best = scored.withColumn("k", F.row_number().over(Window.partitionBy("label").orderBy(F.desc("score"), "id"))).where("k <= 100")
    return greedy(best, "label", 40)


@query("f11_bounded_request", "SELECT conv_id, turn, CASE WHEN length(text) > 1000 THEN 'WHOLE_SOURCE' WHEN length(text) = 0 THEN 'EMPTY' END AS error FROM conversations")
def bounded_request(spark, sf_dir):
    n = F.length("text")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(n > 1000, "WHOLE_SOURCE").when(n == 0, "EMPTY").alias("error"))


@query("f20_snapshot", """
SELECT o_orderkey, count(s_suppkey) = count(*) AS accepted FROM orders JOIN lineitem ON o_orderkey = l_orderkey LEFT JOIN (SELECT * FROM supplier WHERE s_suppkey % 9 <> 4) ON l_suppkey = s_suppkey GROUP BY o_orderkey""")
def snapshot(spark, sf_dir):
    """Accepted only if every speaker of it exists."""
    known = table(spark, sf_dir, "supplier").where("s_suppkey % 9 <> 4").select("s_suppkey")
    lines = table(spark, sf_dir, "lineitem").join(known, F.col("l_suppkey") == F.col("s_suppkey"), "left")
    return lines.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg((F.count("s_suppkey") == F.count("*")).alias("accepted"))
