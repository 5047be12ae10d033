"""Vector functions and ranking over embeddings; a vector's label plays its document."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from inkspark.functions import vectors as v
from inkspark.operators.associations import associated, current_vectors
from inkspark.queries import query
from inkspark.sources.tables import table

COS = "list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / (sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])))"


def probe(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").where("vec_id = 0").select(F.col("vec_id").alias("q"), F.col("embedding").alias("e"))


@query("m01_cosine", f"SELECT b.vec_id, round({COS}, 6) AS cosine FROM embeddings a, embeddings b WHERE a.vec_id = 0")
def cosine(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").join(F.broadcast(probe(spark, sf_dir))).select("vec_id", F.round(v.cosine(F.col("e"), F.col("embedding")), 6).alias("cosine"))  # one row


@query("m02_dot", "SELECT b.vec_id, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS dot FROM embeddings a, embeddings b WHERE a.vec_id = 0")
def dot(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").join(F.broadcast(probe(spark, sf_dir))).select("vec_id", F.round(v.dot(F.col("e"), F.col("embedding")), 6).alias("dot"))  # one row


@query("m03_vector_validation", "SELECT CASE WHEN len(embedding) <> 64 THEN 'DIMENSIONS' WHEN len(list_filter(embedding, lambda x: NOT isfinite(x))) > 0 THEN 'NOT_FINITE' END AS error, count(*)::BIGINT AS n FROM embeddings GROUP BY 1")
def vector_validation(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").groupBy(v.vector_error(F.col("embedding"), 64).alias("error")).agg(F.count("*").alias("n"))


@query("l01_vector_topk", f"""
SELECT b.vec_id, round({COS} + CASE WHEN contains(b.label::VARCHAR, '3') THEN 0.05 ELSE 0 END, 6) AS score FROM embeddings a, embeddings b WHERE a.vec_id = 0
ORDER BY {COS} + CASE WHEN contains(b.label::VARCHAR, '3') THEN 0.05 ELSE 0 END DESC, b.vec_id LIMIT 20""")
def vector_topk(spark, sf_dir):
    """Cosine and a bonus of 0.05 where the query's words are in the content; ids break ties; 1 to 100 rows."""
    bonus = F.when(F.contains(F.col("label").cast("string"), F.lit("3")), 0.05).otherwise(0.0)
    scored = table(spark, sf_dir, "embeddings").join(F.broadcast(probe(spark, sf_dir))).withColumn("s", v.cosine(F.col("e"), F.col("embedding")) + bonus)  # one row
    return scored.where("s is not null").orderBy(F.desc("s"), "vec_id").limit(20).select("vec_id", F.round("s", 6).alias("score"))


#: Memories of twenty books in turn, each with a second edition in the next book whose vector differs somewhat.
EDITIONS = """
WITH v AS (SELECT vec_id, vec_id % 20 AS label, embedding::DOUBLE[] AS e FROM embeddings
  UNION ALL SELECT vec_id + 10000000, (vec_id + 1) % 20, list_transform(embedding::DOUBLE[], lambda x, i: x * (1 + (i - 1) % 4 * 0.25)) FROM embeddings)"""
PAIRS = """p AS (SELECT a.vec_id AS left_id, b.vec_id AS right_id, list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) AS c FROM v a JOIN v b ON a.label <> b.label WHERE a.e IS NOT NULL AND b.e IS NOT NULL)"""


def editions(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", (F.col("vec_id") % 20).alias("label"), F.transform("embedding", lambda x: x.cast("double")).alias("embedding"))
    again = rows.select((F.col("vec_id") + 10_000_000).alias("vec_id"), ((F.col("vec_id") + 1) % 20).alias("label"), F.transform("embedding", lambda x, i: x * (1 + i % 4 * 0.25)).alias("embedding"))
    return rows.union(again)


@query("j09_vector_pairs", EDITIONS + ", " + PAIRS + """
SELECT left_id, right_id, k::INTEGER AS rank, round(c, 6) AS cosine FROM (SELECT *, row_number() OVER (PARTITION BY left_id ORDER BY c DESC, right_id) AS k FROM p WHERE c >= 0.8) WHERE k <= 24""")
def vector_pairs(spark, sf_dir):
    """For every vector the 24 closest ones of other books, at a cosine of 0.8 or more."""
    return associated(editions(spark, sf_dir), 0.8, 24).select("left_id", "right_id", "rank", F.round("score", 6).alias("cosine"))


@query("p28_associations", EDITIONS.replace("WITH v AS", "WITH o AS") + """,
v AS (SELECT vec_id, label, CASE WHEN vec_id % 13 <> 0 THEN e WHEN vec_id % 26 = 0 THEN list_reverse(e) END AS e FROM o),
""" + PAIRS + """
SELECT left_id, right_id, k::INTEGER AS rank, round(c, 6) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY left_id ORDER BY c DESC, right_id) AS k FROM p WHERE c >= 0.8) WHERE k <= 3""")
def associations(spark, sf_dir):
    """The three closest vectors of other books for every current vector, at 0.8 or more. Every 13th memory was revised; of those every
    second has a new vector, the others none yet."""
    rows = editions(spark, sf_dir)
    revisions = rows.where("vec_id % 13 = 0").select("vec_id", F.when(F.col("vec_id") % 26 == 0, F.reverse("embedding")).alias("refreshed"))
    return associated(current_vectors(rows, revisions), 0.8, 3).select("left_id", "right_id", "rank", F.round("score", 6).alias("similarity"))


@query("p10_embedding_batches", "SELECT label, (k - 1) // 16 AS batch, count(*)::BIGINT AS n, min(vec_id)::BIGINT AS first FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS k FROM embeddings) GROUP BY 1, 2")
def embedding_batches(spark, sf_dir):
    ranked = table(spark, sf_dir, "embeddings").withColumn("k", F.row_number().over(Window.partitionBy("label").orderBy("vec_id")))
    return ranked.groupBy("label", F.floor((F.col("k") - 1) / 16).alias("batch")).agg(F.count("*").alias("n"), F.min("vec_id").alias("first"))


@query("m06_clamp_round", "SELECT event_id, greatest(0, least(100, value))::DOUBLE AS clamped, floor(value + 0.5)::BIGINT AS half_up FROM events WHERE value IS NOT NULL")
def clamp_round(spark, sf_dir):
    return table(spark, sf_dir, "events").where("value is not null").select("event_id", F.greatest(F.lit(0.0), F.least(F.lit(100.0), "value")).alias("clamped"), F.floor(F.col("value") + 0.5).alias("half_up"))


@query("m08_backoff", "SELECT l_linenumber, (100 * pow(2, l_linenumber - 1) * 1.0)::BIGINT AS ms FROM (SELECT DISTINCT l_linenumber FROM lineitem)")
def backoff(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_linenumber").distinct().select("l_linenumber", (100 * F.pow(F.lit(2), F.col("l_linenumber") - 1)).cast("long").alias("ms"))


@query("p32_receipt_verification", """
SELECT CASE WHEN r.vec_id IS NULL THEN 'MISSING' WHEN s.vec_id IS NULL THEN 'UNEXPECTED' WHEN r.n <> len(s.embedding) THEN 'DIMENSIONS' ELSE 'OK' END AS state, count(*)::BIGINT AS n
FROM (SELECT vec_id, 64 + (vec_id % 40 = 0)::INTEGER AS n FROM embeddings WHERE vec_id % 30 <> 1) r FULL JOIN (SELECT * FROM embeddings WHERE vec_id % 30 <> 2) s ON r.vec_id = s.vec_id GROUP BY 1""")
def receipt_verification(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    receipts = rows.where("vec_id % 30 <> 1").select(F.col("vec_id").alias("r"), (64 + (F.col("vec_id") % 40 == 0).cast("int")).alias("n"))
    joined = receipts.join(rows.where("vec_id % 30 <> 2"), F.col("r") == F.col("vec_id"), "full")
    state = F.when(F.col("r").isNull(), "MISSING").when(F.col("vec_id").isNull(), "UNEXPECTED").when(F.col("n") != F.size("embedding"), "DIMENSIONS").otherwise("OK")
    return joined.groupBy(state.alias("state")).agg(F.count("*").alias("n"))
