"""Queries in SQL text over the functions that ``inkspark.functions.surface`` registers."""

from __future__ import annotations

from inkspark import queries
from inkspark.functions.surface import register
from inkspark.queries import query


def sql(spark, sf_dir, text):
    """Runs SQL text; ``{name}`` stands for a table."""
    register(spark)
    tables = {name: f"parquet.`{sf_dir}/{name}.parquet`" for name in ("pages", "documents", "embeddings", "orders", "conversations")}
    return spark.sql(text.format(**tables))


@query("y06_json_cosine", """
SELECT a.vec_id, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / (sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[]))), 6) AS score
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def json_cosine(spark, sf_dir):
    """Each vector with the next, as JSON text."""
    return sql(spark, sf_dir, """
WITH docs AS (SELECT vec_id, to_json(transform(embedding, x -> double(x))) AS doc FROM {embeddings})
SELECT a.vec_id, round(json_cosine(a.doc, b.doc), 6) AS score FROM docs a JOIN docs b ON b.vec_id = a.vec_id + 1""")


@query("y06_hard_pieces", """
SELECT doc_id, i::INTEGER AS piece, substr(text, i * 1000 + 1, 1000) AS text FROM (
  SELECT doc_id, text, unnest(range(0, greatest(1, ceil(length(text) / 1000.0))::BIGINT)) AS i FROM documents)""")
def hard_pieces(spark, sf_dir):
    return sql(spark, sf_dir, "SELECT doc_id, p.ordinal AS piece, p.piece AS text FROM {documents}, LATERAL hard_pieces(text, 1000) p")


@query("y06_canonical_json", """SELECT o_orderkey, sha256('{"custkey":' || o_custkey || ',"nested":{"a":null,"b":[1,"' || o_orderstatus || '"]}}') AS digest FROM orders""")
def canonical_json(spark, sf_dir):
    """JSON whose keys come in another order at both levels."""
    return sql(spark, sf_dir, """
SELECT o_orderkey, canonical_json_sha256(concat('{{ "nested": {{"b" : [1, "', o_orderstatus, '"], "a": null}}, "custkey": ', o_custkey, '}}')) AS digest FROM {orders}""")


@query("y06_page_links", queries.SQL["s12_navigation"])
def page_links(spark, sf_dir):
    return sql(spark, sf_dir, "SELECT page_id, l.ordinal, l.depth, l.label, l.href FROM {pages}, LATERAL page_links(html) l")


@query("y06_speech_pieces", """
SELECT doc_id, sha256(regexp_replace(text, '\\s+', '', 'g')) AS digest, true AS bounded FROM documents""")
def speech(spark, sf_dir):
    """Spoken pieces of every text: none is longer than 500, and together they say it all. A row for each row, also where ids repeat
    or a text has no piece."""
    return sql(spark, sf_dir, r"""
SELECT any_value(doc_id) AS doc_id, sha2(regexp_replace(array_join(transform(array_sort(collect_list(struct(p.ordinal, p.piece))), x -> x.piece), ''), '[ \\t\\n\\f\\r]+', ''), 256) AS digest, bool_and(length(p.piece) <= 500) AS bounded
FROM (SELECT monotonically_increasing_id() AS row, doc_id, text FROM {documents}) d, LATERAL speech_pieces(d.text, 500) p GROUP BY row
UNION ALL SELECT doc_id, sha2(regexp_replace(text, '[ \\t\\n\\f\\r]+', ''), 256), true FROM {documents} WHERE text IS NULL OR NOT text RLIKE '[^ \\t\\n\\f\\r]'""")


@query("y06_soft_pieces", "SELECT doc_id, length(text)::BIGINT AS covered, true AS in_order FROM documents WHERE text <> ''")
def soft_pieces(spark, sf_dir):
    """Soft pieces of every text: each begins where the one before ends, none is longer than 1,600, and they cover it all. A row for
    each row, also where ids repeat; spans are in UTF-16 units, what they cover in code points."""
    return sql(spark, sf_dir, """
SELECT any_value(doc_id) AS doc_id, bigint(sum(finish - start) - any_value(pairs)) AS covered, bool_and(start = before AND finish - start BETWEEN 1 AND 1600) AS in_order FROM (
  SELECT row, doc_id, pairs, p.start, p.finish, coalesce(lag(p.finish) OVER (PARTITION BY row ORDER BY p.ordinal), 0) AS before
  FROM (SELECT monotonically_increasing_id() AS row, doc_id, length(encode(text, 'UTF-16LE')) div 2 - length(text) AS pairs, text FROM {documents} WHERE text <> '') d, LATERAL soft_pieces(d.text, 1600) p)
GROUP BY row""")


@query("y06_page_blocks")
def page_blocks(spark, sf_dir):
    """Blocks of pages by kind, through the table function."""
    return sql(spark, sf_dir, "SELECT page_id, b.kind, count(*) AS blocks, sum(length(b.text)) AS chars FROM {pages}, LATERAL page_blocks(html) b GROUP BY page_id, b.kind")


@query("y06_titles")
def titles(spark, sf_dir):
    """Titles that differ in compatibility forms or white space alone, counted by key."""
    return sql(spark, sf_dir, "SELECT sha2(title_key(text), 256) AS digest, count(*) AS texts FROM {documents} WHERE title_key(text) <> '' GROUP BY title_key(text)")
