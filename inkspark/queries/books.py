"""Books bound from pages, written and read through the data source."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from inkspark.queries import query
from inkspark.sources import books
from inkspark.sources.tables import shared_folder, table

#: Pages of a book, and what is wrong with it, by its number.
PAGES = 5
FAULTS = [None, "CONTAINER", "SPINE", "UNKNOWN", "FALLBACK", "FIXED_LAYOUT", "MISSING", "NAVIGATION", "CONTENT", "PATH", "CORRUPT", "ENTITY", "XML", "MIMETYPE", "ENCRYPTED", "RATIO"]
SQL = """
WITH p AS (SELECT page_id // 5 AS b, page_id % 5 AS k, html, page_id, page_id // 5 % 16 AS f FROM pages),
e AS (SELECT *, CASE f WHEN 1 THEN 'CONTAINER' WHEN 2 THEN 'SPINE' WHEN 3 THEN 'SPINE' WHEN 4 THEN 'FALLBACK' WHEN 6 THEN 'MISSING' WHEN 8 THEN 'CONTENT' WHEN 9 THEN 'PATH' WHEN 10 THEN 'CORRUPT'
  WHEN 11 THEN 'ENTITY' WHEN 12 THEN 'XML' WHEN 13 THEN 'MIMETYPE' WHEN 14 THEN 'ENCRYPTED' WHEN 15 THEN 'RATIO' END AS error FROM p)
"""


def shelf(spark, sf_dir):
    """A folder of books of five pages each, bound by tasks and written by the data source."""
    pages = table(spark, sf_dir, "pages").select(F.floor(F.col("page_id") / PAGES).alias("b"), "page_id", "html")

    def bind(rows: pa.Table) -> pa.Table:
        number, *_ = rows.column("b").to_pylist()
        own = sorted(zip(rows.column("page_id").to_pylist(), rows.column("html").to_pylist()))
        content = books.bound([(f"page{i}.xhtml", html or "") for i, html in own], f"Book {number}", FAULTS[number % len(FAULTS)])
        return pa.table({"book": [f"book-{number}"], "content": pa.array([content], pa.binary())})

    books.register(spark)
    folder = shared_folder(spark)
    pages.groupBy("b").applyInArrow(bind, "book string, content binary").write.format("books").mode("append").save(folder)
    return folder


@query("s09_spine_order", SQL + """
SELECT 'book-' || b AS book, error, NULL AS title, NULL::INTEGER AS spine, NULL AS href, 0::BIGINT AS blocks, '' AS warnings FROM e WHERE error IS NOT NULL GROUP BY b, error
UNION ALL
SELECT 'book-' || b, NULL, 'Book ' || b, (count(*) OVER (PARTITION BY b) - 1 - k)::INTEGER, 'page' || page_id || '.xhtml',
  ((length(html) - length(replace(html, '<li>', ''))) / 4 + (length(html) - length(replace(html, '<p>', ''))) / 3 + 1)::BIGINT, CASE f WHEN 5 THEN 'FIXED_LAYOUT' WHEN 7 THEN 'NAVIGATION_DEGRADED' ELSE '' END FROM e WHERE error IS NULL""")
def spine_order(spark, sf_dir):
    """Chapters in the spine's order, last page first, with their blocks; what is wrong with a book in its one row."""
    rows = spark.read.format("books").load(shelf(spark, sf_dir))
    return rows.groupBy("book", "error", "title", "spine", "href", F.array_join("warnings", ",").alias("warnings")).agg(F.count("kind").alias("blocks"))


@query("s09_book_links", SQL + """
SELECT 'book-' || b AS book, error, NULL AS source, NULL::INTEGER AS ordinal, NULL AS href FROM e WHERE error IS NOT NULL AND f NOT IN (6, 8) GROUP BY b, error
UNION ALL SELECT 'book-' || b, NULL, 'NONE', NULL, NULL FROM e WHERE f = 7 GROUP BY b
UNION ALL SELECT 'book-' || b, NULL, 'NAV', (k - CASE f WHEN 6 THEN 1 ELSE 0 END)::INTEGER, 'OPS/page' || page_id || '.xhtml' FROM e WHERE f IN (0, 5, 8) OR f = 6 AND k > 0""")
def book_links(spark, sf_dir):
    """Navigation of the same books; links to chapters that aren't there go."""
    return spark.read.format("books").option("rows", "links").load(shelf(spark, sf_dir)).select("book", "error", "source", "ordinal", "href")
