"""Upserts, archive flags, revision chains, positioned runs, page records, tables and archive limits."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from inkspark.operators import records as r
from inkspark.queries import query
from inkspark.sources import archives, markup
from inkspark.sources.tables import millis, table


@query("y02_upsert", """
WITH e AS (SELECT user_id, event_type, epoch_us(ts) // 1000 AS t, event_id FROM events)
SELECT user_id, arg_max(event_type, (t, event_id)) AS state, min(t)::BIGINT AS created_at, max(t)::BIGINT AS updated_at FROM e GROUP BY user_id""")
def upsert(spark, sf_dir):
    """The later half of the events is put on the state that the earlier half left."""
    events = table(spark, sf_dir, "events").select("user_id", "event_type", millis("ts").alias("at"), "event_id")
    half = events.agg(F.floor((F.min("at") + F.max("at")) / 2).alias("half"))
    split = events.join(F.broadcast(half))  # one row
    state = [F.col("event_type").alias("state"), F.col("at").alias("created_at"), F.col("at").alias("updated_at"), "event_id"]
    rows = lambda later: split.where((F.col("at") > F.col("half")) == later).select("user_id", *state)
    none = rows(False).limit(0)
    held = r.upserted(none, rows(False), ["user_id"], ["updated_at", "event_id"], ["created_at"])
    return r.upserted(held, rows(True), ["user_id"], ["updated_at", "event_id"], ["created_at"]).drop("event_id")


@query("y04_archive_flag", """
SELECT o_custkey, count(*) FILTER (shipped IS NULL)::BIGINT AS listed, count(shipped)::BIGINT AS archived, min(epoch_us(shipped) // 1000)::BIGINT AS first_at
FROM orders LEFT JOIN (SELECT l_orderkey, min(l_shipdate) AS shipped FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_orderkey) ON o_orderkey = l_orderkey GROUP BY o_custkey""")
def archive_flag(spark, sf_dir):
    """Returned orders are archived, twice over; the library lists those that aren't."""
    items = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.lit(None).cast("long").alias("archived_at"))
    marks = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"), millis("l_shipdate").alias("at"))
    again = marks.withColumn("at", F.col("at") + 1000)
    kept = r.archived(r.archived(items, marks, "o_orderkey"), again, "o_orderkey")
    return kept.groupBy("o_custkey").agg(
        F.count_if(F.col("archived_at").isNull()).alias("listed"), F.count("archived_at").alias("archived"), F.min("archived_at").alias("first_at"))


@query("p34_script_revisions", """
WITH o AS (
  SELECT o_orderkey AS id, o_custkey, row_number() OVER w AS k, lag(o_orderkey) OVER w AS before, o_orderpriority <> '1-URGENT' AS edited FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)),
c AS (SELECT id, max(CASE WHEN NOT edited THEN k END) OVER (PARTITION BY o_custkey ORDER BY k) AS top, k, o_custkey FROM o)
SELECT c.id, CASE WHEN c.k - c.top <= 64 THEN o.id END AS origin, CASE WHEN c.k - c.top <= 64 THEN (c.k - c.top)::INTEGER END AS edits,
  CASE WHEN c.top IS NULL OR c.k - c.top > 64 THEN 'PARENT_INVALID' END AS error
FROM c LEFT JOIN o ON o.o_custkey = c.o_custkey AND o.k = c.top""")
def script_revisions(spark, sf_dir):
    """A customer's orders as revisions of one script: urgent ones are new, the others edit the one before."""
    before = F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    return r.origins(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), before.alias("parent"), (F.col("o_orderpriority") != "1-URGENT").alias("edited")))


@query("s19_glyph_runs", r"""
SELECT conv_id AS page, sha256(regexp_replace(string_agg(array_to_string(list_filter(string_split_regex(text, '[ \n]+'), lambda x: x <> ''), ' '), chr(10) ORDER BY turn), '\s+$', '')) AS digest
FROM conversations WHERE regexp_matches(text, '[^ \n]') GROUP BY conv_id""")
def glyph_runs(spark, sf_dir):
    """Turns as lines of a page: each word two runs that touch, with a gap to the next word."""
    words = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(F.filter(F.split("text", r"[ \n]+"), lambda x: x != "")).alias("k", "word"))
    n = F.length("word")
    start = F.coalesce(F.sum(n + 1).over(Window.partitionBy("conv_id", "turn").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    half = F.ceil(n / 2).cast("int")
    parts = F.array(
        F.struct(F.lit(0).alias("part"), F.left("word", half).alias("str"), F.col("start").alias("x"), half.alias("width")),
        F.struct(F.lit(1).alias("part"), F.substr("word", half + 1).alias("str"), (F.col("start") + half).alias("x"), (n - half).alias("width")))
    runs = words.withColumn("start", start).select("conv_id", "turn", "k", F.explode(parts).alias("p"))
    return r.run_text(runs.select(
        F.col("conv_id").alias("page"), F.struct("turn", "k", "p.part").alias("i"), "p.str", F.col("p.x").cast("double").alias("x"), (-14.0 * F.col("turn")).alias("y"),
        F.col("p.width").cast("double").alias("width"), F.lit(5.0).alias("height"), F.lit(False).alias("eol"))).select("page", F.sha2("text", 256).alias("digest"))


@query("s08_native_pages", r"""
WITH p AS (SELECT conv_id, turn - (SELECT min(turn) FROM conversations) AS page, text, length(regexp_replace(text, '\s+', '', 'g')) >= 40 AS has FROM conversations WHERE (conv_id + turn) % 50 <> 7),
g AS (SELECT conv_id, count(*) AS n, max(page) + 1 AS declared, count(DISTINCT page) AS d, count(*) FILTER (has) AS t,
  sum(CASE WHEN has THEN len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')) ELSE 0 END) AS b FROM p GROUP BY conv_id)
SELECT conv_id AS doc, CASE WHEN n <> declared OR d <> n THEN 'PARSE' END AS error, CASE WHEN n = declared AND d = n THEN n END::BIGINT AS pages,
  CASE WHEN n = declared AND d = n THEN t END::BIGINT AS text_pages, CASE WHEN n = declared AND d = n THEN b END::BIGINT AS blocks FROM g""")
def native_pages(spark, sf_dir):
    """Turns as a document's pages, of which some are missing."""
    turns = table(spark, sf_dir, "conversations")
    first = turns.agg(F.min("turn").alias("first"))
    pages = turns.where("(conv_id + turn) % 50 <> 7").join(F.broadcast(first)).select(  # one row
        F.col("conv_id").alias("doc"), (F.col("turn") - F.col("first")).alias("page"), "text",
        F.when(F.length(F.regexp_replace("text", r"\s+", "")) >= 40, "TEXT").otherwise("NONE").alias("evidence"))
    return r.native_pages(pages.withColumn("declared", F.max("page").over(Window.partitionBy("doc")) + 1))


@query("m07_stable_score", "SELECT event_id, printf('%.14e', value / 3)::DOUBLE AS score FROM events WHERE value IS NOT NULL")
def stable_score(spark, sf_dir):
    return table(spark, sf_dir, "events").where("value is not null").select("event_id", r.stable_score(F.col("value") / 3).alias("score"))


@query("s11_table_flattening", """
SELECT l_orderkey AS page_id, string_agg(l_linenumber || chr(9) || l_partkey, chr(10) ORDER BY l_linenumber, l_partkey) AS text, bool_or(l_returnflag = 'R') AS flattened FROM lineitem GROUP BY l_orderkey""")
def table_flattening(spark, sf_dir):
    """An order's lines as an HTML table and back to text; returned lines have a cell over two columns."""
    cell = F.when(F.col("l_returnflag") == "R", "<td colspan='2'>").otherwise("<td>")
    row = F.concat(F.lit("<tr>"), cell, F.col("l_linenumber").cast("string"), F.lit("</td><td> <b>"), F.col("l_partkey").cast("string"), F.lit("</b>\n</td></tr>"))
    rows = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", row.alias("r")))), lambda x: x["r"]), "")
    pages = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("page_id")).agg(F.concat(F.lit("<table><tbody>"), rows, F.lit("</tbody></table>")).alias("html"))
    return markup.html_blocks(pages).where("kind = 'TABLE'").select("page_id", "text", "flattened")


@query("s13_archive_limits", """
SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'PATH' WHEN 1 THEN 'CORRUPT' WHEN 2 THEN 'RATIO' WHEN 3 THEN 'CHECKSUM' END AS error FROM pages""")
def archive_limits(spark, sf_dir):
    """Pages as archives with a fault each: a name that leaves the folder, a cut, a bomb, a changed byte, none."""
    books = archives.faulty(table(spark, sf_dir, "pages"))
    return archives.entries(books).groupBy("page_id").agg(F.max("error").alias("error"))
