"""Parsing, structure and chunks over documents and pages. Short lines of documents play the headings."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkspark.plans import analysis
from inkspark.plans import structure as s
from inkspark.queries import query
from inkspark.sources.markup import html_blocks, navigation
from inkspark.sources.tables import blocks, table

HEADINGS = """
WITH b AS (SELECT doc_id, generate_subscripts(l, 1) - 1 AS o, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)),
h AS (SELECT doc_id, o, 1 + length(line) % 3 AS level FROM b WHERE length(line) < 100),
tree AS (SELECT x.doc_id, x.o AS a, x.level, (SELECT max(y.o) FROM h y WHERE y.doc_id = x.doc_id AND y.o < x.o AND y.level < x.level) AS parent,
  coalesce((SELECT min(y.o) - 1 FROM h y WHERE y.doc_id = x.doc_id AND y.o > x.o AND y.level <= x.level), (SELECT max(o) FROM b WHERE b.doc_id = x.doc_id)) AS z FROM h x)
"""


def documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def leveled(spark, sf_dir):
    rows = blocks(documents(spark, sf_dir))
    return rows.withColumn("level", F.when(F.length("text") < 100, 1 + F.length("text") % 3))


def chunks(spark, sf_dir):
    return s.chunked(documents(spark, sf_dir), lambda block: len(block) < 100)


@query("s10_html_blocks")
def page_blocks(spark, sf_dir):
    return html_blocks(table(spark, sf_dir, "pages"))


@query("s12_navigation", r"""
SELECT page_id, (generate_subscripts(m, 1) - 1)::INTEGER AS ordinal, 0 AS depth, regexp_extract(unnest(m), '>([^<]*)</a>', 1) AS label, regexp_extract(unnest(m), 'href="([^"]*)"', 1) AS href
FROM (SELECT page_id, regexp_extract_all(regexp_extract(html, '<nav>.*?</nav>'), '<a href="[^"]*">[^<]*</a>') AS m FROM pages)""")
def page_navigation(spark, sf_dir):
    return navigation(table(spark, sf_dir, "pages"))


@query("p01_structure", r"""
WITH b AS (SELECT doc_id, generate_subscripts(l, 1) - 1 AS o, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)),
h AS (SELECT doc_id, o, line, CASE WHEN length(line) % 4 = 1 THEN 1 + length(line) % 3 WHEN regexp_matches(line, '^#{1,6}\s+\S') THEN length(regexp_extract(line, '^#{1,6}')) ELSE 2 END AS level,
  row_number() OVER (PARTITION BY doc_id ORDER BY o) AS k FROM b WHERE length(line) < 100),
whole AS (SELECT doc_id, min(o) AS a, max(o) AS z FROM b GROUP BY doc_id),
up AS (SELECT x.doc_id, x.k, max(y.k) AS parent FROM h x JOIN h y ON x.doc_id = y.doc_id AND y.k < x.k AND y.level < x.level GROUP BY x.doc_id, x.k),
down AS (SELECT x.doc_id, x.k, min(y.o) - 1 AS z FROM h x JOIN h y ON x.doc_id = y.doc_id AND y.k > x.k AND y.level <= x.level GROUP BY x.doc_id, x.k)
SELECT doc_id, 0 AS node, 'ROOT' AS kind, 0 AS depth, a::INTEGER AS first, z::INTEGER AS last, NULL::INTEGER AS parent FROM whole
UNION ALL
SELECT h.doc_id, h.k::INTEGER, CASE h.level WHEN 1 THEN 'CHAPTER' WHEN 2 THEN 'SECTION' ELSE 'SUBSECTION' END, h.level::INTEGER, h.o::INTEGER, coalesce(down.z, whole.z)::INTEGER, coalesce(up.parent, 0)::INTEGER
FROM h JOIN whole USING (doc_id) LEFT JOIN up ON up.doc_id = h.doc_id AND up.k = h.k LEFT JOIN down ON down.doc_id = h.doc_id AND down.k = h.k
UNION ALL
SELECT doc_id, 1, 'STRUCTURAL_GROUP', 1, a::INTEGER, z::INTEGER, 0 FROM whole WHERE doc_id NOT IN (SELECT doc_id FROM h)""")
def structure(spark, sf_dir):
    """Short lines are headings; some have a level as metadata, of which some aren't valid."""
    rows = blocks(documents(spark, sf_dir))
    n = F.length("text")
    typed = rows.select(
        "doc_id", "ordinal", "text", F.when(n < 100, "HEADING").otherwise("PARAGRAPH").alias("kind"), F.lit(None).cast("int").alias("page"),
        F.when(n % 4 == 1, 1 + n % 3).when(n % 4 == 2, 9).alias("level"))
    return s.tree(typed).drop("title")


@query("p02_chunks")
def packed_chunks(spark, sf_dir):
    return chunks(spark, sf_dir).select("doc_id", "ordinal", "content_hash", "first_block", "last_block", "units")


@query("p03_reconstruct", """
SELECT doc_id, ['HASH', 'LENGTH', 'TEXT', 'ORDINAL'][(doc_id % 5 + 1)::INTEGER] AS code, 1::BIGINT AS n FROM documents WHERE doc_id % 5 < 4""")
def reconstruct(spark, sf_dir):
    """The first chunk of a document has a fault by its id's remainder; every fifth document has none."""
    fault = F.when(F.col("ordinal") == 0, F.col("doc_id") % 5).otherwise(4)
    longer = F.when(fault == 2, F.concat("content", F.lit("x"))).otherwise(F.col("content"))
    broken = chunks(spark, sf_dir).withColumn("content", longer).withColumn(
        "content_hash", F.when(fault == 0, F.sha2(F.lit("another"), 256)).when(fault == 2, F.sha2("content", 256)).otherwise(F.col("content_hash"))).withColumn(
        "units", F.col("units") + F.when(fault.isin(1, 2), 1).otherwise(0)).withColumn("ordinal", F.col("ordinal") - F.when(fault == 3, 1).otherwise(0))
    return s.provenance_errors(broken, documents(spark, sf_dir))


@query("p04_chunk_set")
def chunk_set(spark, sf_dir):
    """One set per document and configuration, by hash: writing it again adds nothing."""
    rows = chunks(spark, sf_dir).groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ordinal", "content_hash"))), lambda x: x["content_hash"]), "").alias("all"))
    once = rows.select("doc_id", F.sha2(F.concat_ws(":", F.lit("1"), F.lit("1200/1600"), "all"), 256).alias("set_hash"))
    return once.union(once).dropDuplicates(["doc_id", "set_hash"])


@query("p05_coverage", HEADINGS + """
, chapters AS (SELECT * FROM tree WHERE level = 1), sections AS (SELECT * FROM tree WHERE level = 2)
SELECT doc_id, id, parent FROM (SELECT s.doc_id, s.a::INTEGER AS id, c.a::INTEGER AS parent, row_number() OVER (PARTITION BY s.doc_id, s.a ORDER BY c.z - c.a, c.a) AS k
  FROM sections s LEFT JOIN chapters c ON c.doc_id = s.doc_id AND c.a <= s.a AND s.z <= c.z) WHERE k = 1""")
def coverage(spark, sf_dir):
    tree = s.structure(leveled(spark, sf_dir).select("doc_id", "ordinal", "level")).select("doc_id", F.col("ordinal").alias("id"), "level", F.col("ordinal").alias("a"), F.col("end").alias("b"))
    return s.coverage(tree.where("level = 1"), tree.where("level = 2"))


def summed(texts: list[str]) -> str:
    """An analyser whose answer can be checked: the sum of the numbers behind the marks."""
    return f"#{sum(int(x[1:]) for x in texts)}"


@query("p05_hierarchical_analysis", """
SELECT doc_id, '#' || len(string_split(text, chr(10))) AS summary, 0::BIGINT AS faults FROM documents WHERE text IS NOT NULL""")
def hierarchical_analysis(spark, sf_dir):
    """Every block a chunk that counts as one, summed up by sections, chapters and book; all must arrive."""
    rows = blocks(documents(spark, sf_dir))
    parts = rows.select("doc_id", "ordinal", F.lit("#1").alias("content"), F.col("ordinal").alias("first"), F.col("ordinal").alias("last"))
    nodes = s.tree(rows.select(
        "doc_id", "ordinal", "text", F.when(F.length("text") < 100, "HEADING").otherwise("PARAGRAPH").alias("kind"), F.lit(None).cast("int").alias("page"), (1 + F.length("text") % 3).alias("level")))
    answers = analysis.analysed(parts, nodes, summed)
    faults = analysis.incomplete(answers, parts).groupBy("doc_id").agg(F.count("*").alias("faults"))
    return answers.where("scope = 'BOOK'").join(faults, "doc_id", "left").select("doc_id", "summary", F.coalesce("faults", F.lit(0)).alias("faults"))


GREEDY = """
WITH RECURSIVE o AS (SELECT *, row_number() OVER (PARTITION BY request ORDER BY score DESC, id) AS k FROM ({items})),
f AS (
  SELECT request, id, k, cost <= {limit} AS taken, {limit} - CASE WHEN cost <= {limit} THEN cost ELSE 0 END AS room, (cost <= {limit})::INTEGER AS n FROM o WHERE k = 1
  UNION ALL
  SELECT o.request, o.id, o.k, o.cost <= f.room, f.room - CASE WHEN o.cost <= f.room THEN o.cost ELSE 0 END, f.n + (o.cost <= f.room)::INTEGER FROM f JOIN o ON o.request = f.request AND o.k = f.k + 1)
SELECT request AS {name}, (n - 1)::INTEGER AS place, id FROM f WHERE taken"""


@query("l07_context_budget", GREEDY.format(items="SELECT conv_id AS request, turn AS id, length(text) AS score, length(text) AS cost FROM conversations", limit=300, name="conv_id"))
def context_budget(spark, sf_dir):
    """Turns of a conversation by length, as many as fit 300 units."""
    turns = table(spark, sf_dir, "conversations")
    return s.greedy(turns.select("conv_id", F.col("turn").cast("long").alias("id"), F.length("text").alias("score"), F.length("text").alias("cost")), "conv_id", 300)


@query("a31_structure_audit", HEADINGS + """
SELECT 'CHILD_OUTSIDE_PARENT' AS code, count(*)::BIGINT AS n FROM tree x JOIN tree y ON x.doc_id = y.doc_id AND x.parent = y.a WHERE x.a < y.a OR x.z > y.z
UNION ALL SELECT 'EMPTY_RANGE', count(*) FROM tree WHERE z < a
UNION ALL SELECT 'NO_PARENT', count(*) FROM tree WHERE parent IS NULL AND level > 1""")
def structure_audit(spark, sf_dir):
    tree = s.structure(leveled(spark, sf_dir).select("doc_id", "ordinal", "level"))
    up = tree.select("doc_id", F.col("ordinal").alias("parent"), F.col("ordinal").alias("pa"), F.col("end").alias("pb"))
    return s.issues(
        ("CHILD_OUTSIDE_PARENT", tree.join(up, ["doc_id", "parent"]).where((F.col("ordinal") < F.col("pa")) | (F.col("end") > F.col("pb")))),
        ("EMPTY_RANGE", tree.where(F.col("end") < F.col("ordinal"))), ("NO_PARENT", tree.where(F.col("parent").isNull() & (F.col("level") > 1))))


@query("x30_divergence", """
WITH p AS (SELECT a.doc_id, a.text AS one, b.text AS two FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1 WHERE a.doc_id % 2 = 0)
SELECT doc_id, CASE WHEN one = two THEN 'SAME' WHEN starts_with(two, one) THEN 'EXTRA' WHEN starts_with(one, two) THEN 'TRUNCATED'
  WHEN list_sort(string_split(one, chr(10))) = list_sort(string_split(two, chr(10))) THEN 'REORDERED' ELSE 'DIFFERENT' END AS class FROM p""")
def divergence(spark, sf_dir):
    rows = documents(spark, sf_dir)
    two = rows.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("two"))
    one = F.col("text")
    pairs = rows.where("doc_id % 2 = 0").join(two, "doc_id")
    kind = (
        F.when(one == F.col("two"), "SAME").when(F.col("two").startswith(one), "EXTRA").when(one.startswith(F.col("two")), "TRUNCATED")
        .when(F.array_sort(F.split(one, "\n")) == F.array_sort(F.split("two", "\n")), "REORDERED").otherwise("DIFFERENT"))
    return pairs.select("doc_id", kind.alias("class"))
