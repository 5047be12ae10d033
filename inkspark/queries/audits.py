"""Audits over orders as grants, line items as frozen artifacts, and documents as revised books, with faults by their numbers."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from inkspark.functions.text import units
from inkspark.operators import audits
from inkspark.queries import query
from inkspark.sources.tables import table

BUDGETS = """
WITH g AS (SELECT o_orderkey AS id, o_custkey AS doc, o_orderstatus AS st, floor(o_totalprice)::BIGINT AS r, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS k, count(*) OVER (PARTITION BY o_custkey) AS n, o_custkey % 11 AS f FROM orders),
b AS (SELECT * FROM g WHERE k = n),
o AS (SELECT g.*, b.id AS own FROM g JOIN b ON b.doc = g.doc WHERE g.k < g.n),
c AS (SELECT own, f, n,
  count(*) FILTER (f = 1 AND k = 1) AS missing, 0 + max(CASE WHEN f = 2 THEN 1 ELSE 0 END) AS zz, count(*) FILTER (f = 3 AND k = 1) AS changed, count(*) FILTER (f = 4 AND k = 1) AS reserved, count(*) FILTER (f = 5 AND k = 1) AS twice,
  count(*) FILTER (st = 'P' AND NOT (f = 1 AND k = 1)) AS open_, sum(r) AS gross, min(r) FILTER (k = 1) AS r1, count(*) AS m FROM o GROUP BY own, f, n)
SELECT b.id AS grant_id, array_to_string(list_filter([
  CASE WHEN twice > 0 THEN 'SHAPE' END, CASE WHEN b.f = 6 THEN 'PIN_CHANGED' END, CASE WHEN b.f = 7 AND b.n > 1 THEN 'LEGACY_PEERS' END, CASE WHEN missing > 0 THEN 'MISSING_GRANT' END, CASE WHEN b.f = 2 THEN 'UNKNOWN_GRANT' END,
  CASE WHEN b.f <> 7 AND open_ > 0 THEN 'STATUS' END, CASE WHEN changed > 0 THEN 'PAYLOAD_CHANGED' END, CASE WHEN reserved > 0 THEN 'RESERVATION_CHANGED' END, CASE WHEN b.f = 8 AND m >= 2 THEN 'REORDERED' END,
  CASE WHEN 100000 + CASE WHEN b.f = 7 THEN 0 ELSE coalesce(gross, 0) + CASE b.f WHEN 1 THEN -coalesce(r1, 0) WHEN 2 THEN 7 WHEN 4 THEN CASE WHEN m > 0 THEN 1 ELSE 0 END WHEN 5 THEN coalesce(r1, 0) ELSE 0 END END > 2000000 THEN 'BUDGET_EXCEEDED' END], lambda x: x IS NOT NULL), ',') AS codes,
  CASE WHEN b.f = 8 AND m >= 2 THEN 0 END::BIGINT AS first_difference
FROM b LEFT JOIN c ON c.own = b.id"""


@query("p23_budget_audit", BUDGETS)
def budget_audit(spark, sf_dir):
    """Each customer's orders are a document's grants; the last must carry the others. Faults go by the customer's number: the first
    is left out, one more is carried, its digest or amount is another, it is there twice, the pin is another's, nothing is
    carried, the first two are exchanged."""
    orders = table(spark, sf_dir, "orders")
    by = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    k, n, f = F.row_number().over(by), F.count("*").over(Window.partitionBy("o_custkey")), F.col("o_custkey") % 11
    document, reserved = F.col("o_custkey").cast("string"), F.floor("o_totalprice").cast("long")
    # Numbered first, so that what is made of an order doesn't move with it.
    numbered = orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", k.alias("k"), n.alias("n"))
    grants = numbered.select(
        F.col("o_orderkey").alias("grant_id"), document.alias("document"), F.lit("w").alias("workspace"), F.lit("u").alias("user"), F.when(F.col("o_orderstatus") == "P", "RUNNING").when(F.col("o_orderstatus") == "F", "FAILED").otherwise("SUCCEEDED").alias("status"),
        F.concat(F.lit("sha"), document).alias("sha"), reserved.alias("reserved"), F.array(reserved - 1, F.lit(1).cast("long")).alias("entries"), F.sha2(F.concat_ws("|", "o_orderkey", "o_totalprice"), 256).alias("payload_digest"),
        F.concat(F.lit("e"), document).alias("extraction"), F.col("k").cast("long").alias("created"), "n", f.alias("f"))
    last = grants.where("created = n")
    peers = grants.where("created < n").join(last.select("document", F.col("grant_id").alias("own")), "document")
    first = F.col("created") == 1
    plain = peers.select(F.col("own").alias("grant_id"), F.col("created").alias("place"), F.col("grant_id").alias("carried_id"), "payload_digest", "reserved", "f")
    at = F.when((F.col("f") == 8) & (F.col("place") <= 2), 3 - F.col("place")).otherwise(F.col("place"))
    faulty = plain.where("not (f = 1 and place = 1) and f <> 7").select(
        "grant_id", at.alias("place"), "carried_id", F.when((F.col("f") == 3) & (F.col("place") == 1), F.sha2(F.lit("another"), 256)).otherwise(F.col("payload_digest")).alias("payload_digest"),
        F.when((F.col("f") == 4) & (F.col("place") == 1), F.col("reserved") + 1).otherwise(F.col("reserved")).alias("reserved"))
    more = plain.where("f = 5 and place = 1").select("grant_id", F.lit(100_000).cast("long"), "carried_id", "payload_digest", "reserved")
    nobody = last.where("f = 2").select("grant_id", F.lit(100_000).cast("long"), F.lit(-1).cast("long"), F.sha2(F.lit("nobody"), 256), F.lit(7).cast("long"))
    carried = faulty.union(more).union(nobody)
    del first
    pins = audits.budget_digests(carried)
    budgets = last.join(pins, "grant_id", "left").select(
        "grant_id", "document", "workspace", "user", "sha", F.lit(100_000).cast("long").alias("max_reserved"),
        F.when(F.col("f") == 6, F.sha2(F.lit("pin"), 256)).when(F.col("f") != 7, F.coalesce("digest", F.sha2(F.lit("0:"), 256))).alias("pinned"), (F.col("f") != 7).alias("carries"))
    extractions = grants.select("extraction", "workspace", "document").distinct()
    found = audits.budget_audit(budgets, carried, grants.drop("n", "f"), extractions, 2_000_000)
    return found.select("grant_id", F.array_join("codes", ",").alias("codes"), "first_difference")


@query("p29_frozen_selection", """
WITH a AS (SELECT l_suppkey % 3 AS run, l_orderkey * 64 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS ordinal, l_orderkey % 500 AS f FROM lineitem)
SELECT run, ordinal, 'CHANGED' AS code FROM a WHERE f = 7 UNION ALL SELECT run, ordinal, 'UNFROZEN' FROM a WHERE f = 11
UNION ALL SELECT run, ordinal + 4000000000, 'INCOMPLETE' FROM a WHERE f = 13 UNION ALL SELECT run, ordinal + 4000000000, 'RECEIPT' FROM a WHERE f = 13
UNION ALL SELECT run, ordinal, 'RECEIPT' FROM a WHERE f IN (17, 19) UNION ALL SELECT run, ordinal, 'LINEAGE' FROM a WHERE f = 23 UNION ALL SELECT run, ordinal, 'INVALID' FROM a WHERE f = 29 UNION ALL SELECT run, ordinal, 'CHANGED' FROM a WHERE f = 29""")
def frozen_selection(spark, sf_dir):
    """Line items as the artifacts of three long runs. By the order's number a row was frozen with another digest, wasn't frozen, one
    more was, it has two receipts or none, comes from elsewhere, or was frozen with a digest that is none."""
    k = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"))
    lines = table(spark, sf_dir, "lineitem").withColumn("k", k)
    rows = lines.select(
        (F.col("l_suppkey") % 3).alias("run"), (F.col("l_orderkey") * 64 + F.col("k")).alias("ordinal"), F.concat_ws("-", "l_orderkey", "k").alias("artifact_id"),
        F.sha2(F.concat_ws("|", "l_partkey", "l_quantity", "l_extendedprice"), 256).alias("digest"), (F.col("l_orderkey") % 500).alias("f"))
    f = F.col("f")
    artifacts = rows.select("run", "ordinal", "artifact_id", "digest", F.when(f == 23, "elsewhere").otherwise("here").alias("lineage"))
    kept = rows.where(f != 11).select("run", "ordinal", "artifact_id", F.when(f == 7, F.sha2("digest", 256)).when(f == 29, "none").otherwise(F.col("digest")).alias("digest"))
    more = rows.where(f == 13).select("run", (F.col("ordinal") + 4_000_000_000).alias("ordinal"), F.concat("artifact_id", F.lit("?")), "digest")
    receipts = rows.where(f != 19).select("run", "artifact_id").union(rows.where(f == 17).select("run", "artifact_id"))
    runs = rows.select("run").distinct().withColumn("lineage", F.lit("here"))
    return audits.frozen_audit(kept.union(more), artifacts, runs, receipts)


@query("p20_rebased_spans", """
WITH d AS (SELECT doc_id, length(text) AS n FROM documents WHERE length(text) >= 60),
s AS (SELECT doc_id, n, i, i * 17 AS first, i * 17 + 9 AS last FROM d, range(0, 40) r(i) WHERE i * 17 + 9 <= n),
e AS (SELECT doc_id, j * 50 + 20 AS start, j * 50 + 20 + j % 4 * 3 AS finish, j % 3 * 5 AS adds FROM d, range(0, 13) r(j) WHERE j * 50 + 32 <= n)
SELECT s.doc_id AS block_id, s.i::VARCHAR AS span_id, CASE WHEN cut THEN NULL ELSE first + moved END::BIGINT AS first, CASE WHEN cut THEN NULL ELSE last + moved END::BIGINT AS last, cut FROM (
  SELECT s.doc_id, s.i, s.first, s.last, coalesce(sum(adds - (finish - start)) FILTER (finish <= first), 0) AS moved,
    coalesce(bool_or(CASE WHEN start = finish THEN start > first AND start < last ELSE start < last AND finish > first END), false) AS cut
  FROM s LEFT JOIN e ON e.doc_id = s.doc_id GROUP BY ALL) s""")
def rebased_spans(spark, sf_dir):
    """Spans every 17 places of a document, after edits every 50 that add or take text."""
    sizes = table(spark, sf_dir, "documents").select("doc_id", units(F.col("text")).alias("n")).where("n >= 60")
    each = lambda most: sizes.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(most - 1))))
    spans = each(40).select(F.col("doc_id").alias("block_id"), F.col("i").alias("span_id"), (F.col("i") * 17).alias("first"), (F.col("i") * 17 + 9).alias("last"), "n").where("last <= n").drop("n")
    start = F.col("i") * 50 + 20
    edits = each(13).where("i * 50 + 32 <= n").select(F.col("doc_id").alias("block_id"), start.alias("start"), (start + F.col("i") % 4 * 3).alias("finish"), F.repeat(F.lit("x"), (F.col("i") % 3 * 5)).alias("text"))
    return audits.rebased(spans, edits)


REVISIONS = """
WITH d AS (SELECT doc_id, text, coalesce(length(text), 0) AS n, doc_id % 9 AS f FROM documents WHERE n_chars > 200)
"""


def revised(spark, sf_dir):
    """Longer documents as books: a memory is the first line, the summary cites the first places, chunks cover all but the last fifty."""
    docs = table(spark, sf_dir, "documents").where("n_chars > 200")
    f, n = F.col("doc_id") % 9, units(F.col("text"))
    key = F.col("doc_id").cast("string")
    revisions = docs.select(
        key.alias("revision_id"), key.alias("run"), F.when(f == 1, " ").otherwise("why").alias("reason"), F.sha2(F.when(f != 2, "archive"), 256).alias("archive_sha256"), F.left("text", F.lit(80)).alias("summary"),
        F.when(f == 8, F.sha2(F.lit("another"), 256)).alias("recorded"))
    changes = docs.select(key.alias("revision_id"), F.explode(F.array(F.lit("line"), F.when(f == 3, "line").when(f == 4, "nobody").otherwise("all"))).alias("memory_id"), "text", "doc_id").select(
        "revision_id", "memory_id", F.when(F.col("memory_id") != "all", F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("new "), F.left("text", F.lit(20)))).otherwise(F.left("text", F.lit(30)))).alias("text"))
    cited = lambda memory, first, last, quote: F.struct(memory.alias("memory_id"), first.cast("int").alias("first"), last.cast("int").alias("last"), quote.alias("quote"))
    none = F.lit(None).cast("string")
    each = [cited(none, F.lit(0), F.when(f == 5, n + 1).otherwise(F.lit(10)), none), cited(F.lit("line"), F.lit(3), F.lit(9), F.when(f == 6, "no quote").otherwise(F.substring("text", 4, 6))),
            cited(F.when(f == 4, "nobody").when(f == 3, "line").otherwise("all"), F.when(f == 7, n - 40).otherwise(F.lit(0)), F.when(f == 7, n - 10).otherwise(F.lit(5)), none)]
    evidence = docs.select(key.alias("revision_id"), key.alias("block_id"), F.explode(F.array(*each)).alias("e")).select("revision_id", "block_id", "e.*")
    memories = docs.select(key.alias("run"), F.explode(F.create_map(F.lit("line"), F.left("text", F.lit(30)), F.lit("all"), F.col("text"))).alias("memory_id", "content"))
    chunks = docs.select(key.alias("block_id"), F.explode(F.array(F.struct(F.lit(0).alias("first"), F.lit(100).alias("last")), F.struct(F.lit(90).alias("first"), (n - 50).alias("last")))).alias("c")).select("block_id", "c.*")
    vectors = docs.where("doc_id % 4 = 0").select(F.lit("line").alias("memory_id"), F.sha2(F.concat(F.lit("new "), F.left("text", F.lit(20))), 256).alias("input_hash"))
    return audits.revision_audit(revisions, changes, evidence, memories, docs.select(key.alias("block_id"), F.col("text").alias("content")), chunks, vectors)


@query("p20_revision_audit", REVISIONS + """
SELECT doc_id::VARCHAR AS revision_id, CASE f WHEN 1 THEN 'PATCH_INVALID' WHEN 2 THEN 'PATCH_INVALID' WHEN 3 THEN 'DUPLICATE_TARGET' WHEN 4 THEN 'TARGET_NOT_FOUND' WHEN 5 THEN 'EVIDENCE_INVALID' WHEN 6 THEN 'EVIDENCE_INVALID'
  WHEN 7 THEN 'EVIDENCE_OUTSIDE_CHUNKS' WHEN 8 THEN 'CONTENT_CHANGED' ELSE '' END AS codes,
  sha256('b:' || doc_id || ':' || sha256(text) || CASE WHEN f IN (3, 4) THEN '' ELSE ',m:all:' || sha256(text) END || ',m:line:' || sha256(text[1:30])) AS original_hash FROM d""")
def revision_audit(spark, sf_dir):
    """Patches with a fault by the document's number: no reason, no archive, a target twice or unknown, evidence beyond the text, with another
    quote or outside chunks, another original."""
    return revised(spark, sf_dir)[0].select("revision_id", F.array_join("codes", ",").alias("codes"), "original_hash")


@query("p20_revision_overlay", REVISIONS + """
, v AS (SELECT sha256('new ' || text[1:20]) AS h FROM d WHERE doc_id % 4 = 0)
SELECT doc_id::VARCHAR AS revision_id, 'line' AS memory_id, CASE WHEN doc_id % 2 = 1 THEN 'REUSE' WHEN sha256('new ' || text[1:20]) IN (SELECT h FROM v) THEN 'REFRESHED' ELSE 'REFRESH_REQUIRED' END AS vector_state, CASE WHEN f = 3 THEN 2 ELSE 1 END::BIGINT AS n FROM d
UNION ALL SELECT doc_id::VARCHAR, 'all', 'REUSE', 1 FROM d WHERE f NOT IN (3, 4)""")
def revision_overlay(spark, sf_dir):
    """The state of each revised memory's vector: odd documents keep the text, of the others every second has a new vector."""
    return revised(spark, sf_dir)[1].groupBy("revision_id", "memory_id", "vector_state").agg(F.count("*").alias("n"))
