"""Further operators: splitting, hashing, budgets by source, retrieval, reduction and gates."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from inkspark.functions import pieces
from inkspark.functions import text as t
from inkspark.functions import vectors as v
from inkspark.operators import anchors
from inkspark.operators import decisions as d
from inkspark.plans import budgets, reduction
from inkspark.queries import query
from inkspark.queries.documents import GREEDY
from inkspark.sources import archives
from inkspark.sources.tables import blocks, hours, table

LINES = "WITH b AS (SELECT doc_id, generate_subscripts(l, 1) - 1 AS o, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))"


def docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "text")


@query("x02_hard_split", "SELECT doc_id, greatest(1, ceil(length(text) / 1000.0))::BIGINT AS pieces, greatest(0, length(text) - 1000 * (greatest(1, ceil(length(text) / 1000.0))::BIGINT - 1))::BIGINT AS last FROM documents")
def hard_split(spark, sf_dir):
    pieces = t.hard_pieces(F.col("text"), 1000)
    return docs(spark, sf_dir).select("doc_id", F.size(pieces).cast("long").alias("pieces"), F.length(F.element_at(pieces, -1)).cast("long").alias("last"))


@query("x06_sentence_atoms", r"""
SELECT doc_id, len(a)::BIGINT AS atoms, coalesce(list_max(list_transform(a, lambda x: length(x))), 0)::BIGINT AS longest FROM (
  SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(regexp_replace(text, '(?m)^[-*] ', '', 'g'), '([.!?]) +', '\1' || chr(10), 'g'), chr(10)), lambda x: trim(x)), lambda x: x <> '')[1:48] AS a FROM documents)""")
def sentence_atoms(spark, sf_dir):
    atoms = t.sentence_atoms(F.col("text"))
    return docs(spark, sf_dir).select("doc_id", F.size(atoms).cast("long").alias("atoms"), F.coalesce(F.array_max(F.transform(atoms, lambda x: F.length(x))), F.lit(0)).cast("long").alias("longest"))


@query("x09_canonical_json", """SELECT o_orderkey, sha256('{"custkey":' || o_custkey || ',"status":"' || o_orderstatus || '"}') AS digest FROM orders""")
def canonical_json(spark, sf_dir):
    """Keys in order of code points; nulls are kept."""
    ordered = F.to_json(F.struct(F.col("o_custkey").alias("custkey"), F.col("o_orderstatus").alias("status")), {"ignoreNullFields": "false"})
    return table(spark, sf_dir, "orders").select("o_orderkey", F.sha2(ordered, 256).alias("digest"))


@query("x16_pause_rules", "SELECT conv_id, turn, CASE role WHEN 'user' THEN 250 WHEN 'assistant' THEN 400 ELSE 150 END AS before_ms, CASE WHEN length(text) < 80 THEN 120 ELSE 300 END AS after_ms FROM conversations")
def pause_rules(spark, sf_dir):
    role = F.col("role")
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.when(role == "user", 250).when(role == "assistant", 400).otherwise(150).alias("before_ms"), F.when(F.length("text") < 80, 120).otherwise(300).alias("after_ms"))


@query("x26_title_key")
def title_key(spark, sf_dir):
    """Every text as a title: compatibility forms folded, white space runs as one space, none at the ends."""
    keyed = docs(spark, sf_dir).withColumn("key", pieces.compare_key("text"))
    return keyed.select("doc_id", F.sha2("key", 256).alias("digest"))


REANCHORED = LINES + r""",
l AS (SELECT doc_id || ':' || o AS block, line, length(line) AS n FROM b WHERE length(line) >= 40),
e AS (
  SELECT block, line, n, 1 AS k, 0 AS first, 12 AS last, substr(line, 11, 12) AS quote, 'old' AS hash FROM l
  UNION ALL SELECT block, line, n, 2, 2, 9, substr(line, 1, 15) || '#', 'old' FROM l
  UNION ALL SELECT block, line, n, 3, 5, n + 1, NULL, 'h' FROM l
  UNION ALL SELECT block, NULL, NULL, 4, 0, 8, substr(line, 1, 8), 'h' FROM l
  UNION ALL SELECT block, line, n, 5, 3, 20, NULL, 'h' FROM l
  UNION ALL SELECT block, line, n, 6, 7, 7, '', 'h' FROM l),
a AS (SELECT *, line IS NOT NULL AND quote <> '' AND contains(line, quote) AS held FROM e),
p AS (SELECT *, CASE WHEN held THEN instr(line, quote) - 1 ELSE first END AS f, CASE WHEN held THEN instr(line, quote) - 1 + length(quote) ELSE last END AS z FROM a)
SELECT block, k, f::BIGINT AS first, z::BIGINT AS last, CASE WHEN line IS NULL OR held THEN quote END AS quote,
  CASE WHEN line IS NULL OR quote IS NULL THEN hash WHEN held THEN sha256(quote) END AS quote_hash, CASE WHEN line IS NULL THEN 'LINEAGE' WHEN f < 0 OR z <= f OR z > n THEN 'RANGE' END AS code FROM p"""


@query("x31_reanchoring", REANCHORED)
def reanchoring(spark, sf_dir):
    """Six pieces of evidence for each long line: a quote at another place, one that is lost, an end beyond the line, a line that
    isn't there, places without a quote, and an empty quote."""
    lines = blocks(docs(spark, sf_dir)).where(F.length("text") >= 40).select(F.concat_ws(":", "doc_id", "ordinal").alias("block_id"), F.col("text").alias("content"))
    n, text = F.length("content"), F.col("content")
    given = [(1, 0, F.lit(12), F.substring(text, 11, 12), "old"), (2, 2, F.lit(9), F.concat(F.substring(text, 1, 15), F.lit("#")), "old"), (3, 5, n + 1, F.lit(None).cast("string"), "h"),
             (4, 0, F.lit(8), F.substring(text, 1, 8), "h"), (5, 3, F.lit(20), F.lit(None).cast("string"), "h"), (6, 7, F.lit(7), F.lit(""), "h")]
    cases = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.lit(a).cast("long").alias("first"), b.cast("long").alias("last"), q.alias("quote"), F.lit(h).alias("quote_hash")) for k, a, b, q, h in given))).alias("e")
    evidence = lines.select("block_id", cases).select("e.*", F.concat("block_id", F.when(F.col("e.k") == 4, "?").otherwise("")).alias("block_id"))
    found = anchors.reanchored(evidence.withColumn("evidence_id", F.concat_ws("/", F.col("k").cast("string"), "block_id")), lines)
    return found.select(F.regexp_replace("block_id", r"\?$", "").alias("block"), F.substring_index("evidence_id", "/", 1).cast("int").alias("k"), "first", "last", "quote", "quote_hash", "code")


@query("f05_bibliographic", r"SELECT doc_id, regexp_matches(text, '(?i)^\s*(author|translator|isbn|publisher|copyright)\s*[:=]') AS bibliographic FROM documents")
def bibliographic(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.col("text").rlike(r"(?i)^\s*(author|translator|isbn|publisher|copyright)\s*[:=]").alias("bibliographic"))


@query("f08_slice_containment", """
WITH sent AS (SELECT l_orderkey AS k, l_linenumber AS a, l_linenumber + 1 AS b FROM lineitem WHERE l_returnflag = 'N')
SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem x WHERE EXISTS (SELECT 1 FROM sent WHERE k = l_orderkey AND a <= l_linenumber AND l_linenumber + 1 <= b)""")
def slice_containment(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    sent = lines.where("l_returnflag = 'N'").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("a"), (F.col("l_linenumber") + 1).alias("b"))
    inside = (F.col("l_orderkey") == F.col("k")) & (F.col("a") <= F.col("l_linenumber")) & (F.col("l_linenumber") + 1 <= F.col("b"))
    return lines.join(sent, inside, "left_semi").select("l_orderkey", "l_linenumber").distinct()


@query("f09_relation_bounds", "SELECT l_orderkey, bool_and(l_linenumber - 1 < n AND l_partkey % 9 < n) AS fine FROM (SELECT *, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem) GROUP BY l_orderkey")
def relation_bounds(spark, sf_dir):
    edges = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct((F.col("l_linenumber") - 1).alias("a"), (F.col("l_partkey") % 9).alias("b"))).alias("e"))
    return edges.select("l_orderkey", F.forall("e", lambda x: (x["a"] < F.size("e")) & (x["b"] < F.size("e"))).alias("fine"))


@query("f13_feedback_schema", "SELECT event_id, CASE WHEN value IS NULL AND props IS NULL THEN 'EMPTY' WHEN value IS NOT NULL AND (value < 1 OR value > 500) THEN 'RATING' END AS error FROM events")
def feedback_schema(spark, sf_dir):
    rating = F.col("value")
    error = d.first_of((rating.isNull() & F.col("props").isNull(), "EMPTY"), (rating.isNotNull() & ((rating < 1) | (rating > 500)), "RATING"))
    return table(spark, sf_dir, "events").select("event_id", error.alias("error"))


@query("f16_private_address", """
WITH a AS (SELECT event_id, event_id % 256 AS x, user_id % 256 AS y FROM events)
SELECT event_id, x IN (0, 10, 127) OR (x = 172 AND y BETWEEN 16 AND 31) OR (x = 192 AND y = 168) OR (x = 169 AND y = 254) OR (x = 100 AND y BETWEEN 64 AND 127) OR x >= 224 AS private FROM a""")
def private_address(spark, sf_dir):
    address = F.concat_ws(".", (F.col("event_id") % 256).cast("string"), (F.col("user_id") % 256).cast("string"), F.lit("1"), F.lit("2"))
    return table(spark, sf_dir, "events").select("event_id", t.private_address(address).alias("private"))


@query("a23_scenarios", """
SELECT * FROM (VALUES ('small', 108000::BIGINT), ('medium', 432000::BIGINT), ('large', 1296000::BIGINT)) v(scenario, cost)""")
def scenarios(spark, sf_dir):
    """Three sizes through the cost calculator."""
    from inkspark.operators.usage import costed

    sizes = [("small", 80_000, 16_000, 20_000), ("medium", 320_000, 64_000, 80_000), ("large", 960_000, 192_000, 240_000)]
    used = spark.createDataFrame([(s, 1, *m) for s, *m in sizes], "scenario string, model_id long, input_tokens long, cached_tokens long, output_tokens long")
    rates = spark.createDataFrame([(1, 1_000_000, 250_000, 2_000_000)], "model_id long, input_rate long, cached_rate long, output_rate long")
    return costed(used, rates, ["model_id"]).select("scenario", "cost")


@query("a30_visual_fidelity", """
SELECT page_id, concat_ws(',', CASE WHEN contains(html, '<img') THEN 'RASTER' END, CASE WHEN contains(html, '<svg') THEN 'VECTOR' END, CASE WHEN NOT contains(html, '<article') THEN 'NO_ARTICLE' END, CASE WHEN length(html) > 5000 THEN 'LONG' END) AS codes FROM pages""")
def visual_fidelity(spark, sf_dir):
    html = F.col("html")
    flags = {"RASTER": html.contains("<img"), "VECTOR": html.contains("<svg"), "NO_ARTICLE": ~html.contains("<article"), "LONG": F.length(html) > 5000}
    return table(spark, sf_dir, "pages").select("page_id", F.concat_ws(",", *(F.when(bad, code) for code, bad in flags.items())).alias("codes"))


@query("a33_pcm_measurement", """
WITH s AS (SELECT vec_id, list_transform(embedding, lambda x: round_even(greatest(-1, least(1, x::DOUBLE)) * 32767, 0)::BIGINT) AS s FROM embeddings WHERE embedding IS NOT NULL),
q AS (SELECT vec_id, s, array_to_string(list_transform(s, lambda x: CASE WHEN abs(x) < 328 THEN '1' ELSE '0' END), '') AS quiet FROM s)
SELECT vec_id, coalesce(list_max(list_transform(s, lambda x: abs(x))), 0)::BIGINT AS peak, len(list_filter(s, lambda x: abs(x) >= 32767))::BIGINT AS clipped,
  len(list_filter(s, lambda x: abs(x) < 328))::BIGINT AS silent, list_max(list_transform(string_split(quiet, '0'), lambda r: length(r)))::BIGINT AS longest FROM q""")
def pcm_measurement(spark, sf_dir):
    """Vectors as 16-bit samples: silence, peak and clipping of each."""
    return budgets.pcm(table(spark, sf_dir, "embeddings"))


@query("l05_thinking_page", "SELECT conv_id, turn FROM conversations WHERE (conv_id, turn) < (50, 2) ORDER BY conv_id DESC, turn DESC LIMIT 50")
def thinking_page(spark, sf_dir):
    from inkspark.operators.relations import keyset_page

    return keyset_page(table(spark, sf_dir, "conversations"), ["conv_id", "turn"], ["50L", "2L"], 50).select("conv_id", "turn")


@query("l08_fair_budget")
def fair_budget(spark, sf_dir):
    """Each host of a conversation has its shortest turn; the rest of 1,200 units goes in order."""
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("request"), F.col("role").alias("source"), F.col("turn").cast("long").alias("place"), F.length("text").alias("cost"))
    return budgets.fair(turns, 1200)


@query("l09_source_split", GREEDY.format(items="SELECT conv_id || '/' || role AS request, turn AS id, -turn AS score, length(text) AS cost FROM conversations", limit=600, name="request"))
def source_split(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select(F.concat_ws("/", F.col("conv_id").cast("string"), "role").alias("request"), F.col("turn").cast("long").alias("id"), (-F.col("turn")).cast("double").alias("score"), F.length("text").cast("long").alias("cost"))
    from inkspark.plans.structure import greedy

    return greedy(turns, "request", 600)


@query("m05_embedding_identity", """SELECT DISTINCT label, sha256('["driver","embeddings","","' || label || '",' || len(embedding) || ']') AS identity FROM embeddings""")
def embedding_identity(spark, sf_dir):
    preimage = F.concat(F.lit('["driver","embeddings","","'), F.col("label").cast("string"), F.lit('",'), F.size("embedding").cast("string"), F.lit("]"))
    return table(spark, sf_dir, "embeddings").select("label", F.sha2(preimage, 256).alias("identity")).distinct()


@query("d01_hour_arithmetic", "SELECT event_id, ts + INTERVAL 24 HOUR AS day_later FROM events")
def hour_arithmetic(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", (F.col("ts") + hours(24)).alias("day_later"))


@query("n01_array_sort", "SELECT l_orderkey, string_agg(l_partkey::VARCHAR, ',' ORDER BY l_quantity DESC, l_partkey) AS parts FROM lineitem GROUP BY l_orderkey")
def array_sort(spark, sf_dir):
    order = lambda a, b: F.when(a["q"] != b["q"], F.when(a["q"] > b["q"], -1).otherwise(1)).otherwise(F.when(a["p"] < b["p"], -1).when(a["p"] > b["p"], 1).otherwise(0))
    grouped = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("l_quantity").alias("q"), F.col("l_partkey").alias("p"))).alias("x"))
    return grouped.select("l_orderkey", F.array_join(F.transform(F.array_sort("x", order), lambda x: x["p"].cast("string")), ",").alias("parts"))


@query("n06_vector_unnest", "SELECT label, round(sum(x), 4) AS total, count(*)::BIGINT AS n FROM (SELECT label, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY label")
def vector_unnest(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("place", "x"))
    return rows.groupBy("label").agg(F.round(F.sum(F.col("x").cast("double")), 4).alias("total"), F.count("*").alias("n"))


@query("p06_bounded_reduction")
def bounded_reduction(spark, sf_dir):
    """Blocks of a document reduced in batches of bounded size until one answer is left."""
    return reduction.reduced(docs(spark, sf_dir), 2000).drop("error")


@query("p07_memory_plan", LINES + ", m AS (SELECT doc_id, o, sha256('LINE:' || trim(line)) AS key FROM b WHERE length(trim(line)) >= 40) SELECT doc_id, key, (row_number() OVER (PARTITION BY doc_id ORDER BY first) - 1)::INTEGER AS ordinal FROM (SELECT doc_id, key, min(o) AS first FROM m GROUP BY doc_id, key)")
def memory_plan(spark, sf_dir):
    rows = blocks(docs(spark, sf_dir)).where(F.length(F.trim("text")) >= 40)
    keyed = rows.groupBy("doc_id", F.sha2(F.concat(F.lit("LINE:"), F.trim("text")), 256).alias("key")).agg(F.min("ordinal").alias("first"))
    return keyed.select("doc_id", "key", (F.row_number().over(Window.partitionBy("doc_id").orderBy("first")) - 1).alias("ordinal"))


@query("p11_retrieval", """
WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 1), s AS (
  SELECT vec_id, label, list_dot_product(embedding::DOUBLE[], e::DOUBLE[]) AS s FROM embeddings, q)
SELECT s.vec_id, round(s.s, 6) AS score, (d.doc_id IS NOT NULL) AS has_source FROM (SELECT * FROM s ORDER BY s DESC, vec_id LIMIT 30) s LEFT JOIN documents d ON s.vec_id = d.doc_id""")
def retrieval(spark, sf_dir):
    """Ranked by dot product, then overlaid with the documents that there are."""
    rows = table(spark, sf_dir, "embeddings")
    asked = rows.where("vec_id = 1").select(F.col("embedding").alias("e"))
    best = rows.join(F.broadcast(asked)).withColumn("s", v.dot(F.col("embedding"), F.col("e"))).orderBy(F.desc("s"), "vec_id").limit(30)  # one row
    sources = table(spark, sf_dir, "documents").select("doc_id")
    return best.join(sources, F.col("vec_id") == F.col("doc_id"), "left").select("vec_id", F.round("s", 6).alias("score"), F.col("doc_id").isNotNull().alias("has_source"))


@query("p16_epub_quality", LINES + " SELECT doc_id, CASE WHEN count(*) FILTER (length(trim(line)) > 0) = 0 THEN 'REJECTED' WHEN bool_or(contains(line, '|')) THEN 'DEGRADED' ELSE 'ACCEPTED' END AS decision FROM b GROUP BY doc_id")
def epub_quality(spark, sf_dir):
    usable = F.count_if(F.length(F.trim("text")) > 0)
    decision = d.first_of((usable == 0, "REJECTED"), (F.bool_or(F.contains(F.col("text"), F.lit("|"))), "DEGRADED"), otherwise="ACCEPTED")
    return blocks(docs(spark, sf_dir)).groupBy("doc_id").agg(decision.alias("decision"))


@query("p17_ocr_tier", "SELECT doc_id, CASE WHEN n_chars = 0 THEN 'NONE' WHEN n_chars > 5000 THEN 'STANDARD' WHEN lang <> 'en' THEN 'FLASH' ELSE 'NATIVE' END AS tier FROM documents")
def ocr_tier(spark, sf_dir):
    n = F.col("n_chars")
    return table(spark, sf_dir, "documents").select("doc_id", d.first_of((n == 0, "NONE"), (n > 5000, "STANDARD"), (F.col("lang") != "en", "FLASH"), otherwise="NATIVE").alias("tier"))


@query("p18_admission", "SELECT o_orderkey, CASE WHEN o_orderpriority = '5-LOW' THEN 'DISABLED' WHEN o_totalprice > 400000 THEN 'PIXELS' WHEN o_orderstatus = 'P' THEN 'CAPACITY' ELSE 'ADMITTED' END AS verdict FROM orders")
def admission(spark, sf_dir):
    verdict = d.first_of((F.col("o_orderpriority") == "5-LOW", "DISABLED"), (F.col("o_totalprice") > 400000, "PIXELS"), (F.col("o_orderstatus") == "P", "CAPACITY"), otherwise="ADMITTED")
    return table(spark, sf_dir, "orders").select("o_orderkey", verdict.alias("verdict"))


@query("p27_audio_gate", """
WITH a AS (SELECT conv_id, sum(length(text)) * 60 AS planned, sum(length(text) * (58 + turn % 7)) AS raw, count(DISTINCT role) AS voices FROM conversations GROUP BY conv_id)
SELECT conv_id, abs(planned - raw) > greatest(100, 0.05 * planned) AS drifts, voices < 2 AS one_voice FROM a""")
def audio_gate(spark, sf_dir):
    n = F.length("text")
    sums = table(spark, sf_dir, "conversations").groupBy("conv_id").agg((F.sum(n) * 60).alias("planned"), F.sum(n * (58 + F.col("turn") % 7)).alias("raw"), F.count_distinct("role").alias("voices"))
    return sums.select("conv_id", (F.abs(F.col("planned") - F.col("raw")) > F.greatest(F.lit(100.0), 0.05 * F.col("planned"))).alias("drifts"), (F.col("voices") < 2).alias("one_voice"))


@query("s09_archive_entries")
def archive_entries(spark, sf_dir):
    """Pages zipped as books and read again: entries, safe names and kinds of blocks."""
    return archives.entries(archives.zipped(table(spark, sf_dir, "pages")))


@query("s14_extraction_sink", "SELECT doc_id, len(string_split(text, chr(10)))::BIGINT AS blocks FROM documents")
def extraction_sink(spark, sf_dir):
    """Blocks are appended first, the pointer to them last; the current blocks are those that the pointer names."""
    return archives.published(blocks(docs(spark, sf_dir)), archives.shared_folder(spark)).groupBy("doc_id").agg(F.count("*").alias("blocks"))


@query("s18_metrics_artifact", "SELECT event_type, count(*)::BIGINT AS n FROM events GROUP BY event_type")
def metrics_artifact(spark, sf_dir):
    """Written as JSON with its header and read back."""
    counts = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    folder = archives.shared_folder(spark)
    counts.select("*", F.lit("1").alias("version")).write.json(folder)
    return spark.read.schema("event_type string, n long, version string").json(folder).drop("version")


@query("s20_page_evidence", r"SELECT page_id, length(html)::BIGINT AS raw, length(regexp_replace(html, '\s+', '', 'g'))::BIGINT AS significant, (len(string_split(html, '<a ')) - 1)::BIGINT AS links FROM pages")
def page_evidence(spark, sf_dir):
    html = F.col("html")
    return table(spark, sf_dir, "pages").select(
        "page_id", F.length(html).cast("long").alias("raw"), F.length(F.regexp_replace(html, r"\s+", "")).cast("long").alias("significant"), t.phrase_count(html, "<a ").cast("long").alias("links"))
