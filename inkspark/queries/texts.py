"""Text functions over documents and pages' paths."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from inkspark.functions import text as t
from inkspark.queries import query
from inkspark.sources.tables import blocks, table


def docs(spark, sf_dir, *columns):
    return table(spark, sf_dir, "documents").select("doc_id", *(columns or ("text",)))


@query("s06_text_blocks", "SELECT doc_id, (generate_subscripts(l, 1) - 1)::INTEGER AS ordinal, unnest(l) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)")
def text_blocks(spark, sf_dir):
    return blocks(docs(spark, sf_dir))


@query("s07_markdown_kinds", r"""
WITH b AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)
SELECT kind, count(*)::BIGINT AS n FROM (SELECT CASE WHEN regexp_matches(line, '^#{1,6}[ \t]') THEN 'HEADING' WHEN regexp_matches(line, '^[ \t]*([-*+]|[0-9]+[.)])[ \t]') THEN 'LIST_ITEM'
  WHEN starts_with(line, '>') THEN 'QUOTE' WHEN starts_with(line, '```') THEN 'CODE' ELSE 'PARAGRAPH' END AS kind FROM b) GROUP BY kind""")
def markdown_kinds(spark, sf_dir):
    return blocks(docs(spark, sf_dir)).groupBy(t.block_kind(F.col("text")).alias("kind")).agg(F.count("*").alias("n"))


@query("s04_stream_inspection", "SELECT doc_id, octet_length(encode(text))::BIGINT AS bytes, sha256(text) AS sha256 FROM documents")
def stream_inspection(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.octet_length("text").cast("long").alias("bytes"), F.sha2("text", 256).alias("sha256"))


@query("s03_media_sniffing", "SELECT page_id, CASE WHEN starts_with(html, '%PDF-') THEN 'pdf' WHEN starts_with(html, 'PK' || chr(3) || chr(4)) THEN 'zip' WHEN regexp_matches(html, '(?i)^<!doctype html|^<html') THEN 'html' ELSE 'text' END AS media FROM pages")
def media_sniffing(spark, sf_dir):
    html = F.col("html")
    kind = F.when(html.startswith("%PDF-"), "pdf").when(html.startswith("PK\x03\x04"), "zip").when(html.rlike("(?i)^<!doctype html|^<html"), "html").otherwise("text")
    return table(spark, sf_dir, "pages").select("page_id", kind.alias("media"))


@query("s15_text_artifact", """
SELECT doc_id, sha256(string_agg(line, chr(10) || chr(10) ORDER BY i)) AS digest FROM (
  SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)) GROUP BY doc_id""")
def text_artifact(spark, sf_dir):
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("ordinal", "text"))), lambda b: b["text"])
    return blocks(docs(spark, sf_dir)).groupBy("doc_id").agg(F.sha2(F.array_join(ordered, "\n\n"), 256).alias("digest"))


@query("s16_json_export", """
SELECT o_custkey, count(*)::BIGINT AS n, sum(o_orderkey)::BIGINT AS keys FROM orders GROUP BY o_custkey""")
def json_export(spark, sf_dir):
    """A section per user as JSON, read again to count what it holds."""
    item = F.struct("o_orderkey", "o_orderstatus")
    section = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.to_json(F.collect_list(item)).alias("json"))
    items = F.from_json("json", "array<struct<o_orderkey:bigint,o_orderstatus:string>>")
    return section.select("o_custkey", F.size(items).cast("long").alias("n"), F.aggregate(items, F.lit(0).cast("long"), lambda a, x: a + x["o_orderkey"]).alias("keys"))


@query("x01_canonical_text", r"""
SELECT doc_id, sha256(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '^' || chr(65279), ''), '^([ \t]*\n)+', ''), '(\n[ \t]*)+$', '')) AS digest FROM documents""")
def canonical_text(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.sha2(t.canonical(F.col("text")), 256).alias("digest"))


@query("x08_sha256", "SELECT doc_id, sha256(text) AS digest FROM documents")
def sha256(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.sha2("text", 256).alias("digest"))


@query("x10_token_estimate", "SELECT doc_id, ceil(length(text) / 4.0)::BIGINT AS tokens FROM documents")
def token_estimate(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", t.stored_tokens(F.col("text")).alias("tokens"))


@query("x11_budget_tokens", "SELECT doc_id, greatest(ceil(length(text) / 3.0), ceil(length(text) / 2.0))::BIGINT AS tokens FROM documents")
def budget_tokens(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", t.budget_tokens(F.col("text")).alias("tokens"))


@query("x13_spoken_duration", r"""
SELECT doc_id, greatest(400, ceil(round((len(regexp_extract_all(text, '[A-Za-z0-9]+(?:[''-][A-Za-z0-9]+)*')) / 2.6::DOUBLE + len(regexp_extract_all(text, '[,.!?;:，。！？；：、]')) * 0.12::DOUBLE) * 1000, 6)))::BIGINT AS ms FROM documents""")
def spoken_duration(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", t.spoken_millis(F.col("text")).alias("ms"))


@query("x12_resource_units", "SELECT doc_id, least(1000000, greatest(1, octet_length(encode(text)) + 16))::BIGINT AS units FROM documents")
def resource_units(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.least(F.lit(1_000_000), F.greatest(F.lit(1), F.octet_length("text") + 16)).cast("long").alias("units"))


@query("x15_ssml_escape", """SELECT page_id, sha256(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&apos;')) AS digest FROM pages""")
def ssml_escape(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.sha2(t.escaped(F.col("html")), 256).alias("digest"))


@query("x14_spoken_text", r"""
SELECT page_id, sha256(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '\[([^\]]*)\]\([^)]*\)', '\1', 'g'), '<[^>]*>', ' ', 'g'), '&lt;.*?&gt;', ' ', 'g'), '[*_`#~]+', '', 'g'), '[ \t\r\n]+', ' ', 'g'))) AS digest FROM pages""")
def spoken_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.sha2(t.spoken_text(F.col("html")), 256).alias("digest"))


@query("x17_word_tokens", r"SELECT conv_id, turn, len(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'))::BIGINT AS n FROM conversations")
def word_tokens(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.size(t.word_tokens(F.col("text"))).cast("long").alias("n"))


@query("x18_phrase_count", "SELECT doc_id, (len(string_split(text, 'the ')) - 1)::BIGINT AS n FROM documents")
def phrase_count(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", t.phrase_count(F.col("text"), "the ").cast("long").alias("n"))


@query("x22_ocr_quality", r"""
SELECT doc_id, array_to_string(list_filter([CASE WHEN trim(text) = '' THEN 'EMPTY' END, CASE WHEN regexp_matches(text, '[\x00-\x08\x0b\x0c\x0e-\x1f]') THEN 'CONTROL' END,
  CASE WHEN repeated > 0.25 THEN 'DUPLICATE_LINES' END, CASE WHEN longest > 2000 THEN 'LONG_BLOCK' END, CASE WHEN contains(text, '|') THEN 'TABLE' END], lambda x: x IS NOT NULL), ',') AS codes
FROM (SELECT doc_id, text, list_max(list_transform(l, lambda x: length(x))) AS longest,
  CASE WHEN len(long) > 0 THEN (len(long) - len(list_distinct(long))) / len(long) ELSE 0 END AS repeated
  FROM (SELECT *, list_filter(l, lambda x: length(x) >= 20) AS long FROM (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents)))""")
def ocr_quality(spark, sf_dir):
    text, lines = F.col("text"), F.split("text", "\n")
    long = F.filter(lines, lambda x: F.length(x) >= 20)
    repeated = F.when(F.size(long) > 0, (F.size(long) - F.size(F.array_distinct(long))) / F.size(long)).otherwise(0)
    longest = F.array_max(F.transform(lines, lambda x: F.length(x)))
    codes = F.array_compact(F.array(
        F.when(F.trim(text) == "", "EMPTY"), F.when(text.rlike(r"[\x00-\x08\x0b\x0c\x0e-\x1f]"), "CONTROL"), F.when(repeated > 0.25, "DUPLICATE_LINES"),
        F.when(longest > 2000, "LONG_BLOCK"), F.when(text.contains("|"), "TABLE")))
    return docs(spark, sf_dir).select("doc_id", F.array_join(codes, ",").alias("codes"))


@query("x23_output_class", r"""
SELECT doc_id, CASE WHEN numeric_share >= 0.2 THEN 'CHART' WHEN contains(text, '|') THEN 'TABLE' ELSE 'TEXT' END AS class FROM (
  SELECT doc_id, text, len(list_filter(l, lambda x: regexp_matches(x, '^[ 0-9.,%-]*[0-9][ 0-9.,%-]*$'))) / len(l) AS numeric_share FROM (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents))""")
def output_class(spark, sf_dir):
    lines = F.split("text", "\n")
    share = F.size(F.filter(lines, lambda x: x.rlike(r"^[ 0-9.,%-]*[0-9][ 0-9.,%-]*$"))) / F.size(lines)
    return docs(spark, sf_dir).select("doc_id", F.when(share >= 0.2, "CHART").when(F.col("text").contains("|"), "TABLE").otherwise("TEXT").alias("class"))


@query("x24_candidate_quality", r"SELECT doc_id, CASE WHEN trim(text) = '' THEN 'EMPTY' WHEN length(text) > 50000 THEN 'TOO_LONG' WHEN regexp_matches(text, '[\x00-\x08]') THEN 'CONTROL' ELSE 'OK' END AS quality FROM documents")
def candidate_quality(spark, sf_dir):
    text = F.col("text")
    return docs(spark, sf_dir).select("doc_id", F.when(F.trim(text) == "", "EMPTY").when(F.length(text) > 50000, "TOO_LONG").when(text.rlike(r"[\x00-\x08]"), "CONTROL").otherwise("OK").alias("quality"))


@query("x27_isbn", r"""
WITH v AS (SELECT p_partkey, lpad((p_partkey * 7919 % 1000000000)::VARCHAR, 9, '0') AS d FROM part),
s AS (SELECT p_partkey, d, (SELECT sum(substr(d, i::INTEGER, 1)::INTEGER * (11 - i)) FROM range(1, 10) r(i))::INTEGER AS w FROM v)
SELECT p_partkey, (w + CASE WHEN p_partkey % 2 = 0 THEN (11 - w % 11) % 11 ELSE 5 END) % 11 = 0 AS ok FROM s""")
def isbn(spark, sf_dir):
    d = F.lpad((F.col("p_partkey") * 7919 % 1_000_000_000).cast("string"), 9, "0")
    weight = sum((F.substring(d, i, 1).cast("int") * (11 - i) for i in range(1, 10)), F.lit(0))
    last = F.when(F.col("p_partkey") % 2 == 0, (11 - weight % 11) % 11).otherwise(5)
    return table(spark, sf_dir, "part").select("p_partkey", t.isbn_ok(F.concat(d, F.when(last == 10, "X").otherwise(last.cast("string")))).alias("ok"))


@query("x28_language_tag", r"SELECT doc_id, regexp_matches(lang || '-' || source, '^[A-Za-z]{2,8}(-[A-Za-z0-9]{1,8})*$') AND length(lang || '-' || source) <= 64 AS ok FROM documents")
def language_tag(spark, sf_dir):
    return docs(spark, sf_dir, "lang", "source").select("doc_id", t.language_tag_ok(F.concat_ws("-", "lang", "source")).alias("ok"))


@query("x32_srt_timestamp", "SELECT event_id, printf('%02d:%02d:%02d,%03d', ms // 3600000 % 100, ms // 60000 % 60, ms // 1000 % 60, ms % 1000) AS at_time FROM (SELECT event_id, event_id * 37123 AS ms FROM events)")
def srt_timestamp(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", t.srt_time(F.col("event_id") * 37123).alias("at_time"))


@query("x33_title_projection", "SELECT p_partkey, coalesce(nullif(trim(CASE WHEN p_size % 3 = 0 THEN '  ' ELSE p_name END), ''), p_type) AS title, CASE WHEN p_size % 3 = 0 THEN 'FILE' ELSE 'WORK' END AS origin FROM part")
def title_projection(spark, sf_dir):
    work = F.nullif(F.trim(F.when(F.col("p_size") % 3 == 0, "  ").otherwise(F.col("p_name"))), F.lit(""))
    return table(spark, sf_dir, "part").select("p_partkey", F.coalesce(work, "p_type").alias("title"), F.when(work.isNull(), "FILE").otherwise("WORK").alias("origin"))


@query("f07_span_validity", """
WITH s AS (SELECT doc_id, text, (doc_id % 7 - 1)::INTEGER AS a, (doc_id % 7 + doc_id % 40)::INTEGER AS b FROM documents)
SELECT doc_id, CASE WHEN a < 0 OR b <= a OR b > length(text) THEN 'RANGE' WHEN substr(text, a + 1, b - a) IS DISTINCT FROM CASE WHEN doc_id % 5 > 0 THEN substr(text, a + 1, b - a) ELSE 'x' END THEN 'QUOTE' END AS error FROM s""")
def span_validity(spark, sf_dir):
    a, b = (F.col("doc_id") % 7 - 1).cast("int"), (F.col("doc_id") % 7 + F.col("doc_id") % 40).cast("int")
    quote = F.when(F.col("doc_id") % 5 > 0, t.units_slice(F.col("text"), a, b)).otherwise("x")
    return docs(spark, sf_dir).select("doc_id", t.span_error(F.col("text"), a, b, quote).alias("error"))


@query("f15_safe_path", r"""
WITH p AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN url WHEN 1 THEN 'a/../b' WHEN 2 THEN '/abs' ELSE 'text/part' || page_id || '.xhtml' END AS path FROM pages)
SELECT page_id, page_id % 4 = 3 AS ok FROM p""")
def safe_path(spark, sf_dir):
    k = F.col("page_id") % 4
    path = F.when(k == 0, F.col("url")).when(k == 1, "a/../b").when(k == 2, "/abs").otherwise(F.concat(F.lit("text/part"), F.col("page_id").cast("string"), F.lit(".xhtml")))
    return table(spark, sf_dir, "pages").select("page_id", t.safe_path(path).alias("ok"))


@query("f17_error_codes", "SELECT event_id, CASE WHEN event_type IN ('view', 'click') THEN event_type WHEN event_type IS NOT NULL THEN 'OTHER' END AS code FROM events")
def error_codes(spark, sf_dir):
    kind = F.col("event_type")
    return table(spark, sf_dir, "events").select("event_id", F.when(kind.isin("view", "click"), kind).when(kind.isNotNull(), "OTHER").alias("code"))


@query("f18_redaction")
def redaction(spark, sf_dir):
    """Every whole text. Engines differ on word boundaries, so tests hold it against a plain version."""
    return docs(spark, sf_dir).select("doc_id", F.sha2(t.redacted(F.col("text")), 256).alias("digest"))


@query("f19_log_sanitizer", r"""
SELECT page_id, sha256(CASE WHEN length(h) > 6144 THEN left(h, 3072) || '...' || right(h, 3072) ELSE h END) AS digest FROM (
  SELECT page_id, regexp_replace(regexp_replace(html, 'https?://\S+', '[url]', 'g'), '/tmp/\S+', '[path]', 'g') AS h FROM pages)""")
def log_sanitizer(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.sha2(t.sanitized_log(F.col("html")), 256).alias("digest"))


@query("a28_repeated_ngrams", """
WITH w AS (SELECT conv_id, turn, string_split(text, ' ') AS w FROM conversations),
g AS (SELECT conv_id, turn, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g FROM w WHERE len(w) >= 3)
SELECT conv_id, count(*)::BIGINT AS kinds, count(*) FILTER (n > 1)::BIGINT AS repeated FROM (SELECT conv_id, g, count(*) AS n FROM g GROUP BY conv_id, g) GROUP BY conv_id""")
def repeated_ngrams(spark, sf_dir):
    words = F.split("text", " ")
    grams = F.transform(F.sequence(F.lit(1), F.size(words) - 2), lambda i: F.array_join(F.slice(words, i, 3), " "))
    rows = table(spark, sf_dir, "conversations").where(F.size(words) >= 3).select("conv_id", F.explode(grams).alias("g"))
    return rows.groupBy("conv_id", "g").agg(F.count("*").alias("n")).groupBy("conv_id").agg(F.count("*").alias("kinds"), F.count_if(F.col("n") > 1).alias("repeated"))


@query("s21_excerpt_projection", """
WITH b AS (SELECT doc_id, generate_subscripts(l, 1) - 1 AS o, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)),
r AS (SELECT *, sum(length(line)) OVER (PARTITION BY doc_id ORDER BY o ROWS UNBOUNDED PRECEDING) - length(line) AS used FROM b WHERE o < 16)
SELECT doc_id, sum(least(length(line), greatest(0, 6000 - used)))::BIGINT AS shown, bool_or(used + length(line) > 6000) AS truncated FROM r GROUP BY doc_id""")
def excerpt_projection(spark, sf_dir):
    first = blocks(docs(spark, sf_dir)).where("ordinal < 16").withColumn("n", t.units(F.col("text")))
    used = F.coalesce(F.sum("n").over(Window.partitionBy("doc_id").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return first.withColumn("used", used).groupBy("doc_id").agg(
        F.sum(F.least(F.col("n"), F.greatest(F.lit(0), 6000 - F.col("used")))).alias("shown"), F.bool_or(F.col("used") + F.col("n") > 6000).alias("truncated"))
