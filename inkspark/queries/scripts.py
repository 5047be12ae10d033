"""Scripts and what they copy: lines of documents against other documents, and conversations as dialogue scripts."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkspark.functions import text as t
from inkspark.operators import copies, scripts
from inkspark.queries import query
from inkspark.sources.tables import blocks, table

#: Risks of the levels in ``own`` (script, turn, segment, s: letters and digits alone) against ``src`` (s).
RISKS = r"""
levels AS (
  SELECT script, 'utterance' AS level, turn AS place, s FROM own
  UNION ALL SELECT script, 'segment', segment, string_agg(s, '' ORDER BY turn) FROM own GROUP BY script, segment
  UNION ALL SELECT script, 'script', 0, string_agg(s, '' ORDER BY turn) FROM own GROUP BY script),
cut AS (SELECT script, level, place, s, list_transform(range(0, greatest(0, ceil((length(s) - 59) / 20.0))::BIGINT), lambda i: substr(s, i * 20 + 1, 60)) AS g FROM levels),
pool AS (SELECT DISTINCT unnest(list_transform(range(0, greatest(0, ceil((length(s) - 59) / 20.0))::BIGINT), lambda i: substr(s, i * 20 + 1, 60))) AS g FROM src),
shares AS (SELECT script, level, place, count(pool.g) / count(*) AS share FROM (SELECT script, level, place, unnest(g) AS g FROM cut) c LEFT JOIN pool ON c.g = pool.g GROUP BY ALL),
whole AS (SELECT DISTINCT script, level, place FROM levels SEMI JOIN src ON contains(src.s, levels.s) WHERE length(levels.s) >= 120),
risks AS (
  SELECT l.script, l.level, CASE WHEN w.script IS NOT NULL THEN 1 ELSE coalesce(s.share, 0) END AS risk FROM levels l
  LEFT JOIN shares s ON s.script = l.script AND s.level = l.level AND s.place = l.place LEFT JOIN whole w ON w.script = l.script AND w.level = l.level AND w.place = l.place),
risk AS (SELECT script, max(risk) FILTER (level = 'utterance') AS u, max(risk) FILTER (level = 'segment') AS g, max(risk) FILTER (level = 'script') AS c, max(risk) AS m FROM risks GROUP BY script)
"""


@query("x19_copy_risk", r"""
WITH l AS (SELECT doc_id AS script, generate_subscripts(p, 1) - 1 AS turn, unnest(p) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents)),
own AS (SELECT script, turn, turn // 5 AS segment, regexp_replace(lower(line), '[^\p{L}\p{N}]+', '', 'g') AS s FROM l WHERE script % 2 = 1),
src AS (SELECT DISTINCT regexp_replace(lower(text), '[^\p{L}\p{N}]+', '', 'g') AS s FROM documents WHERE doc_id % 2 = 0),""" + RISKS + """
SELECT script AS doc_id, round(u, 6) AS line_risk, round(g, 6) AS segment_risk, round(c, 6) AS text_risk, round(m, 6) AS risk FROM risk""")
def copy_risk(spark, sf_dir):
    """What documents with odd ids take from those with even ones: by line, by five lines in a row, and as a whole."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    lines = blocks(documents.where("doc_id % 2 = 1")).select(F.col("doc_id").alias("script"), F.col("ordinal").alias("turn"), F.floor(F.col("ordinal") / 5).alias("segment"), "text")
    found = copies.script_risk(lines, documents.where("doc_id % 2 = 0").withColumnRenamed("doc_id", "source_id"))
    return found.select(F.col("script").alias("doc_id"), *(F.round(a, 6).alias(b) for a, b in (("utterance_risk", "line_risk"), ("segment_risk", "segment_risk"), ("script_risk", "text_risk"), ("copy_risk", "risk"))))


def script_turns(spark, sf_dir):
    """Conversations as scripts: short turns react, the others ask, challenge, call back or state in turn; long ones make claims that
    rest on their longest words."""
    turns = table(spark, sf_dir, "conversations")
    n = t.units(F.col("text"))
    kind = F.when(n <= 24, "REACTION").when(F.col("turn") % 5 == 1, "CHALLENGE").when(F.col("turn") % 5 == 3, "CALLBACK").when(F.col("turn") % 7 == 2, "QUESTION").otherwise("STATEMENT")
    evidence = F.array_distinct(F.filter(t.word_tokens(F.col("text")), lambda w: F.length(w) >= 11))
    return turns.select(
        F.col("conv_id").alias("script"), "turn", F.col("role").alias("host"), "text", kind.alias("kind"), (n >= 200).alias("substantive"), evidence.alias("evidence"), F.floor(F.col("turn") / 3).alias("segment"))


EVALUATION = r"""
WITH own0 AS (
  SELECT conv_id AS script, turn, role AS host, text, length(text) AS n, turn // 3 AS segment, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS tokens,
    CASE WHEN length(text) <= 24 THEN 'REACTION' WHEN turn % 5 = 1 THEN 'CHALLENGE' WHEN turn % 5 = 3 THEN 'CALLBACK' WHEN turn % 7 = 2 THEN 'QUESTION' ELSE 'STATEMENT' END AS kind,
    length(text) >= 200 AS substantive FROM conversations),
t AS (SELECT *, list_distinct(tokens) AS w, list_distinct(list_filter(tokens, lambda x: length(x) >= 11)) AS evidence, row_number() OVER (PARTITION BY script ORDER BY turn) AS k FROM own0),
own AS (SELECT script, turn, segment, regexp_replace(lower(text), '[^\p{L}\p{N}]+', '', 'g') AS s FROM t),
src AS (SELECT DISTINCT regexp_replace(lower(text), '[^\p{L}\p{N}]+', '', 'g') AS s FROM documents),""" + RISKS + r""",
base AS (SELECT script, count(*) AS turns, count(DISTINCT host) AS hosts, var_pop(n) AS variance, count(*) FILTER (kind = 'REACTION') AS reacting, count(*) FILTER (kind = 'QUESTION') AS asking,
  count(*) FILTER (kind = 'CHALLENGE') AS challenges, count(*) FILTER (substantive) AS substantive, count(*) FILTER (substantive AND len(evidence) > 0) AS grounded, sum(ceil(n / 4.0)) AS budget FROM t GROUP BY script),
near AS (SELECT a.script, count(*) FILTER (len(list_intersect(a.w, b.w)) / nullif(len(list_distinct(list_concat(a.w, b.w))), 0) >= 0.62) AS restating, count(*) FILTER (abs(a.n - b.n) <= 8) AS close_by
  FROM t a JOIN t b ON a.script = b.script AND b.k = a.k - 1 GROUP BY a.script),
alt AS (SELECT a.script, count(*) AS windows, count(*) FILTER (a.host = c.host AND b.host = d.host AND a.host <> b.host) AS alternating
  FROM t a JOIN t b ON a.script = b.script AND b.k = a.k - 1 JOIN t c ON a.script = c.script AND c.k = a.k - 2 JOIN t d ON a.script = d.script AND d.k = a.k - 3 GROUP BY a.script),
cyc AS (SELECT a.script, a.k - b.k AS period, count(*) FILTER (a.host = b.host) / count(*) AS rate FROM t a JOIN t b ON a.script = b.script AND a.k - b.k BETWEEN 2 AND 12 GROUP BY a.script, a.k - b.k),
cyclic AS (SELECT c.script, max(rate) AS rate FROM cyc c JOIN base USING (script) WHERE hosts > 2 AND turns >= 8 AND period <= hosts GROUP BY c.script),
follow AS (SELECT a.script, count(DISTINCT a.turn) AS followed FROM t a JOIN t b ON a.script = b.script AND b.k BETWEEN a.k + 1 AND a.k + 3
  WHERE a.kind = 'CHALLENGE' AND a.host <> b.host AND (b.kind IN ('QUESTION', 'CALLBACK') OR b.kind = 'STATEMENT' AND b.substantive AND len(b.evidence) > 0) GROUP BY a.script),
back AS (SELECT a.script, avg(CASE WHEN EXISTS (SELECT 1 FROM t b WHERE a.script = b.script AND b.k <= a.k - 2 AND (len(list_intersect(a.w, b.w)) / nullif(len(list_distinct(list_concat(a.w, b.w))), 0) >= 0.2 OR list_has_any(a.evidence, b.evidence))) THEN 1.0 ELSE 0.0 END)::DOUBLE AS coverage
  FROM t a WHERE kind = 'CALLBACK' GROUP BY a.script),
byhost AS (SELECT script, host, count(*) AS own_turns, avg(n) AS mean, avg((kind = 'QUESTION')::INT) AS q, avg((kind = 'CHALLENGE')::INT) AS c, avg((kind = 'REACTION')::INT) AS r, list_distinct(flatten(list(tokens))) AS words FROM t GROUP BY script, host),
gaps AS (SELECT script, max(own_turns) AS most, (max(mean) - min(mean)) / greatest(1, max(mean)) AS length_gap, max(q) - min(q) AS q, max(c) - min(c) AS c, max(r) - min(r) AS r FROM byhost GROUP BY script),
lex AS (SELECT a.script, avg(coalesce(len(list_intersect(a.words, b.words)) / nullif(len(list_distinct(list_concat(a.words, b.words))), 0), 0)) AS lexical FROM byhost a JOIN byhost b ON a.script = b.script AND a.host < b.host GROUP BY a.script),
runs AS (SELECT script, unnest(list_transform(range(1, greatest(1, len(tokens) - 1)), lambda i: array_to_string(tokens[i:i + 2], '|'))) AS g FROM t),
rep AS (SELECT script, count(*) FILTER (n > 1) / count(*) AS repetition FROM (SELECT script, g, count(*) AS n FROM runs GROUP BY script, g) GROUP BY script),
cites AS (SELECT script, count(DISTINCT e) AS cited FROM (SELECT script, unnest(evidence) AS e FROM t WHERE substantive) GROUP BY script),
m AS (SELECT b.script, turns, hosts > 1 AS multi, variance, substantive, asking, most, u, g, r.c AS c, r.m AS copy, budget <= 1500 AS within, challenges,
  CASE WHEN hosts > 1 AND turns >= 8 AND windows >= 5 THEN alternating / windows ELSE 0 END AS alternation, coalesce(cyclic.rate, 0) AS cyclic,
  coalesce(restating, 0) / greatest(1, turns - 1) AS restatement, coalesce(close_by, 0) / greatest(1, turns - 1) AS alike, reacting / turns AS short, coalesce(repetition, 0) AS repetition,
  CASE WHEN challenges > 0 THEN coalesce(followed, 0) / challenges ELSE 1 END AS follow, coalesce(coverage, 1) AS coverage, coalesce(cited, 0) AS cited,
  CASE WHEN substantive > 0 THEN grounded / substantive * 100 ELSE 100 END AS grounding,
  CASE WHEN hosts > 1 THEN greatest(0, least(100, 100 * (0.30 * (1 - lexical) + 0.25 * length_gap + 0.20 * gaps.q + 0.15 * gaps.c + 0.10 * gaps.r))) ELSE 100 END AS differentiation
  FROM base b JOIN gaps USING (script) JOIN risk r USING (script) LEFT JOIN near USING (script) LEFT JOIN alt USING (script) LEFT JOIN cyclic USING (script) LEFT JOIN follow USING (script)
  LEFT JOIN back USING (script) LEFT JOIN lex USING (script) LEFT JOIN rep USING (script) LEFT JOIN cites USING (script)),
s AS (SELECT *, greatest(0, least(100, 92 - (alternation * 22 + cyclic * 22 + restatement * 20 + alike * 12 + repetition * 18) + least(7, sqrt(variance) / 4) + CASE WHEN short > 0 THEN 2 ELSE 0 END)) AS naturalness FROM m),
f AS (SELECT *, greatest(0, least(100, 100 - ((100 - naturalness) * 0.7 + alternation * 15 + cyclic * 15))) AS ai_feel FROM s)
SELECT script AS conv_id, round(naturalness, 4) AS naturalness, round(grounding, 4)::DOUBLE AS grounding, round(differentiation, 4)::DOUBLE AS differentiation,
  round(greatest(0, least(100, 100 * (0.35 * grounding / 100 + 0.22 * least(1, substantive / turns * 2) + 0.18 * least(1, cited / greatest(1, substantive)) + CASE WHEN asking > 0 THEN 0.1 ELSE 0 END + 0.1 * follow + 0.05 * coverage) - restatement * 20)), 4)::DOUBLE AS cognitive_value,
  round(greatest(0, least(100, 100 - restatement * 30 - repetition * 25)), 4)::DOUBLE AS coherence, round(100 - repetition * 100, 4)::DOUBLE AS repetition, round(ai_feel, 4)::DOUBLE AS ai_feel, round(100 * (1 - copy), 4)::DOUBLE AS source_copy,
  array_to_string(list_filter([CASE WHEN grounding < 100 THEN 'UNSUPPORTED_SUBSTANTIVE_CLAIM' END, CASE WHEN NOT within THEN 'CONTEXT_BUDGET_VIOLATION' END, CASE WHEN copy >= 0.8 THEN 'SOURCE_COPY_HARD_GATE' END, CASE WHEN ai_feel < 15 THEN 'AI_TASTE_SEVERE' END,
    CASE WHEN turns >= 8 AND most / turns > 0.94 THEN 'HOST_COLLAPSE' END, CASE WHEN turns >= 30 AND repetition > 0.99 THEN 'EXTREME_REPETITION' END], lambda x: x IS NOT NULL), ',') AS hard_failures,
  array_to_string(list_filter(['SEMANTIC_SUPPORT_NOT_ASSESSED', CASE WHEN alternation > 0.7 THEN 'STRICT_ALTERNATION_HIGH' END, CASE WHEN cyclic > 0.7 THEN 'CYCLIC_SPEAKER_PATTERN_HIGH' END, CASE WHEN restatement > 0.35 THEN 'ADJACENT_RESTATEMENT_HIGH' END,
    CASE WHEN alike > 0.7 THEN 'TURN_LENGTHS_TOO_SYMMETRIC' END, CASE WHEN multi AND differentiation < 35 THEN 'HOSTS_TOO_SIMILAR' END, CASE WHEN challenges > 0 AND follow < 0.5 THEN 'CHALLENGE_ABANDONED' END,
    CASE WHEN multi AND turns >= 8 AND short = 0 THEN 'SHORT_REACTIONS_MISSING' END, CASE WHEN copy >= 0.35 THEN 'SOURCE_COPY_OVERLAP' END], lambda x: x IS NOT NULL), ',') AS warnings FROM f
"""


@query("x21_script_evaluation", EVALUATION)
def script_evaluation(spark, sf_dir):
    """Each conversation as a script, whose sources are the documents; 1,500 stored tokens are its budget."""
    turns = script_turns(spark, sf_dir)
    styles = turns.groupBy("script").agg((F.sum(t.stored_tokens(F.col("text"))) <= 1500).alias("within_budget"))
    sources = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("source_id"), "text")
    scores = ["naturalness", "grounding", "differentiation", "cognitive_value", "coherence", "repetition", "ai_feel", "source_copy"]
    found = scripts.evaluation(turns, sources, styles)
    return found.select(F.col("script").alias("conv_id"), *(F.round(c, 4).alias(c) for c in scores), *(F.array_join(c, ",").alias(c) for c in ("hard_failures", "warnings")))
