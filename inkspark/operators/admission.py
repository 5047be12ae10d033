"""Failover holds and grounding failures, with every code, over typed inputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkspark.functions import text as t
from inkspark.operators.decisions import first_of

#: Errors after which nothing is tried again, those that cost nothing, and those of a settled paid call.
FINAL = ("CONTENT_REJECTED CANCELLED BUDGET_EXCEEDED AUTHORIZATION_FAILED CREDENTIAL_REVOKED NETWORK_POLICY_REJECTED IDEMPOTENCY_CONFLICT "
         "PROVIDER_CONNECTION_CHANGED PROVIDER_CONNECTION_NAME_CONFLICT").split()
FREE, PAID = "QUOTA_EXCEEDED RATE_LIMITED CIRCUIT_OPEN TRANSIENT_UPSTREAM TIMEOUT".split(), "OUTPUT_TRUNCATED INVALID_PROVIDER_RESPONSE".split()
#: Slots whose answers must be structured.
STRUCTURED = "PODCAST_SCRIPT SHORT_VIDEO_SCRIPT THINKING_SESSION BOOK_SEMANTIC_REVIEW".split()
#: Fixed value: what a host with a made-up life says.
FABRICATED = r"(?i)我去年.{0,12}(?:创业|工作|经历)|我朋友.{0,12}(?:正好|曾经|就是)|I once worked at|when I worked at"


def failover_hold() -> Column:
    """Why a failed call isn't passed on to the next candidate; null if it is. The first reason in order counts.

    Of columns enabled, authority, sealed, terminal, unclaimed, may_pay, has_budget, independent, voice (booleans),
    error, outcome, slot, switches, most, at, and candidates, an array of (provider, model, connection, credential,
    source, capable, structured). Unknown booleans count as false.
    """
    c, no = F.col, lambda x: ~F.coalesce(F.col(x), F.lit(False))
    here, after = F.get("candidates", c("at")), F.get("candidates", c("at") + 1)
    whole = c("switches").isNull() | c("most").isNull() | (c("switches") < 0) | (c("most") < 0) | (c("most") > 2) | (c("switches") >= c("most"))
    seen = F.exists(F.slice("candidates", 1, F.greatest(c("at") + 1, F.lit(1))), lambda x: (x["provider"] == after["provider"]) & (x["model"] == after["model"]))
    loose = after["connection"].isNull() | after["credential"].isNull() | ~after["source"].eqNullSafe(F.lit("WORKSPACE"))
    fine = F.when(c("outcome") == "PAID_AND_RECONCILED", c("error").isin(PAID)).otherwise(c("outcome").isin("NOT_SENT", "PROVIDER_CONFIRMED_UNBILLED") & c("error").isin(FREE))
    return first_of(
        (no("enabled") | (c("most") == 0), "NOT_ENABLED"), (no("authority") | no("sealed"), "UNSEALED_PLAN"), (no("terminal") | no("unclaimed"), "IN_FLIGHT"),
        (c("error") == "CONTENT_REJECTED", "CONTENT_POLICY_REVIEW_REQUIRED"), (c("error").isin(FINAL), "UNSAFE_FAILURE_CLASS"), (c("outcome") == "UNKNOWN", "UNKNOWN_BILLING"),
        (no("may_pay"), "NO_PAID_CALL_AUTHORIZATION"), (no("has_budget"), "BUDGET_EXHAUSTED"), (whole, "ATTEMPT_LIMIT_REACHED"),
        (c("at").isNull() | (c("at") < 0) | (c("at") >= F.size("candidates") - 1), "NO_BACKUP"), (c("at") != c("switches"), "ATTEMPT_LIMIT_REACHED"),
        (here.isNull() | after.isNull(), "NO_BACKUP"), (seen, "REPEATED_MODEL"), (loose, "UNPINNED_ROUTE"), (~F.coalesce(fine, F.lit(False)), "UNSAFE_FAILURE_CLASS"),
        (c("slot") == "EMBEDDING", "EMBEDDING_REINDEX_REQUIRED"), (c("slot") == "PDF_VISUAL_STRUCTURE", "VISION_PROVIDER_CONSENT_REQUIRED"),
        ((c("slot") == "BOOK_SEMANTIC_REVIEW") & no("independent"), "INDEPENDENT_REVIEW_REQUIRED"), ((c("slot") == "SPEECH") & no("voice"), "SPEECH_VOICE_MAPPING_REQUIRED"),
        (~F.coalesce(after["capable"], F.lit(False)) | (c("slot").isin(STRUCTURED) & ~F.coalesce(after["structured"], F.lit(False))), "INCOMPATIBLE_CAPABILITY"))


def podcast_grounding(utterances: DataFrame, evidence: DataFrame, blocks: DataFrame) -> DataFrame:
    """(run, code, id): failures of utterances (run, utterance, text, substantive, direct) by their evidence (evidence,
    utterance, block, first, last, quote) in blocks (block, content). Spans count UTF-16 units; id is the utterance's or
    the evidence's, as text."""
    said = utterances.join(evidence, "utterance", "left").join(blocks, "block", "left")
    size = t.units(F.col("content"))
    exact = t.units_slice(F.col("content"), F.greatest(F.col("first"), F.lit(0)), F.least(F.col("last"), size))
    has, quoted = F.col("evidence").isNotNull(), F.coalesce("quote", F.lit("")) != ""
    off = (F.col("first") < 0) | (F.col("last") <= F.col("first")) | (F.col("last") > size)
    name = lambda c: F.col(c).cast("string")
    each = said.select("run", F.explode(F.array_compact(F.array(*(F.when(bad, F.struct(F.lit(code).alias("code"), name(c).alias("id"))) for bad, code, c in (
        (has & off, "INVALID_OFFSETS", "evidence"), (has & F.col("quote").isNotNull() & ~exact.eqNullSafe(F.col("quote")), "QUOTE_EVIDENCE_MISMATCH", "evidence"),
        (F.col("direct") & has & quoted & ~F.contains("text", "quote"), "QUOTE_NOT_EXACT", "utterance")))))).alias("e")).select("run", "e.*")
    whole = said.groupBy("run", "utterance").agg(
        F.any_value("text").alias("text"), F.bool_or("substantive").alias("substantive"), F.bool_or("direct").alias("direct"), F.count("evidence").alias("n"),
        F.count_if(has & quoted).alias("quotes"))
    own = whole.select("run", F.explode(F.array_compact(F.array(*(F.when(bad, F.struct(F.lit(code).alias("code"), name("utterance").alias("id"))) for bad, code in (
        (F.col("substantive") & (F.col("n") == 0), "UNSUPPORTED"), (F.col("text").rlike(FABRICATED), "FABRICATED_BIOGRAPHY"),
        (F.col("direct") & (F.col("quotes") == 0), "QUOTE_EVIDENCE_TEXT_MISSING")))))).alias("e")).select("run", "e.*")
    return own.union(each).distinct()


def video_grounding(scenes: DataFrame, evidence: DataFrame, blocks: DataFrame, sources: DataFrame, most: int = 300, share: float = 0.2) -> DataFrame:
    """(run, codes): the distinct failures, in order of code, of runs of scenes (run, scene, kind, narration) by their
    evidence (evidence, run, scene, lineage, block, first, last, quote, digest) in blocks (block, content) of the run's
    sources (run, lineage). Quotes hold ``most`` units in all, and ``share`` of the narration."""
    held = evidence.join(blocks, "block", "left").join(sources.distinct().withColumn("known", F.lit(True)), ["run", "lineage"], "left")
    first, last, size = F.col("first"), F.col("last"), t.units(F.col("content"))
    off = (first < 0) | (last <= first) | (last > size)
    split = ~off & (t.splits_pair(F.col("content"), first) | t.splits_pair(F.col("content"), last))
    counts = ~off & ~split & F.col("quote").isNotNull()
    exact = F.when(counts, t.units_slice(F.col("content"), first, last))
    marked = held.select("run", "scene", F.when(counts, last - first).otherwise(0).alias("quoted"), F.array_compact(F.array(
        F.when(F.col("known").isNull(), "GROUNDING_FOREIGN_LINEAGE"), F.when(off, "GROUNDING_OFFSET_INVALID"), F.when(split, "GROUNDING_SURROGATE_SPLIT"),
        F.when(counts & (F.col("quote") != exact), "GROUNDING_QUOTE_MISMATCH"),
        F.when(counts & ~F.col("digest").eqNullSafe(F.sha2(exact, 256)), "GROUNDING_QUOTE_HASH_MISMATCH"))).alias("codes"))
    by_run = marked.groupBy("run").agg(F.sum("quoted").alias("quoted"), F.flatten(F.collect_set("codes")).alias("codes"))
    bare = scenes.join(evidence.select("run", "scene").distinct().withColumn("has", F.lit(True)), ["run", "scene"], "left").groupBy("run").agg(
        F.sum(t.units(F.col("narration"))).alias("narrated"), F.bool_or(F.col("kind").isin("EVIDENCE", "CLAIM", "QUOTE") & F.col("has").isNull()).alias("bare"))
    joined = bare.join(by_run, "run", "left")
    quoted = F.coalesce("quoted", F.lit(0))
    over = (quoted > most) | (quoted > share * F.col("narrated"))
    extra = F.array_compact(F.array(F.when(F.col("bare"), "GROUNDING_EVIDENCE_REQUIRED"), F.when(over, "GROUNDING_QUOTE_BUDGET_EXCEEDED")))
    return joined.select("run", F.array_sort(F.array_distinct(F.concat(extra, F.coalesce("codes", F.array().cast("array<string>"))))).alias("codes"))
