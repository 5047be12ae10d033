"""Quality of dialogue scripts: naturalness with its warnings, and evaluation with its hard failures.

Turns are rows (script, turn, host, text, kind, substantive, evidence, segment): kind is what the turn does (QUESTION, REACTION,
CHALLENGE, CALLBACK, CLARIFICATION, EXAMPLE, STATEMENT, ...), evidence the ids it rests on. Every measure is a window of a few
turns, an aggregate, or an equi join by script; no script is held as a whole but for its text.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkspark.functions.text import phrase_count, units, word_tokens
from inkspark.operators.copies import script_risk
from inkspark.operators.dialogue import called_back, jaccard

# Phrases, patterns, weights and limits of the quality contract.
AGREEMENTS = ["你说得非常对", "你说得对", "确实如此", "没错", "完全同意", "非常赞同", "这点非常重要", "你这个问题非常好", "这个观点很有意思", "确实是这样"]
TRANSITIONS = ["总的来说", "综上所述", "接下来让我们", "首先", "其次", "最后", "一方面", "另一方面", "换句话说", "值得注意的是", "需要指出的是"]
PRESENTING = ["让我们深入探讨", "接下来我们来看", "这是一个值得深入思考的问题", "总结一下", "总体而言", "从这个角度来看", "这里有一个关键点"]
SUMMARIES = ["总而言之", "归根结底", "简单总结一下", "总结一下"]
BIOGRAPHY = "我去年.{0,12}(创业|工作|经历)|我朋友.{0,12}(正好|曾经|就是)|(?i:I once worked at)|(?i:when I worked at)"
RHETORICAL = "(?:那么问题来了|这意味着什么呢|为什么这么说呢)[？?]"
ANSWERS = ["CLARIFICATION", "QUESTION", "EXAMPLE", "CALLBACK"]
PENALTIES = {"agreement": 24, "agreement_opening": 18, "alternation": 22, "cyclic": 22, "presenting": 18, "restatement": 20, "similar_length": 12, "repetition": 18, "rhetorical": 12}
STYLE = {"host_count": None, "debate": 5, "formality": 5, "interruption": 5, "summary_density": 5, "within_budget": True}
PERIODS = range(2, 13)


def total(phrases: list[str]) -> Column:
    return reduce(lambda a, b: a + b, [phrase_count(F.col("text"), p) for p in phrases])


def clamp(score: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), score))


def ratio(a: Column | str, b: Column | str, missing: float = 0.0) -> Column:
    return F.coalesce(F.try_divide(F.col(a) if isinstance(a, str) else a, F.col(b) if isinstance(b, str) else b), F.lit(missing))


def codes(*cases: tuple[Column, str]) -> Column:
    """The codes whose conditions hold, in order; an unknown condition doesn't hold."""
    return F.filter(F.array(*(F.when(holds, code) for holds, code in cases)), lambda x: x.isNotNull())


def turn_measures(turns: DataFrame) -> DataFrame:
    """One row a script: counts over its turns, each with up to twelve turns before and three after."""
    w = Window.partitionBy("script").orderBy("turn")
    strong = (F.col("kind") == "STATEMENT") & F.col("substantive") & (F.size("evidence") > 0)
    answer = F.col("kind").isin(ANSWERS) | strong
    rows = turns.select(
        "script", "host", "text", "kind", "substantive", "evidence", units(F.col("text")).alias("n"), F.array_distinct(word_tokens(F.col("text"))).alias("words"),
        *(F.lag("host", p).over(w).alias(f"h{p}") for p in (1, *PERIODS)), F.lag("text").over(w).alias("before"),
        F.array(*(F.struct(F.lead("host", k).over(w).alias("host"), F.lead(answer, k).over(w).alias("answers")) for k in (1, 2, 3))).alias("later"))
    rows = rows.withColumn("words_before", F.array_distinct(word_tokens(F.col("before"))))
    here = F.count_if
    kind = lambda k: F.col("kind") == k
    opens = reduce(lambda a, b: a | b, [F.regexp_replace("text", r"^[\s 　﻿]+", "").startswith(p) for p in AGREEMENTS])
    alternates = (F.col("host") == F.col("h2")) & (F.col("h1") == F.col("h3")) & (F.col("host") != F.col("h1"))
    followed = F.exists("later", lambda x: (x["host"] != F.col("host")) & x["answers"])
    return rows.groupBy("script").agg(
        F.count("*").alias("turns"), F.countDistinct("host").alias("hosts"), F.var_pop("n").alias("length_variance"),
        here(F.col("h3").isNotNull()).alias("windows"), here(alternates).alias("alternating"), *(here(F.col("host") == F.col(f"h{p}")).alias(f"period{p}") for p in PERIODS),
        here(total(AGREEMENTS) > 0).alias("agreeing"), here(opens).alias("opening"), F.sum(total(TRANSITIONS)).alias("transitions"), F.sum(total(PRESENTING)).alias("presented"),
        F.sum(total(SUMMARIES)).alias("summaries"), here(F.col("text").rlike(RHETORICAL)).alias("rhetorical"), here(F.col("text").rlike(BIOGRAPHY)).alias("fabricated"),
        here(F.col("before").isNotNull() & (jaccard(F.col("words"), F.col("words_before")) >= 0.62)).alias("restating"),
        here(F.abs(F.col("n") - units(F.col("before"))) <= 8).alias("similar"), here(kind("REACTION") & (F.col("n") <= 24)).alias("reacting"), here(kind("QUESTION")).alias("asking"),
        here(kind("CHALLENGE")).alias("challenges"), here(kind("CHALLENGE") & followed).alias("followed"),
        here(F.col("substantive")).alias("substantive"), here(F.col("substantive") & (F.size("evidence") > 0)).alias("grounded"))


def host_measures(turns: DataFrame) -> DataFrame:
    """One row a script: how its hosts differ in turns, lengths, kinds and words."""
    rate = lambda kind: F.count_if(F.col("kind") == kind) / F.count("*")
    by = turns.groupBy("script", "host").agg(
        F.count("*").alias("own"), F.avg(units(F.col("text"))).alias("length"), rate("QUESTION").alias("q"), rate("CHALLENGE").alias("c"), rate("REACTION").alias("r"))
    gap = lambda c: (F.max(c) - F.min(c)).alias(f"{c}_gap")
    spread = by.groupBy("script").agg(F.max("own").alias("most_turns"), F.max("length").alias("longest"), gap("length"), gap("q"), gap("c"), gap("r"))
    words = turns.select("script", "host", F.explode(word_tokens(F.col("text"))).alias("word")).distinct()
    sizes = turns.select("script", "host").distinct().join(words.groupBy("script", "host").agg(F.count("*").alias("size")), ["script", "host"], "left").select("script", "host", F.coalesce("size", F.lit(0)).alias("size"))
    common = words.alias("a").join(words.alias("b"), ["script", "word"]).where("a.host < b.host").groupBy("script", F.col("a.host").alias("one"), F.col("b.host").alias("two")).agg(F.count("*").alias("both"))
    one, two = (sizes.select("script", F.col("host").alias(x), F.col("size").alias(f"{x}_size")) for x in ("one", "two"))
    pairs = one.join(two, "script").where("one < two").join(common, ["script", "one", "two"], "left")
    both = F.coalesce("both", F.lit(0))
    alike = pairs.groupBy("script").agg(F.avg(ratio(both, F.col("one_size") + F.col("two_size") - both)).alias("lexical"))
    return spread.join(alike, "script", "left")


def repetition(turns: DataFrame) -> DataFrame:
    """(script, repetition): the share of its distinct runs of three words in a turn that occur twice or more."""
    runs = lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - 2), lambda i: F.array_join(F.slice(w, i, 3), "|"))
    words = turns.select("script", word_tokens(F.col("text")).alias("w")).where(F.size("w") >= 3)
    counts = words.select("script", F.explode(F.flatten(F.transform(F.array("w"), runs))).alias("run")).groupBy("script", "run").agg(F.count("*").alias("n"))
    return counts.groupBy("script").agg((F.count_if(F.col("n") > 1) / F.count("*")).alias("repetition"))


def naturalness(turns: DataFrame, styles: DataFrame | None = None) -> DataFrame:
    """One row a script with its scores, rates and warnings. ``styles`` has (script, columns of ``STYLE``), null where a default holds."""
    rows = turn_measures(turns).join(host_measures(turns), "script").join(repetition(turns), "script", "left")
    asked = called_back(turns.where(F.col("kind") == "CALLBACK"), turns, 0.2)
    rows = rows.join(asked.groupBy("script").agg(F.avg(F.col("called_back").cast("double")).alias("callback_coverage")), "script", "left")
    rows = rows.join(styles, "script", "left") if styles is not None else rows
    style = lambda name: F.coalesce(F.col(name), F.lit(STYLE[name])) if styles is not None and name in styles.columns else F.lit(STYLE[name])
    rows = rows.withColumns({f"style_{name}": style(name) for name in STYLE}).drop(*STYLE)
    n = F.col("turns")
    multi = (F.coalesce(F.col("style_host_count").cast("long"), F.col("hosts")) > 1) & (F.col("hosts") > 1)
    per = {p: F.when((F.col("hosts") > 2) & (n >= 8) & (F.col("hosts") >= p), ratio(f"period{p}", n - p)) for p in PERIODS}
    rows = rows.withColumns({
        "multi": multi, "alternation": F.when(multi & (n >= 8) & (F.col("windows") >= 5), ratio("alternating", "windows")).otherwise(0.0), "cyclic": F.coalesce(F.greatest(*per.values()), F.lit(0.0)),
        "agreement": ratio("agreeing", n), "agreement_opening": ratio("opening", n), "transition": ratio("transitions", n), "presenting": ratio("presented", n), "rhetorical": ratio("rhetorical", n),
        "restatement": ratio("restating", F.greatest(F.lit(1), n - 1)), "similar_length": ratio("similar", F.greatest(F.lit(1), n - 1)), "short_reaction": ratio("reacting", n), "summary": ratio("summaries", n),
        "follow_through": ratio("followed", "challenges", 1.0), "callback_coverage": F.coalesce("callback_coverage", F.lit(1.0)), "repetition": F.coalesce("repetition", F.lit(0.0)),
        "lexical": F.when(multi, F.coalesce("lexical", F.lit(0.0))).otherwise(0.0), "length_difference": ratio("length_gap", F.greatest(F.lit(1), F.col("longest")))})
    differ = 100 * (0.30 * (1 - F.col("lexical")) + 0.25 * F.col("length_difference") + 0.20 * F.col("q_gap") + 0.15 * F.col("c_gap") + 0.10 * F.col("r_gap"))
    formal = F.col("style_formality") >= 7
    penalty = reduce(lambda a, b: a + b, [F.col(name) * weight for name, weight in PENALTIES.items()]) + F.col("transition") * 10 * F.when(formal, 0.6).otherwise(1.0)
    lively = F.when((F.col("short_reaction") > 0) & (F.col("style_interruption") > 2), 2).otherwise(0)
    rows = rows.withColumns({
        "differentiation": F.when(F.col("multi"), clamp(differ)).otherwise(100.0),
        "naturalness": clamp(92 - penalty + F.least(F.lit(7.0), F.sqrt("length_variance") / 4) + lively)})
    talks = F.col("multi") & (n >= 8)
    warnings = codes(
        (F.col("alternation") > 0.7, "STRICT_ALTERNATION_HIGH"), (F.col("cyclic") > 0.7, "CYCLIC_SPEAKER_PATTERN_HIGH"), (F.col("agreement") > 0.18, "GENERIC_AGREEMENT_DENSITY"),
        (F.col("transition") > F.when(formal, 0.55).otherwise(0.35), "FORMAL_TRANSITION_DENSITY"), (F.col("presenting") > 0.12, "META_PRESENTER_DENSITY"),
        (F.col("restatement") > 0.35, "ADJACENT_RESTATEMENT_HIGH"), (F.col("similar_length") > 0.7, "TURN_LENGTHS_TOO_SYMMETRIC"), (F.col("multi") & (F.col("differentiation") < 35), "HOSTS_TOO_SIMILAR"),
        ((F.col("challenges") > 0) & (F.col("follow_through") < 0.5), "CHALLENGE_ABANDONED"), (talks & (F.col("short_reaction") == 0) & (F.col("style_interruption") > 2), "SHORT_REACTIONS_MISSING"),
        ((F.col("style_summary_density") < 4) & (F.col("summary") > 0.25), "SUMMARY_DENSITY_HIGH"), ((F.col("style_debate") >= 7) & talks & (F.col("challenges") == 0), "CHALLENGES_MISSING"))
    return rows.withColumn("warnings", warnings)


def evaluation(turns: DataFrame, sources: DataFrame, styles: DataFrame | None = None) -> DataFrame:
    """(script, scores, hard_failures, warnings): ``naturalness`` with grounding, copied sources and fabricated lives.

    ``sources`` has (source_id, text). A script without substantive turns is grounded; one without sources copies none. The seven
    hard failures stand in their order.
    """
    rows = naturalness(turns, styles).join(script_risk(turns, sources), "script")
    cited = turns.where(F.col("substantive")).select("script", F.explode("evidence").alias("id")).distinct().groupBy("script").agg(F.count("*").alias("cited"))
    rows = rows.join(cited, "script", "left").withColumn("cited", F.coalesce("cited", F.lit(0)))
    n = F.col("turns")
    rows = rows.withColumn("grounding", 100 * ratio("grounded", "substantive", 1.0)).withColumn("ai_feel", clamp(100 - (
        (100 - F.col("naturalness")) * 0.7 + F.col("alternation") * 15 + F.col("cyclic") * 15 + F.col("agreement") * 8 + F.col("presenting") * 10)))
    value = (
        0.35 * F.col("grounding") / 100 + 0.22 * F.least(F.lit(1.0), ratio("substantive", n) * 2) + 0.18 * F.least(F.lit(1.0), ratio("cited", F.greatest(F.lit(1), F.col("substantive"))))
        + F.when(F.col("asking") > 0, 0.1).otherwise(0.0) + 0.1 * F.col("follow_through") + 0.05 * F.col("callback_coverage"))
    failures = codes(
        (F.col("grounding") < 100, "UNSUPPORTED_SUBSTANTIVE_CLAIM"), (F.col("fabricated") > 0, "FABRICATED_BIOGRAPHY"), (~F.col("style_within_budget"), "CONTEXT_BUDGET_VIOLATION"),
        (F.col("copy_risk") >= 0.8, "SOURCE_COPY_HARD_GATE"), (F.col("ai_feel") < 15, "AI_TASTE_SEVERE"),
        ((n >= 8) & (F.col("most_turns") / n > 0.94) & (F.coalesce(F.col("style_host_count").cast("long"), F.lit(2)) > 1), "HOST_COLLAPSE"), ((n >= 30) & (F.col("repetition") > 0.99), "EXTREME_REPETITION"))
    warnings = F.concat(F.array(F.lit("SEMANTIC_SUPPORT_NOT_ASSESSED")), "warnings", codes((F.col("copy_risk") >= 0.35, "SOURCE_COPY_OVERLAP")))
    return rows.select(
        "script", "naturalness", "grounding", "differentiation", clamp(100 * value - F.col("restatement") * 20).alias("cognitive_value"),
        clamp(100 - F.col("restatement") * 30 - F.col("repetition") * 25).alias("coherence"), clamp(100 - F.col("repetition") * 100).alias("repetition"), "ai_feel",
        clamp(100 * (1 - F.col("copy_risk"))).alias("source_copy"), F.when(F.col("style_within_budget"), 100.0).otherwise(0.0).alias("context_budget"),
        F.when(F.col("fabricated") > 0, 0.0).otherwise(100.0).alias("fabrication_boundary"), "utterance_risk", "segment_risk", "script_risk", failures.alias("hard_failures"), warnings.alias("warnings"))
