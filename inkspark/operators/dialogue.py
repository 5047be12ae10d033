"""Window operators over the turns of a conversation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkspark.functions.text import units, word_tokens


def turns_in_order():
    return Window.partitionBy("conv_id").orderBy("turn")


def alternation(turns: DataFrame) -> DataFrame:
    """(conv_id, windows, abab): four turns in a row by two hosts in turn."""
    host, back = F.col("role"), [F.lag("role", k).over(turns_in_order()) for k in (1, 2, 3)]
    marked = turns.select("conv_id", back[2].isNotNull().alias("w"), ((host == back[1]) & (back[0] == back[2]) & (host != back[0])).alias("abab"))
    return marked.groupBy("conv_id").agg(F.count_if("w").alias("windows"), F.count_if(F.col("w") & F.col("abab")).alias("abab"))


def cyclic(turns: DataFrame, periods=range(2, 13)) -> DataFrame:
    """(conv_id, rate): over the periods, the greatest share of turns by the host of so many turns before."""
    marked = turns.select("conv_id", *((F.col("role") == F.lag("role", p).over(turns_in_order())).alias(f"p{p}") for p in periods))
    shares = [F.coalesce(F.count_if(f"p{p}") / F.nullif(F.count(f"p{p}"), F.lit(0)), F.lit(0.0)) for p in periods]
    return marked.groupBy("conv_id").agg(F.greatest(*shares).alias("rate"))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def adjacent(turns: DataFrame, similar: float = 0.62, close: int = 8) -> DataFrame:
    """Each turn's word-set similarity with the one before, whether it restates it, and whether lengths are alike."""
    words = F.array_distinct(word_tokens(F.col("text")))
    sized = turns.withColumn("w", words).withColumn("n", units(F.col("text")))
    before, length = F.lag("w").over(turns_in_order()), F.lag("n").over(turns_in_order())
    alike = jaccard(F.col("w"), before)
    return sized.select(
        "conv_id", "turn", F.when(before.isNotNull(), alike).alias("similarity"), F.coalesce(alike >= similar, F.lit(False)).alias("restates"),
        F.coalesce(F.abs(F.col("n") - length) <= close, F.lit(False)).alias("same_length"))


def follow_through(turns: DataFrame, asks: Column, within: int = 3) -> DataFrame:
    """(conv_id, asked, answered): turns that ask, and those of them that another host follows within so many turns."""
    later = [F.lead("role", k).over(turns_in_order()) for k in range(1, within + 1)]
    answered = reduce(lambda a, b: a | b, [F.coalesce(x != F.col("role"), F.lit(False)) for x in later])
    marked = turns.select("conv_id", asks.alias("ask"), answered.alias("answered"))
    return marked.groupBy("conv_id").agg(F.count_if("ask").alias("asked"), F.count_if(F.col("ask") & F.col("answered")).alias("answered"))


def called_back(asking: DataFrame, turns: DataFrame, similar: float) -> DataFrame:
    """(script, turn, called_back): whether a turn at least two before an asking one shares so much of its words or cites an
    evidence id that it cites. Both have (script, turn, text[, evidence]); asking turns are among the turns.

    Turns that are so similar share a word among the rarest of each, all but so many as the similarity could still do
    without; they meet by those words, never turn by turn, and are compared in full.
    """
    cited = F.col("evidence") if "evidence" in turns.columns else F.array().cast("array<string>")
    place = F.row_number().over(Window.partitionBy("script").orderBy("turn"))
    rows = turns.select("script", "turn", place.alias("place"), F.array_distinct(word_tokens(F.col("text"))).alias("words"), cited.alias("ids"))
    words = rows.select("script", "turn", "place", F.size("words").alias("n"), F.explode("words").alias("word"))
    common = words.groupBy("script", "word").agg(F.count("*").alias("in"))
    rare = F.row_number().over(Window.partitionBy("script", "turn").orderBy("in", "word"))
    needed = F.col("n") - F.ceil(F.col("n") * similar - 1e-9) + 1
    signs = words.join(common, ["script", "word"]).withColumn("rank", rare).where(F.col("rank") <= needed).select("script", "turn", "place", F.concat(F.lit("w"), "word").alias("sign"))
    signs = signs.union(rows.select("script", "turn", "place", F.explode(F.array_distinct("ids")).alias("id")).select("script", "turn", "place", F.concat(F.lit("e"), "id")))
    asked = asking.select("script", "turn").distinct()
    later = signs.join(asked, ["script", "turn"]).select("script", "sign", F.col("turn").alias("own"), F.col("place").alias("at"))
    pairs = later.join(signs.select("script", "sign", "turn", "place"), ["script", "sign"]).where(F.col("place") <= F.col("at") - 2).select("script", "own", "turn").distinct()
    own = rows.select("script", F.col("turn").alias("own"), F.col("words").alias("w"), F.col("ids").alias("i"))
    fits = (jaccard(F.col("w"), F.col("words")) >= similar) | F.arrays_overlap("i", "ids")
    found = pairs.join(own, ["script", "own"]).join(rows.select("script", "turn", "words", "ids"), ["script", "turn"]).where(fits).select("script", F.col("own").alias("turn")).distinct()
    return asked.join(found.withColumn("found", F.lit(True)), ["script", "turn"], "left").select("script", "turn", F.coalesce("found", F.lit(False)).alias("called_back"))


def callbacks(turns: DataFrame, similar: float = 0.2) -> DataFrame:
    """(conv_id, turn, called_back): a turn at least two before shares so much of its words."""
    named = turns.withColumnRenamed("conv_id", "script")
    return called_back(named, named, similar).withColumnRenamed("script", "conv_id")


def speakers(turns: DataFrame) -> DataFrame:
    """Share of turns, mean length and share of questions for each host of a conversation."""
    question = F.contains(F.col("text"), F.lit("?"))
    by = turns.groupBy("conv_id", "role").agg(
        F.count("*").alias("turns"), F.avg(units(F.col("text"))).alias("mean_length"), (F.count_if(question) / F.count("*")).alias("question_rate"))
    return by.withColumn("share", F.col("turns") / F.sum("turns").over(Window.partitionBy("conv_id")))


def naturalness(turns: DataFrame) -> DataFrame:
    """(conv_id, score): 92 less weighted penalties, more for varied lengths, within 0 and 100."""
    a = alternation(turns).select("conv_id", F.when(F.col("windows") >= 5, F.col("abab") / F.col("windows")).otherwise(0.0).alias("strict"))
    b = adjacent(turns).groupBy("conv_id").agg(
        F.avg(F.col("restates").cast("double")).alias("restated"), F.avg(F.col("same_length").cast("double")).alias("alike"))
    c = turns.groupBy("conv_id").agg(F.stddev_pop(units(F.col("text"))).alias("spread"))
    penalty = 22 * F.col("strict") + 20 * F.col("restated") + 12 * F.col("alike")
    score = F.greatest(F.lit(0.0), F.least(F.lit(100.0), 92 - penalty + F.least(F.lit(7.0), F.col("spread") / 4)))
    return a.join(b, "conv_id").join(c, "conv_id").select("conv_id", score.alias("score"))
