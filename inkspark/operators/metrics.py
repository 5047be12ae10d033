"""Product metrics over participants and their activity. Every time is compared with a given as-of time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkspark.sources.tables import hours, millis


def rate(n: Column, d: Column, empty: float | None = None) -> Column:
    """n / d; ``empty`` (null for metrics, 0 for usage) where d is 0."""
    return F.when(d > 0, n / d).otherwise(F.lit(empty))


def valid(at: str, as_of: str = "as_of", enrolled: str = "enrolled_at", withdrawn: str | None = None) -> Column:
    """Activity counts from enrolment to the as-of time, both included, and to withdrawal where there is one."""
    inside = (F.col(at) >= F.col(enrolled)) & (F.col(at) <= F.col(as_of))
    return inside & (F.col(withdrawn).isNull() | (F.col(at) <= F.col(withdrawn))) if withdrawn else inside


def nearest_rank(column: str, p: float) -> Column:
    """The whole number at rank ceil(p * n); null for none."""
    return F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {column})").cast("long")


def first_per_user(activity: DataFrame, kinds: list[str], name: str) -> DataFrame:
    return activity.where(F.col("event_type").isin(kinds)).groupBy("user_id").agg(F.min("ts").alias(name))


def activation(people: DataFrame, activity: DataFrame, analysis: list[str], meaningful: list[str]) -> DataFrame:
    """``people`` with activated_at, the later of the first analysis and the first meaningful event; null without both."""
    both = first_per_user(activity, analysis, "_analysis").join(first_per_user(activity, meaningful, "_meaningful"), "user_id")
    return people.join(both.select("user_id", F.greatest("_analysis", "_meaningful").alias("activated_at")), "user_id", "left")


def retention(activated: DataFrame, activity: DataFrame, kinds: list[str], start: int) -> DataFrame:
    """(user_id, eligible, retained): an event in the day from ``start`` hours after activation, its end left out. Only
    those whose day is over by the as-of time are eligible."""
    begin, end = F.col("activated_at") + hours(start), F.col("activated_at") + hours(start + 24)
    eligible = activated.where(F.col("activated_at").isNotNull()).select(
        "user_id", "as_of", begin.alias("_from"), end.alias("_to"), (end <= F.col("as_of")).alias("eligible"))
    events = activity.where(F.col("event_type").isin(kinds)).select("user_id", "ts")
    back = events.join(eligible.select("user_id", "_from", "_to"), "user_id").where(
        (F.col("ts") >= F.col("_from")) & (F.col("ts") < F.col("_to"))).select("user_id").distinct().withColumn("_back", F.lit(True))
    return eligible.join(back, "user_id", "left").select(
        "user_id", "eligible", (F.col("eligible") & F.coalesce("_back", F.lit(False))).alias("retained"))


def ordered_pairs(starts: DataFrame, finishes: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, started, completed): completed if anything finishes at or after the pair's first start."""
    first = starts.groupBy(*keys).agg(F.min("ts").alias("started_at"))
    last = finishes.groupBy(*keys).agg(F.max("ts").alias("finished_at"))
    return first.join(last, keys, "left").select(*keys, F.coalesce(F.col("finished_at") >= F.col("started_at"), F.lit(False)).alias("completed"))


def rating_summary(ratings: DataFrame, column: str = "rating") -> DataFrame:
    counts = [F.count_if(F.col(column) == k).alias(f"rated_{k}") for k in range(1, 6)]
    return ratings.agg(F.count(column).alias("n"), nearest_rank(column, 0.5).alias("median"), *counts)


def elapsed(column: str, start: str) -> Column:
    return millis(column) - millis(start)
