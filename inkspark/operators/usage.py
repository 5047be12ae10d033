"""Provider usage: prices in integer micro-units, quality labels, run timings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkspark.operators.metrics import rate
from inkspark.operators.ordering import nearest_ranks
from inkspark.sources.tables import millis

MILLION = 1_000_000


def line(amount: Column, price: Column) -> Column:
    """floor(amount * price / 1,000,000), exact in decimals."""
    product = amount.cast("decimal(20,0)") * price.cast("decimal(18,0)")
    return F.floor(product / F.lit(MILLION).cast("decimal(7,0)")).cast("decimal(38,0)")


def costed(usage: DataFrame, prices: DataFrame, keys: list[str]) -> DataFrame:
    """``usage`` with quality and cost (null unless ACTUAL): missing and invalid usage never counts as zero."""
    known = prices.withColumn("_listed", F.lit(True))
    joined = usage.join(F.broadcast(known) if small(prices) else known, keys, "left")
    meters = ["input_tokens", "cached_tokens", "output_tokens"]
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    none = reduce(lambda a, b: a & b, [F.col(x).isNull() for x in meters])
    invalid = reduce(lambda a, b: a | b, [zero(x) < 0 for x in meters]) | (zero("cached_tokens") > zero("input_tokens"))
    lines = [(zero("input_tokens") - zero("cached_tokens"), F.col("input_rate")), (zero("cached_tokens"), F.col("cached_rate")), (zero("output_tokens"), F.col("output_rate"))]
    unpriced = reduce(lambda a, b: a | b, [(amount > 0) & price.isNull() for amount, price in lines])
    quality = (
        F.when(F.col("_listed").isNull(), "UNPRICED").when(none, "MISSING_USAGE").when(invalid, "INVALID_METERING")
        .when(unpriced, "UNPRICED").otherwise("ACTUAL"))
    total = reduce(lambda a, b: a + b, [F.when(amount > 0, line(amount, price)).otherwise(F.lit(0)) for amount, price in lines])
    return joined.withColumn("quality", quality).withColumn("cost", F.when(F.col("quality") == "ACTUAL", total).cast("long")).drop("_listed")


def small(df: DataFrame, most: int = 50_000) -> bool:
    """Whether a table may be broadcast: it has at most ``most`` rows."""
    return df.limit(most + 1).count() <= most


def summary(costs: DataFrame) -> DataFrame:
    """One row: invocations, attempts, retries, tokens, latency, cost and its coverage."""
    first = costs.groupBy("invocation_id").agg(F.count("*").alias("n"))
    retried = first.agg(F.count("*").alias("invocations"), F.count_if(F.col("n") > 1).alias("retried"))
    total = costs.agg(
        F.count("*").alias("attempts"), F.count_if(F.col("status") == "SUCCEEDED").alias("succeeded"),
        F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"),
        F.sum("cost").alias("cost"), F.count("cost").alias("priced"))
    waits = nearest_ranks(costs.select(F.col("latency_ms").alias("latency")), ["latency"], [0.5, 0.95])
    return total.join(retried).join(waits).select(  # single rows
        "invocations", "attempts", "succeeded", rate(F.col("retried"), F.col("invocations"), 0.0).alias("retry_rate"), "input_tokens", "output_tokens",
        "latency_p50", "latency_p95", "cost", rate(F.col("priced"), F.col("attempts"), 0.0).alias("coverage"))


def timing(runs: DataFrame) -> DataFrame:
    """Nearest-rank p50 and p95 of waits, over runs (created_at, started_at?, completed_at?); none is below 0."""
    wait = lambda a, b: F.greatest(F.lit(0), millis(b) - millis(a))
    times = runs.select(
        wait("created_at", "started_at").alias("queue"), wait("started_at", "completed_at").alias("run"), wait("created_at", "completed_at").alias("total"),
        F.col("completed_at").isNull().alias("open"))
    # greatest() skips nulls; a wait without its end is unknown, not 0.
    times = times.select(*(F.when(~F.col("open") | F.lit(c == "queue"), F.col(c)).alias(c) for c in ("queue", "run", "total")), "open")
    counts = times.agg(F.count("*").alias("runs"), F.count_if("open").alias("incomplete"))
    return counts.join(nearest_ranks(times, ["queue", "run", "total"], [0.5, 0.95]))  # single rows
