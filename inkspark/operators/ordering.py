"""Ordered work that no single task may hold: folds over sorted groups, and ranks over a whole column."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkspark.sources.tables import checkpointed, partitions


def folded(rows: DataFrame, keys: list[str], order: list[str], value: str, out: str, start: Callable, step: Callable) -> DataFrame:
    """``rows`` with a boolean ``out``: ``step(state, value)`` gives (state, out) for a key's rows in order.

    Rows stream through a task in order of key, so that a key of any size needs the memory of its state alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, None
        for batch in batches:
            found = []
            for key, x in zip(zip(*(batch.column(k).to_pylist() for k in keys)), batch.column(value).to_pylist()):
                if key != last:
                    last, state = key, start()
                state, y = step(state, x)
                found.append(y)
            yield batch.append_column(out, pa.array(found, pa.bool_()))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, f"{fields}, `{out}` boolean")


def admitted(requests: DataFrame, keys: list[str], order: list[str], cost: str, limit: float, out: str = "within_limit") -> DataFrame:
    """``requests`` with whether each is admitted: it costs nothing, or fits with all that were admitted before. A refused
    request leaves the budget as it was."""

    def step(used, x):
        ok = x is not None and (x <= 0 or used + x <= limit)
        return (used + x if ok and x > 0 else used), ok

    return folded(requests, keys, order, cost, out, lambda: 0.0, step)


def nearest_ranks(rows: DataFrame, columns: list[str], shares: list[float]) -> DataFrame:
    """One row with ``<column>_p<percent>``: the value at rank ceil(share * n) of each column's values, null for none.

    Values are counted first and sorted over ranges; a range's rows are numbered from the sums of those before.
    """
    named = F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).cast("long").alias("v")) for c in columns))).alias("x")
    counts = rows.select(named).select("x.*").where("v is not null").groupBy("name", "v").agg(F.count("*").alias("n"))
    spark = rows.sparkSession
    ranged = checkpointed(counts.repartitionByRange(partitions(spark), "name", "v").withColumn("part", F.spark_partition_id()))
    sums = ranged.groupBy("name", "part").agg(F.sum("n").alias("own"))
    before = F.coalesce(F.sum("own").over(Window.partitionBy("name").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select("name", "part", before.alias("before"), F.sum("own").over(Window.partitionBy("name")).alias("total"))
    inside = F.sum("n").over(Window.partitionBy("name", "part").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    placed = ranged.withColumn("upto", inside).join(sums, ["name", "part"]).withColumn("upto", F.col("upto") + F.col("before"))

    def at(column: str, share: float):
        rank = F.greatest(F.lit(1), F.ceil(F.lit(share) * F.col("total")))
        hit = (F.col("name") == column) & (F.col("upto") >= rank) & (F.col("upto") - F.col("n") < rank)
        return F.max(F.when(hit, F.col("v"))).alias(f"{column}_p{round(100 * share)}")

    return placed.agg(*(at(c, p) for c in columns for p in shares))
