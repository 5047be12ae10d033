"""Relational building blocks: latest rows, ranges, islands, keyset pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by ``order``. Tasks rank their own rows before the exchange."""
    by = Window.partitionBy(*keys).orderBy(*(F.desc(c) for c in order))
    return df.withColumn("_k", F.row_number().over(by)).where("_k = 1").drop("_k")


def line_nodes(lines: DataFrame) -> DataFrame:
    """(k, node, a, b): each line as a node over the lines from its own on."""
    return lines.select(
        F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("node"), F.col("l_linenumber").alias("a"),
        (F.col("l_linenumber") + (F.col("l_quantity") % 4).cast("int")).alias("b"))


def contained(ranges: DataFrame, items: DataFrame, keys: list[str], ends: list[str], place: str) -> DataFrame:
    """Ranges with the items of the same key within both ends; keys = [key of ranges, key of items]."""
    inside = F.col(place).between(F.col(ends[0]), F.col(ends[1]))
    return ranges.join(items, (F.col(keys[0]) == F.col(keys[1])) & inside)


def islands(spans: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Spans of a key that touch or overlap as one, with their number ``n``."""
    order = Window.partitionBy(*keys).orderBy(start, end)
    seen = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.withColumn("_new", F.when(seen.isNull() | (F.col(start) > seen), 1).otherwise(0))
    numbered = marked.withColumn("_island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "_island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n")).drop("_island")


def search(df: DataFrame, needle: str, columns: list[str]) -> DataFrame:
    """Rows with ``needle`` in any of the columns, case aside; nothing in it is a wildcard."""
    found = F.lit(False)
    for c in columns:
        found = found | F.contains(F.lower(F.col(c)), F.lit(needle.lower()))
    return df.where(found)


def bound(values: list[str]) -> Column:
    """A cursor from SQL literals."""
    return F.struct(*(F.expr(v) for v in values))


def keyset_page(df: DataFrame, order: list[str], before: list[str], size: int) -> DataFrame:
    """The page of ``size`` rows (1 to 50) after a cursor in descending order, with has_next: one row more is looked at."""
    size = max(1, min(50, size))
    key = F.struct(*order)
    rows = df.where(key < bound(before)).orderBy(*(F.desc(c) for c in order)).limit(size + 1)
    place = F.row_number().over(Window.orderBy(*(F.desc(c) for c in order)))  # over size + 1 rows
    seen = rows.withColumn("_k", place).withColumn("has_next", F.count("*").over(Window.partitionBy()) > size)
    return seen.where(F.col("_k") <= size).drop("_k")


def from_either_end(edges: DataFrame, items: DataFrame, about: str) -> DataFrame:
    """(own, other, <about>, other_<about>): relations (from_id, to_id) as each of their ends sees them; a loop counts once."""
    end = F.explode(F.when(F.col("from_id") == F.col("to_id"), F.array("from_id")).otherwise(F.array("from_id", "to_id"))).alias("own")
    seen = edges.select("from_id", "to_id", end).select("own", F.when(F.col("own") == F.col("from_id"), F.col("to_id")).otherwise(F.col("from_id")).alias("other"))
    named = seen.join(items.select(F.col("id").alias("own"), about), "own")
    return named.join(items.select(F.col("id").alias("other"), F.col(about).alias(f"other_{about}")), "other")
