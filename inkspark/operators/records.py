"""Keyed state, revisions, and pages made of positioned runs of text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upserted(held: DataFrame, incoming: DataFrame, keys: list[str], order: list[str], kept: list[str]) -> DataFrame:
    """One row for each key: the last incoming one in ``order``, or what is held; ``kept`` columns stay as first set.

    Held rows come before all incoming ones.
    """
    rows = held.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)))
    at = F.struct("_new", *order)
    others = [c for c in held.columns if c not in keys]
    return rows.groupBy(*keys).agg(*((F.min_by if c in kept else F.max_by)(F.col(c), at).alias(c) for c in others)).select(*held.columns)


def archived(items: DataFrame, marks: DataFrame, key: str) -> DataFrame:
    """``items`` (with archived_at) after ``marks`` (key, at): an item that is archived keeps the time it was first."""
    first = marks.groupBy(key).agg(F.min("at").alias("_at"))
    return items.join(first, key, "left").withColumn("archived_at", F.coalesce("archived_at", "_at")).drop("_at").select(*items.columns)


def origins(revisions: DataFrame, most: int = 64) -> DataFrame:
    """(id, origin, edits, error): the revision that edits go back to, for revisions (id, parent, edited).

    An edit names its parent; what isn't an edit is an origin. Each round doubles the steps known from every revision, so
    that seven reach ``most`` edits. A chain with more of them, without an end, or with a parent that there isn't, is an
    error.
    """
    edit = F.col("edited")
    up = revisions.select("id", F.when(edit, F.col("parent")).otherwise(F.col("id")).alias("top"), edit.cast("int").alias("edits"))
    ends = revisions.select(F.col("id").alias("top"), (~edit).alias("whole"))
    for _ in range(max(1, (most - 1).bit_length())):
        above = up.select(F.col("id").alias("top"), F.col("top").alias("next"), F.col("edits").alias("more"))
        up = up.join(above, "top", "left").select("id", F.coalesce("next", "top").alias("top"), (F.col("edits") + F.coalesce("more", F.lit(0))).alias("edits"))
    found = up.join(ends, "top", "left")
    fine = F.coalesce("whole", F.lit(False)) & (F.col("edits") <= most)
    return found.select("id", F.when(fine, F.col("top")).alias("origin"), F.when(fine, F.col("edits")).alias("edits"), F.when(~fine, F.lit("PARENT_INVALID")).alias("error"))


def run_text(runs: DataFrame) -> DataFrame:
    """(page, text) of positioned runs (page, i, str, x, y, width, height, eol), in stream order.

    A run begins a line if its baseline moves by 0.4 of its height or more, and a word if it lies on the same line more
    than 0.15 of its height beyond the end of the one before; neither where the text has that break already.
    """
    order = Window.partitionBy("page").orderBy("i")
    height = F.greatest(F.lit(1.0), F.abs(F.coalesce("height", F.lit(12.0))))
    before_y, right = F.lag("y").over(order), F.lag(F.col("x") + F.coalesce("width", F.lit(0.0))).over(order)
    rank = F.row_number().over(order)
    # The last character of the text before a run: that of the last run with one, or the line feed behind it.
    ending = F.when(F.col("eol"), "\n").when(F.col("str") != "", F.right("str", F.lit(1)))
    tail = F.coalesce(F.last(ending, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(""))
    same = F.coalesce(F.abs(F.col("y") - before_y) < height * 0.4, F.lit(False))
    gap = F.coalesce(F.col("x") - right, F.lit(0.0))
    space = lambda c: c.rlike(r"^\s")
    breaks = (
        F.when((rank == 1) | (F.col("str") == ""), "").when(~same & F.col("y").isNotNull() & (tail != "\n"), "\n")
        .when(same & (gap > height * 0.15) & ~space(tail) & ~space(F.col("str")), " ").otherwise(""))
    has = F.when(F.col("str") != "", F.right("str", F.lit(1))).otherwise(tail)
    piece = F.concat(breaks, "str", F.when(F.col("eol") & (has != "\n"), "\n").otherwise(""))
    pieces = runs.where("str is not null").select("page", "i", piece.alias("piece"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "piece"))), lambda x: x["piece"]), "")
    return pieces.groupBy("page").agg(F.regexp_replace(joined, r"\s+$", "").alias("text"))


def native_pages(pages: DataFrame) -> DataFrame:
    """(doc, error, pages, text_pages, blocks) of extracted pages (doc, page, declared, text, evidence): every declared page
    must be there exactly once; only pages with evidence of text keep their paragraphs."""
    place = F.row_number().over(Window.partitionBy("doc").orderBy("page")) - 1
    has = F.col("evidence") == "TEXT"
    blocks = F.size(F.filter(F.split("text", r"\n\s*\n|\n"), lambda x: F.trim(x) != ""))
    marked = pages.select("doc", "declared", (place != F.col("page")).alias("off"), has.alias("has"), F.when(has, blocks).otherwise(0).alias("blocks"))
    sums = marked.groupBy("doc").agg(
        F.count("*").alias("n"), F.max("declared").alias("declared"), F.bool_or("off").alias("off"), F.count_if("has").alias("text_pages"), F.sum("blocks").alias("blocks"))
    bad = (F.col("n") != F.col("declared")) | F.col("off")
    return sums.select(
        "doc", F.when(bad, "PARSE").alias("error"), *(F.when(~bad, F.col(c)).cast("long").alias(name) for c, name in (("n", "pages"), ("text_pages", "text_pages"), ("blocks", "blocks"))))


def stable_score(value: Column) -> Column:
    """15 significant digits."""
    return F.format_string("%.14e", value).cast("double")
