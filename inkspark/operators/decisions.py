"""Decision tables as columns: the first condition that holds decides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Days to the next review by mastery, for 0 to 5 and more reviews so far.
REVIEW_DAYS = {
    "UNASSESSED": [1, 2, 4, 7, 14, 30], "NEEDS_REVIEW": [1, 1, 2, 3, 5, 7], "DEVELOPING": [3, 5, 7, 14, 21, 30], "DEMONSTRATED": [7, 14, 30, 60, 90, 120]}
OVERDUE = {"NEEDS_REVIEW": 0, "DEVELOPING": 1, "UNASSESSED": 2, "DEMONSTRATED": 3}


def first_of(*cases: tuple[Column, str], otherwise: str | None = None) -> Column:
    out = F.when(*cases[0])
    for condition, value in cases[1:]:
        out = out.when(condition, value)
    return out.otherwise(F.lit(otherwise))


def review_days(mastery: Column, reviews: Column) -> Column:
    table = F.create_map(*(x for k, days in REVIEW_DAYS.items() for x in (F.lit(k), F.array(*map(F.lit, days)))))
    return F.element_at(F.element_at(table, mastery), (F.least(reviews, F.lit(5)) + 1).cast("int"))


def due_bucket(mastery: Column, due: Column, now: Column) -> Column:
    ranks = F.create_map(*(x for k, v in OVERDUE.items() for x in (F.lit(k), F.lit(v))))
    return F.when(due <= now, F.element_at(ranks, mastery)).otherwise(F.lit(4))


def mastery(marks: Column) -> Column:
    """Of an array of MET, PARTIAL and NOT_MET."""
    return first_of(
        (F.size(marks) == 0, "UNASSESSED"), (F.exists(marks, lambda m: m == "NOT_MET"), "NEEDS_REVIEW"),
        (F.forall(marks, lambda m: m == "MET"), "DEMONSTRATED"), otherwise="DEVELOPING")


def page_route(significant: Column, blocks: Column, images: Column, vectors: Column, notes: Column) -> Column:
    """Text needs characters and a block; any other content goes to OCR; an empty page stays native."""
    return first_of(((significant > 0) & (blocks > 0), "TEXT"), ((images > 0) | (vectors > 0) | (notes > 0), "OCR"), otherwise="EMPTY")


def extraction_quality(pages: DataFrame) -> DataFrame:
    """(doc_id, decision) from pages (doc_id, route, usable): usable blocks of each page, unresolved where a page that
    isn't empty has none."""
    return pages.groupBy("doc_id").agg(
        F.count_if(F.col("usable") > 0).alias("_ok"), F.count_if((F.col("route") != "EMPTY") & (F.col("usable") == 0)).alias("_open"),
        F.count_if(F.col("route") == "OCR").alias("_ocr")).select("doc_id", first_of(
            (F.col("_ok") == 0, "REJECTED"), (F.col("_open") > 0, "REQUIRES_FALLBACK"), (F.col("_ocr") > 0, "DEGRADED"), otherwise="ACCEPTED").alias("decision"))


def response_error(kind: Column, content: Column, allowed: list[str], most: int = 20_000) -> Column:
    return first_of((kind.isNull() | ~kind.isin(allowed), "TYPE"), (content.isNull() | (F.trim(content) == ""), "BLANK"), (F.length(content) > most, "LENGTH"))


def graph_error(nodes: Column, edges: Column) -> Column:
    """Of arrays of node ids and of (source, target) structs."""
    ends = F.exists(edges, lambda e: ~F.array_contains(nodes, e["source"]) | ~F.array_contains(nodes, e["target"]))
    return first_of(
        ((F.size(nodes) > 32) | (F.size(edges) > 48), "SIZE"), (F.size(F.array_distinct(nodes)) != F.size(nodes), "DUPLICATE"), (ends, "ENDPOINT"))


def byte_range(header: Column, size: Column) -> Column:
    """struct(first, last) of a single range; null if it can't be satisfied."""
    a = F.nullif(F.regexp_extract(header, r"^bytes=([0-9]*)-([0-9]*)$", 1), F.lit("")).try_cast("long")
    b = F.nullif(F.regexp_extract(header, r"^bytes=([0-9]*)-([0-9]*)$", 2), F.lit("")).try_cast("long")
    first = F.when(a.isNotNull(), a).otherwise(F.greatest(F.lit(0), size - b))
    last = F.when(a.isNotNull(), F.least(F.coalesce(b, size - 1), size - 1)).otherwise(size - 1)
    fine = (a.isNotNull() | (b > 0)) & (first < size) & (first <= last)
    return F.when(fine, F.struct(first.alias("first"), last.alias("last")))
