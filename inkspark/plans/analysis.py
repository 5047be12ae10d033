"""Hierarchical analysis of a book with an analyser that is passed in: chunks, sections, chapters, the book."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkspark.plans.reduction import head, reduce_texts
from inkspark.plans.structure import coverage

Analyser = Callable[[list[str]], str]


def answered(inputs: DataFrame, analyse: Analyser, limit: int) -> DataFrame:
    """(doc_id, unit, inputs, summary): each unit's inputs (doc_id, unit, place, summary) in order of place, reduced."""
    gathered = inputs.groupBy("doc_id", "unit").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "summary"))), lambda x: x["summary"]).alias("s"))

    def run(batches):
        for batch in batches:
            lists = batch.column("s").to_pylist()
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("unit"), pa.array(list(map(len, lists)), pa.int32()), pa.array([reduce_texts(x, limit, analyse)[0] for x in lists], pa.string())],
                ["doc_id", "unit", "inputs", "summary"])

    kind = inputs.schema["doc_id"].dataType.simpleString()
    return gathered.mapInArrow(run, f"doc_id {kind}, unit int, inputs int, summary string")


def analysed(chunks: DataFrame, nodes: DataFrame, analyse: Analyser = head, limit: int = 8000) -> DataFrame:
    """(doc_id, scope, unit, inputs, summary) from chunks (doc_id, ordinal, content, first, last) and nodes of ``tree``.

    Every chunk has an answer of its own. A section's is made of its chunks' answers, a chapter's of its sections' and of
    its chunks' that lie in no section, the book's of its chapters' and of all that lies in none. A part belongs to the
    narrowest unit that holds its blocks, so each answer goes into exactly one above it.
    """
    each = chunks.select("doc_id", F.col("ordinal").alias("unit"), F.lit(0).alias("place"), F.col("content").alias("summary"))
    done = answered(each, analyse, limit).withColumn("scope", F.lit("CHUNK"))
    found, open_ = done, done.join(chunks.select("doc_id", F.col("ordinal").alias("unit"), "first", "last"), ["doc_id", "unit"]).select(
        "doc_id", "first", "last", "summary", F.concat(F.lit("CHUNK:"), F.col("unit").cast("string")).alias("id"))
    for scope in ("SECTION", "CHAPTER"):
        units = nodes.where(F.col("kind") == scope).select("doc_id", F.col("node").alias("id"), F.col("first").alias("a"), F.col("last").alias("b"))
        placed = coverage(units, open_.select("doc_id", "id", F.col("first").alias("a"), F.col("last").alias("b")))
        held = open_.join(placed, ["doc_id", "id"])
        inputs = held.where("parent is not null").select("doc_id", F.col("parent").alias("unit"), F.struct("first", "id").alias("place"), "summary")
        done = answered(inputs, analyse, limit).withColumn("scope", F.lit(scope))
        found = found.unionByName(done)
        made = done.join(units.withColumnRenamed("id", "unit"), ["doc_id", "unit"]).select(
            "doc_id", F.col("a").alias("first"), F.col("b").alias("last"), "summary", F.concat(F.lit(f"{scope}:"), F.col("unit").cast("string")).alias("id"))
        open_ = held.where("parent is null").drop("parent").unionByName(made)
    book = open_.select("doc_id", F.lit(0).alias("unit"), F.struct("first", "id").alias("place"), "summary")
    return found.unionByName(answered(book, analyse, limit).withColumn("scope", F.lit("BOOK"))).select("doc_id", "scope", "unit", "inputs", "summary")


def incomplete(answers: DataFrame, chunks: DataFrame) -> DataFrame:
    """(doc_id, code): books with a chunk that has no answer, without one of their own, or with answers that are lost or
    used twice on the way up (a book's answers, but its own, are each an input once)."""
    counts = answers.groupBy("doc_id").agg(
        F.count_if(F.col("scope") == "CHUNK").alias("chunks"), F.count_if(F.col("scope") == "BOOK").alias("books"), F.count_if(F.col("scope") != "BOOK").alias("made"),
        F.sum(F.when(F.col("scope") != "CHUNK", F.col("inputs")).otherwise(0)).alias("used"))
    all_ = chunks.groupBy("doc_id").agg(F.count("*").alias("n")).join(counts, "doc_id", "left")
    code = F.when(F.coalesce("chunks", F.lit(0)) != F.col("n"), "CHUNK_ANALYSIS_INCOMPLETE").when(F.col("books") != 1, "BOOK_ANALYSIS_INCOMPLETE").when(F.col("made") != F.col("used"), "COVERAGE")
    return all_.select("doc_id", code.alias("code")).where("code is not null")
