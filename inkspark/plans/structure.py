"""Structure trees and chunks of documents that are made of ordered blocks."""

from __future__ import annotations

import hashlib
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkspark.functions.text import units
from inkspark.sources.tables import parts

LEVELS = range(1, 7)


def structure(blocks: DataFrame) -> DataFrame:
    """(doc_id, ordinal, level, parent, end) for each heading of blocks (doc_id, ordinal, level; level null for others).

    The parent is the last heading before with a smaller level (null: the root), the end the block before the next
    heading of this level or a smaller one. Both are windows over a document's headings, a column for each level.
    """
    last = blocks.groupBy("doc_id").agg(F.max("ordinal").alias("_last"))
    headings = blocks.where("level is not null")
    by = Window.partitionBy("doc_id").orderBy("ordinal")
    before, after = by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(1, Window.unboundedFollowing)
    at = lambda n: F.when(F.col("level") == n, F.col("ordinal"))
    wide = headings.select(
        "*", *(F.max(at(n)).over(before).alias(f"_b{n}") for n in LEVELS), *(F.min(at(n)).over(after).alias(f"_a{n}") for n in LEVELS))
    parent = F.greatest(*(F.when(F.lit(n) < F.col("level"), F.col(f"_b{n}")) for n in LEVELS))
    following = F.least(*(F.when(F.lit(n) <= F.col("level"), F.col(f"_a{n}")) for n in LEVELS))
    return wide.join(last, "doc_id").select("doc_id", "ordinal", "level", parent.alias("parent"), F.coalesce(following - 1, "_last").alias("end"))


def heading_level(text: Column, given: Column) -> Column:
    """A given level of 1 to 6, else the number of marks before a title, else 2."""
    marks = F.length(F.regexp_extract(text, r"^(#{1,6})\s+\S", 1))
    return F.when(given.between(1, 6), given).when(marks > 0, marks).otherwise(2).cast("int")


def tree(blocks: DataFrame) -> DataFrame:
    """(doc_id, node, kind, depth, title, first, last, parent) from blocks (doc_id, ordinal, text, kind, page, level).

    Node 0 is the root and holds all blocks. Headings are numbered in order; a document without any has one group
    instead, of pages if its blocks name pages. ``level`` is what metadata say of a heading, of any value or null.
    """
    whole = blocks.groupBy("doc_id").agg(
        F.min("ordinal").alias("first"), F.max("ordinal").alias("last"), F.bool_or(F.col("kind") == "HEADING").alias("headed"), F.count("page").alias("paged"))
    titled = F.when(F.col("text").rlike(r"^#{1,6}\s+\S"), F.regexp_extract("text", r"(?s)^#{1,6}\s+(.*?)\s*$", 1)).otherwise(F.regexp_replace("text", r"^\s+|\s+$", ""))
    level = F.when(F.col("kind") == "HEADING", heading_level(F.col("text"), F.col("level")))
    spans = structure(blocks.select("doc_id", "ordinal", level.alias("level")))
    titles = blocks.where("kind = 'HEADING'").select("doc_id", "ordinal", titled.alias("title"))
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("ordinal"))
    nodes = spans.join(titles, ["doc_id", "ordinal"]).withColumn("node", number)
    parents = nodes.select("doc_id", F.col("ordinal").alias("parent"), F.col("node").alias("above"))
    kind = F.when(F.col("level") == 1, "CHAPTER").when(F.col("level") == 2, "SECTION").otherwise("SUBSECTION")
    headings = nodes.join(parents, ["doc_id", "parent"], "left").select(
        "doc_id", "node", kind.alias("kind"), F.col("level").alias("depth"), "title", F.col("ordinal").alias("first"), F.col("end").alias("last"), F.coalesce("above", F.lit(0)).alias("parent"))
    none = lambda kind: F.lit(None).cast(kind)
    roots = whole.select("doc_id", F.lit(0).alias("node"), F.lit("ROOT").alias("kind"), F.lit(0).alias("depth"), none("string").alias("title"), "first", "last", none("int").alias("parent"))
    group = F.when(F.col("paged") > 0, "PAGE_GROUP").otherwise("STRUCTURAL_GROUP")
    groups = whole.where("not headed").select("doc_id", F.lit(1).alias("node"), group.alias("kind"), F.lit(1).alias("depth"), none("string").alias("title"), "first", "last", F.lit(0).alias("parent"))
    return roots.unionByName(headings).unionByName(groups)


def wide(text: str) -> str:
    """A character for each UTF-16 unit, so that lengths and places count units."""
    return text if not text or max(text) <= "\uffff" else "".join(map(chr, memoryview(text.encode("utf-16-le", "surrogatepass")).cast("H")))


def narrow(units: str) -> str:
    return units.encode("utf-16-le", "surrogatepass").decode("utf-16-le", "surrogatepass")


def soft_split(text: str, most: int) -> list[tuple[int, int]]:
    """Spans of at most ``most`` UTF-16 units; cuts fall after a paragraph, sentence or line that ends past 45 % of a span,
    and never inside a surrogate pair."""
    text, spans, at = wide(text), [], 0
    while len(text) - at > most:
        window = text[at : at + most]
        cut = 0
        for mark, keep in (("\n\n", 2), (". ", 2), ("。", 1), ("\n", 1)):
            place = window.rfind(mark)
            if place > 0.45 * most:
                cut = place + keep
                break
        cut = cut or most
        if cut > 1 and "\ud800" <= text[at + cut - 1] <= "\udbff" and "\udc00" <= text[at + cut] <= "\udfff":
            cut -= 1
        spans.append((at, at + cut))
        at += cut
    spans.append((at, len(text)))
    return spans


def packed(text: str, heading, target: int, most: int) -> list[tuple[str, int, int, int]]:
    """(content, first block, last block, UTF-16 units) of a document's chunks.

    Blocks longer than ``most`` are split. A chunk ends before a heading and where the next unit, with the blank line
    between, would pass the target; at ``most`` it ends at once.
    """
    chunks, content, first, last = [], [], 0, 0
    size = 0

    def flush():
        nonlocal content, size
        if content:
            chunks.append((narrow("\n\n".join(content)), first, last, size))
        content, size = [], 0

    for ordinal, block in enumerate(text.split("\n")):
        units = wide(block)
        for start, end in soft_split(block, most):
            unit = units[start:end]
            if content and (heading(block) or size + 2 + len(unit) > target):
                flush()
            if not content:
                first = ordinal
            size += len(unit) + (2 if content else 0)
            content.append(unit)
            last = ordinal
            if size >= most:
                flush()
    flush()
    return chunks


def chunked(documents: DataFrame, heading, target: int = 1200, most: int = 1600) -> DataFrame:
    """(doc_id, ordinal, content, content_hash, first_block, last_block, units): a document is packed where it lies, so
    nothing is shuffled. Lengths count UTF-16 units."""

    def run(batches):
        for batch in parts(batches, "text"):
            ids, rows = [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                own = packed(text or "", heading, target, most)
                ids += [i] * len(own)
                rows += [(k, c, hashlib.sha256(c.encode()).hexdigest(), a, b, n) for k, (c, a, b, n) in enumerate(own)]
            types = (pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32())
            columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(ids, pa.int64())), *columns], ["doc_id", "ordinal", "content", "content_hash", "first_block", "last_block", "units"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, ordinal int, content string, content_hash string, first_block int, last_block int, units int")


def provenance_errors(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """(doc_id, code, n): chunks whose hash or length is wrong, out of order, or that don't rebuild their document."""
    order = Window.partitionBy("doc_id").orderBy("ordinal")
    placed = chunks.withColumn("_place", F.row_number().over(order) - 1).withColumn("_before", F.lag("last_block", 1, 0).over(order))
    flags = {
        "HASH": F.sha2("content", 256) != F.col("content_hash"), "LENGTH": units(F.col("content")) != F.col("units"),
        "ORDINAL": F.col("ordinal") != F.col("_place"), "ORDER": F.col("first_block") < F.col("_before"),
    }
    codes = F.array_compact(F.array(*(F.when(bad, code) for code, bad in flags.items())))
    local = placed.select("doc_id", F.explode(codes).alias("code"))
    plain = lambda c: F.regexp_replace(c, "\n", "")
    whole = chunks.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ordinal", "content"))), lambda x: plain(x["content"])), "").alias("rebuilt"))
    lost = documents.join(whole, "doc_id", "left").where(~F.coalesce("rebuilt", F.lit("")).eqNullSafe(plain(F.coalesce("text", F.lit(""))))).select("doc_id", F.lit("TEXT").alias("code"))
    return local.union(lost).groupBy("doc_id", "code").agg(F.count("*").alias("n"))


def coverage(parents: DataFrame, children: DataFrame) -> DataFrame:
    """Children (doc_id, id, a, b) with the narrowest parent (doc_id, id, a, b) that holds their range, null if none."""
    p, c = parents.alias("p"), children.alias("c")
    inside = (F.col("p.doc_id") == F.col("c.doc_id")) & (F.col("p.a") <= F.col("c.a")) & (F.col("c.b") <= F.col("p.b"))
    held = c.join(p, inside, "left")
    return held.groupBy("c.doc_id", "c.id").agg(F.min_by("p.id", F.struct(F.col("p.b") - F.col("p.a"), "p.id")).alias("parent"))


def greedy(items: DataFrame, by: str, limit: int) -> DataFrame:
    """The items (by, id, score, cost) that fit: best score first, one that doesn't fit is skipped, not the end.

    A fold over each request's sorted items, which are few (a request's candidates).
    """
    ordered = F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "id", "cost")))
    start = F.struct(F.lit(limit).cast("long").alias("left"), F.array().cast("array<bigint>").alias("taken"))
    step = lambda a, x: F.when(x["cost"] <= a["left"], F.struct((a["left"] - x["cost"]).alias("left"), F.array_append(a["taken"], x["id"]).alias("taken"))).otherwise(a)
    folded = items.groupBy(by).agg(ordered.alias("items")).select(by, F.aggregate("items", start, step).alias("r"))
    return folded.select(by, F.posexplode("r.taken").alias("place", "id"))


def issues(*violations: tuple[str, DataFrame]) -> DataFrame:
    """(code, n) over frames of violations; none is a pass."""
    return reduce(DataFrame.unionByName, [df.agg(F.lit(code).alias("code"), F.count("*").alias("n")) for code, df in violations])
