"""Quoted evidence set on the places of its quotes again."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkspark.sources.tables import checkpointed

#: Evidence of one block that a task looks for in one pass; more of it is dealt to further passes.
QUOTES = 4096
#: So few quotes are looked for one by one, more by an automaton over all of them.
FEW_QUOTES = 4
#: Blocks with more evidence than that which may be broadcast; beyond it they are joined.
FEW = 10_000


def first_places(text: str, quotes: set[str]) -> dict[str, int]:
    """The first place, in UTF-16 units, of each quote that ``text`` holds: one pass over the text for all of them."""
    if len(quotes) <= FEW_QUOTES:
        found = {quote: at for quote in quotes if (at := text.find(quote)) >= 0}
        return wide_places(text, found)
    import ahocorasick

    patterns = ahocorasick.Automaton()
    for quote in quotes:
        patterns.add_word(quote, quote)
    found: dict[str, int] = {}
    if quotes:
        patterns.make_automaton()
        for last, quote in patterns.iter(text):
            found.setdefault(quote, last + 1 - len(quote))
            if len(found) == len(quotes):
                break
    return wide_places(text, found)


def wide_places(text: str, found: dict[str, int]) -> dict[str, int]:
    """Places in UTF-16 units from those in code points."""
    if text.isascii() or not found:
        return found
    # A character beyond the basic plane counts as two units.
    wide = np.cumsum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32) > 0xFFFF)
    return {quote: at + (int(wide[at - 1]) if at else 0) for quote, at in found.items()}


def reanchored(evidence: DataFrame, blocks: DataFrame) -> DataFrame:
    """``evidence`` (evidence_id, block_id, first, last, quote, quote_hash) against ``blocks`` (block_id, content), with ``code``.

    A quote that its block holds sets first and last to its first place there, in UTF-16 units, and the hash to its own. One that
    it doesn't hold, or an empty one, goes with its hash, and the places stay. Code is LINEAGE where the block doesn't exist
    or has no content, RANGE where the places are null, negative, empty or beyond the block, else null. Repeated rows each
    give a row; blocks have one row an id. A block with very much evidence is searched by several tasks.
    """
    rows = evidence.select("evidence_id", "block_id", F.col("first").cast("long"), F.col("last").cast("long"), "quote", "quote_hash")
    # Only blocks with more evidence than a pass takes need passes; mostly there are none, so no row moves for them.
    hot = checkpointed(rows.groupBy("block_id").agg(F.ceil(F.count("*") / QUOTES).alias("passes")).where("passes > 1"))
    many = hot.count()
    hot = F.broadcast(hot) if many <= FEW else hot
    dealt = lambda df: (df.join(hot, "block_id", "left") if many else df.withColumn("passes", F.lit(None).cast("long"))).withColumn("passes", F.coalesce("passes", F.lit(1)))
    left = dealt(rows).withColumn("pass", F.pmod(F.xxhash64("evidence_id"), F.col("passes")))
    right = dealt(blocks.select("block_id", "content")).withColumn("pass", F.explode(F.sequence(F.lit(0).cast("long"), F.col("passes") - 1)))
    both = left.select("block_id", "pass", "evidence_id", "first", "last", "quote", "quote_hash", F.lit(None).cast("string").alias("content"), F.lit(True).alias("asks")).unionByName(
        right.select("block_id", "pass", "content", F.lit(False).alias("asks")), allowMissingColumns=True)

    names = ["evidence_id", "block_id", "first", "last", "quote", "quote_hash"]

    def anchored(text: str | None, rows: list[tuple]) -> list[tuple]:
        if text is None:
            return [(*row, "LINEAGE") for row in rows]
        found = first_places(text, {row[4] for row in rows if row[4]})
        units, out = len(text.encode("utf-16-le", "surrogatepass")) // 2, []
        for key, block, first, last, quote, digest in rows:
            if quote is not None and quote in found:
                first, digest = found[quote], hashlib.sha256(quote.encode("utf-8", "surrogatepass")).hexdigest()
                last = first + len(quote.encode("utf-16-le", "surrogatepass")) // 2
            elif quote is not None:
                quote = digest = None
            bad = first is None or last is None or first < 0 or last <= first or last > units
            out.append((key, block, first, last, quote, digest, "RANGE" if bad else None))
        return out

    def run(batches):
        """A block's content comes before its evidence, which is looked for so many at a time."""
        own, text, waiting, schema = None, None, [], None
        for batch in batches:
            schema = pa.schema([*(batch.schema.field(c) for c in names), pa.field("code", pa.string())])
            done = []
            for block, number, asks, content, *row in zip(*(batch.column(c).to_pylist() for c in ("block_id", "pass", "asks", "content", "evidence_id", "first", "last", "quote", "quote_hash"))):
                if (block, number) != own or len(waiting) >= QUOTES:
                    done += anchored(text, waiting)
                    waiting = []
                    own, text = (block, number), (text if (block, number) == own else None)
                if asks:
                    waiting.append((row[0], block, *row[1:]))
                else:
                    text = content
            yield record(done, schema)
        if waiting:
            yield record(anchored(text, waiting), schema)

    def record(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows) if rows else [[]] * 7, schema)], schema=schema)

    kind = lambda c: evidence.schema[c].dataType.simpleString()
    ordered = both.repartition("block_id", "pass").sortWithinPartitions("block_id", "pass", "asks")
    return ordered.mapInArrow(run, f"evidence_id {kind('evidence_id')}, block_id {kind('block_id')}, first long, last long, quote string, quote_hash string, code string")
