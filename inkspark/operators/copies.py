"""Texts that repeat passages of sources: shares of shingles, and whole containment at any offset."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkspark.functions.text import units
from inkspark.sources.tables import checkpointed, parts, shared_folder

#: UTF-16 units of a shingle, between shingles, and of a text that is looked for whole.
SHINGLE, STEP, WHOLE = 60, 20, 120
BASE, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
#: Units of a source that are hashed at a time; runs overlap, so that no window is lost between them.
RUN = 100_000
#: Texts whose probes may be broadcast (16 bytes each); beyond that both sides are shuffled.
FEW = 1_000_000


def plain(text: Column) -> Column:
    """Letters and digits alone, in lower case."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", "")


def hashes(points: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the ``SHINGLE`` units from each place, from hashes of runs of doubled length."""
    n = len(points) - SHINGLE + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    width, power, run = 1, int(BASE), points.astype(np.uint64) + np.uint64(1)
    out, done = None, 0
    while True:
        if SHINGLE & width:
            out = run[:n] if out is None else out * np.uint64(power) + run[done : done + n]
            done += width
        if done == SHINGLE:
            break
        run, width, power = run[:-width] * np.uint64(power) + run[width:], 2 * width, power * power % 2**64
    out = (out ^ (out >> np.uint64(31))) * MIX
    return out ^ (out >> np.uint64(29))


def probe(h: np.ndarray) -> np.ndarray:
    """The least hash of each window of ``WHOLE`` units, once each. They depend on the window alone, so a text that holds another
    has all its probes. Least values of windows come from running minima within blocks of a window's width, from both sides."""
    width = WHOLE - SHINGLE + 1
    many = len(h) - width + 1
    if many <= 0:
        return h[:0]
    blocks = np.pad(h, (0, -len(h) % width), constant_values=np.iinfo(np.uint64).max).reshape(-1, width)
    ahead, back = np.minimum.accumulate(blocks, axis=1).ravel(), np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.unique(np.minimum(back[:many], ahead[width - 1 : width - 1 + many]))


def marks(text: str, kinds: tuple[str, ...] = ("shingle", "probe")):
    """(whether they are probes, hashes) of each run of a text."""
    wide = np.frombuffer(text.encode("utf-16-le"), np.uint16)
    for low in range(0, max(1, len(wide) - SHINGLE + 1), RUN):
        h = hashes(wide[low : low + RUN + WHOLE - 1])
        if "shingle" in kinds:
            yield False, h[:RUN][(-low) % STEP :: STEP].copy()  # a view would keep all of ``h``
        if "probe" in kinds:
            yield True, probe(h)


def fingerprints(texts: DataFrame, key: str, kind: str) -> DataFrame:
    """(key, hash, many): hashes of the shingles of ``plain`` or of its probes, as ``kind`` says, and how many rows a text has."""

    def run(batches):
        for batch in parts(batches, "plain"):
            found = [[h for _, h in marks(text or "", (kind,))] for text in batch.column("plain").to_pylist()]
            sizes = np.array([sum(map(len, own)) for own in found], np.int64)
            rows, both = np.repeat(np.arange(len(sizes)), sizes), np.concatenate([h for own in found for h in own] or [np.empty(0, np.uint64)]).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(rows)), pa.array(both), pa.array(sizes[rows].astype(np.int32))], [key, "hash", "many"])

    return texts.select(key, "plain").mapInArrow(run, f"`{key}` {texts.schema[key].dataType.simpleString()}, hash long, many int")


def overlap(texts: DataFrame, keys: list[str], sources: DataFrame) -> DataFrame:
    """(keys, risk): the share of a text's shingles that begin ``STEP`` apart which the sources hold among theirs, and 1 if a text of
    ``WHOLE`` units or more lies in a source whole, at any offset; 0 for texts below a shingle.

    ``texts`` has (keys, plain), ``sources`` (source_id, plain); both are read more than once. Shares go by 64-bit hashes. A text lies
    in those sources only that have all its probes, a thirtieth of its places; it meets those that have the one fewest sources
    have, and is compared with them in full, with one of them first. Equal texts, and equal sources, are one. Of shingles and
    probes only those that a source holds move a second time.
    """
    named, there = texts.withColumn("own", F.xxhash64("plain", F.length("plain"))), sources.select(F.xxhash64("plain", F.length("plain")).alias("source"), "plain")
    pool = fingerprints(there, "source", "shingle").select(F.col("hash").alias("held")).distinct()
    # Rows carry two numbers. Equal texts are counted together, as often as there are any.
    held = fingerprints(named, "own", "shingle").select("own", "hash").join(pool, F.col("hash") == F.col("held")).groupBy("own").agg(F.count("*").alias("held"))
    whole_units = units(F.col("plain"))
    every = named.where(whole_units >= SHINGLE).select("own", F.ceil((whole_units - SHINGLE + 1) / STEP).alias("n")).groupBy("own").agg(F.sum("n").alias("n"))
    shared = held.join(every, "own").select("own", (F.col("held") / F.col("n")).alias("share"))
    index = fingerprints(there, "source", "probe").select("source", "hash")
    common = index.groupBy("hash").agg(F.count("*").alias("n"))
    # A text that lies in a source has no probe that none has.
    rarest = fingerprints(named, "own", "probe").join(common, "hash").groupBy("own").agg(F.min(F.struct("n", "hash")).alias("x"), F.count("*").alias("met"), F.min("many").alias("many"))
    rarest = checkpointed(rarest.where("met >= many").select("own", F.col("x.hash").alias("hash")))
    # One row a text that may lie in a source; the sources' own probes, many more, then needn't move.
    asked = F.broadcast(rarest) if rarest.count() <= FEW else rarest
    met = checkpointed(index.join(asked, "hash").select("own", "source").distinct())

    few = met.count() <= FEW
    chosen = lambda df: F.broadcast(df) if few else df

    def inside(pairs: DataFrame) -> DataFrame:
        """Those of the texts in ``pairs`` (own, source) that lie in their source. Of texts and sources only those of the pairs move."""
        one = named.select("own", F.col("plain").alias("text")).join(chosen(pairs.select("own").distinct()), "own", "left_semi").dropDuplicates(["own"])
        two = there.select("source", F.col("plain").alias("whole")).join(chosen(pairs.select("source").distinct()), "source", "left_semi").dropDuplicates(["source"])
        return pairs.join(one, "own").join(two, "source").where((units(F.col("text")) >= WHOLE) & F.contains("whole", "text")).select("own").distinct()

    first = checkpointed(inside(met.groupBy("own").agg(F.min("source").alias("source"))))
    rest = met.join(first, "own", "left_anti")
    whole = first.union(inside(rest)).withColumn("whole", F.lit(1.0))
    risks = shared.join(whole, "own", "full").select("own", F.coalesce("whole", "share").alias("found"))
    return named.select(*keys, "own").join(risks, "own", "left").select(*keys, F.coalesce("found", F.lit(0.0)).alias("risk"))


def script_risk(turns: DataFrame, sources: DataFrame) -> DataFrame:
    """(script, utterance_risk, segment_risk, script_risk, copy_risk): the greatest ``overlap`` of a turn, of a segment's turns in a row,
    and that of the whole script, and the greatest of the three. ``turns`` has (script, turn, segment, text)."""
    spark = turns.sparkSession
    # One exchange: a script's turns, and so its segments, meet where it lies. It is written once; each look makes its texts anew.
    own = turns.select("script", "turn", F.coalesce("segment", F.lit(0)).cast("long").alias("segment"), plain(F.col("text")).alias("plain")).repartition("script")
    spoken = own.groupBy("script", "segment").agg(F.array_sort(F.collect_list(F.struct("turn", "plain"))).alias("turns"))
    folder = shared_folder(spark)
    spoken.groupBy("script").agg(F.collect_list("turns").alias("segments")).write.parquet(folder)
    one = F.size("segments") == 1
    text = lambda utterance, segment, script, plain: F.struct(utterance.alias("utterance"), segment.alias("segment"), script.alias("whole"), plain.alias("plain"))
    joined = lambda turns: F.array_join(F.transform(turns, lambda x: x["plain"]), "")
    yes, no = F.lit(True), F.lit(False)
    # A text that is two levels at once, as of a segment of one turn, is one.
    lines = F.flatten(F.transform("segments", lambda s: F.transform(s, lambda x: text(yes, F.size(s) == 1, one & (F.size(s) == 1), x["plain"]))))
    segments = F.transform(F.filter("segments", lambda s: F.size(s) > 1), lambda s: text(no, yes, one, joined(s)))
    whole = F.filter(F.array(text(no, no, yes, joined(F.array_sort(F.flatten("segments"))))), lambda _: ~one)
    levels = spark.read.parquet(folder).select("script", F.inline(F.concat(lines, segments, whole)))
    source_rows = sources.select("source_id", plain(F.col("text")).alias("plain"))
    found = overlap(levels, ["script", "utterance", "segment", "whole"], source_rows)
    of = lambda level, name: F.max(F.when(F.col(level), F.col("risk"))).alias(name)
    return found.groupBy("script").agg(of("utterance", "utterance_risk"), of("segment", "segment_risk"), of("whole", "script_risk"), F.max("risk").alias("copy_risk"))
