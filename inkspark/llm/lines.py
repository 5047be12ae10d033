"""Line dedup over levelled sorted runs of line hashes (DataFrame operations only).

Runs are bucketed, sorted tables of (h1, h2, n_docs, holder): a line key's 128-bit hash, the documents that hold it and
the largest id among them. Batches of documents come in descending ranges of doc_id. Each batch aggregates its own
keys in one exchange, merge-anti-joins every run (co-bucketed, so no exchange), and adds what no run holds as a new run
of level 0; keys that a run holds already go to a log of repeats. When a level has ``fanout`` runs they are merged into
one of the next level. A holder never changes, since earlier batches have larger ids.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkspark.llm.common import WHITE, ascii_lower, cut, partitions, work_dir

HASH = ["h1", "h2"]


def line_keys(docs: DataFrame, min_chars: int, *more: str) -> DataFrame:
    """(doc_id, *more, pos, h1, h2): one row per line whose key has ``min_chars`` code points or more."""
    lines = docs.select("doc_id", *more, F.posexplode(F.split(F.col("text"), "\n")).alias("pos", "line"))
    keyed = lines.where(F.length("line") >= min_chars).select(
        "doc_id", *more, "pos", ascii_lower(F.btrim("line", F.lit(WHITE))).alias("key"))
    return keyed.where(F.length("key") >= min_chars).select(
        "doc_id", *more, "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))


class Runs:
    """The levelled store. ``levels[i]`` lists the names of level i's tables."""

    def __init__(self, spark, fanout: int):
        self.spark, self.fanout, self.buckets = spark, fanout, partitions(spark)
        self.levels: list[list[str]] = [[]]
        self.folder, self.names = work_dir(spark), []

    def write(self, df: DataFrame) -> str:
        name = f"run_{uuid.uuid4().hex}"
        df.write.bucketBy(self.buckets, *HASH).sortBy(*HASH).option("path", f"{self.folder}/{name}").saveAsTable(name)
        self.names.append(name)
        return name

    def tables(self) -> list[DataFrame]:
        return [self.spark.table(x) for level in self.levels for x in level]

    def add(self, keys: DataFrame) -> DataFrame | None:
        """Adds the keys that no run holds; returns those that one holds already."""
        batch = self.spark.table(self.write(keys))
        held = self.tables()
        fresh = reduce(lambda left, run: left.join(run, HASH, "left_anti"), held, batch)
        repeats = [batch.join(run.select(*HASH, F.col("holder").alias("first")), HASH).select(
            *HASH, "n_docs", F.col("first").alias("holder")) for run in held]
        self.levels[0].append(self.write(fresh) if held else self.names[-1])
        self.compact()
        return reduce(DataFrame.unionByName, repeats) if repeats else None

    def compact(self) -> None:
        """Merges full levels. Runs share no key, so a full outer merge join only interleaves them."""
        for i, level in enumerate(self.levels):
            if len(level) < self.fanout:
                continue
            def merge(a: DataFrame, b: DataFrame) -> DataFrame:
                a, b = a.alias("a"), b.alias("b")
                on = (F.col("a.h1") == F.col("b.h1")) & (F.col("a.h2") == F.col("b.h2"))
                return a.join(b, on, "full_outer").select(
                    *(F.coalesce(f"a.{c}", f"b.{c}").alias(c) for c in [*HASH, "n_docs", "holder"]))
            merged = self.write(reduce(merge, [self.spark.table(x) for x in level]))
            if i + 1 == len(self.levels):
                self.levels.append([])
            self.levels[i + 1].append(merged)
            self.levels[i] = []

    def close(self) -> None:
        for name in self.names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")


def dedup_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, batches: int = 4, fanout: int = 2) -> DataFrame:
    """All columns of ``docs`` (doc_id, text and any more) with ``kept_text``, ``n_lines`` and ``n_dropped``.

    A line's key is the line without white space at its ends, A-Z lower-cased. Keys of ``min_chars`` code points or
    more that ``min_docs`` documents or more hold lose all their lines, except in the largest doc_id that holds them.
    Null or empty text is one empty line and becomes an empty text. Rows with a null doc_id pass through untouched and
    aren't counted. A doc_id that repeats counts as a document for each row with another text. Extra columns are
    carried along; ones named like an output are replaced. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    outputs = ["kept_text", "n_lines", "n_dropped", "_drop", "_thash"]
    docs = docs.drop(*outputs).withColumn("_thash", F.xxhash64("text"))
    known = docs.where("doc_id is not null and text is not null").select("doc_id", "text", "_thash")
    cuts = known.select(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)], 1000).alias("q")).first()["q"] if batches > 1 else []
    edges = [None, *sorted(set(cuts or [])), None]
    runs, repeats = Runs(spark, fanout), []
    try:
        for low, high in reversed(list(zip(edges, edges[1:]))):
            batch = known
            if low is not None:
                batch = batch.where(F.col("doc_id") > low)
            if high is not None:
                batch = batch.where(F.col("doc_id") <= high)
            keys = line_keys(batch, min_chars, "_thash").groupBy(*HASH).agg(
                F.count_distinct("doc_id", "_thash").alias("n_docs"), F.max("doc_id").alias("holder"))
            again = runs.add(keys)
            if again is not None:
                repeats.append(cut(again))
        firsts = reduce(DataFrame.unionByName, [*runs.tables(), *repeats])
        common = cut(
            firsts.groupBy(*HASH).agg(F.sum("n_docs").alias("n_docs"), F.max("holder").alias("holder"))
            .where(F.col("n_docs") >= min_docs).select(*HASH, "holder"))
    finally:
        runs.close()
    drops = (
        line_keys(known, min_chars, "_thash").join(common, HASH).where("doc_id <> holder")
        .groupBy("doc_id", "_thash").agg(F.array_sort(F.collect_set("pos")).alias("_drop")))
    joined = docs.join(drops, ["doc_id", "_thash"], "left")
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    kept = F.transform(
        F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("_drop")), lambda i: F.get(lines, i))
    return joined.select(
        *(c for c in docs.columns if c != "_thash"),
        F.when(F.col("_drop").isNull(), F.coalesce("text", F.lit(""))).otherwise(F.array_join(kept, "\n")).alias("kept_text"),
        F.size(lines).cast("long").alias("n_lines"), F.when(F.col("_drop").isNull(), 0).otherwise(F.size("_drop")).cast("long").alias("n_dropped"))


def op4_line_dedup(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))
