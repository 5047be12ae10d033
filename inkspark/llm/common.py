"""Shared helpers: the shared work folder, lineage cuts, distributed ordering and connected components."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes of an Arrow batch on its way to a Python step.
BATCH_BYTES = 4 << 20
WHITE = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; a temporary one only on a single machine that names none (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    current = context._jsc.sc().getCheckpointDir()
    if named is None and current.isDefined():
        return current.get()
    if named is None and not context.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    named = named or tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    if not current.isDefined():
        context.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder, so that later steps neither recompute it nor depend on one executor."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def swept(spark: SparkSession) -> None:
    """What no step refers to any more leaves the driver, and with it its shuffle files.

    A job of many steps makes plans all the time, and they are collected only when the heap is full: its driver would take all
    the memory that it may have, and shuffles stay on disk that long.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def work_dir(spark: SparkSession) -> str:
    """A new folder for written tables, in the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{uuid.uuid4().hex}"


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small_batches(spark: SparkSession) -> None:
    """Batches of at most ``BATCH_BYTES`` for this session's Python steps, if it allows larger ones (64 MB by default).

    Each task holds a batch several times over, in the executor and in its Python worker, on the way there and back; the
    setting is read when a plan is made, so it stays.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    limit = int(spark.conf.get(name).rstrip("bB"))
    if not 0 < limit <= BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def ascii_lower(col):
    """Lower-case A-Z only. Pure ASCII takes the fast path of ``lower``."""
    return F.when(F.octet_length(col) == F.length(col), F.lower(col)).otherwise(F.translate(col, UPPER, LOWER))


def held_out(doc_id="doc_id"):
    """crc32 of the id as text, modulo 4, is 2. A null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def range_numbered(df: DataFrame, *order) -> DataFrame:
    """``df`` sorted globally by range and cut, with ``part`` (the range's number, in order).

    The sort is the only exchange; no range grows with a key, as ``order`` should end in a unique column.
    """
    spark = df.sparkSession
    ranged = df.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    return cut(ranged.withColumn("part", F.spark_partition_id()))


def running_sum(ranged: DataFrame, value: str, out: str, order: list, by: list[str] | None = None) -> DataFrame:
    """Adds ``out``: the inclusive running sum of ``value`` in the global order (within ``by``, if given).

    Sums per range are added up in a window over as many rows as there are ranges; the rows of a range in a window
    of that range alone. So a hot key in ``by`` is spread over its ranges.
    """
    by = by or []
    before = Window.partitionBy(*by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = (
        ranged.groupBy(*by, "part").agg(F.sum(value).alias("_sum"))
        .withColumn("_before", F.coalesce(F.sum("_sum").over(before), F.lit(0)))
        .drop("_sum")
    )
    inside = Window.partitionBy(*by, "part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    on = [F.col(f"r.{c}").eqNullSafe(F.col(f"s.{c}")) for c in [*by, "part"]]
    condition = on[0]
    for c in on[1:]:
        condition = condition & c
    joined = ranged.withColumn("_in", F.sum(value).over(inside)).alias("r").join(sums.alias("s"), condition)
    return joined.select("r.*", (F.col("_in") + F.col("s._before")).alias(out)).drop("_in")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of undirected ``edges``: (node, component), component the smallest node reachable.

    Every round each node takes the smallest label among its own and its neighbours', then the label of its label
    (pointer jumping), so rounds grow with the logarithm of a path's length. Labels stay in Spark, cut each round;
    only a count of changes comes to the driver. Nodes without an edge do not appear.
    """
    both = edges.select(F.col(a).alias("node"), F.col(b).alias("other")).where("node <> other")
    both = cut(both.union(both.select(F.col("other").alias("node"), F.col("node").alias("other"))).distinct())
    labels = cut(both.groupBy("node").agg(F.min("other").alias("m")).select("node", F.least("node", "m").alias("label")))
    while True:
        near = (
            both.join(labels.select(F.col("node").alias("other"), F.col("label").alias("theirs")), "other")
            .groupBy("node").agg(F.min("theirs").alias("theirs"))
        )
        taken = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "theirs").alias("label"))
        taken = cut(taken)
        # The label of a label: labels are few and pre-aggregated, so that the hot ones are joined as single rows.
        used = taken.select("label").distinct()
        up = used.join(taken.select(F.col("node").alias("label"), F.col("label").alias("top")), "label")
        jumped = taken.join(up, "label", "left").select(
            "node", "old", F.least("label", F.coalesce("top", "label")).alias("label"))
        labels = cut(jumped)
        if labels.where("label <> old").isEmpty():
            swept(labels.sparkSession)
            return labels.select("node", F.col("label").alias("component"))
        labels = labels.select("node", "label")
