"""Mixing sources to target weights by weighted fair queueing (DataFrame operations only)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkspark.llm.common import cut, range_numbered, running_sum

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
EPOCHS = 3


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, tie): size is the number of words, 0 for a null text; tie tells apart rows of one id."""
    return docs.select(
        "doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.xxhash64("text").alias("tie"))


def targets(sizes: DataFrame, weights=WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """(source, source_size, longest, target) with one row per source, null a source of its own.

    Sources by code point, null last, take the weights in turn and share the sum of all sizes. A target stops at
    ``epochs`` times its source's size and the excess goes to the others by weight, until none is above. Each round
    fixes the sources above their cap in Spark; only two sums come to the driver.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.max("size").alias("longest"))
    totals = totals.withColumn("last", F.col("source").isNull()).withColumn("one", F.lit(1))
    order = ["last", "source"]
    ranged = range_numbered(totals, *order)
    ranked = running_sum(ranged, "one", "rank", order)
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), ((F.col("rank") - 1) % len(weights) + 1).cast("int"))
    left = cut(ranked.select("source", "source_size", "longest", weight.alias("weight"), F.lit(None).cast("double").alias("fixed")))
    while True:
        share, free = left.agg(
            F.coalesce(F.sum("source_size"), F.lit(0)) - F.coalesce(F.sum("fixed"), F.lit(0.0)),
            F.coalesce(F.sum(F.when(F.col("fixed").isNull(), F.col("weight"))), F.lit(0.0))).first()
        level = F.lit(share / free if free else 0.0) * F.col("weight")
        cap = F.lit(float(epochs)) * F.col("source_size")
        above = F.col("fixed").isNull() & (level > cap)
        if left.where(above).isEmpty():
            return left.select("source", "source_size", "longest", F.coalesce("fixed", level).alias("target"))
        left = cut(left.withColumn("fixed", F.when(above, cap).otherwise(F.col("fixed"))))


def horizon(aims: DataFrame, budget: int, epochs: int) -> float:
    """A virtual time by which copies of at least ``budget`` words have finished.

    By time t a source has finished t times its target but for one document, or all its copies. Of times that grow by
    powers of two beyond 1 the first that is late enough for the sum over all sources is taken.
    """
    tried = aims.withColumn("t", F.explode(F.array(*(F.lit(1 + 2.0**i) for i in range(-8, 40)))))
    served = F.least(epochs * F.col("source_size"), F.greatest(F.lit(0.0), F.col("t") * F.col("target") - F.col("longest")))
    enough = tried.groupBy("t").agg(F.sum(served).alias("served")).where(F.col("served") >= budget)
    return enough.agg(F.coalesce(F.min("t"), F.lit(float("inf")))).first()[0]


def mix(docs: DataFrame, seed: int = 17, weights=WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """(doc_id, source, tie, row, size, source_size, target, copies) for every row of ``docs``. ``tie`` is a hash of the
    text, and ``row`` counts the rows that are equal in all three.

    Documents of a source are shuffled by a seeded hash, so reruns agree. The e-th copy of a document finishes at
    virtual time ((e - 1) * source size + cumulative size) / target. All copies are sorted by that time over ranges and
    the longest prefix within the budget, the sum of all sizes, is taken. Copies that finish after a time by which the
    budget is used up for certain (``horizon``) are never made. Documents without words cost nothing and are
    taken once. Rows that are equal in all of doc_id, source and text share their places among them in any order. Null
    sources are one source; extra columns are ignored; an empty table gives an empty result.
    """
    sizes = cut(sized(docs))
    aims = cut(targets(sizes, weights, epochs))
    order = ["source", "shuffled", "doc_id", "tie"]
    shuffled = sizes.withColumn("shuffled", F.xxhash64(F.lit(seed), "doc_id", "tie"))
    inside = running_sum(range_numbered(shuffled, *order), "size", "cumulative", order, ["source"])
    timed = inside.alias("d").join(aims.alias("t"), F.col("d.source").eqNullSafe(F.col("t.source"))).select(
        "d.*", "t.source_size", "t.target")
    timed = cut(timed)
    budget = aims.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    copies = (
        timed.where("size > 0").withColumn("epoch", F.explode(F.sequence(F.lit(1), F.lit(epochs))))
        .withColumn("finish", ((F.col("epoch") - 1) * F.col("source_size") + F.col("cumulative")) / F.col("target"))
        .where(F.col("finish") <= F.lit(horizon(aims, budget, epochs)))
        .select("finish", "source", "shuffled", "doc_id", "tie", "epoch", "size"))
    queue = ["finish", "source", "shuffled", "doc_id", "tie", "epoch"]
    queued = running_sum(range_numbered(copies, *queue), "size", "served", queue)
    key = ["doc_id", "source", "tie"]
    alike = Window.partitionBy(*key)
    taken = queued.where(F.col("served") <= budget).groupBy(*key).agg(F.count("*").alias("n"))
    # Rows equal in all three are told apart by number only here, so that their copies are shared out and none is lost.
    rows = timed.withColumn("row", F.row_number().over(alike.orderBy("cumulative"))).withColumn("rows", F.count("*").over(alike))
    on = F.lit(True)
    for c in key:
        on = on & F.col(f"r.{c}").eqNullSafe(F.col(f"k.{c}"))
    n = F.coalesce("k.n", F.lit(0))
    share = F.floor(n / F.col("r.rows")) + F.when(F.col("r.row") <= n % F.col("r.rows"), 1).otherwise(0)
    return rows.alias("r").join(taken.alias("k"), on, "left").select(
        *(f"r.{c}" for c in [*key, "row", "size", "source_size", "target"]),
        F.when(F.col("r.size") == 0, 1).otherwise(share).cast("int").alias("copies"))


def mixed(docs: DataFrame, seed: int = 17, weights=WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """The rows of ``docs``, each as often as ``mix`` takes it; columns are those of ``docs``."""
    key = ["doc_id", "source", "tie", "row"]
    chosen = mix(docs, seed, weights, epochs).where("copies > 0").select(*(F.col(c).alias(f"_{c}") for c in key), F.col("copies").alias("_copies"))
    tied = docs.withColumn("_t", F.xxhash64("text"))
    rows = tied.withColumn("_r", F.row_number().over(Window.partitionBy("doc_id", "source", "_t").orderBy(F.lit(0))))
    same = F.col("doc_id").eqNullSafe(F.col("_doc_id")) & F.col("source").eqNullSafe(F.col("_source")) & (F.col("_t") == F.col("_tie"))
    return rows.join(chosen, same & (F.col("_r") == F.col("_row"))).withColumn("_copy", F.explode(F.sequence(F.lit(1), "_copies"))).select(*docs.columns)


def op3_mixing(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return mix(docs).select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))
