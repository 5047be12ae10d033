"""Hard negatives by a distributed nearest-neighbour join over Voronoi cells.

Greatest inner products are least distances once each vector has a further component, sqrt(m - |x|^2) with m the greatest
squared norm, and each asking vector a zero there. Pivots, a bounded draw of the rows, split that space into cells. Rows
lie in the cell of their closest pivot, and so do anchors, which makes them groups. A group meets its own cell first;
what it finds bounds how far any better row can be. Of the other cells only those rows are copied to it that its radius
and that bound don't exclude by the triangle inequality. Meetings are block by block, each exact, and their best are
merged.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkspark.llm.common import cut, read

#: Anchors to a pivot, and the most pivots there are (all tasks have their vectors). They change what meets, not what is found.
ANCHORS, PIVOTS = 64, 512
#: Components of the rows that meet in a task, and anchors that they meet.
BLOCK, ASKING = 1_000_000, 512
#: Where anchors want rows of their own label, groups are told apart by so many buckets of labels.
BUCKETS = 16
#: Whole numbers below this are exact in double precision.
EXACT = 2.0**53
SPANS = "spans array<struct<key:long,low:long,high:long>>"


def usable(rows: DataFrame, scale: int) -> DataFrame:
    """(id, label, v): rows with an id, a label and a vector of finite components, floor(scale * x), once each.
    Shorter vectors end in zeros."""
    fine = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    scaled = lambda x: x.cast("double") * scale
    floor = F.transform("embedding", lambda x: F.when(F.abs(scaled(x)) < EXACT, F.floor(scaled(x)).cast("double")).otherwise(scaled(x)))
    some = cut(rows.where(fine).select(F.col("vec_id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), floor.alias("v")).distinct())
    sizes = some.agg(F.min(F.size("v")).alias("least"), F.max(F.size("v")).alias("most")).first()
    if sizes["least"] == sizes["most"]:
        return some
    return cut(some.withColumn("v", F.concat("v", F.array_repeat(F.lit(0.0), F.lit(sizes["most"]) - F.size("v")))))


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


class Cells:
    """Pivots, and what is known of the groups of anchors around them, by (pivot, bucket of labels)."""

    def __init__(self, pivots: np.ndarray, greatest: float):
        self.pivots, self.greatest = pivots, greatest
        self.squares = (pivots**2).sum(axis=1)
        self.raised = np.sqrt(np.maximum(greatest - self.squares, 0))
        self.slack = 1e-6 * (1 + np.sqrt(greatest))  # far beyond the rounding of distances
        self.shape = (len(pivots), BUCKETS)

    def distances(self, v: np.ndarray, asking: bool) -> np.ndarray:
        """Of each vector from each pivot, in the space with the further component."""
        squares = (v**2).sum(axis=1)
        further = np.zeros(len(v)) if asking else np.sqrt(np.maximum(self.greatest - squares, 0))
        products = v @ self.pivots.T + np.outer(further, self.raised)
        return np.sqrt(np.maximum((squares + further**2)[:, None] + self.greatest - 2 * products, 0))

    def table(self, found: list, column: str, missing: float) -> np.ndarray:
        out = np.full(self.shape, missing)
        for row in found:
            out[row["cell"], row["bucket"]] = row[column]
        return out


def grouped(anchors: DataFrame, cells: Cells) -> DataFrame:
    """Anchors with ``cell`` (of the closest pivot), ``away`` (its distance) and ``square`` (their squared norm)."""

    def run(batches):
        for batch in batches:
            v = matrix(batch.column("v"))
            far = cells.distances(v, True)
            cell = far.argmin(axis=1)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(cell.astype(np.int32)), pa.array(far[np.arange(len(v)), cell]), pa.array((v**2).sum(axis=1))],
                [*batch.schema.names, "cell", "away", "square"])

    return anchors.mapInArrow(run, "id long, label long, v array<double>, cell int, away double, square double")


def bucket(same: bool):
    return F.pmod(F.xxhash64("label"), F.lit(BUCKETS)).cast("int") if same else F.lit(0)


def candidates(rows: DataFrame, cells: Cells, wanted) -> tuple:
    """(rows copied to the groups that ``wanted(distances, home, buckets)`` says, chunks of each group): each copy has its group and
    a chunk of it, as many chunks as keep a meeting in bounds. Counts of the groups' rows come to the driver first."""

    def pairs(batch):
        v = matrix(batch.column("v"))
        far, buckets = cells.distances(v, False), batch.column("bucket").to_numpy()
        return *np.nonzero(wanted(far, far.argmin(axis=1), buckets)), buckets

    def count(batches):
        total = np.zeros(cells.shape, np.int64)
        for batch in batches:
            row, cell, buckets = pairs(batch)
            np.add.at(total, (cell, buckets[row]), 1)
        cell, own = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(own.astype(np.int32)), pa.array(total[cell, own])], ["cell", "bucket", "n"])

    found = rows.select("v", "bucket").mapInArrow(count, "cell int, bucket int, n long").groupBy("cell", "bucket").agg(F.sum("n").alias("n")).collect()
    per = max(1, BLOCK // max(1, cells.pivots.shape[1]))
    chunks = np.ceil(cells.table(found, "n", 0) / per).astype(np.int64)

    def deal(batches):
        for batch in batches:
            row, cell, buckets = pairs(batch)
            for low in range(0, len(row), 4096):
                at, to = row[low : low + 4096], cell[low : low + 4096]
                chunk = batch.column("h").to_numpy()[at].astype(np.uint64) % chunks[to, buckets[at]].astype(np.uint64)
                some = batch.select(["id", "label", "v", "bucket"]).take(pa.array(at))
                yield some.append_column("cell", pa.array(to.astype(np.int32))).append_column("chunk", pa.array(chunk.astype(np.int64)))

    dealt = rows.select("id", "label", "v", "bucket", F.xxhash64("id").alias("h")).mapInArrow(deal, "id long, label long, v array<double>, bucket int, cell int, chunk long")
    return dealt, chunks


def best_of(scores: np.ndarray, low, high, k: int) -> np.ndarray:
    """Places of the ``k`` greatest scores from ``low`` to ``high``, earlier places first among equals."""
    at = np.flatnonzero((scores >= (-np.inf if low is None else low)) & (scores <= (np.inf if high is None else high)))
    if len(at) > k:
        some = scores[at]
        at = at[some >= np.partition(some, len(at) - k)[len(at) - k]]
    return at[np.argsort(-scores[at], kind="stable")[:k]]


def meet(anchors: DataFrame, dealt: DataFrame, chunks: np.ndarray, k: int, same: bool) -> DataFrame:
    """(anchor_id, key, other_id, score): the ``k`` best rows in each span of each anchor, of each chunk of its group."""
    spark = anchors.sparkSession
    sizes = [(cell, own, int(n)) for (cell, own), n in np.ndenumerate(chunks) if n]
    if not sizes:
        return spark.createDataFrame([], "anchor_id long, key long, other_id long, score long")
    # A row for each group: at most PIVOTS x BUCKETS.
    many = F.broadcast(spark.createDataFrame(sizes, "cell int, bucket int, chunks long"))
    blocks = anchors.groupBy("cell", "bucket").agg(F.ceil(F.count("*") / ASKING).alias("blocks"))
    blocks = F.broadcast(many.join(blocks, ["cell", "bucket"]))
    left = anchors.join(blocks, ["cell", "bucket"]).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks"))).withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    right = dealt.join(blocks, ["cell", "bucket"]).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    columns = ["cell", "bucket", "block", "chunk", "id", "label", "v"]
    both = left.select(*columns, "spans", F.lit(True).alias("asks")).unionByName(right.select(*columns, F.lit(None).cast(SPANS.split(" ", 1)[1]).alias("spans"), F.lit(False).alias("asks")))

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        asks = table.column("asks").to_numpy()
        ids, labels, v = table.column("id").to_numpy(), table.column("label").to_numpy(), matrix(table.column("v").combine_chunks())
        asking, others = np.flatnonzero(asks), np.flatnonzero(~asks)
        others = others[np.argsort(ids[others], kind="stable")]
        found = []
        if len(asking) and len(others):
            a, b = v[asking], v[others]
            if not np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * v.shape[1] < EXACT:
                a, b = (np.array([[int(x) for x in row] for row in side], object) for side in (a, b))
            scores, spans = a @ b.T, table.column("spans").take(pa.array(asking)).to_pylist()
            fitting = {x: np.flatnonzero((labels[others] == x) == same) for x in np.unique(labels[asking])}
            for i, row in enumerate(asking):
                at = fitting[labels[row]]
                at = at[ids[others[at]] != ids[row]]
                own = scores[i, at]
                for span in spans[i]:
                    for place in best_of(own, span["low"], span["high"], k):
                        found.append((int(ids[row]), span["key"], int(ids[others[at[place]]]), int(own[place])))
        names = ["anchor_id", "key", "other_id", "score"]
        return pa.table([pa.array(x, pa.int64()) for x in zip(*found)] if found else [pa.array([], pa.int64())] * 4, names)

    return both.groupBy("cell", "bucket", "block", "chunk").applyInArrow(run, "anchor_id long, key long, other_id long, score long")


def top(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("anchor_id", "key").orderBy(F.desc("score"), "other_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def join(rows: DataFrame, anchors: DataFrame, cells: Cells, k: int, same: bool) -> DataFrame:
    """(anchor_id, key, other_id, score, rank): the ``k`` rows, of the anchor's label or of others, with the greatest inner product
    with the anchor in each of its spans (key, low, high; null bounds are open); smaller ids come first among equals."""
    rows, anchors = rows.withColumn("bucket", bucket(same)), anchors.withColumn("bucket", bucket(same))
    radii = cells.table(anchors.groupBy("cell", "bucket").agg(F.max("away").alias("away")).collect(), "away", -np.inf)
    asked = np.isfinite(radii)
    at_home = lambda far, home, own: (np.arange(far.shape[1]) == home[:, None]) & asked[:, own].T
    first = cut(top(meet(anchors, *candidates(rows, cells, at_home), k, same), k).drop("rank"))
    # A row that an anchor still lacks scores at least as the last of its k, or as the span's lower bound.
    last = first.groupBy("anchor_id", "key").agg(F.count("*").alias("n"), F.min("score").alias("last"))
    spans = anchors.select("id", "label", "v", "cell", "bucket", "square", F.explode("spans").alias("s")).select("*", "s.*").drop("s")
    spans = spans.join(last.withColumnRenamed("anchor_id", "id"), ["id", "key"], "left")
    least = F.when(F.col("n") >= k, F.greatest("low", "last")).otherwise(F.col("low"))
    spans = cut(spans.withColumn("low", least))
    # Distance for a score; null for an open bound.
    far = lambda score: F.when(F.col(score).isNotNull(), F.sqrt(F.greatest(F.col("square") + cells.greatest - 2 * F.col(score), F.lit(0.0))))
    bounds = spans.groupBy("cell", "bucket").agg(
        F.max(F.coalesce(far("low"), F.lit(float("inf")))).alias("reach"), F.min(F.coalesce(far("high"), F.lit(0.0))).alias("from_")).collect()
    reach, near = cells.table(bounds, "reach", -np.inf), cells.table(bounds, "from_", np.inf)

    def elsewhere(distances, home, own):
        away = np.arange(distances.shape[1]) != home[:, None]
        outer = distances - radii[:, own].T <= reach[:, own].T + cells.slack
        return away & asked[:, own].T & outer & (distances + radii[:, own].T >= near[:, own].T - cells.slack)

    tighter = spans.groupBy("id", "label", "v", "cell", "bucket").agg(F.collect_list(F.struct("key", "low", "high")).alias("spans"))
    return top(first.union(meet(tighter, *candidates(rows, cells, elsewhere), k, same)), k)


def hard_negatives(rows: DataFrame, asks: str = "id % 100 = 0", scale: int = 256, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each anchor (a row that ``asks`` holds
    for) and each of its first ``positives`` other rows of its label, the first ``negatives`` rows of other labels that score
    between ``low`` and ``high`` hundredths of the positive.

    Scores are inner products of components floor(scale * x), exact; higher scores come first, ties by smaller vec_id. Rows
    whose id, label, vector or any component is null, or a component not finite, take no part. Equal rows count once, and
    rows of one id aren't each other's positives or negatives. Shorter vectors end in zeros; empty ones score zero. With
    fewer rows than asked for all are taken; a negative positive score has no negatives. A score beyond a long is an
    error. Further columns are ignored; an empty table gives an empty result.
    """
    rows = usable(rows, scale)
    anchors = rows.where(asks)
    many = anchors.count()
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    greatest = rows.agg(F.max(square)).first()[0]
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not many:
        return rows.sparkSession.createDataFrame([], schema)
    drawn = rows.orderBy(F.xxhash64("id"), "id", "label", "v").limit(min(PIVOTS, max(1, many // ANCHORS))).select("v").toArrow()
    cells = Cells(matrix(drawn.column("v").combine_chunks()), greatest)
    around = cut(grouped(anchors, cells))
    everything = F.array(F.struct(F.lit(0).cast("long").alias("key"), F.lit(None).cast("long").alias("low"), F.lit(None).cast("long").alias("high")))
    near = cut(join(rows, around.withColumn("spans", everything), cells, positives, True))
    wide = F.col("score").cast("decimal(20,0)")
    div = lambda x: F.call_function("div", x, F.lit(100).cast("decimal(20,0)"))
    span = F.struct(F.col("other_id").alias("key"), div(low * wide + 99).alias("low"), div(high * wide).alias("high"))
    wanted = near.where("score >= 0").groupBy(F.col("anchor_id").alias("id")).agg(F.collect_list(span).alias("spans"))
    met = join(rows, around.join(wanted, "id"), cells, negatives, False)
    scores = near.select("anchor_id", F.col("other_id").alias("key"), F.col("score").alias("positive_score"))
    return met.join(scores, ["anchor_id", "key"]).select(
        "anchor_id", F.col("key").alias("positive_id"), F.col("rank").cast("int").alias("rank"), F.col("other_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op11_hard_negatives(spark, sf_dir):
    rows = read(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.withColumn("label", label))
