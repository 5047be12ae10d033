"""Vectors of other documents that are close to each vector: an exact join of all rows by pivots and triangle bounds.

Unit vectors lie in the cell of their closest pivot. One that is within reach of a cell's border, by the plane between the pivots,
visits that cell too; so each vector finds all its partners at home. Equal vectors of a document ask as one.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkspark.sources.tables import checkpointed

#: Points to a pivot and the most pivots (all tasks have their vectors); they change what meets, not what is found.
POINTS, PIVOTS = 2000, 512
#: Points drawn for each pivot that is chosen from them: 4,096 at most.
DRAWN = 8
#: Components of the vectors that meet in a task, and askers that they meet there.
BLOCK, ASKING = 8_000_000, 65_536
#: How often a vector may move on average, as long as fewer cells keep to it. Where directions have no clusters, hardly a cell is excluded,
#: and a copy for each would grow with the square of the rows.
MOVES = 12
SLACK = 1e-6


def current_vectors(rows: DataFrame, revisions: DataFrame) -> DataFrame:
    """``rows`` (vec_id, label, embedding) as revised: ``revisions`` has (vec_id, refreshed), the vector of a changed text, null where none
    was made yet; such rows have no vector and take no part."""
    new = revisions.select("vec_id", F.col("refreshed"), F.lit(True).alias("revised"))
    chosen = F.when(F.col("revised"), F.col("refreshed")).otherwise(F.col("embedding"))
    return rows.join(new, "vec_id", "left").select("vec_id", "label", chosen.alias("embedding")).where(F.col("embedding").isNotNull())


def unit_points(rows: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """((key, dim, label, e, ids), (id, key)): distinct unit vectors of a label with their ``k`` smallest ids, and whose they are."""
    columns = [F.col("vec_id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), F.transform("embedding", lambda x: x.cast("double")).alias("e")]
    fine = F.col("id").isNotNull() & F.col("label").isNotNull() & (F.size("e") > 0) & F.forall("e", lambda x: x.isNotNull() & (F.abs(x) < float("inf"))) & F.exists("e", lambda x: x != 0)
    # The greatest component first, so that no square leaves the range of doubles.
    most = F.array_max(F.transform("e", F.abs))
    scaled = rows.select(*columns).where(fine).distinct().withColumn("e", F.transform(F.array(F.struct("e", most.alias("m"))), lambda p: F.transform(p["e"], lambda x: x / p["m"]))[0])
    key = F.concat_ws("-", "label", F.hex(F.xxhash64("label", "e")), F.hex(F.hash("e", "label")))
    named = checkpointed(scaled.withColumn("key", key))
    rank = F.row_number().over(Window.partitionBy("key").orderBy("id"))
    points = named.withColumn("rank", rank).where(F.col("rank") <= k).groupBy("key").agg(F.first("label").alias("label"), F.first("e").alias("e"), F.array_sort(F.collect_list("id")).alias("ids"))
    return checkpointed(points.withColumn("dim", F.size("e"))), named.select("id", "key")


def matrix(column) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    out = flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)
    return out / np.linalg.norm(out, axis=1, keepdims=True)


def spread(drawn: np.ndarray, many: int) -> np.ndarray:
    """So many of the drawn vectors as pivots, each the farthest from those before, so that they reach into every cluster drawn from."""
    chosen, far = [0], 1 - drawn @ drawn[0]
    while len(chosen) < min(many, len(drawn)):
        chosen.append(int(far.argmax()))
        far = np.minimum(far, 1 - drawn @ drawn[chosen[-1]])
    return drawn[chosen]


def visits(v: np.ndarray, pivots: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """(home cell, cells within ``reach`` as a mask): a vector this far from the plane between two pivots has no partner beyond it."""
    squares = np.maximum(2 - 2 * v @ pivots.T, 0)
    home = squares.argmin(axis=1)
    apart = np.sqrt(np.maximum(2 - 2 * pivots @ pivots.T, 0))[home]
    # Equal pivots are one cell, the first's; nothing lies in the others.
    beyond = (squares - squares[np.arange(len(v)), home][:, None]) > 2 * apart * (reach + SLACK)
    return home, ~beyond


def tiles(home: np.ndarray, inside: np.ndarray, per: int) -> tuple[np.ndarray, np.ndarray]:
    """(blocks of askers, chunks of candidates) of cells with so many of them."""
    return tuple(np.maximum(1, np.ceil(np.asarray(x) / size)).astype(np.int64) for x, size in ((home, ASKING), (inside, per)))


def fewest(drawn: np.ndarray, pivots: np.ndarray, many: int, reach: float, per: int) -> np.ndarray:
    """The first so many pivots with which ``many`` points like those drawn compare least, among those that move them up to ``MOVES`` times on
    average, or that move them least."""
    options = []
    for n in sorted({*(1 << np.arange(len(pivots).bit_length())), len(pivots)}):
        if n > len(pivots):
            continue
        home, inside = visits(drawn, pivots[:n], reach)
        homes, insides = (x * many / len(drawn) for x in (np.bincount(home, minlength=n), inside.sum(axis=0)))
        blocks, chunks = tiles(homes, insides, per)
        moves = (homes * chunks + insides * blocks).sum() / many
        options.append((max(moves, MOVES), (homes * insides).sum(), n))
    return pivots[: min(options)[2]]


def associated(rows: DataFrame, least: float = 0.8, k: int = 3) -> DataFrame:
    """(left_id, right_id, rank, score): for every vector the ``k`` closest ones of other labels with a cosine of ``least`` or more, smaller ids
    first among equals.

    ``rows`` has (vec_id, label, embedding). Vectors without an id or label, that are null, empty or zero, or hold null or non-finite
    components take no part; those of other lengths never meet. Rows that are equal count once. Copies of a vector under
    one label ask once, and answer with their first ids, as no others can be among the ``k``.
    """
    points, members = unit_points(rows, k)
    reach = math.sqrt(max(0.0, 2 - 2 * least))
    found = [near(points.where(F.col("dim") == row["dim"]), row["n"], reach, least, k) for row in points.groupBy("dim").agg(F.count("*").alias("n")).orderBy("dim").collect()]
    if not found:
        return points.sparkSession.createDataFrame([], "left_id long, right_id long, rank int, score double")
    whole = found[0]
    for part in found[1:]:
        whole = whole.union(part)
    rank = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("score"), "right_id"))
    best = whole.withColumn("rank", rank).where(F.col("rank") <= k)
    return members.join(best, "key").select(F.col("id").alias("left_id"), "right_id", "rank", "score")


def near(points: DataFrame, many: int, reach: float, least: float, k: int) -> DataFrame:
    """(key, right_id, score) of points of one length: the best that each finds in each block of its cell."""
    wanted = min(PIVOTS, max(1, many // POINTS))
    drawn = points.orderBy(F.xxhash64("key"), "key").limit(DRAWN * wanted).select("e").toArrow()
    sample = matrix(drawn.column("e"))
    per = max(1, BLOCK // sample.shape[1])
    pivots = fewest(sample, spread(sample, wanted), many, reach, per)

    def count(batches):
        total = np.zeros((2, len(pivots)), np.int64)
        for batch in batches:
            home, inside = visits(matrix(batch.column("e")), pivots, reach)
            total += [np.bincount(home, minlength=len(pivots)), inside.sum(axis=0)]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(pivots), dtype=np.int32)), pa.array(total[0]), pa.array(total[1])], ["cell", "home", "inside"])

    sums = points.select("e").mapInArrow(count, "cell int, home long, inside long").groupBy("cell").agg(F.sum("home").alias("home"), F.sum("inside").alias("inside")).orderBy("cell").collect()
    blocks, chunks = tiles([r["home"] for r in sums], [r["inside"] for r in sums], per)
    names = ["key", "label", "e", "ids"]

    def deal(batches):
        for batch in batches:
            h = batch.column("h").to_numpy().astype(np.uint64)
            home, inside = visits(matrix(batch.column("e")), pivots, reach)
            row, cell = np.nonzero(inside)
            # Askers meet every chunk of their cell, candidates every block of askers.
            for asks, at, to, own, times in ((True, np.arange(len(h)), home, blocks, chunks), (False, row, cell, chunks, blocks)):
                many = times[to]
                at, to = np.repeat(at, many), np.repeat(to, many)
                other = np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many)
                mine = (h[at] % own[to].astype(np.uint64)).astype(np.int64)
                for low in range(0, len(at), 4096):
                    s = slice(low, low + 4096)
                    # Askers are known by their keys, candidates by their ids.
                    some = batch.select(names).take(pa.array(at[s]))
                    field = some.schema.field("ids" if asks else "key")
                    some = some.set_column(names.index(field.name), field, pa.nulls(len(some), field.type))
                    block, chunk = (mine[s], other[s]) if asks else (other[s], mine[s])
                    for name, value in (("cell", to[s].astype(np.int32)), ("block", block), ("chunk", chunk), ("asks", np.full(len(to[s]), asks))):
                        some = some.append_column(name, pa.array(value))
                    yield some

    def meet(table: pa.Table) -> pa.Table:
        asks = table.column("asks").to_numpy()
        asking, others = table.filter(pa.array(asks)), table.filter(pa.array(~asks))
        out = []
        if asking.num_rows and others.num_rows:
            ids = others.column("ids").to_pylist()
            order = np.argsort([x[0] for x in ids], kind="stable")
            v, labels = matrix(others.column("e"))[order], others.column("label").to_numpy()[order]
            for low in range(0, asking.num_rows, 64):
                some = asking.slice(low, 64)
                scores = matrix(some.column("e")) @ v.T
                for i, (key, label) in enumerate(zip(some.column("key").to_pylist(), some.column("label").to_pylist())):
                    at = np.flatnonzero(scores[i] >= least - SLACK)
                    # Sums of equal vectors may differ in their last bits.
                    own = np.round(scores[i, at], 12)
                    fits = (own >= least) & (labels[at] != label)
                    at, own = at[fits], own[fits]
                    for place in np.argsort(-own, kind="stable")[:k]:
                        out += [(key, x, float(own[place])) for x in ids[order[at[place]]]]
        kinds = [pa.string(), pa.int64(), pa.float64()]
        return pa.table([pa.array(x, t) for x, t in zip(zip(*out) if out else [[]] * 3, kinds)], ["key", "right_id", "score"])

    dealt = points.select(*names, F.xxhash64("key").alias("h")).mapInArrow(deal, "key string, label long, e array<double>, ids array<long>, cell int, block long, chunk long, asks boolean")
    return dealt.groupBy("cell", "block", "chunk").applyInArrow(meet, "key string, right_id long, score double")
