"""Embedding near-dedup: exact threshold pairs by dual traversal of cover trees.

A label's vectors lie in blocks around centres. A vector is sent to its own block and to those that can hold a link of it,
by the plane between the centres and by the block's covering radius. For each pair of blocks a task builds a
cover tree of either block (nested levels of centres with halving radii) and walks both at once. A pair of nodes is
dropped if its centres are further apart than the covering radii and the threshold allow, and counted as a whole if
all of its members must link. A task gives each vector's number of links and a spanning forest, never all pairs.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkspark.llm.common import components, cut, read

#: Vectors of a block, and of a task that finds their blocks; centres of a label at most; slack of rounding.
BLOCK, ROWS, CENTRES, SLACK = 4096, 65_536, 2048, 1e-6


@dataclass
class Node:
    center: int
    members: np.ndarray
    radius: float
    children: list[Node]


def apart(points: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * (points[a] @ points[b].T), 0))


def net(points: np.ndarray, members: np.ndarray, radius: float, batch: int = 256) -> list[np.ndarray]:
    """Groups of members, each within ``radius`` of its first; the firsts are further apart than that."""
    groups, left = [], members
    while len(left):
        some = apart(points, left[:batch], left) <= radius
        free = np.ones(len(left), bool)
        for i in range(min(batch, len(left))):
            if free[i]:
                own = some[i] & free
                own[i] = True
                free &= ~own
                groups.append(np.concatenate([left[i : i + 1], left[own & (np.arange(len(left)) != i)]]))
        left = left[free]
    return groups


def build(points: np.ndarray, members: np.ndarray) -> Node:
    root = Node(int(members[0]), members, 0.0, [])
    todo = [root]
    while todo:
        node = todo.pop()
        if len(node.members) == 1:
            continue
        node.radius = float(apart(points, node.members[:1], node.members).max())
        if node.radius <= 1e-7:
            continue
        half = 2.0 ** (np.ceil(np.log2(node.radius)) - 1)
        node.children = [Node(int(g[0]), g, 0.0, []) for g in net(points, node.members, half)]
        todo.extend(node.children)
    return root


class Forest:
    """Link counts and a union-find over the vectors of a task."""

    def __init__(self, weights: np.ndarray):
        self.weights, self.links, self.parent = weights, np.zeros(len(weights), np.int64), np.arange(len(weights))

    def roots(self, of: np.ndarray) -> np.ndarray:
        found = self.parent[of]
        while (self.parent[found] != found).any():
            found = self.parent[found]
        self.parent[of] = found
        return found

    def linked(self, a: np.ndarray, b: np.ndarray, near: np.ndarray, same: bool) -> None:
        """``near``: which of ``a`` link with which of ``b``. If ``same``, b is a."""
        if same:
            near = near & ~np.eye(len(a), dtype=bool)
        self.links[a] += near @ self.weights[b]
        if not same:
            self.links[b] += near.T @ self.weights[a]
        for i in np.flatnonzero(near.any(axis=1)):
            tops = np.unique(self.roots(np.append(b[near[i]], a[i])))
            self.parent[tops] = tops[0]


def traverse(points: np.ndarray, forest: Forest, one: Node, two: Node, cosine: float, chunk: int = 512) -> None:
    """Counts and ties all pairs with ``cosine`` or more between the members of two nodes (or within one)."""
    reach = float(np.sqrt(2 - 2 * cosine))
    todo = [(one, two)]
    while todo:
        a, b = todo.pop()
        same = a is b
        if not a.children and not b.children or len(a.members) * len(b.members) <= chunk:
            forest.linked(a.members, b.members, points[a.members] @ points[b.members].T >= cosine, same)
            continue
        # The node with the larger radius opens; a node against itself opens on both sides.
        if same:
            left = right = a.children
        elif not b.children or a.children and a.radius >= b.radius:
            left, right = a.children, [b]
        else:
            left, right = [a], b.children
        # Single vectors meet each other at once; what is left has a node with members on one side at least.
        alone, other = ([x for x in side if len(x.members) == 1] for side in (left, right))
        for low in range(0, len(alone), chunk):
            if other:
                rows = np.array([x.center for x in alone[low : low + chunk]])
                columns = np.array([x.center for x in other])
                near = points[rows] @ points[columns].T >= cosine
                if same:
                    near[np.arange(len(columns))[None, :] <= np.arange(low, low + len(rows))[:, None]] = False
                forest.linked(rows, columns, near, False)
        crowds = [x for x in left if len(x.members) > 1]
        meetings = [(crowds, right)] + ([] if same else [(alone, [x for x in right if len(x.members) > 1])])
        for some_left, some_right in meetings:
            if not some_left or not some_right:
                continue
            centers = np.array([x.center for x in some_right])
            bounds = np.array([covering(points, x) for x in some_right])
            place = {id(x): k for k, x in enumerate(some_right)}
            for low in range(0, len(some_left), chunk):
                some = some_left[low : low + chunk]
                gaps = apart(points, np.array([x.center for x in some]), centers)
                both = np.array([covering(points, x) for x in some])[:, None] + bounds[None, :]
                if same:  # each pair of children once: a crowd with the crowds from itself on, and with all single ones
                    crowd = np.array([len(x.members) > 1 for x in right])
                    mine = np.array([place[id(x)] for x in some])
                    gaps[crowd[None, :] & (np.arange(len(right))[None, :] < mine[:, None])] = np.inf
                for i, j in zip(*np.nonzero(gaps <= reach + both + SLACK)):
                    x, y = some[i], some_right[j]
                    if x is not y and gaps[i, j] + both[i, j] <= reach - 1e-6:
                        forest.linked(x.members, y.members, np.ones((len(x.members), len(y.members)), bool), False)
                    else:
                        todo.append((x, y))


def covering(points: np.ndarray, node: Node) -> float:
    if len(node.members) > 1 and not node.radius:
        node.radius = float(apart(points, np.array([node.center]), node.members).max())
    return node.radius


def block_links(ids: np.ndarray, vectors: np.ndarray, weights: np.ndarray, sides: np.ndarray, cosine: float, alone: bool = True):
    """(id, links, tied to) over the vectors of one block (``alone``) or between those of two."""
    points = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    order = np.argsort(ids, kind="stable")
    ids, points, weights, sides = ids[order], points[order], weights[order], sides[order]
    forest = Forest(weights)
    parts = [np.flatnonzero(sides == s) for s in (0, 1)]
    trees = [build(points, p) for p in parts if len(p)]
    if len(trees) == 2:
        traverse(points, forest, trees[0], trees[1], cosine)
    elif trees and alone:
        traverse(points, forest, trees[0], trees[0], cosine)
    return ids, forest.links, ids[forest.roots(np.arange(len(ids)))]


def placed(points: DataFrame, cosine: float, block: int) -> DataFrame:
    """(label, dim, node, v, w, block, gap, meets): each vector's block and which others its links may be in.

    A label's vectors go to the nearest of its centres, one for every ``block`` vectors up to ``CENTRES``. A vector x that
    links with a y of another block is no further than the threshold from the plane between the two centres, on whose
    other side y lies; ``meets`` has the blocks for which that holds, with the distance to their centres. Tasks take
    ``ROWS`` vectors and the label's centres, so a label that holds most rows is spread over many.
    """
    key = ["label", "dim"]
    reach = float(np.sqrt(2 - 2 * cosine)) + SLACK
    sizes = cut(points.groupBy(*key).agg(F.count("*").alias("n")).select(
        *key, F.least(F.ceil(F.col("n") / F.lit(block)), F.lit(CENTRES)).alias("m"), F.ceil(F.col("n") / F.lit(ROWS)).alias("parts")))
    own = points.join(sizes, key).select(*key, F.pmod("node", "parts").alias("part"), F.lit(None).cast("int").alias("centre"), "node", "v", "w")
    first = Window.partitionBy(*key).orderBy("node")
    centres = points.select(*key, "node", "v", "w").withColumn("centre", F.row_number().over(first) - 1).where(F.col("centre") < CENTRES)
    centres = centres.join(sizes, key).where("centre < m").select(
        *key, F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "centre", "node", "v", "w")

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        flat = table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, -1)
        unit = flat / np.linalg.norm(flat, axis=1, keepdims=True)
        number = table.column("centre").to_numpy(zero_copy_only=False)
        is_centre = ~np.isnan(number.astype(float))
        order = np.flatnonzero(is_centre)[np.argsort(number[is_centre])]
        rows, centre = np.flatnonzero(~is_centre), unit[order]
        between = np.sqrt(np.maximum(2 - 2 * centre @ centre.T, 0))
        none = np.empty(0)
        blocks, gaps, meets, far, counts = ([none] for _ in range(5))
        for low in range(0, len(rows), 4096):
            some = rows[low : low + 4096]
            squares = np.maximum(2 - 2 * unit[some] @ centre.T, 0)
            nearest = squares.argmin(axis=1)
            least = squares[np.arange(len(some)), nearest]
            beyond = squares - least[:, None] <= 2 * between[nearest] * reach + SLACK
            at, to = np.nonzero(beyond)
            blocks.append(nearest)
            gaps.append(np.sqrt(least))
            meets.append(to)
            far.append(np.sqrt(squares[at, to]))
            counts.append(np.bincount(at, minlength=len(some)))
        offsets = np.concatenate([[0], np.concatenate(counts).cumsum()])
        pairs = pa.StructArray.from_arrays([pa.array(np.concatenate(meets).astype(np.int32)), pa.array(np.concatenate(far))], ["block", "gap"])
        kept = table.take(pa.array(rows)).select([*key, "node", "v", "w"])
        return kept.append_column("block", pa.array(np.concatenate(blocks).astype(np.int32))).append_column("gap", pa.array(np.concatenate(gaps))).append_column(
            "meets", pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pairs))

    kind = points.schema["label"].dataType.simpleString()
    both = own.unionByName(centres)
    return cut(both.groupBy(*key, "part").applyInArrow(run, f"label {kind}, dim int, node long, v array<double>, w long, block int, gap double, meets array<struct<block: int, gap: double>>"))


def blocked(points: DataFrame, cosine: float, block: int) -> DataFrame:
    """(label, dim, task, alone, side, node, v, w): the vectors of each pair of blocks that may hold links.

    A vector isn't sent to a block whose covering radius keeps it out of reach. Blocks of more than ``block`` vectors are
    dealt out into units, so that a task has two units at most.
    """
    key = ["label", "dim"]
    reach = float(np.sqrt(2 - 2 * cosine)) + SLACK
    rows = placed(points, cosine, block)
    about = cut(rows.groupBy(*key, "block").agg(F.max("gap").alias("radius"), F.ceil(F.count("*") / F.lit(block)).alias("units")))
    own = rows.join(about.select(*key, "block", "units"), [*key, "block"]).select(
        *key, F.struct("block", F.pmod(F.xxhash64("node"), "units").alias("unit")).alias("own"), "node", "v", "w", F.explode("meets").alias("other"))
    met = own.withColumn("block", F.col("other.block")).join(about, [*key, "block"]).where(F.col("other.gap") <= F.col("radius") + reach)
    met = met.withColumn("to", F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.col("units") - 1), lambda u: F.struct(F.col("block").alias("block"), u.alias("unit")))))
    return met.select(
        *key, F.xxhash64(F.least("own", "to"), F.greatest("own", "to")).alias("task"), (F.col("own") == F.col("to")).alias("alone"),
        (F.col("own") > F.col("to")).cast("int").alias("side"), "node", "v", "w")


def near_vectors(vectors: DataFrame, cosine: float = 0.98, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of (vec_id, embedding, label), extra columns ignored.

    Vectors link if their labels and lengths are equal, their labels are not null, and their cosine is ``cosine`` or
    more. Vectors that are null, empty, zero or hold null or non-finite components link with nothing. Copies are one
    vector with a weight, so that their pairs are never made. Rows whose vec_id is null link by their vectors like
    others but name no component. A vec_id that repeats is reported for each row. An empty table gives an empty result.
    """
    rows = vectors.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    fine = F.coalesce(
        F.col("label").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists("v", lambda x: x != 0), F.lit(False))
    rows = rows.withColumn("v", F.when(fine, F.transform("v", lambda x: x + 0.0))).withColumn("dim", F.size("v"))
    rows = cut(rows.withColumn("h", F.when(F.col("v").isNotNull(), F.xxhash64("v"))))
    key = ["label", "dim"]
    points = cut(
        rows.where("v is not null").groupBy(*key, "h", "v").agg(F.count("*").alias("w"), F.min("vec_id").alias("least"))
        .withColumn("node", F.xxhash64(*key, "v")))
    dealt = blocked(points, cosine, block)

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        flat = table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        ids, links, tied = block_links(
            table.column("node").to_numpy(), flat.reshape(table.num_rows, -1), table.column("w").to_numpy(), table.column("side").to_numpy(), cosine,
            table.column("alone")[0].as_py())
        some = links > 0
        return pa.table({"node": ids[some], "links": links[some], "tied": tied[some]})

    found = cut(dealt.groupBy(*key, "task").applyInArrow(run, "node long, links long, tied long"))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    of = components(found.where("node <> tied").select(F.col("node").alias("a"), F.col("tied").alias("b")))
    nodes = points.select("node", "h", *key, "v", "w", "least").join(links, "node", "left").join(of, "node", "left").withColumn(
        "component", F.coalesce("component", "node"))
    tops = nodes.groupBy("component").agg(F.min("least").alias("component_id"))
    named = nodes.join(tops, "component").select(*key, "h", "v", (F.coalesce("links", F.lit(0)) + F.col("w") - 1).alias("n_links"), "component_id")
    joined = rows.alias("r").join(named.alias("n"), [F.col(f"r.{c}") == F.col(f"n.{c}") for c in ("h", *key, "v")], "left")
    of_row = F.coalesce("n.component_id", "r.vec_id")
    return joined.select(
        "r.vec_id", F.coalesce("n.n_links", F.lit(0)).cast("long").alias("n_links"), of_row.alias("component_id"),
        F.coalesce(F.col("r.vec_id") == of_row, F.lit(False)).alias("kept"))


def op7_embedding_dedup(spark, sf_dir):
    return near_vectors(read(spark, sf_dir, "embeddings"))
