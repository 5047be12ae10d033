"""SimHash near-dedup by the generalised pigeonhole principle.

Fingerprints link at ``bits`` or fewer differing bits. The 64 bits are dealt into m partitions, correlated bits
together; partition i gets a threshold t_i of at least -1 (left out), and the t_i sum to bits - m + 1. Two fingerprints
within ``bits`` then differ by t_i or fewer in some partition i: otherwise they would differ by bits + 1 or more.
A dynamic program takes the thresholds (and m) of least cost, from candidate counts estimated on a bounded sample.
Every fingerprint probes with its partition keys and their variants; the join verifies the whole distance.
"""

from __future__ import annotations

from functools import partial
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkspark.llm.common import components, cut, read

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
CHUNK = 1 << 16
#: Fingerprints that the plan's estimates are made of, and the size from which a bucket counts as hot.
PLAN_SAMPLE, HOT_BUCKET = 2000, 256


def fingerprint(text: str | None, words: int) -> int:
    """Bit b is set if it is in over half of the XXH64 (seed 42) of the text's word shingles; 0 without words."""
    found = (text or "").encode("utf-8", "replace").translate(LOWER).split()
    if not found:
        return 0
    joined = b" ".join(found)
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    n = max(1, len(found) - words + 1)
    first, last = starts[:n].tolist(), ends[len(found) - n :].tolist()
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    for low in range(0, n, CHUNK):
        hashes = np.array([digest(joined[a:b], 42) for a, b in zip(first[low : low + CHUNK], last[low : low + CHUNK])], np.uint64)
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long."""

    def run(batches):
        for batch in batches:
            found = np.array([fingerprint(t.as_py(), words) for t in batch.column("text")], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    slim = docs.select("doc_id", "text")
    return slim.mapInArrow(run, f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, fp long")


def co_occurrence(fps: DataFrame) -> np.ndarray:
    """How often each pair of bits is set together, over all fingerprints (64 x 64 sums from each task)."""

    def run(batches):
        total = np.zeros((64, 64))
        for batch in batches:
            values = np.ascontiguousarray(batch.column("fp").to_numpy(zero_copy_only=False))
            for low in range(0, len(values), CHUNK):
                bits = np.unpackbits(values[low : low + CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
                total += bits.T @ bits
        a, b = np.divmod(np.arange(4096), 64)
        yield pa.RecordBatch.from_arrays([pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(total.ravel())], ["a", "b", "n"])

    rows = fps.select("fp").mapInArrow(run, "a int, b int, n double").groupBy("a", "b").agg(F.sum("n").alias("n")).toPandas()
    together = np.zeros((64, 64))
    together[rows["a"], rows["b"]] = rows["n"]
    return together


def correlation(together: np.ndarray, n: int) -> np.ndarray:
    p = np.diag(together) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    phi = np.abs((together / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread))
    np.fill_diagonal(phi, 0)
    return phi


def grouped(phi: np.ndarray, m: int) -> list[list[int]]:
    """Deals the bits into m partitions of near-equal width: each takes the bits most correlated with those it has."""
    left, parts = set(range(64)), []
    for i in range(m):
        width = len(left) // (m - i)
        part = [max(left, key=lambda b: (phi[b, list(left)].sum(), -b))]
        left.discard(part[0])
        while len(part) < width:
            best = max(left, key=lambda b: (phi[b, part].sum(), -b))
            part.append(best)
            left.discard(best)
        parts.append(sorted(part))
    return parts


def allocate(costs: list[dict[int, float]], total: int) -> tuple[float, list[int]]:
    """Thresholds that sum to ``total`` at least cost; costs[i][t] for t from -1."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for options in costs:
        after: dict[int, tuple[float, list[int]]] = {}
        for so_far, (cost, taken) in best.items():
            for t, c in options.items():
                if so_far + t not in after or cost + c < after[so_far + t][0]:
                    after[so_far + t] = (cost + c, [*taken, t])
        best = after
    return best.get(total, (float("inf"), []))


def plan(together: np.ndarray, sample: np.ndarray, n: int, bits: int) -> list[tuple[list[int], int]]:
    """(partition's bits, threshold) for each partition that is probed."""
    phi, best = correlation(together, n), (float("inf"), [])
    p = np.diag(together) / max(n, 1)
    differ = 2 * p * (1 - p)
    for m in range(1, min(8, bits + 1) + 1):
        parts = grouped(phi, m)
        costs = []
        for part in parts:
            mask = np.uint64(sum(1 << b for b in part))
            # A row at a time: the table of all pairs would be the driver's largest.
            apart = np.concatenate([np.bitwise_count((sample[k + 1 :] ^ x) & mask) for k, x in enumerate(sample)] or [np.empty(0, np.uint8)])
            # Chance of each distance: the sample's, and where it has none, that of independent bits.
            chance = np.zeros(len(part) + 1)
            chance[0] = 1
            for b in part:
                chance[1:] = chance[1:] * (1 - differ[b]) + chance[:-1] * differ[b]
                chance[0] *= 1 - differ[b]
            costs.append({-1: 0.0} | {
                t: n * sum(comb(len(part), k) for k in range(t + 1)) + 0.02 * n * n * max((apart <= t).mean() if len(apart) else 0, chance[: t + 1].sum())
                for t in range(bits + 1) if sum(comb(len(part), k) for k in range(t + 1)) <= 5000})
        cost, thresholds = allocate(costs, bits - m + 1)
        if cost < best[0]:
            best = (cost, [(part, t) for part, t in zip(parts, thresholds) if t >= 0])
    return best[1]


def signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def flips(bits: list[int], most: int) -> list[int]:
    return [signed(sum(1 << b for b in chosen)) for k in range(most + 1) for chosen in combinations(bits, k)]


def numbered(part: int, key):
    return F.struct(F.lit(part).alias("part"), key.alias("key"))


def keys(fps: DataFrame, parts: list[tuple[list[int], int]], probe: bool) -> DataFrame:
    """(part, key, fp): the key of each partition; for probing also its variants within the partition's threshold."""
    made = []
    for i, (bits, t) in enumerate(parts):
        own = F.col("fp").bitwiseAND(F.lit(signed(sum(1 << b for b in bits))))
        masks = flips(bits, t if probe else 0)
        variants = F.transform(F.array(*map(F.lit, masks)), own.bitwiseXOR)
        # A second argument of a transform's function, even one with a default, would be the index.
        made.append(F.transform(variants, partial(numbered, i)))
    return fps.select("fp", F.inline(F.concat(*made)))


def links(fps: DataFrame, bits: int) -> DataFrame:
    """(a, b) pairs of distinct fingerprints; their connected components are those of all pairs within ``bits``.

    Fingerprints of hot buckets, and those that probe one, don't meet pairwise in them. Each emits all values within half of ``bits`` of its own;
    two within ``bits`` have such a value in common, and those that share one are within ``bits``, or one more if
    ``bits`` is odd, where the distance to the value is part of the key. They are tied to the smallest at the value.
    """
    n = fps.count()
    if n < 2:
        return fps.select(F.col("fp").alias("a"), F.col("fp").alias("b")).limit(0)
    sample = fps.select("fp").orderBy(F.xxhash64("fp")).limit(PLAN_SAMPLE).toPandas()["fp"].to_numpy(np.int64).view(np.uint64)
    parts = plan(co_occurrence(fps), sample, n, bits)
    index = keys(fps, parts, False)
    hot = cut(index.groupBy("part", "key").agg(F.count("*").alias("n")).where(F.col("n") > HOT_BUCKET).select("part", "key"))
    some = not hot.isEmpty()
    if some:
        crowd = cut(keys(fps, parts, True).join(hot, ["part", "key"], "left_semi").select("fp").distinct())
        index = index.join(hot, ["part", "key"], "left_anti")
    probes = keys(fps, parts, True).alias("p")
    on = (F.col("p.part") == F.col("i.part")) & (F.col("p.key") == F.col("i.key")) & (F.col("p.fp") < F.col("i.fp"))
    near = F.bit_count(F.col("p.fp").bitwiseXOR(F.col("i.fp"))) <= bits
    pairs = probes.join(index.alias("i"), on & near).select(F.col("p.fp").alias("a"), F.col("i.fp").alias("b"))
    return pairs.union(midpoints(crowd, bits)) if some else pairs


def midpoints(fps: DataFrame, bits: int) -> DataFrame:
    """(a, b) pairs that tie each fingerprint to the smallest one at every value between them."""
    even = bits // 2
    masks = F.array(*map(F.lit, flips(list(range(64)), even)))
    near = fps.select("fp", F.explode(F.transform(masks, lambda m: F.col("fp").bitwiseXOR(m))).alias("value"))
    least = near.groupBy("value").agg(F.min("fp").alias("a"), F.count("*").alias("n")).where("n > 1").select("value", "a")
    tied = near.join(least, "value").where("a <> fp").select("a", F.col("fp").alias("b"))
    if bits % 2 == 0:
        return tied.distinct()
    # Odd: also pairs of which one is half a step further off; its key is the value, met by those at `even` from it.
    outer = F.array(*map(F.lit, [x for x in flips(list(range(64)), even + 1) if bin(x & (1 << 64) - 1).count("1") == even + 1]))
    far = fps.select("fp", F.explode(F.transform(outer, lambda m: F.col("fp").bitwiseXOR(m))).alias("value"))
    meets = near.groupBy("value").agg(F.min("fp").alias("a"))
    return tied.union(far.join(meets, "value").select("a", F.col("fp").alias("b"))).where("a <> b").distinct()


def near_groups(docs: DataFrame, words: int = 3, bits: int = 2) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs``; extra columns are ignored.

    component_id is the smallest doc_id that links reach, itself included. Null and empty texts, and those of white
    space only, have fingerprint zero and link like any other; equal texts and repeated rows have one fingerprint. Rows
    whose doc_id is null take part and get the component of their fingerprint, null if it has no other id. An empty
    table gives an empty result.
    """
    fps = cut(fingerprints(docs, words))
    distinct = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("least")))
    of = components(links(distinct.select("fp"), bits), "a", "b")
    tops = distinct.join(of, distinct.fp == of.node, "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    least = tops.groupBy("component").agg(F.min("least").alias("component_id"))
    named = tops.join(least, "component").select("fp", "component_id")
    return fps.join(named, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def near_rows(texts: DataFrame, words: int = 3, bits: int = 2) -> DataFrame:
    """(a, b) stars, a the least, of the rows of (row, text), row a text's hash; they are the fingerprints' components."""
    fps = cut(fingerprints(texts.select(F.col("row").alias("doc_id"), "text"), words).dropDuplicates(["doc_id"]))
    distinct = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("least")))
    of = components(links(distinct.select("fp"), bits), "a", "b")
    tops = distinct.join(of, distinct.fp == of.node, "left").select("fp", F.coalesce("component", "fp").alias("component"))
    named = cut(fps.join(tops, "fp").select("doc_id", "component"))
    least = named.groupBy("component").agg(F.min("doc_id").alias("a"))
    return cut(named.join(least, "component").where("a <> doc_id").select("a", F.col("doc_id").alias("b")))


def op10_simhash(spark, sf_dir):
    return near_groups(read(spark, sf_dir, "documents"))
