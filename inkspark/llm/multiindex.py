"""Exact top-k search over binary codes by incremental multi-index hashing.

Codes of 64 x W bits are cut into m segments, each with an index from its value to the codes that have it. In round s
every open query probes each segment with all values at s differing bits. After round s each code within
m * (s + 1) - 1 bits of the query has been met, by the pigeonhole principle. A query closes once its k-th best verified
distance is covered; so the radius grows for as few queries as need it, and the result is exact.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations
from math import log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkspark.llm.common import cut, read

SALTS = 64


def coded(vectors: DataFrame, words: int) -> DataFrame:
    """(vec_id, code): a bit for each component, 1 if it is above zero; null and missing components are 0."""

    def run(batches):
        for batch in batches:
            lists = batch.column("embedding")
            codes = np.zeros((len(lists), words * 64), bool)
            for i, value in enumerate(lists.to_pylist()):
                codes[i, : len(value)] = [x is not None and x > 0 for x in value]
            packed = np.packbits(codes, axis=1, bitorder="little").view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(list(packed), pa.list_(pa.int64()))], ["vec_id", "code"])

    return vectors.select("vec_id", "embedding").mapInArrow(run, f"vec_id {vectors.schema['vec_id'].dataType.simpleString()}, code array<long>")


def distance(a: str, b: str, words: int):
    return reduce(lambda x, y: x + y, [F.bit_count(F.col(a)[w].bitwiseXOR(F.col(b)[w])) for w in range(words)])


def segments(bits: int, n: int) -> list[np.ndarray]:
    """The bits dealt into segments of about log2(n) - 2 bits each, at least 8 and at most 20: four codes to a value keep
    verification cheap, and narrower segments need far fewer probes."""
    width = min(20, max(8, round(log2(max(n, 2))) - 2))
    return np.array_split(np.arange(bits), -(-bits // width))


def segment_values(codes: np.ndarray, segment: np.ndarray) -> np.ndarray:
    """The segment's value in each code (rows of 64-bit words)."""
    picked = (codes[:, segment // 64].view(np.uint64) >> (segment % 64).astype(np.uint64)) & np.uint64(1)
    return (picked << np.arange(len(segment), dtype=np.uint64)).sum(axis=1, dtype=np.uint64).astype(np.int64)


def keyed(rows: DataFrame, schema: str, parts: list[np.ndarray], radius: int) -> DataFrame:
    """``rows`` with (segment, value) for each value at exactly ``radius`` differing bits of a segment."""
    masks = [np.array([sum(1 << b for b in c) for c in combinations(range(len(p)), radius)], np.int64) for p in parts]

    def run(batches):
        for batch in batches:
            for low in range(0, batch.num_rows, 64):
                some = batch.slice(low, 64)
                codes = np.array(some.column("code").to_pylist(), np.int64).reshape(some.num_rows, -1)
                for j, (part, mask) in enumerate(zip(parts, masks)):
                    if not len(mask):
                        continue
                    values = segment_values(codes, part)[:, None] ^ mask[None, :]
                    at = pa.array(np.repeat(np.arange(some.num_rows), len(mask)))
                    out = pa.RecordBatch.from_arrays([c.take(at) for c in some.columns], some.schema.names)
                    yield out.append_column("segment", pa.array(np.full(values.size, j, np.int32))).append_column("value", pa.array(values.ravel()))

    return rows.mapInArrow(run, f"{schema}, segment int, value long")


def smallest(rows: DataFrame, by: list[str], order: list[str], k: int) -> DataFrame:
    """The first k rows of each group; a hot group is first cut down in salted parts."""
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(SALTS)))
    part = Window.partitionBy(*by, "_salt").orderBy(*order)
    some = salted.withColumn("_rank", F.row_number().over(part)).where(F.col("_rank") <= k)
    whole = Window.partitionBy(*by).orderBy(*order)
    return some.withColumn("_rank", F.row_number().over(whole)).where(F.col("_rank") <= k).drop("_salt", "_rank")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, distance): for each query the k rows of ``vectors`` at the least Hamming distance.

    Both have (vec_id, embedding); extra columns are ignored. Ties go to the smaller vec_id, and a row isn't its own
    neighbour (rows of one vec_id neither). Rows whose vec_id or vector is null are neither queries nor neighbours;
    empty vectors have code zero. Repeated rows count once. With fewer than k other rows all of them are returned; an
    empty table gives an empty result. Copies of a code are one entry with its k + 1 smallest ids.
    """
    fine = lambda df: df.where("vec_id is not null and embedding is not null").select("vec_id", "embedding")
    longest = fine(vectors).union(fine(queries)).agg(F.max(F.size("embedding"))).first()[0] or 0
    words = max(1, -(-longest // 64))
    rows = cut(coded(fine(vectors), words).distinct())
    asks = cut(coded(fine(queries), words).distinct().withColumnRenamed("vec_id", "query_id"))
    codes = cut(rows.select("code").distinct())
    n = codes.count()
    parts = segments(words * 64, n)
    ids = smallest(rows, ["code"], ["vec_id"], k + 1).groupBy("code").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    index = cut(keyed(codes, "code array<long>", parts, 0).join(ids, "code"))
    kind = dict(asks.dtypes)["query_id"]
    open_ = asks.withColumn("bound", F.lit(words * 64))
    best = done = None
    for radius in range(max(map(len, parts)) + 1):
        probes = keyed(open_, f"query_id {kind}, code array<long>, bound int", parts, radius).alias("q")
        on = (F.col("q.segment") == F.col("i.segment")) & (F.col("q.value") == F.col("i.value"))
        gap = distance("q.code", "i.code", words)
        met = probes.join(index.alias("i"), on & (gap <= F.col("q.bound"))).select(
            "q.query_id", gap.alias("distance"), F.col("i.ids").alias("ids")).distinct()
        met = met.select("query_id", "distance", F.explode("ids").alias("vec_id")).where("vec_id <> query_id")
        if best is not None:
            met = met.union(best).distinct()
        best = cut(smallest(met, ["query_id"], ["distance", "vec_id"], k))
        covered = len(parts) * (radius + 1) - 1
        kth = best.groupBy("query_id").agg(F.count("*").alias("n"), F.max("distance").alias("far"))
        open_ = cut(
            open_.join(kth, "query_id", "left").where((F.coalesce("n", F.lit(0)) < k) | (F.col("far") > covered))
            .select("query_id", "code", F.when(F.col("n") >= k, F.col("far")).otherwise(F.lit(words * 64)).cast("int").alias("bound")))
        ready = best.join(open_.select("query_id"), "query_id", "left_anti")
        done = ready if done is None else done.union(ready)
        if covered >= words * 64 or open_.isEmpty():
            done = done if covered < words * 64 else done.union(best.join(open_.select("query_id"), "query_id", "left_semi"))
            break
        best = cut(best.join(open_.select("query_id"), "query_id", "left_semi"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "vec_id"))
    return done.select("query_id", rank.alias("rank"), "vec_id", F.col("distance").cast("int").alias("distance"))


def op8_topk_search(spark, sf_dir):
    vectors = read(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.where(F.col("vec_id") % 100 == 0))
