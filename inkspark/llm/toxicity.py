"""Toxicity: averaged subword embeddings under a linear softmax, trained jointly in numpy.

A text is cut into windows of ``window`` words (the last may be shorter). A window's vector is the mean of the
embeddings of its words' character n-grams and whole-word hashes; a linear softmax turns it into two logits. The
document's margin is the largest of its windows' (in training a smooth maximum), so that a long text doesn't dilute
a short insult. Misspelt words share n-gram vectors with those seen.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from inkspark.llm.arrays import coded_words, give_back, segment_sums, slices, subwords
from inkspark.llm.common import held_out, read


@dataclass(frozen=True)
class Settings:
    """``fit_rows`` and ``fit_chars`` bound the sample that the model is fitted on: so many labelled rows of each class, and
    so many characters of theirs in all. Texts of any length are in it, whole."""

    shortest: int = 3
    longest: int = 5
    buckets: int = 1 << 16
    dim: int = 8
    window: int = 6
    steps: int = 300
    batch: int = 32
    rate: float = 0.15
    sharp: float = 2.0
    fit_rows: int = 2000
    fit_chars: int = 6_000_000
    seed: int = 5


def split_words(texts: pa.Array) -> pa.Array:
    return pc.utf8_split_whitespace(pc.utf8_trim_whitespace(pc.utf8_lower(texts)))


def windows(offsets: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first window of each document) over words; every document has one window at least."""
    sizes = np.diff(offsets)
    per = np.maximum(1, -(-sizes // window))
    firsts = np.concatenate([[0], np.cumsum(per)[:-1]]).astype(np.int64)
    owner = np.repeat(np.arange(len(sizes)), per)
    starts = offsets[owner] + (np.arange(per.sum()) - firsts[owner]) * window
    return starts, np.minimum(starts + window, offsets[1:][owner]), firsts


def margins(texts: pa.Array, weights: np.ndarray, bias: float, s: Settings) -> np.ndarray:
    """Each text's margin. ``weights``: every bucket's embedding times the difference of the softmax's rows."""
    out = np.empty(len(texts))
    for at, part in slices(texts):
        offsets, codes, words = coded_words(split_words(part))
        ids, ends = subwords(words, s.shortest, s.longest, s.buckets)
        some = pc.not_equal(words, "").to_numpy(zero_copy_only=False)  # a text without words splits into an empty one
        sums, counts = segment_sums(weights[ids], ends[:-1], ends[1:]) * some, np.diff(ends) * some
        starts, stops, firsts = windows(offsets, s.window)
        total = segment_sums(counts[codes], starts, stops)
        each = segment_sums(sums[codes], starts, stops) / np.maximum(total, 1) + bias
        out[at : at + len(part)] = np.maximum.reduceat(each, firsts)
    return out


def fit(texts: list[str], labels: np.ndarray, s: Settings) -> tuple[np.ndarray, float]:
    """Trains embeddings and softmax together by Adagrad over small batches; gives (weights, bias) for ``margins``."""
    rng = np.random.default_rng(s.seed)
    offsets, codes, words = coded_words(split_words(pa.array(texts, pa.large_string())))
    ids, ends = subwords(words, s.shortest, s.longest, s.buckets)
    counts = np.diff(ends)
    table = rng.uniform(-0.5, 0.5, (s.buckets, s.dim)).astype(np.float32)
    top, bias = rng.uniform(-0.5, 0.5, (s.dim, 2)).astype(np.float32), np.zeros(2, np.float32)
    seen = [np.full(x.shape, 1e-6, np.float32) for x in (table, top, bias)]
    toxic = max(1, int(labels.sum()))
    weight = np.where(labels == 1, len(labels) / (2 * toxic), len(labels) / (2 * max(1, len(labels) - toxic)))
    for _ in range(max(2, -(-s.steps * s.batch // len(texts)))):
        order = rng.permutation(len(texts))
        for low in range(0, len(order), s.batch):
            docs = order[low : low + s.batch]
            sizes = offsets[docs + 1] - offsets[docs]
            own = np.concatenate([[0], np.cumsum(sizes)])
            took = codes[np.repeat(offsets[docs] - own[:-1], sizes) + np.arange(own[-1])]
            starts, stops, firsts = windows(own, s.window)
            # Distinct words once: a window's sum is made of its words' sums.
            used, inverse = np.unique(took, return_inverse=True)
            n = counts[used]
            begin = np.concatenate([[0], np.cumsum(n)])
            grams = ids[np.repeat(ends[used] - begin[:-1], n) + np.arange(begin[-1])]
            vectors = np.add.reduceat(table[grams], begin[:-1], axis=0) if len(used) else np.zeros((0, s.dim), np.float32)
            occurrences = vectors[inverse]
            running = np.concatenate([np.zeros((1, s.dim)), np.cumsum(occurrences, axis=0, dtype=np.float64)])
            total = np.maximum(segment_sums(n[inverse], starts, stops), 1)
            means = ((running[stops] - running[starts]) / total[:, None]).astype(np.float32)
            logits = means @ top + bias
            margin = s.sharp * (logits[:, 1] - logits[:, 0])
            owner = np.repeat(np.arange(len(docs)), np.diff(np.concatenate([firsts, [len(starts)]])))
            peak = np.maximum.reduceat(margin, firsts)
            share = np.exp(margin - peak[owner])
            mass = np.add.reduceat(share, firsts)
            pooled = (peak + np.log(mass)) / s.sharp
            error = (1 / (1 + np.exp(-np.clip(pooled, -30, 30))) - labels[docs]) * weight[docs] / len(docs)
            step = (share / mass[owner] * error[owner]).astype(np.float32)
            sides = np.stack([-step, step], axis=1)
            back = (sides @ top.T) / total[:, None].astype(np.float32)
            window_of = np.repeat(np.arange(len(starts)), stops - starts)
            by_word = np.stack([np.bincount(inverse, back[window_of, k], len(used)) for k in range(s.dim)], axis=1)
            gram_back = np.repeat(by_word, n, axis=0)
            rows, where = np.unique(grams, return_inverse=True)
            slope = np.stack([np.bincount(where, gram_back[:, k], len(rows)) for k in range(s.dim)], axis=1).astype(np.float32)
            seen[0][rows] += slope * slope
            slopes = (means.T @ sides, sides.sum(axis=0))
            table[rows] -= 4 * s.rate * slope / np.sqrt(seen[0][rows])
            for x, g, old in zip((top, bias), slopes, seen[1:]):
                old += g * g
                x -= s.rate * g / np.sqrt(old)
    return (table @ (top[:, 1] - top[:, 0])).astype(np.float64), float(bias[1] - bias[0])


def sample(docs: DataFrame, labels: DataFrame, label: str, s: Settings) -> tuple[list[str], np.ndarray]:
    """At most ``fit_rows`` labelled texts of each class, ``fit_chars`` characters in all, by the order of a hash of doc_id.

    Labels are joined with the documents that there are before they are counted, so that labels of others don't use up
    the sample; only ids and lengths take part in that join.
    """
    mix = F.xxhash64(F.lit(s.seed), "doc_id")
    known = labels.where(~held_out() & F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).select("doc_id", F.col(label).cast("int").alias("_label"))
    docs = docs.where(F.col("text").rlike(r"\S"))
    sizes = docs.groupBy("doc_id").agg(F.max(F.length("text")).alias("_n"))
    usable = known.distinct().join(sizes, "doc_id").withColumn("_mix", mix)
    order = Window.partitionBy("_label").orderBy("_mix", "doc_id")
    first = usable.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= s.fit_rows)
    chosen = first.withColumn("_sum", F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, 0))).where((F.col("_sum") <= s.fit_chars) | (F.col("_rank") == 1))
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen.select("doc_id", "_label", "_mix")), "doc_id")  # 2 * fit_rows
    got = rows.orderBy("_mix", "_label", "text").limit(2 * s.fit_rows).select("text", "_label").toPandas()
    return got["text"].tolist(), got["_label"].to_numpy(np.int64)


def score(docs: DataFrame, weights: np.ndarray, bias: float, s: Settings = Settings()) -> DataFrame:
    """All columns of ``docs`` with ``score``; a null or empty text gets the score of the bias alone."""
    docs = docs.drop("score")
    shared = docs.sparkSession.sparkContext.broadcast((weights, bias, s))

    def run(batches):
        for batch in batches:
            weights, bias, s = shared.value
            margin = margins(batch.column("text"), weights, bias, s) if batch.num_rows else np.empty(0)
            yield batch.append_column("score", pa.array(1 / (1 + np.exp(-np.clip(margin, -500, 500)))))

    schema = StructType([*docs.schema.fields, StructField("score", DoubleType())])
    return docs.mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, label: str = "toxic", threshold: float = 0.3, settings: Settings = Settings()) -> DataFrame:
    """All columns of ``docs`` (doc_id, text and any more) with ``held_out``, ``score`` (0 to 1) and ``predicted``.

    The model is fitted on a bounded sample of the labelled documents that aren't held out, and scores every row from
    its whole text alone. Without labels of both classes the model knows nothing and every score is 0.5 or near it.
    Null and empty texts have a score too, very long ones are scored whole; rows that repeat are scored alike; columns named like an output are replaced;
    an empty table gives an empty result.
    """
    docs = docs.drop("held_out", "score", "predicted")
    texts, marks = sample(docs, labels, label, settings)
    weights, bias = fit(texts, marks, settings) if texts else (np.zeros(settings.buckets), 0.0)
    del texts
    give_back()
    return (
        score(docs, weights, bias, settings).withColumn("held_out", held_out())
        .withColumn("predicted", (F.col("score") >= threshold).cast("int")))


def op5_toxicity(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return classify(docs, read(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")
