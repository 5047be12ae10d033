"""Language identification: multinomial naive Bayes over hashed character n-grams of words."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from inkspark.llm.arrays import coded_words, segment_sums, slices, subwords
from inkspark.llm.common import held_out, read

UNKNOWN = "und"


@dataclass(frozen=True)
class Settings:
    """``fit_rows`` bounds the sample of labelled documents that the counts are made of: that many of each language in
    expectation, chosen by a hash of doc_id. Scoring covers every row and whole texts. The matrix has a column for each
    language learned: the ``most_langs`` with the most documents, if there are more."""

    shortest: int = 1
    longest: int = 3
    buckets: int = 1 << 15
    smoothing: float = 0.5
    fit_rows: int = 4000
    most_langs: int = 200
    seed: int = 11


def words_of(texts: pa.Array, s: Settings):
    """(offsets, codes, buckets, ends) of the texts' words; words without a letter have no bucket."""
    offsets, codes, words = coded_words(pc.utf8_split_whitespace(pc.utf8_lower(texts)))
    ids, ends = subwords(words, s.shortest, s.longest, s.buckets)
    letters = pc.match_substring_regex(words, r"\p{L}").to_numpy(zero_copy_only=False).astype(bool)
    sizes = np.diff(ends)
    ids = ids[np.repeat(letters, sizes)]
    return offsets, codes, ids, np.concatenate([[0], np.cumsum(np.where(letters, sizes, 0))])


def counts(docs: DataFrame, s: Settings) -> DataFrame:
    """(lang, bucket, n) over (lang, text) rows, summed within each task first."""

    def run(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = np.array(batch.column("lang").to_pylist(), object)
            for at, part in slices(batch.column("text")):
                offsets, codes, ids, ends = words_of(part, s)
                sizes = np.diff(ends)
                owner = np.repeat(np.arange(len(part)), np.diff(offsets))
                for lang in set(langs[at : at + len(part)].tolist()):
                    own = np.bincount(codes[(langs[at : at + len(part)] == lang)[owner]], minlength=len(sizes))
                    found = np.bincount(ids, np.repeat(own, sizes), s.buckets)
                    sums[lang] = sums.get(lang, 0) + found
        for lang, n in sums.items():
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array(some.astype(np.int32)), pa.array(n[some].astype(np.int64))], ["lang", "bucket", "n"])

    return docs.select("lang", "text").mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, s: Settings = Settings()) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(languages, log-probability matrix, log priors) from rows with text and lang that aren't held out."""
    known = docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counted = known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(s.most_langs)
    totals = {r["lang"]: r["n"] for r in counted.collect()}
    chance = F.pmod(F.xxhash64(F.lit(s.seed), "doc_id"), F.lit(1 << 40)) / float(1 << 40)
    many = known.sparkSession.createDataFrame(list(totals.items()), "lang string, _many long")
    chosen = known.select("lang", "text", chance.alias("_chance")).join(F.broadcast(many), "lang").where(F.col("_chance") * F.col("_many") < s.fit_rows)
    table = counts(chosen, s).toPandas()
    langs = sorted(totals)
    matrix = np.full((s.buckets, len(langs)), s.smoothing)
    matrix[table["bucket"], np.searchsorted(langs, table["lang"])] += table["n"]
    matrix = np.log(matrix / matrix.sum(axis=0)).astype(np.float32)
    prior = np.array([totals[x] for x in langs], float)
    return langs, matrix, np.log(prior / prior.sum()) if langs else prior


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray], s: Settings = Settings()) -> DataFrame:
    """All columns of ``docs`` (text and any more) with ``lang_pred`` and ``score``, the posterior of the prediction."""
    docs = docs.drop("lang_pred", "score")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            langs, matrix, prior = shared.value
            names, scores = [UNKNOWN] * batch.num_rows, np.zeros(batch.num_rows)
            for at, part in slices(batch.column("text")) if langs else ():
                offsets, codes, ids, ends = words_of(part, s)
                some = segment_sums((np.diff(ends)[codes] > 0), offsets[:-1], offsets[1:]) > 0
                logs = np.empty((len(part), len(langs)))
                for k in range(len(langs)):
                    word = segment_sums(matrix[ids, k], ends[:-1], ends[1:])
                    logs[:, k] = segment_sums(word[codes], offsets[:-1], offsets[1:]) + prior[k]
                best = logs.argmax(axis=1)
                chance = 1 / np.exp(logs - logs.max(axis=1, keepdims=True)).sum(axis=1)
                for i in np.flatnonzero(some):
                    names[at + i], scores[at + i] = langs[best[i]], chance[i]
            yield batch.append_column("lang_pred", pa.array(names, pa.string())).append_column("score", pa.array(scores))

    schema = StructType([*docs.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    return docs.mapInArrow(run, schema)


def identify(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """All columns of ``docs`` but lang (doc_id, text and any more) with ``held_out``, ``lang_pred`` and ``score``.

    Learns from text and lang of rows that aren't held out, and predicts from text alone. Null texts and texts without
    a letter are ``und`` with score 0, as is everything if no row has a language. Rows that repeat are predicted alike,
    ties go to the language first by code point, columns named like an output are replaced, and an empty table gives
    an empty result.
    """
    docs = docs.drop("held_out", "lang_pred", "score")
    return predict(docs.drop("lang"), fit(docs, s), s).withColumn("held_out", held_out())


def op1_language_id(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return identify(docs).select("doc_id", "held_out", "lang_pred", "score")
