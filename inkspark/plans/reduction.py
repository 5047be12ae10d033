"""Bounded hierarchical reduction with a deterministic analyser in the place of a remote one."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from functools import reduce

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkspark.sources.tables import checkpointed, shared_folder

MOST_ROUNDS = 12


def head(texts: list[str]) -> str:
    """The analyser by default: a digest of the batch and the start of its first text."""
    joined = "\n".join(texts)
    return hashlib.sha256(joined.encode()).hexdigest()[:16] + " " + texts[0][:64]


def batches_of(texts: list[str], limit: int) -> list[list[str]]:
    """Texts in order, as many to a batch as fit with a character between; longer ones are cut to the limit."""
    out, size = [], limit + 1
    for text in (t[i : i + limit] for t in texts for i in range(0, max(1, len(t)), limit)):
        if size + 1 + len(text) > limit:
            out.append([])
            size = -1
        out[-1].append(text)
        size += 1 + len(text)
    return out


def reduce_texts(texts: list[str], limit: int, analyse: Callable[[list[str]], str] = head) -> tuple[str, int]:
    """(answer, rounds): one batch's answer is final; each round must make the whole shorter."""
    for number in range(1, MOST_ROUNDS + 1):
        groups = batches_of(texts, limit)
        answers = [analyse(g) for g in groups]
        if len(answers) == 1:
            return answers[0], number
        if len("\n".join(answers)) >= len("\n".join(texts)):
            raise ValueError("a round made nothing shorter")
        texts = answers
    raise ValueError("too many rounds")


class ReductionFailed(RuntimeError):
    """The analyser failed for some batches; what it answered to the others is remembered."""


def batched(units: DataFrame, limit: int) -> DataFrame:
    """(doc_id, batch, texts, size): a document's units (doc_id, place, text) in order, as many to a batch as fit with a character
    between; longer ones are cut. ``size`` is the length of all. Units stream through a task in order, which holds one batch at a time,
    so a document may be of any size."""
    kind = units.schema["doc_id"].dataType.simpleString()

    def filled(batches):
        own, number, texts, used = None, -1, [], 0
        for rows in batches:
            for key, whole in zip(rows.column("doc_id").to_pylist(), rows.column("text").to_pylist()):
                if (key,) != own:
                    if texts:
                        yield own[0], number, texts
                    own, number, texts, used = (key,), 0, [], 0
                for text in (whole[i : i + limit] for i in range(0, max(1, len(whole)), limit)):
                    if texts and used + 1 + len(text) > limit:
                        yield key, number, texts
                        number, texts, used = number + 1, [], 0
                    used += len(text) + (1 if texts else 0)
                    texts.append(text)
        if texts:
            yield own[0], number, texts

    def run(batches):
        made, chars = [], 0
        for row in filled(batches):
            made.append(row)
            chars += sum(map(len, row[2]))
            if chars > 4_000_000 or len(made) > 10_000:
                yield record(made)
                made, chars = [], 0
        yield record(made)

    field = pa.int64() if kind == "bigint" else pa.int32() if kind == "int" else pa.string()

    def record(made):
        keys, numbers, texts = zip(*made) if made else ([], [], [])
        sizes = [len("\n".join(x)) for x in texts]
        return pa.RecordBatch.from_arrays([pa.array(keys, field), pa.array(numbers, pa.int64()), pa.array(texts, pa.list_(pa.string())), pa.array(sizes, pa.int64())], ["doc_id", "batch", "texts", "size"])

    ordered = units.select("doc_id", "place", "text").repartition("doc_id").sortWithinPartitions("doc_id", "place")
    return ordered.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, batch long, texts array<string>, size long")


def reduced(documents: DataFrame, limit: int, analyse: Callable[[list[str]], str] = head, memo: str | None = None, run: str = "run", stage: str = "BOOK") -> DataFrame:
    """(doc_id, answer, rounds, error): each document's lines, reduced level by level until one answer is left.

    A level is a distributed round for all documents that are still open. Answers are kept in the folder ``memo`` by (run, stage,
    document, level, batch, hash of the input), and what is there is not asked again: a second run asks nothing, and one
    after ``ReductionFailed`` only what had failed. A null text is an empty line. A document whose answers don't get
    shorter, or that isn't done after twelve levels, has the error DID_NOT_CONVERGE.
    """
    spark = documents.sparkSession
    folder = memo or shared_folder(spark)
    kind = documents.schema["doc_id"].dataType.simpleString()
    columns = f"level int, doc_id {kind}, batch long, input_hash string, answer string"

    def ask(batches):
        for batch in batches:
            answers, errors = [], []
            for texts in batch.column("texts").to_pylist():
                try:
                    answer, error = analyse(texts), None
                except Exception as failure:  # whatever a provider raises
                    answer, error = None, f"{type(failure).__name__}: {failure}"
                answers.append(answer)
                errors.append(error)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "batch", "input_hash")), pa.array(answers, pa.string()), pa.array(errors, pa.string())], ["doc_id", "batch", "input_hash", "answer", "error"])

    def remembered(level: int) -> DataFrame:
        path = f"{folder}/run={run}/stage={stage}"
        try:
            known = spark.read.schema(columns).parquet(path)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            known = spark.createDataFrame([], columns)
        return known.where(F.col("level") == level).drop("level")

    same = lambda a, b: reduce(lambda x, y: x & y, [a[c].eqNullSafe(b[c]) for c in ("doc_id", "batch", "input_hash")])
    units = documents.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("place", "text")).withColumn("place", F.col("place").cast("long"))
    done = []
    for level in range(1, MOST_ROUNDS + 1):
        table = shared_folder(spark)
        batched(units, limit).withColumn("input_hash", F.sha2(F.to_json("texts"), 256)).write.parquet(table)
        inputs = spark.read.parquet(table)
        known = remembered(level)
        open_ = inputs.join(known, same(inputs, known), "left_anti").select("doc_id", "batch", "input_hash", "texts")
        answers = checkpointed(open_.mapInArrow(ask, f"doc_id {kind}, batch long, input_hash string, answer string, error string"))
        fresh = answers.where("error is null").select(F.lit(level).alias("level"), "doc_id", "batch", "input_hash", "answer")
        if not fresh.isEmpty():
            fresh.write.mode("append").parquet(f"{folder}/run={run}/stage={stage}")
        failed = answers.where("error is not null").agg(F.count("*").alias("n"), F.min("error").alias("first")).first()
        if failed["n"]:
            raise ReductionFailed(f"{failed['n']} batches of level {level} failed, among them: {failed['first']}")
        known = remembered(level)
        answered = inputs.join(known, same(inputs, known)).select(inputs.doc_id, inputs.batch, "size", "answer")
        joined = lambda size: F.sum(size) + F.count("*") - 1
        sums = answered.groupBy("doc_id").agg(F.count("*").alias("n"), joined("size").alias("before"), joined(F.length("answer")).alias("after"), F.max("answer").alias("answer"))
        sums = checkpointed(sums.withColumn("stuck", (F.col("n") > 1) & ((F.col("after") >= F.col("before")) | F.lit(level == MOST_ROUNDS))))
        done.append(sums.where("n = 1 or stuck").select(
            "doc_id", F.when(~F.col("stuck"), F.col("answer")).alias("answer"), F.lit(level).alias("rounds"), F.when(F.col("stuck"), "DID_NOT_CONVERGE").alias("error")))
        more = sums.where("n > 1 and not stuck").select(F.col("doc_id").alias("own"))
        units = checkpointed(answered.join(more, F.col("doc_id").eqNullSafe(F.col("own")), "left_semi").select("doc_id", F.col("batch").alias("place"), F.col("answer").alias("text")))
        if units.isEmpty():
            break
    return reduce(DataFrame.union, done)
