"""Tables, and the roles that the driver's tables play for the operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Event types that play the roles of product activities.
ENROLMENT, ANALYSIS, MEANINGFUL, SESSION = "signup", "view", "purchase", "click"
#: Rows and bytes of a column that a Python step takes at a time.
PART_ROWS, PART_BYTES = 1024, 4_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_base(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; a temporary one only on a single machine that names none (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return base.rstrip("/")


def shared_folder(spark: SparkSession) -> str:
    """A new folder for written tables that all machines can see."""
    return f"{shared_base(spark)}/{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder, so that its rows and partitions stay as they are."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(shared_base(df.sparkSession))
    return df.checkpoint(eager=True)


def parts(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """Arrow batches in slices of ``PART_ROWS`` rows at most and about ``PART_BYTES`` of a column of texts or bytes, one row at least: a
    batch holds as many rows as Spark gives it, however long they are."""
    for batch in batches:
        texts = batch.column(column)
        texty = pa.types.is_string(texts.type) or pa.types.is_binary(texts.type) or pa.types.is_large_string(texts.type)
        sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False) if texty else np.zeros(len(texts), np.int64)
        ends, start = np.cumsum(sizes, dtype=np.int64), 0
        while start < batch.num_rows:
            stop = int(np.searchsorted(ends, (ends[start - 1] if start else 0) + PART_BYTES, "right"))
            stop = min(max(stop, start + 1), start + PART_ROWS)
            yield batch.slice(start, stop - start)
            start = stop


def as_of(events: DataFrame) -> DataFrame:
    """One row with the last time that is known."""
    return events.agg(F.max("ts").alias("as_of"))


def participants(events: DataFrame) -> DataFrame:
    """(user_id, enrolled_at, cohort): enrolment is the first signup."""
    return events.where(F.col("event_type") == ENROLMENT).groupBy("user_id").agg(F.min("ts").alias("enrolled_at")).withColumn(
        "cohort", F.col("user_id") % 2)


def millis(column: Column | str) -> Column:
    return F.unix_millis(F.col(column).cast("timestamp") if isinstance(column, str) else column.cast("timestamp"))


def hours(n: int) -> Column:
    return F.make_dt_interval(F.lit(0), F.lit(n))


def blocks(documents: DataFrame) -> DataFrame:
    """(doc_id, ordinal, text): a document's lines as blocks."""
    return documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("ordinal", "text"))


def usage(lineitem: DataFrame) -> DataFrame:
    """Line items as provider usage: the order is the invocation, the line its attempt."""
    return lineitem.select(
        F.col("l_orderkey").alias("invocation_id"), F.col("l_linenumber").alias("attempt_number"), F.col("l_partkey").alias("model_id"),
        F.when(F.col("l_linestatus") == "F", "SUCCEEDED").otherwise("FAILED").alias("status"),
        F.when(F.col("l_returnflag") != "N", (F.col("l_quantity") * 1000).cast("long")).alias("input_tokens"),
        F.when(F.col("l_linenumber") != 3, (F.col("l_linenumber") * 7000).cast("long")).alias("cached_tokens"),
        F.when(F.col("l_returnflag") != "N", (F.col("l_quantity") * 10).cast("long")).alias("output_tokens"),
        F.when(F.col("l_linenumber") != 5, (F.col("l_quantity") * 20 + F.col("l_linenumber")).cast("long")).alias("latency_ms"),
        F.col("l_shipdate").alias("created_at"))


def prices(part: DataFrame) -> DataFrame:
    """Parts as a price list in micro-units per million; models whose size is a multiple of 7 aren't listed."""
    return part.where(F.col("p_size") % 7 != 0).select(
        F.col("p_partkey").alias("model_id"), F.lit(1_000_000).cast("long").alias("input_rate"),
        F.when(F.col("p_size") % 5 != 0, F.lit(250_000)).cast("long").alias("cached_rate"), F.lit(2_000_000).cast("long").alias("output_rate"))
