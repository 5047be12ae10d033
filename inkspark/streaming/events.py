"""Structured Streaming over event files: deduplication, rates and keyed state.

A query reads what is there (``availableNow``), keeps its progress in the shared checkpoint folder and writes Parquet
there; a second run reads only files that came since.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from inkspark.sources.tables import shared_folder


def event_stream(spark: SparkSession, sf_dir: str, files: int | None = None) -> DataFrame:
    """The events table's files as a stream with event time ``at``."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    reader = spark.readStream.schema(schema)
    reader = reader.option("maxFilesPerTrigger", files) if files else reader
    return reader.parquet(f"{sf_dir}/event[s].parquet").withColumn("at", F.col("ts").cast("timestamp"))


def run_once(stream: DataFrame, mode: str = "append", folder: str | None = None) -> DataFrame:
    """Runs the stream over all that is there and gives what it wrote."""
    spark = stream.sparkSession
    folder = folder or shared_folder(spark)
    query = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start(f"{folder}/out")
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def deduplicated(stream: DataFrame, keys: list[str], within: str) -> DataFrame:
    """The first event of each key within a span of event time."""
    return stream.withWatermark("at", within).dropDuplicatesWithinWatermark(keys)


def rates(stream: DataFrame, keys: list[str], window: str, limit: int, late: str = "0 seconds") -> DataFrame:
    """(keys, start, n, over_limit) per tumbling window that the watermark has passed."""
    counts = stream.withWatermark("at", late).groupBy(F.window("at", window), *keys).agg(F.count("*").alias("n"))
    return counts.select(*keys, F.col("window.start").alias("start"), "n", (F.col("n") > limit).alias("over_limit"))


def breaker(failures: int, cool_down: float) -> Callable[[tuple, Iterator[pd.DataFrame], GroupState], Iterator[pd.DataFrame]]:
    """A circuit breaker for each key: closed, open after so many failures in a row, one probe after the cool-down."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        mode, run, since = state.get if state.exists else ("CLOSED", 0, 0.0)
        rows = pd.concat(list(frames)).sort_values(["at", "event_id"])
        out = []
        for event_id, at, failed in zip(rows["event_id"], rows["at"].astype("int64") / 1e9, rows["failed"]):
            if mode == "OPEN" and at < since + cool_down:
                out.append((key[0], int(event_id), "REFUSED"))
                continue
            probing = mode == "OPEN"
            run = run + 1 if failed else 0
            if failed and (probing or run >= failures):
                mode, since = "OPEN", at
            elif not failed:
                mode = "CLOSED"
            out.append((key[0], int(event_id), "PROBE" if probing else "PASSED"))
        state.update((mode, int(run), float(since)))
        yield pd.DataFrame(out, columns=["user_id", "event_id", "outcome"])

    return step


def broken(stream: DataFrame, failures: int = 2, cool_down: float = 3600) -> DataFrame:
    """(user_id, event_id, outcome) for each event; an error is a failure of its user's circuit."""
    rows = stream.select("user_id", "event_id", "at", (F.col("event_type") == "error").alias("failed"))
    return rows.groupBy("user_id").applyInPandasWithState(
        breaker(failures, cool_down), "user_id long, event_id long, outcome string", "mode string, run long, since double", "append", GroupStateTimeout.NoTimeout)


def merge_batch(folder: str, keys: list[str]) -> Callable[[DataFrame, int], None]:
    """A sink that adds rows whose keys it doesn't hold yet. Each batch is a partition of one table, written over if the
    batch comes again, so a replay adds nothing twice. A batch reads the keys of the partitions before it once."""

    def write(batch: DataFrame, number: int) -> None:
        from pyspark.errors import AnalysisException

        spark, new = batch.sparkSession, batch.dropDuplicates(keys)
        try:
            held = spark.read.parquet(folder).where(F.col("batch") < number).select(*keys)
            new = new.join(held, keys, "left_anti")
        except AnalysisException:  # nothing is held yet
            pass
        new.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return write
