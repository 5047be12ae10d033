"""Zipped books as binary columns, and tables that are published by a pointer."""

from __future__ import annotations

import io
import re
import zipfile

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkspark.sources.markup import page_blocks
from inkspark.sources.tables import parts, shared_folder

__all__ = ["entries", "published", "shared_folder", "zipped"]

MOST_ENTRIES, MOST_BYTES, MOST_RATIO = 10_000, 64_000_000, 200


def zipped(pages: DataFrame) -> DataFrame:
    """(page_id, content): each page as the one chapter of an archive."""

    def run(batches):
        for batch in parts(batches, "html"):
            out = []
            for html in batch.column("html").to_pylist():
                buffer = io.BytesIO()
                with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as book:
                    book.writestr(zipfile.ZipInfo("text/chapter1.xhtml"), html or "")
                out.append(buffer.getvalue())
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), pa.array(out, pa.binary())], ["page_id", "content"])

    return pages.select("page_id", "html").mapInArrow(run, f"page_id {pages.schema['page_id'].dataType.simpleString()}, content binary")


def faulty(pages: DataFrame) -> DataFrame:
    """(page_id, content): archives with a fault by the id's remainder: 0 a name that leaves the folder, 1 cut short, 2 an
    entry that grows too much, 3 a changed byte, 4 none."""

    def run(batches):
        for batch in parts(batches, "html"):
            out = []
            for page_id, html in zip(batch.column("page_id").to_pylist(), batch.column("html").to_pylist()):
                fault, buffer = page_id % 5, io.BytesIO()
                with zipfile.ZipFile(buffer, "w", zipfile.ZIP_STORED if fault == 3 else zipfile.ZIP_DEFLATED) as book:
                    name = "../chapter.xhtml" if fault == 0 else "text/chapter1.xhtml"
                    book.writestr(zipfile.ZipInfo(name), " " * 3_000_000 if fault == 2 else html or "<p>x</p>", zipfile.ZIP_DEFLATED if fault == 2 else None)
                content = bytearray(buffer.getvalue())
                if fault == 1:
                    del content[len(content) // 2 :]
                if fault == 3:
                    content[30 + len("text/chapter1.xhtml")] ^= 1
                out.append(bytes(content))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), pa.array(out, pa.binary())], ["page_id", "content"])

    return pages.select("page_id", "html").mapInArrow(run, f"page_id {pages.schema['page_id'].dataType.simpleString()}, content binary")


def problem(book: zipfile.ZipFile, size: int) -> str | None:
    """Why an archive isn't read: too many or too large entries, too good a ratio, or unsafe names."""
    infos = book.infolist()
    total = sum(x.file_size for x in infos)
    if len(infos) > MOST_ENTRIES:
        return "ENTRIES"
    if total > MOST_BYTES:
        return "BYTES"
    if total > MOST_RATIO * max(size, 1):
        return "RATIO"
    if any(re.match(r"/|[A-Za-z]:|[a-z]+:", x.filename) or "\\" in x.filename or {"..", "."} & set(x.filename.split("/")) for x in infos):
        return "PATH"
    return None


def entries(books: DataFrame) -> DataFrame:
    """(page_id, entry, kind, blocks, error) for each kind of block in an archive's chapters, in order of names."""

    def run(batches):
        for batch in parts(batches, "content"):
            owner, rows = [], []
            for i, content in enumerate(batch.column("content").to_pylist()):
                try:
                    with zipfile.ZipFile(io.BytesIO(content or b"")) as book:
                        bad = problem(book, len(content))
                        if not bad and book.testzip():
                            bad = "CHECKSUM"
                        found = [(None, None, 0, bad)] if bad else []
                        for name in [] if bad else sorted(book.namelist()):
                            kinds = [b[0] for b in page_blocks(book.read(name).decode("utf-8", "replace"))]
                            found += [(name, k, kinds.count(k), None) for k in sorted(set(kinds))]
                except zipfile.BadZipFile:
                    found = [(None, None, 0, "CORRUPT")]
                owner += [i] * len(found)
                rows += found
            types = (pa.string(), pa.string(), pa.int64(), pa.string())
            columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([batch.column("page_id").take(pa.array(owner, pa.int64())), *columns], ["page_id", "entry", "kind", "blocks", "error"])

    kind = books.schema["page_id"].dataType.simpleString()
    return books.mapInArrow(run, f"page_id {kind}, entry string, kind string, blocks long, error string")


def published(blocks: DataFrame, folder: str, version: int = 1) -> DataFrame:
    """Appends blocks as a version, then moves the pointer; gives the blocks that the pointer names."""
    spark = blocks.sparkSession
    stored = blocks.withColumn("hash", F.sha2("text", 256)).withColumn("version", F.lit(version))
    stored.write.mode("append").partitionBy("version").parquet(f"{folder}/blocks")
    spark.range(1).select(F.lit(version).alias("version")).write.mode("overwrite").parquet(f"{folder}/current")
    current = spark.read.parquet(f"{folder}/current")
    return spark.read.parquet(f"{folder}/blocks").join(F.broadcast(current), "version", "left_semi")  # one row
