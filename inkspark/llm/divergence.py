"""How the sources of a language differ in the terms they use, from wide term vectors.

One pass counts terms by (language, source, term), with the documents that hold them. Each term kept becomes one row with
an array of counts, a place for each source of its language. Shares, differences between all pairs of sources and the
terms that a source uses most above its language come from array functions over that row alone; sums over terms are
partial sums first, so an exchange carries a number for each pair of sources and task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkspark.llm.arrays import coded_words, slices
from inkspark.llm.common import cut, read

#: Bytes of texts that a task counts at a time.
SLICE = 8_000_000
#: What stands for each byte: terms are runs of letters, that is of all but ASCII characters other than A-Z and a-z.
BYTES = np.array([b if b >= 128 or chr(b).isalpha() else 32 for b in range(256)], np.uint8)
BYTES[ord("A") : ord("Z") + 1] += 32
#: Parts that a language's terms are dealt to, each with a copy of the language's row.
SALTS = 32


def share(count, total, kept):
    """1 + floor(10^9 * (count + 5) / (total + 5 * kept)), exact in longs while the divisor is below 9 * 10^15.

    The quotient is built in three steps of three decimal digits, as the product with 10^9 could leave the long range.
    """
    divisor = total + 5 * kept
    whole, rest = F.lit(0), count + 5
    for _ in range(3):
        scaled = rest * 1000
        whole, rest = whole * 1000 + F.call_function("div", scaled, divisor), scaled % divisor
    return whole + 1


def terms_only(texts: pa.Array) -> pa.Array:
    """``texts`` (large strings without nulls) with A-Z small and a space for each character that belongs to no term.

    One look-up of bytes does it, as UTF-8 has no ASCII byte inside another character.
    """
    offsets, data = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1], np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    shown = BYTES[data[offsets[0] : offsets[-1]]]
    return pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(offsets - offsets[0]), pa.py_buffer(shown))


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences, and rows that hold the term, of each group, from columns without nulls.
    Tasks count slices of texts, so that a slice gives each term of a group once; their sums are partial sums again."""

    def run(batches):
        for batch in batches:
            langs, sources = batch.column("lang").dictionary_encode(), batch.column("source").dictionary_encode()
            many = len(sources.dictionary)
            group = langs.indices.to_numpy(zero_copy_only=False).astype(np.int64) * many + sources.indices.to_numpy(zero_copy_only=False)
            for at, texts in slices(batch.column("text"), SLICE):
                offsets, codes, terms = coded_words(pc.split_pattern(terms_only(texts), " "))
                row, width = np.repeat(np.arange(len(texts)), np.diff(offsets)), max(1, len(terms))
                # Occurrences in each row, then sums and rows of each group.
                held, n = np.unique(row * width + codes, return_counts=True)
                cells, place = np.unique(group[at + held // width] * width + held % width, return_inverse=True)
                own, code = cells // width, cells % width
                yield pa.RecordBatch.from_arrays(
                    [langs.dictionary.take(pa.array(own // many)), sources.dictionary.take(pa.array(own % many)), terms.take(pa.array(code)).cast(pa.string()),
                     pa.array(np.bincount(place, n, len(cells)).astype(np.int64)), pa.array(np.bincount(place, minlength=len(cells)).astype(np.int64))],
                    ["lang", "source", "term", "n", "docs"])

    found = docs.select("text", "lang", "source").mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return found.where("term <> ''").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def wide(counts: DataFrame, sources: DataFrame, least: int) -> DataFrame:
    """(lang, term, counts): for each term in ``least`` documents of its language its count in each source, in the order of
    ``sources`` (lang, sources). A term has at most as many rows before as its language has sources."""
    rows = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.map_from_entries(F.collect_list(F.struct("source", "n"))).alias("by_source"))
    rows = rows.where(F.col("docs") >= least).withColumn("salt", F.pmod(F.xxhash64("term"), F.lit(SALTS)).cast("int"))
    salted = sources.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    own = F.transform("sources", lambda s: F.coalesce(F.col("by_source")[s], F.lit(0).cast("long")))
    return rows.join(salted, ["lang", "salt"]).select("lang", "salt", "term", own.alias("counts"))


def divergence(docs: DataFrame, least: int = 30, ranks: int = 50) -> DataFrame:
    """(lang, source, part, item, value, rank): how far each source of a language is from its others (part ``pair``), and
    the ``ranks`` terms that it uses most above its language (part ``term``).

    Null texts, languages and sources are ''. A term is kept if ``least`` rows of its language hold it; each row counts as
    a document, so repeated rows count again, whatever their ids. A group's share of a term is ``share``, smoothed, so
    that it is never 0. The value of a pair is the sum over the kept terms of the difference of shares, 0 if none is
    kept; of a term its share above the language's. Ties rank by item in the order of UTF-8 bytes. A language with one source
    has no pairs. Texts are taken whole; further columns are ignored; an empty table gives an empty result.
    """
    docs = docs.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("text", "lang", "source")))
    sources = cut(docs.select("lang", "source").distinct().groupBy("lang").agg(F.sort_array(F.collect_list("source")).alias("sources")))
    vectors = cut(wide(term_counts(docs), sources, least))
    sums = vectors.select("lang", "term", F.posexplode("counts").alias("at", "n")).groupBy("lang", "at").agg(F.sum("n").alias("n"), F.count("*").alias("kept"))
    totals = sums.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("at", "n")))["n"].alias("totals"), F.max("kept").alias("kept"))
    salted = totals.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    added = lambda column: F.aggregate(column, F.lit(0).cast("long"), lambda a, x: a + x)
    shares = cut(vectors.join(salted, ["lang", "salt"]).select(
        "lang", "term", "counts", F.zip_with("counts", "totals", lambda c, n: share(c, n, F.col("kept"))).alias("shares"),
        share(added("counts"), added("totals"), F.col("kept")).alias("usual")))

    def pairs_of(column, pair):
        later = lambda x, i: F.transform(F.slice(column, i + 2, F.size(column)), lambda y: pair(x, y))
        return F.flatten(F.transform(column, later))

    far = shares.select("lang", F.posexplode(pairs_of(F.col("shares"), lambda x, y: F.abs(x - y))).alias("at", "f"))
    far = far.groupBy("lang", "at").agg(F.sum("f").alias("f"))
    named = sources.select("lang", F.posexplode(pairs_of(F.col("sources"), lambda x, y: F.struct(x.alias("a"), y.alias("b")))).alias("at", "pair"))
    pairs = named.join(far, ["lang", "at"], "left").select("lang", "pair.a", "pair.b", F.coalesce("f", F.lit(0)).cast("long").alias("value"))
    both = pairs.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "value").union(pairs.select("lang", "b", "a", "value"))
    above = shares.select("lang", "term", "usual", F.posexplode(F.arrays_zip("counts", "shares")).alias("at", "x"))
    above = above.where("x.counts > 0 and x.shares > usual").select("lang", "at", F.col("term").alias("item"), (F.col("x.shares") - F.col("usual")).alias("value"))
    # The first ranks of a source are taken in each task before rows are exchanged.
    rank = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("value"), "item"))
    above = above.withColumn("rank", rank("lang", "at")).where(F.col("rank") <= ranks)
    names = sources.select("lang", F.posexplode("sources").alias("at", "source"))
    columns = ["lang", "source", "part", "item", "value", "rank"]
    pair_part = both.withColumn("rank", rank("lang", "source")).withColumn("part", F.lit("pair")).select(columns)
    return pair_part.union(above.join(names, ["lang", "at"]).withColumn("part", F.lit("term")).select(columns))


def op12_source_divergence(spark, sf_dir):
    return divergence(read(spark, sf_dir, "documents"))
