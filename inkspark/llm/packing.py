"""Best-fit packing of token sequences by large-item matching.

Pieces above a third of the capacity fit at most twice into a sequence: each, from the longest down, is matched with
the longest other that fits beside it. Shorter pieces then best-fit the gaps, longest first. Both run on the histogram
of lengths, which the capacity bounds however many documents there are: equal pieces are interchangeable, and so are
equally full sequences. The plan is a list of runs; a piece finds its place by its length and its rank among equals.
"""

from __future__ import annotations

import bisect
import functools
import zlib
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkspark.llm.arrays import coded_words, slices
from inkspark.llm.common import cut, range_numbered, read, running_sum

CAPACITY = 2048
#: Words whose ids a worker remembers (only a store: others are encoded each time).
REMEMBERED = 150_000
#: One pre-token of letters that case folding and composition leave letters, and such with ASCII marks after them.
LETTERS = "[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f]+"
MARKS = r"[!-&(-/:-@\[-`{-~]+"


def strings(words: pa.Array) -> list[str]:
    """A list of an array without nulls, by one call in place of one for each item."""
    return words.to_numpy(zero_copy_only=False).tolist()


class Words:
    """Ids of whole texts, word by word.

    The vocabulary's pre-tokenizer never joins characters over white space, which it drops. So a text's ids are those
    of its words in turn, and each distinct word is encoded once. Words known to be one or two pre-tokens are encoded
    many in a line and told apart by the tokens that end a pre-token; all others are encoded alone.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closes[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.known: dict[str, int] = {}
        self.table, self.begin = np.empty(0, np.uint32), np.zeros(1, np.int64)

    def in_lines(self, words: pa.Array, per_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, sizes) of words with so many pre-tokens each."""
        lists = pa.ListArray.from_arrays(pa.array([*range(0, len(words), 1000), len(words)], pa.int32()), words)
        lines = strings(pc.binary_join(lists, pa.scalar(" ", words.type)))
        found = [np.array(x.ids, np.uint32) for x in self.tokenizer.encode_batch_fast(lines, add_special_tokens=False)]
        ids = np.concatenate([*found, np.empty(0, np.uint32)])
        ends = np.flatnonzero(self.closes[ids])[np.cumsum(per_word) - 1] + 1
        return ids, np.diff(np.concatenate([[0], ends]))

    def new(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        plain = pc.match_substring_regex(words, f"^{LETTERS}$").to_numpy(zero_copy_only=False).astype(bool)
        marked = pc.match_substring_regex(words, f"^{LETTERS}{MARKS}$").to_numpy(zero_copy_only=False).astype(bool)
        marked &= ~pc.match_substring(words, "<|").to_numpy(zero_copy_only=False).astype(bool)
        easy = plain | marked
        ids, sizes = self.in_lines(words.filter(pa.array(easy)), 1 + marked[easy])
        alone = [np.array(x.ids, np.uint32) for x in self.tokenizer.encode_batch_fast(strings(words.filter(pa.array(~easy))), add_special_tokens=False)]
        all_sizes = np.empty(len(words), np.int64)
        all_sizes[easy], all_sizes[~easy] = sizes, [len(x) for x in alone]
        begin = np.concatenate([[0], np.cumsum(all_sizes)])
        out = np.empty(begin[-1], np.uint32)
        from_line = np.repeat(easy, all_sizes)
        out[from_line] = ids
        out[~from_line] = np.concatenate([*alone, np.empty(0, np.uint32)])
        return out, all_sizes

    def encode(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(table of ids, first id, number) for each word."""
        texts, known = strings(words), self.known
        at = np.fromiter(map(known.get, texts, repeat(-1)), np.int64, len(texts))
        unknown = np.flatnonzero(at < 0)
        ids, sizes = self.new(words.take(pa.array(unknown)))
        begin = np.concatenate([self.begin, self.begin[-1] + np.cumsum(sizes)])
        table = np.concatenate([self.table, ids])
        at[unknown] = len(self.begin) - 1 + np.arange(len(unknown))
        if len(known) + len(unknown) <= REMEMBERED:
            known.update(zip(map(texts.__getitem__, unknown.tolist()), at[unknown].tolist()))
            self.table, self.begin = table, begin
        return table, begin[at], begin[at + 1] - begin[at]

    def texts(self, texts: pa.Array):
        """The ids of each text, in slices of bounded size: (first row, ids, offsets)."""
        for at, part in slices(texts):
            split = pc.split_pattern(pc.replace_substring(pc.replace_substring(part, "\n", " "), "\t", " "), " ")
            offsets, codes, words = coded_words(split)
            table, begin, sizes = self.encode(words)
            n = sizes[codes]
            ends = np.concatenate([[0], np.cumsum(n)])
            ids = table[np.repeat(begin[codes] - ends[:-1], n) + np.arange(ends[-1])]
            yield at, ids, ends[offsets]


@functools.lru_cache(1)
def worker_words(path: str) -> Words:
    return Words(path)


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): each document's ids and ``end_id``, cut into pieces of at most
    ``capacity``. A null text is empty."""
    slim = docs.select("doc_id", "text")
    names = ["piece", "start", "length", "ids_crc32"]
    kind = slim.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids

    def run(batches):
        words = worker_words(path)
        for batch in batches:
            for at, ids, ends in words.texts(batch.column("text")):
                rows, columns, parts = [], [[] for _ in names], []
                for i in range(len(ends) - 1):
                    own = np.append(ids[ends[i] : ends[i + 1]], np.uint32(end_id)).astype("<u4")
                    for k, start in enumerate(range(0, len(own), capacity)):
                        some = own[start : start + capacity]
                        rows.append(at + i)
                        for column, value in zip(columns, (k, start, len(some), zlib.crc32(some.tobytes()))):
                            column.append(value)
                        if with_ids:
                            parts.append(some.view(np.int32))
                arrays = [batch.column("doc_id").take(pa.array(rows, pa.int64())), pa.array(columns[0], pa.int32()), *(pa.array(c, pa.int64()) for c in columns[1:])]
                if with_ids:
                    arrays.append(pa.array(parts, pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", *names, *["ids"] * with_ids])

    return slim.mapInArrow(run, schema)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Runs (length, first rank, number, first sequence, pieces per sequence, offset) from the histogram of lengths."""
    left, used = {k: n for k, n in counts.items() if n}, dict.fromkeys(counts, 0)
    runs, gaps, sequences = [], {}, 0  # gaps: room left -> [(first sequence, number)]

    def take(length: int, n: int, first: int, per: int, offset: int) -> None:
        runs.append((length, used[length], n, first, per, offset))
        used[length] += n
        left[length] -= n

    large = sorted(k for k in left if 3 * k > capacity)
    while large:
        a = large[-1]
        n = left[a]
        place = bisect.bisect_right(large, capacity - a)
        b = large[place - 1] if place else 0
        if b == a and n == 1:
            b = large[place - 2] if place > 1 else 0
        if b:
            n = n // 2 if b == a else min(n, left[b])
        take(a, n, sequences, 1, 0)
        if b:
            take(b, n, sequences, 1, a)
        gaps.setdefault(capacity - a - b, []).append((sequences, n))
        sequences += n
        large = [k for k in large if left[k]] if not left[a] or b and not left[b] else large
    room = sorted(gaps)
    for length in sorted((k for k, n in left.items() if n), reverse=True):
        while n := left[length]:
            at = bisect.bisect_left(room, length)
            if at == len(room):
                per = capacity // length
                gap, first, many = capacity, sequences, -(-n // per)
                sequences += many
            else:
                gap = room[at]
                per = gap // length
                first, many = gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap]
                    room.pop(at)
            whole = min(many, n // per)
            rest = n - whole * per if whole < many else 0
            made = [(first, whole, per), (first + whole, 1 if rest else 0, rest), (first + whole + (1 if rest else 0), many - whole - (1 if rest else 0), 0)]
            for start, number, each in made:
                if not number:
                    continue
                if each:
                    take(length, number * each, start, each, capacity - gap)
                after = gap - each * length
                if after not in gaps:
                    gaps[after] = []
                    bisect.insort(room, after)
                gaps[after].append((start, number))
    return runs


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``: the sequence that holds the piece, and its place there.

    Sequences are filled from 0 without gaps; ids of sequences have none either. Only the number of pieces of each
    length comes to the driver. Null and empty texts are one piece of ``end_id`` alone. Rows that repeat are packed
    each for itself; extra columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    order = ["length", "doc_id", "piece", "ids_crc32"]
    ranged = range_numbered(cut(pieces(docs, path, capacity, end_id, with_ids)), *order)
    counts = {int(r["length"]): r["n"] for r in ranged.groupBy("length").agg(F.count("*").alias("n")).collect()}
    ranked = running_sum(ranged.withColumn("_one", F.lit(1)), "_one", "_rank", order, ["length"]).withColumn("_rank", F.col("_rank") - 1)
    by_length: dict[int, list] = {}
    for length, *run in plan(counts, capacity):
        by_length.setdefault(length, []).append(tuple(run))
    # Runs of pieces of one length, of which one holds a piece's rank. There are as many as the plan has, which the capacity
    # bounds (lengths are at most that), not the data; so they may be broadcast.
    rows = [(k, [tuple(r) for r in runs]) for k, runs in by_length.items()]
    runs = spark.createDataFrame(rows, "length long, _runs array<struct<rank:long,n:long,first:long,per:int,at:int>>")
    run = F.explode("_runs").alias("_run")
    flat = runs.select("length", run).select("length", "_run.*")
    placed = ranked.join(F.broadcast(flat), "length").where(
        (F.col("_rank") >= F.col("rank")) & (F.col("_rank") < F.col("rank") + F.col("n")))
    inside = F.col("_rank") - F.col("rank")
    return placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids,
        (F.col("first") + F.floor(inside / F.col("per"))).cast("long").alias("sequence_id"),
        (F.col("at") + inside % F.col("per") * F.col("length")).cast("long").alias("offset"))


def op2_packing(spark, sf_dir, path: str | None = None):
    import public_tokenizers

    docs = read(spark, sf_dir, "documents")
    return pack(docs, path or public_tokenizers.path("word_bpe_49k.json"))
