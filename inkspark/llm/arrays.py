"""Vectorised helpers over batches of words, for use inside tasks."""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Code points of text that a task works on at once; longer batches are taken in slices.
SLICE_CHARS = 2_000_000
PRIME, MIX = np.uint64(1099511628211), np.uint64(0x9E3779B97F4A7C15)


def give_back() -> None:
    """Free memory goes back to the machine. Workers stay for later stages, and what they keep counts as theirs."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc alone
    if trim:
        trim(0)


def slices(texts: pa.Array, limit: int = SLICE_CHARS):
    """(start, array) runs of ``texts`` (nulls become empty) with about ``limit`` bytes each, one text at least."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)
    start = 0
    while start < len(texts):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield start, texts.slice(start, stop - start)
        start = stop
        pa.default_memory_pool().release_unused()
    give_back()


def coded_words(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(offsets, codes, distinct words) of an array of word lists."""
    flat = lists.flatten().dictionary_encode()
    lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.concatenate([[0], np.cumsum(lengths)]), flat.indices.to_numpy(zero_copy_only=False), flat.dictionary


def code_points(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(code points of all strings in a row, offsets)."""
    lengths = pc.utf8_length(strings).to_numpy(zero_copy_only=False).astype(np.int64)
    joined = "".join(strings.to_pylist())
    return np.frombuffer(joined.encode("utf-32-le"), np.uint32), np.concatenate([[0], np.cumsum(lengths)])


def ngram_hashes(points: np.ndarray, n: int) -> np.ndarray:
    """A mixed 64-bit hash of the ``n`` code points from each place on (len - n + 1 of them)."""
    many = len(points) - n + 1
    if many <= 0:
        return np.empty(0, np.uint64)
    h = np.full(many, n, np.uint64)
    for j in range(n):
        h *= PRIME
        h += points[j : j + many]
    h ^= h >> np.uint64(29)
    h *= MIX
    h ^= h >> np.uint64(32)
    return h


def subwords(words: pa.Array, shortest: int, longest: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, offsets): each word's character n-grams, with marks at its ends, and the word as a whole."""
    marked = pc.binary_join_element_wise("<", words.cast(pa.string()), ">", "")
    points, offsets = code_points(marked)
    sizes = np.diff(offsets).astype(np.int32)
    numbers = [np.maximum(sizes - n + 1, 0) for n in range(shortest, longest + 1)]
    begin = np.concatenate([[0], np.cumsum(sum(numbers) + 1, dtype=np.int64)])
    out, at = np.empty(begin[-1], np.int32), begin[:-1].copy()
    for n, number in zip(range(shortest, longest + 1), numbers):
        # Each word's grams begin where the word does; they go behind those of the orders before.
        place = np.arange(number.sum(), dtype=np.int64) - np.repeat(np.cumsum(number, dtype=np.int64) - number, number)
        grams = (ngram_hashes(points, n)[np.repeat(offsets[:-1], number) + place] % np.uint64(buckets)).astype(np.int32)
        out[np.repeat(at, number) + place] = grams
        at += number
    powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(int(sizes.max(initial=0)), PRIME)]), dtype=np.uint64)
    place = np.arange(len(points), dtype=np.int64) - np.repeat(offsets[:-1], sizes)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(points.astype(np.uint64) * powers[place], dtype=np.uint64)])
    whole = (sums[offsets[1:]] - sums[offsets[:-1]]) * MIX
    out[at] = ((whole ^ (whole >> np.uint64(31))) % np.uint64(buckets)).astype(np.int32)
    return out, begin


def segment_sums(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return sums[ends] - sums[starts]
