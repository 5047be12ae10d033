"""Byte-pair encoding by a tokenization automaton, and decoding by its labels.

The automaton reads tokens and accepts exactly the sequences that byte-pair encoding gives. It starts as one state
where every byte loops. Each merge (u, v), in turn, applies a gadget: the state that u leads to is copied without its arc
for v, u leads to the copy, and each state with an arc for u gets one for uv, which leads where v does. All arcs of a token
lead to one state, and all states accept; so each prefix of a word has one accepted sequence, and a search through the
tables that goes back where no arc leads on comes to each place of the word once at most.
"""

from __future__ import annotations

import codecs
import functools
import hashlib
import json
import re
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame

from inkspark.llm.common import read

#: Words whose ids a worker remembers, and arcs that it has looked up (only stores: others are found each time).
REMEMBERED, ARCS = 300_000, 2_000_000
#: Characters that are split at a time; longer texts are cut before white space, where pre-tokens always end.
PART = 1_000_000
TYPES = {"long": pa.int64(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}
CUT = re.compile(r"(?<=[!-~])[ \n]")
#: Pre-tokens of texts of these characters alone, whose classes are the same in any version of Unicode.
COMMON = re.compile("[\t\n\r -~À-ɏ]*")
SPLIT = re.compile(
    "'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-zÀ-ÖØ-öø-ɏ]+| ?[0-9]+"
    r"| ?[^\s0-9A-Za-zÀ-ÖØ-öø-ɏ]+|\s+(?!\S)|\s+")


def byte_letters() -> dict[str, int]:
    """The printable characters by which byte-level vocabularies write bytes: printable Latin-1 stands for itself, the others, in
    turn, for characters from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(other)}


class Automaton:
    """The automaton of ``merges`` (pairs of tokens, in order) over ``labels`` (each token's bytes, by id).

    Copies aren't written out. A state is the last token with the gadgets applied to it: ``lost[u, v]`` is the number of
    the gadget that took v from u's state, and ``made`` the number of the merge that made a token. Whether the state has
    an arc follows from those two tables by going back through the copies.
    """

    def __init__(self, labels: dict[int, bytes], merges: list[tuple[int, int]], ids: list[int]):
        self.labels = labels
        self.made, self.left, self.right = dict.fromkeys(labels, -1), {}, {}
        self.lost: dict[tuple[int, int], int] = {}
        for number, ((u, v), token) in enumerate(zip(merges, ids)):
            # Without an arc from u to v the pair never occurs, and neither does the token.
            if u not in self.made or v not in self.made or not self.has(u, v, number):
                self.made.pop(token, None)
                continue
            self.lost[u, v] = number
            self.left[token], self.right[token], self.made[token] = u, v, number
        # Places of the tokens' bytes in a tree of prefixes: (node, byte) -> (node below, token that ends there or -1).
        below: dict[int, list] = {}
        nodes = 1
        for token, label in labels.items():
            if token not in self.made:
                continue
            node = 0
            for b in label:
                entry = below.setdefault(node << 8 | b, [nodes, -1])
                nodes += entry[0] == nodes
                node = entry[0]
            entry[1] = token
        self.below = {key: tuple(entry) for key, entry in below.items()}
        self.arcs: dict[int, dict[int, bool]] = {}
        self.looked_up = 0

    def has(self, u: int, t: int, before: int) -> bool:
        """Whether the state that token ``u`` leads to, after the gadgets numbered below ``before``, has an arc for ``t``."""
        made, left = self.made, self.left
        while True:
            age = made[t]
            if 0 <= age and age >= before - 1:
                t = left[t]  # the arc came with the last gadget or later, beside that of the left part
            elif self.lost.get((u, t), before) < before:
                return False
            elif age > made[u]:
                t, before = left[t], age + 1  # the arc came to an earlier copy of u's state
            elif made[u] < 0:
                return True  # the first state has them all
            else:
                u, before = self.right[u], made[u]  # u led where its right part did when it was made

    def arc(self, u: int, t: int) -> bool:
        """Whether token ``t`` may follow ``u`` in the finished automaton."""
        row = self.arcs.get(u)
        if row is None:
            row = self.arcs.setdefault(u, {})
        known = row.get(t)
        if known is None:
            known = self.has(u, t, len(self.labels))
            if self.looked_up < ARCS:
                row[t] = known
                self.looked_up += 1
        return known

    def encode(self, word: bytes) -> list[int]:
        """The ids of one pre-token: a search for the accepted sequence, longer tokens first.

        Each sequence met is the only one of its bytes, so no place in the word is met twice.
        """
        size, below, labels = len(word), self.below, self.labels
        path, untried, start = [], [], 0
        while start < size:
            found, node = [], 0
            for b in word[start:]:
                entry = below.get(node << 8 | b)
                if entry is None:
                    break
                node, t = entry
                if t >= 0:
                    found.append(t)
            while True:
                while not found:
                    found = untried.pop()
                    start -= len(labels[path.pop()])
                t = found.pop()
                if not path or self.arc(path[-1], t):
                    break
            path.append(t)
            untried.append(found)
            start += len(labels[t])
        return path


class Words(dict):
    """Ids by pre-token; a missing one is encoded, and remembered while there is room."""

    def __init__(self, automaton: Automaton):
        self.automaton = automaton

    def __missing__(self, word: str) -> list[int]:
        ids = self.automaton.encode(word.encode())
        if len(self) < REMEMBERED:
            self[word] = ids
        return ids


class Coder:
    """Encoding and decoding of whole texts with a byte-level vocabulary file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, kind = spec["model"], spec["pre_tokenizer"] or {}
        plain = not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        if model["type"] != "BPE" or spec["normalizer"] or kind.get("type") != "ByteLevel" or kind["add_prefix_space"] or not kind["use_regex"] or not plain:
            raise ValueError(f"{path} isn't a plain byte-level vocabulary")
        if any(x["single_word"] or x["lstrip"] or x["rstrip"] or x["normalized"] for x in spec["added_tokens"]):
            raise ValueError(f"added tokens of {path} take more than their own text")
        self.splitter = Tokenizer.from_file(path).pre_tokenizer
        letters = byte_letters()
        vocab = model["vocab"]
        labels = {i: bytes(letters[c] for c in token) for token, i in vocab.items()}
        merges = [tuple(x.split(" ")) if isinstance(x, str) else tuple(x) for x in model["merges"]]
        self.automaton = Automaton(labels, [(vocab[a], vocab[b]) for a, b in merges], [vocab[a + b] for a, b in merges])
        self.added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        longest = sorted(self.added, key=len, reverse=True)
        self.specials = re.compile("(" + "|".join(map(re.escape, longest)) + ")") if longest else None
        self.labels = labels | {i: c.encode() for c, i in self.added.items()}
        self.decimals = {i: str(i) for i in self.labels}
        self.known = Words(self.automaton)

    def words(self, text: str) -> list[str]:
        """The pre-tokens of ``text``."""
        if COMMON.fullmatch(text):
            return SPLIT.findall(text)
        return [text[a:b] for _, (a, b) in self.splitter.pre_tokenize_str(text)]

    def parts(self, text: str):
        """The ids of ``text``, in lists of bounded size."""
        for piece in self.specials.split(text) if self.specials else [text]:
            if piece in self.added:
                yield [self.added[piece]]
                continue
            start = 0
            while start < len(piece):
                found = CUT.search(piece, start + PART)
                end = found.start() if found else len(piece)
                yield list(chain.from_iterable(map(self.known.__getitem__, self.words(piece[start:end]))))
                start = end

    def decode(self, parts) -> str:
        """The text of ids, given in lists: labels in a row, with U+FFFD for bytes that aren't UTF-8. Unknown ids have none."""
        decoder = codecs.getincrementaldecoder("utf-8")("replace")
        texts = [decoder.decode(b"".join(self.labels.get(i, b"") for i in ids)) for ids in parts]
        return "".join(texts) + decoder.decode(b"", True)

    def digests(self, text: str) -> tuple[int, str, str]:
        """(number of ids, SHA-256 of the ids, SHA-256 of the text decoded from them), in memory bounded by a part's."""
        n, of_ids, of_text = 0, hashlib.sha256(), hashlib.sha256()
        decoder = codecs.getincrementaldecoder("utf-8")("replace")
        for ids in self.parts(text):
            of_ids.update((("," if n else "") + ",".join(map(self.decimals.__getitem__, ids))).encode() if ids else b"")
            of_text.update(decoder.decode(b"".join(map(self.labels.__getitem__, ids))).encode())
            n += len(ids)
        of_text.update(decoder.decode(b"", True).encode())
        return n, of_ids.hexdigest(), of_text.hexdigest()


@functools.lru_cache(1)
def worker_coder(path: str) -> Coder:
    return Coder(path)


def mapped(df: DataFrame, path: str, column: str, keep: list[str], out: str, f) -> DataFrame:
    """``keep`` columns with those that ``f(coder, value)`` gives for each value of ``column``, in Arrow batches."""
    names, kinds = zip(*(field.split() for field in out.split(", ")))
    schema = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep), out])

    def run(batches):
        coder = worker_coder(path)
        for batch in batches:
            rows = [f(coder, batch.column(0)[i].as_py()) for i in range(batch.num_rows)]
            arrays = [pa.array([r[k] for r in rows], TYPES[kind]) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *arrays], [*keep, *names])

    return df.select(column, *keep).mapInArrow(run, schema)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids): the ids of each row's whole text, as the vocabulary's own tokenizer gives them without special tokens at
    the ends. Strings of special tokens inside a text are those tokens. Null and empty texts have no ids. Repeated rows
    each give a row; further columns are ignored."""
    return mapped(docs.select("doc_id", "text"), path, "text", ["doc_id"], "ids array<int>", lambda c, text: (list(chain.from_iterable(c.parts(text or ""))),))


def decode(coded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) of (doc_id, ids): special tokens give their strings, null ids none, and null lists an empty text."""
    return mapped(coded.select("doc_id", "ids"), path, "ids", ["doc_id"], "text string", lambda c, ids: (c.decode([ids or []]),))


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): digests of ``encode`` and of ``decode`` of its ids, in one pass and in memory
    bounded by a part of a text besides the text. Rows, nulls and empty texts as in ``encode``: one row each."""
    return mapped(docs.select("doc_id", "text"), path, "text", ["doc_id"], "n_tokens long, ids_sha256 string, decoded_sha256 string", lambda c, text: c.digests(text or ""))


def op13_bpe(spark, sf_dir, path: str | None = None):
    import public_tokenizers

    return round_trip(read(spark, sf_dir, "documents"), path or public_tokenizers.path("byte_bpe_50k.json"))
