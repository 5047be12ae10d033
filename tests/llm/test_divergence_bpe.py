import hashlib
import random
import re
from collections import Counter, defaultdict
from itertools import product

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from inkspark.llm import bpe, divergence
from tests.llm.data import awkward, documents, frame

PATH = public_tokenizers.path("byte_bpe_50k.json")
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def plain_divergence(rows, least, ranks):
    docs = [(lang or "", source or "", TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))) for _, text, lang, source, _ in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        held = Counter(t for *_, terms in own for t in set(terms))
        kept = sorted(t for t, n in held.items() if n >= least)
        by = {s: Counter(t for _, s2, terms in own if s2 == s for t in terms if held[t] >= least) for s in {d[1] for d in own}}

        def shares(counts):
            total = sum(counts.values())
            return {t: 1 + (10**9 * (counts[t] + 5)) // (total + 5 * len(kept)) for t in kept}

        p, q = {s: shares(c) for s, c in by.items()}, shares(sum(by.values(), Counter()))
        for s in by:
            pairs = [(-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in by if o != s]
            terms = [(q[t] - p[s][t], t.encode()) for t in kept if by[s][t] > 0 and p[s][t] > q[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:ranks])):
                out += [(lang, s, part, item.decode(), -value, k) for k, (value, item) in enumerate(found, 1)]
    return sorted(out)


@pytest.mark.parametrize("least,ranks", [(3, 50), (10, 4), (1000, 50)])
def test_divergence(spark, least, ranks):
    rows = documents(80) + awkward() + [(950 + i, "Zürich ZÜRICH \x00a\x7fb 😀x {y} naïve", None, "s1", 1) for i in range(12)]
    got = divergence.divergence(frame(spark, rows, ["term", "n", "counts", "salt", "value"]), least, ranks)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == plain_divergence(rows, least, ranks)


def test_divergence_edges(spark):
    assert divergence.divergence(frame(spark, [])).collect() == []
    assert divergence.divergence(frame(spark, [(1, None, None, None, 1)])).collect() == []
    # Small slices give the same counts as one.
    rows, whole = documents(40), divergence.SLICE
    try:
        divergence.SLICE = 500
        assert sorted(map(tuple, divergence.divergence(frame(spark, rows), 2, 9).collect())) == plain_divergence(rows, 2, 9)
    finally:
        divergence.SLICE = whole


def test_share_is_exact(spark):
    from pyspark.sql import functions as F

    rng = random.Random(4)
    rows = [(n := rng.randrange(1, 10 ** rng.randrange(1, 15)), rng.randrange(0, n + 1), rng.randrange(1, 10**9)) for _ in range(300)]
    df = spark.createDataFrame(rows, "n long, c long, v long").select("*", divergence.share(F.col("c"), F.col("n"), F.col("v")).alias("p"))
    assert all(r["p"] == 1 + 10**9 * (r["c"] + 5) // (r["n"] + 5 * r["v"]) for r in df.collect())


def merged(word, ranks):
    """Byte-pair encoding as defined: merge the pair of the least rank, leftmost first, until none is left."""
    parts = [bytes([b]) for b in word]
    while True:
        found = min(((ranks[a, b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if (a, b) in ranks), default=None)
        if found is None:
            return parts
        i = found[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def gadgets(alphabet, merges):
    """The automaton written out: each gadget copies a state's arcs."""
    arcs = [{a: 0 for a in alphabet}]
    for u, v in merges:
        leads = {s[u] for s in arcs if u in s}
        if not leads or v not in arcs[leads.copy().pop()]:
            continue
        (old,) = leads
        end = arcs[old][v]
        arcs.append({t: s for t, s in arcs[old].items() if t != v})
        copy = len(arcs) - 1
        for s in arcs:
            if u in s:
                s[u] = copy
                s[u + v] = end
    return arcs


@pytest.mark.parametrize("seed", range(12))
def test_automaton_on_random_merges(seed):
    rng, alphabet = random.Random(seed), [b"a", b"b", b"c"][: 1 + seed % 3]
    tokens, merges = list(alphabet), []
    for _ in range(60):
        u, v = rng.choice(tokens), rng.choice(tokens)
        if len(merges) < 14 and len(u + v) < 9 and u + v not in tokens:
            merges.append((u, v))
            tokens.append(u + v)
    ids = {t: i for i, t in enumerate(tokens)}
    automaton = bpe.Automaton({i: t for t, i in ids.items()}, [(ids[a], ids[b]) for a, b in merges], [ids[a + b] for a, b in merges])
    ranks = {pair: k for k, pair in enumerate(merges)}
    states = gadgets(alphabet, merges)
    for n in range(1, 8):
        for letters in product(alphabet, repeat=n):
            word = b"".join(letters)
            want = merged(word, ranks)
            assert [tokens[i] for i in automaton.encode(word)] == want
            state = 0
            for t in want:
                state = states[state][t]
    for u, v in product([t for t in tokens if any(t in s for s in states)], repeat=2):
        state = next(s[u] for s in states if u in s)
        assert automaton.arc(ids[u], ids[v]) == (v in states[state]), (u, v)


def strange():
    rng = random.Random(9)
    kinds = ["ab", "aeiou thxs'", " \n\t", "éßñ€中文😀́", "0123", "\x85\xa0\x1c 　²½ªµ×÷ǅ", "'s'll I'M"]
    texts = ["".join(rng.choice(rng.choice(kinds)) for _ in range(rng.randrange(80))) for _ in range(400)]
    return texts + ["<|endoftext|>", "a<|endoftext|> b<|endoftext|>", "<|endoftext", "x" * 5000, "ab" * 3000, " " * 3000, "\n\n  \n a", "﻿a\x00b", *"'s 't 're 've 'm 'll 'd 'S".split()]


def test_bpe_equals_library(spark):
    rows = documents(30) + awkward() + [(2000 + i, t, None, None, 0) for i, t in enumerate(strange())]
    tokenizer = Tokenizer.from_file(PATH)
    want = {}
    for i, text, *_ in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids
        back = tokenizer.decode(ids, skip_special_tokens=False)
        want.setdefault((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()), []).append(text)
    docs = frame(spark, rows, ["ids", "n_tokens"])
    got = bpe.round_trip(docs, PATH).collect()
    assert Counter(map(tuple, got)) == Counter({k: len(v) for k, v in want.items()})
    coded = bpe.encode(docs, PATH)
    texts = Counter((r["doc_id"], r["text"]) for r in bpe.decode(coded, PATH).collect())
    assert texts == Counter((i, text or "") for i, text, *_ in rows)
    assert bpe.round_trip(frame(spark, []), PATH).collect() == [] and bpe.encode(frame(spark, []), PATH).collect() == []


def test_long_texts_in_parts(monkeypatch):
    text = "".join(random.Random(2).choice(["word ", "\n\n  next", "it's", " 12 ", "é", "<|endoftext|>", "."]) for _ in range(4000))
    monkeypatch.setattr(bpe, "PART", 50)
    coder = bpe.Coder(PATH)
    assert [i for part in coder.parts(text) for i in part] == Tokenizer.from_file(PATH).encode(text).ids
    assert coder.digests(text)[2] == hashlib.sha256(text.encode()).hexdigest()


def test_decode_any_ids():
    coder, tokenizer, rng = bpe.Coder(PATH), Tokenizer.from_file(PATH), random.Random(6)
    for _ in range(200):
        ids = [rng.randrange(50257) for _ in range(rng.randrange(30))]
        assert coder.decode([ids[:7], ids[7:]]) == tokenizer.decode(ids, skip_special_tokens=False)


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError, match="byte-level"):
        bpe.Coder(public_tokenizers.path("word_bpe_49k.json"))
