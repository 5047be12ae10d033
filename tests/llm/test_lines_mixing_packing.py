import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from inkspark.llm import lines, mixing, packing
from tests.llm.data import awkward, documents, frame

PATH = public_tokenizers.path("word_bpe_49k.json")
WHITE = " \t\n\x0b\f\r"


def key(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(WHITE))


def plain_dedup(rows, least, docs):
    holders = defaultdict(set)
    for i, text, *_ in rows:
        if i is not None:
            for line in (text or "").split("\n"):
                if len(key(line)) >= least:
                    holders[key(line)].add((i, text))
    common = {k: max(i for i, _ in v) for k, v in holders.items() if len(v) >= docs}
    out = []
    for i, text, *_ in rows:
        own = (text or "").split("\n")
        kept = own if i is None else [x for x in own if not (key(x) in common and common[key(x)] != i)]
        out.append((i, len(own), len(own) - len(kept), "\n".join(kept)))
    return Counter(out)


def line_rows():
    rng = random.Random(1)
    common = [f"License line number {k} of this long corpus" for k in range(5)]
    rows = []
    for i, text, *rest in documents(50):
        own = text.split("\n") + [rng.choice([c, c.upper(), f"  {c}\t"]) for c in common if rng.random() < 0.4] + ["short"]
        rng.shuffle(own)
        rows.append((i, "\n".join(own), *rest))
    return rows + awkward() + [(908, common[0] + "\n" + common[0], "en", "s", 1), (909, "Ünïcode Line With Capitals ÀÉ here\n", "en", "s", 1)]


@pytest.mark.parametrize("batches,fanout", [(1, 2), (4, 2), (5, 3)])
def test_line_dedup(spark, batches, fanout):
    rows = line_rows()
    got = lines.dedup_lines(frame(spark, rows, ["kept_text", "n_dropped", "other", "pos", "key"]), batches=batches, fanout=fanout)
    assert {"other", "lang", "pos", "key"} <= set(got.columns)
    assert Counter((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_text"]) for r in got.collect()) == plain_dedup(rows, 20, 3)


def test_line_dedup_empty(spark):
    assert lines.dedup_lines(frame(spark, [])).collect() == []


def plain_targets(sizes):
    """(source -> size), targets by weights 5, 2, 1 in order of code points, null last, capped at three times."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    fixed = {}
    while True:
        free = [s for s in order if s not in fixed]
        share = sum(sizes.values()) - sum(fixed.values())
        total = sum(weight[s] for s in free)
        level = {s: share * weight[s] / total for s in free} if total else {}
        above = [s for s in free if level[s] > 3 * sizes[s]]
        if not above:
            return fixed | level
        fixed |= {s: 3.0 * sizes[s] for s in above}


def test_mixing(spark):
    rows = documents(80) + awkward()
    df = frame(spark, rows, ["size", "taken", "copies", "other"])
    got = mixing.mix(df).collect()
    assert len(got) == len(rows)
    count = lambda t: len((t or "").replace("\n", " ").replace("\t", " ").split(" ")) - (t or " ").replace("\n", " ").replace("\t", " ").split(" ").count("") if t else 0
    sizes = Counter()
    for _, text, _, source, _ in rows:
        sizes[source] += count(text)
    aims = plain_targets(sizes)
    longest = max(count(r[1]) for r in rows)
    taken = Counter()
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(aims[r["source"]]) and 0 <= r["copies"] <= 3
        taken[r["source"]] += r["copies"] * r["size"]
    assert sum(taken.values()) <= sum(sizes.values()) and all(abs(taken[s] - aims[s]) <= 2 * longest for s in aims)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(df).collect()))
    whole = mixing.mixed(df)
    assert whole.columns == df.columns and whole.count() == sum(r["copies"] for r in got)


def test_mixing_is_close_for_even_documents(spark):
    rows = [(i, " ".join(["w"] * 10), None, f"s{i % 3}", 20) for i in range(600)]
    taken, aims = Counter(), {}
    for r in mixing.mix(frame(spark, rows)).collect():
        taken[r["source"]] += r["copies"] * r["size"]
        aims[r["source"]] = r["target"]
    assert all(abs(taken[s] - aims[s]) <= 20 for s in aims)


@pytest.mark.parametrize("case", range(4))
def test_mixing_is_the_queue(spark, case):
    """Copies taken are those of a queue played through one by one, long documents and sources near their cap included."""
    from pyspark.sql import functions as F

    rng = random.Random(case)
    sizes = [
        [("a", 10)] * 214 + [("b", 40)] * 140 + [("c", 2500)], [(rng.choice("abcdef"), int(rng.paretovariate(1)) + 1) for _ in range(300)],
        [("a", 1000), (None, 7), ("b", 1), ("b", 1)], [(f"s{i}", rng.randrange(1, 400)) for i in range(40) for _ in range(rng.randrange(1, 6))]][case]
    rows = [(i, " ".join(["w"] * n), None, source, 0) for i, (source, n) in enumerate(sizes)]
    df = frame(spark, rows)
    shuffled = {r[0]: r[1] for r in df.select("doc_id", F.xxhash64(F.lit(17), "doc_id", F.xxhash64("text"))).collect()}
    of, queue = defaultdict(list), []
    for i, (source, n) in enumerate(sizes):
        of[source].append((shuffled[i], i, n))
    aims = plain_targets({source: sum(n for _, _, n in own) for source, own in of.items()})
    for source, own in of.items():
        served = 0
        for epoch in (1, 2, 3):
            for order, i, n in sorted(own):
                served += n
                queue.append((served / aims[source], source is not None, source or "", order, i, epoch, n))
    budget, expected = sum(n for _, n in sizes), Counter()
    for *_, i, epoch, n in sorted(queue):
        if n > budget:
            break
        budget -= n
        expected[i] += n
    got = {r["doc_id"]: r["copies"] * r["size"] for r in mixing.mix(df).collect()}
    assert got == {i: expected[i] for i in range(len(sizes))}


def test_mixing_empty(spark):
    assert mixing.mix(frame(spark, [])).collect() == []
    assert [r["copies"] for r in mixing.mix(frame(spark, [(1, None, None, None, None)])).collect()] == [1]


def test_words_are_the_tokenizers(spark):
    import pyarrow as pa

    own = Tokenizer.from_file(PATH)
    texts = ["I'LL don't a<|endoftext|>b x y  z", "é ́e İstanbul ΣΑΣ １２ ½x", "", None, "a\r\nb\tc\x0b\x0cd ...?! (x)", "क़ख ﬁ Å"] + [r[1] for r in documents(20)]
    got = []
    for _, ids, ends in packing.Words(PATH).texts(pa.array(texts)):
        got += [ids[ends[i] : ends[i + 1]].tolist() for i in range(len(ends) - 1)]
    assert got == [own.encode(t or "", add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("capacity", [64, 2048])
def test_packing(spark, capacity):
    rows = documents(60) + awkward()
    got = packing.pack(frame(spark, rows, ["length", "piece", "other"]), PATH, capacity=capacity, with_ids=True).collect()
    own = Tokenizer.from_file(PATH)
    expected = Counter()
    for i, text, *_ in rows:
        ids = own.encode(text or "", add_special_tokens=False).ids + [0]
        for k, start in enumerate(range(0, len(ids), capacity)):
            part = np.array(ids[start : start + capacity], "<u4")
            expected[(i, k, start, len(part), zlib.crc32(part.tobytes()), hashlib.md5(part.tobytes()).hexdigest())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"], hashlib.md5(np.array(r["ids"], "<u4").tobytes()).hexdigest()) for r in got) == expected
    sequences = defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    assert sorted(sequences) == list(range(len(sequences)))
    assert len(sequences) <= 1.08 * sum(r["length"] for r in got) / capacity + 1


def test_plan_places_everything_once():
    rng = np.random.default_rng(2)
    for capacity in (10, 97, 2048):
        lengths = rng.integers(1, capacity + 1, 4000)
        counts = dict(zip(*(x.tolist() for x in np.unique(lengths, return_counts=True))))
        fill, seen = Counter(), Counter()
        spans = defaultdict(list)
        for length, rank, n, first, per, at in packing.plan(counts, capacity):
            for k in range(n):
                seen[(length, rank + k)] += 1
                spans[first + k // per].append((at + k % per * length, length))
        assert max(seen.values()) == 1 and len(seen) == 4000
        for parts in spans.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= capacity
            assert sum(3 * x > capacity for _, x in parts) <= 2
        fill = len(spans)
        assert fill <= 1.2 * lengths.sum() / capacity + 1


def test_packing_empty(spark):
    assert packing.pack(frame(spark, []), PATH).collect() == []
