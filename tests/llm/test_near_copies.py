import random

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from inkspark.llm import chaining, covertree, multiindex, simhash
from tests.llm.data import ENGLISH, awkward, documents, frame, sentence


def plain_fingerprint(text, k=3):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\n", " ").replace("\t", " ").split(" ")
    words = [w for w in words if w]
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + k]).encode(), 42) for i in range(max(1, len(words) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def smallest_reachable(ids, linked):
    parent = list(range(len(ids)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if linked(i, j):
                parent[top(i)] = top(j)
    least = {}
    for i, own in enumerate(ids):
        if own is not None:
            least[top(i)] = min(least.get(top(i), own), own)
    return [least.get(top(i)) for i in range(len(ids))]


def near_rows():
    rng, rows = random.Random(5), documents(40)
    for k in range(40):
        words = rows[k % 8][1].split(" ")
        for _ in range(rng.randrange(0, 3)):
            words[rng.randrange(len(words))] = "changed"
        rows.append((1000 + k, " ".join(words), "en", "s", 1))
    return rows + awkward()


@pytest.mark.parametrize("bits,hot", [(2, 256), (2, 1), (3, 1), (5, 256)])
def test_simhash(spark, bits, hot, monkeypatch):
    monkeypatch.setattr(simhash, "HOT_BUCKET", hot)
    rows = near_rows()
    got = simhash.near_groups(frame(spark, rows, ["fingerprint", "component_id", "fp", "node"]), bits=bits).collect()
    prints = [plain_fingerprint(r[1]) for r in rows]
    expected = smallest_reachable([r[0] for r in rows], lambda i, j: bin(prints[i] ^ prints[j]).count("1") <= bits)
    assert sorted(map(str, ((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got))) == sorted(
        map(str, ((r[0], f"{p:016x}", c) for r, p, c in zip(rows, prints, expected))))


def test_simhash_reaches_hot_buckets_from_others(spark, monkeypatch):
    """A fingerprint in a small bucket is within two bits of one in a hot bucket, whose key differs in one."""
    monkeypatch.setattr(simhash, "HOT_BUCKET", 3)
    monkeypatch.setattr(simhash, "plan", lambda *_: [(list(range(32)), 1), (list(range(32, 64)), 0)])
    crowd = [0b1100 | (0b1111 << 32 + 5 * k) for k in range(6)]
    near = crowd[2] & ~0b100 & ~(1 << 42)
    far = 0b11 << 20 | 0b1 << 60
    got = simhash.links(spark.createDataFrame([(x,) for x in [*crowd, near, far]], "fp long"), 2).collect()
    assert {frozenset((r["a"], r["b"])) for r in got} == {frozenset((near, crowd[2]))}


def test_simhash_empty(spark):
    assert simhash.near_groups(frame(spark, [])).collect() == []
    assert simhash.near_groups(frame(spark, [(7, None, None, None, None)])).first()["fingerprint"] == "0" * 16


def test_thresholds_keep_the_pigeonhole():
    rng = np.random.default_rng(0)
    sample = rng.integers(0, 1 << 63, 400).astype(np.uint64)
    bits = np.unpackbits(sample.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(float)
    for tau in range(0, 8):
        parts = simhash.plan(bits.T @ bits, sample, 100_000, tau)
        used = sum(t for _, t in parts)
        for m in range(len(parts), 9):  # the left out partitions have -1
            if used - (m - len(parts)) == tau - m + 1:
                break
        else:
            raise AssertionError(parts)


def vectors(seed=4):
    rng = np.random.default_rng(seed)
    rows, base = [], rng.normal(size=(12, 8))
    for i in range(150):
        v = base[i % 12] + rng.normal(size=8) * (0.02 if i % 3 else 0.3)
        rows.append((i, [float(x) for x in np.float32(v)], i % 2))
    rows += [(200 + k, rows[3][1], rows[3][2]) for k in range(5)] + [(210, [2 * x for x in rows[3][1]], rows[3][2])]
    return rows + [(300, None, 1), (301, [], 1), (302, [0.0] * 8, 1), (303, [float("nan")] * 8, 1), (304, [1.0, None] * 4, 1), (305, rows[3][1], None), (306, [1.0] * 3, 1), (307, [float("inf")] * 8, 0), (None, rows[3][1], rows[3][2])]


def fine(v):
    return v is not None and len(v) and None not in v and np.isfinite(v).all() and any(v)


@pytest.mark.parametrize("block", [4096, 8])
def test_cover_tree(spark, block):
    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    from pyspark.sql import functions as F

    for name in ("node", "w", "h", "dim", "kept", "block"):
        df = df.withColumn(name, F.lit("mine"))
    got = covertree.near_vectors(df, block=block).collect()

    def linked(i, j):
        a, b = rows[i], rows[j]
        if i == j or a[2] is None or a[2] != b[2] or not fine(a[1]) or not fine(b[1]) or len(a[1]) != len(b[1]):
            return False
        x, y = np.array(a[1], np.float32).astype(float), np.array(b[1], np.float32).astype(float)
        return x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.98

    n = [sum(bool(linked(i, j)) for j in range(len(rows))) for i in range(len(rows))]
    component = smallest_reachable([r[0] for r in rows], linked)
    expected = [(r[0], k, c, r[0] == c and c is not None) for r, k, c in zip(rows, n, component)]
    assert sorted(map(str, ((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in got))) == sorted(map(str, expected))


def test_cover_tree_large_cluster():
    rng = np.random.default_rng(1)
    points = np.concatenate([rng.normal(size=16) + rng.normal(size=(400, 16)) * s for s in (0.001, 0.05, 0.12, 1.0)])
    ids, links, tied = covertree.block_links(np.arange(1600), points, np.ones(1600, np.int64), np.zeros(1600, np.int32), 0.98)
    unit = points / np.linalg.norm(points, axis=1, keepdims=True)
    assert (links == (unit @ unit.T >= 0.98).sum(axis=1) - 1).all()


def test_cover_tree_blocks_meet_only_neighbours(spark):
    """Of clustered vectors in many blocks few pairs of blocks meet, and no link is lost."""
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, 16))
    rows = [(i, [float(x) for x in centres[i % 40] + rng.normal(size=16) * 0.08], 1) for i in range(1200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    points = df.selectExpr("label", "16 as dim", "vec_id as node", "embedding as v", "1L as w")
    dealt = covertree.blocked(points, 0.98, 20).collect()
    placed = {r["node"]: (r["block"]) for r in covertree.placed(points, 0.98, 20).collect()}
    assert len(placed) == 1200 and len(set(placed.values())) > 30
    pairs = len({(r["task"]) for r in dealt})
    assert len(dealt) < 1200 * 12 and pairs < 60 * 61 / 2 / 4
    unit = np.array([r[1] for r in rows])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    expected = (unit @ unit.T >= 0.98).sum(axis=1) - 1
    assert expected.sum() > 1000
    assert {r["vec_id"]: r["n_links"] for r in covertree.near_vectors(df, block=20).collect()} == dict(enumerate(expected.tolist()))


def test_cover_tree_empty(spark):
    assert covertree.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).collect() == []


def test_top_k(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=20)]) for i in range(120)]
    rows += [(200 + i, rows[5][1]) for i in range(15)] + [(300, None), (301, []), (None, rows[0][1]), (302, [None, 1.0]), (5, rows[5][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = multiindex.top_k(df, df.where("vec_id % 5 = 0"), 10).collect()
    known = {(i, tuple(x is not None and x > 0 for x in v) + (False,) * (64 - len(v))) for i, v in rows if i is not None and v is not None}
    expected = set()
    for i, code in known:
        if i % 5 == 0:
            near = sorted((sum(a != b for a, b in zip(code, c)), k) for k, c in known if k != i)[:10]
            expected |= {(i, rank + 1, k, d) for rank, (d, k) in enumerate(near)}
    assert {(r["query_id"], r["rank"], r["vec_id"], r["distance"]) for r in got} == expected and len(got) == len(expected)


def test_top_k_wide_and_few(spark):
    rng = np.random.default_rng(8)
    rows = [(i, [float(x) for x in rng.normal(size=100)]) for i in range(4)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert multiindex.top_k(df, df.where("vec_id = 0"), 10).count() == 3
    assert multiindex.top_k(df.limit(0), df.limit(0), 10).collect() == []


def passage_rows():
    rng = random.Random(11)
    words = ENGLISH + [f"w{i}" for i in range(400)]
    rows = [(i, sentence(rng, words, 150), "en", "s", 1) for i in range(40)]
    passage = [f"p{rng.randrange(10_000)}" for _ in range(70)]
    expected = set()
    for i in range(0, 12):
        own = passage[:]
        if i % 3 == 1:
            for at in (20, 45):
                own[at] = "edited"
        if i % 3 == 2:
            del own[30:32]
        at = rng.randrange(1, 140)
        old = rows[i][1].split(" ")
        rows[i] = (i, " ".join(old[:at] + own + old[at:]), *rows[i][2:])
        expected.add(i)
    rows.append((500, rows[20][1], "en", "s", 1))
    rows.append((501, " ".join(rows[21][1].split(" ")[:40]), "en", "s", 1))  # too short to count
    return rows + awkward(), expected | {20, 500}


def test_chaining(spark):
    rows, expected = passage_rows()
    got = chaining.shared_passages(frame(spark, rows, ["pos", "h", "rep", "start_word"])).collect()
    assert {r["doc_id"] for r in got} | {r["of_doc_id"] for r in got} == expected
    texts = {r[0]: (r[1] or "").lower().split() for r in rows}
    for r in got:
        assert r["of_doc_id"] < r["doc_id"] and r["similarity"] >= 0.8 and r["end_word"] - r["start_word"] >= 50
        one, two = texts[r["doc_id"]][r["start_word"] : r["end_word"]], texts[r["of_doc_id"]][r["of_start_word"] : r["of_end_word"]]
        assert len(set(one) & set(two)) >= 0.8 * len(set(one)) and one[0] == two[0] and one[-1] == two[-1]
    whole = next(r for r in got if r["doc_id"] == 500)
    assert (whole["start_word"], whole["end_word"]) == (0, len(texts[500]))


def test_chaining_finds_passages_that_lie_apart(spark):
    """Two passages with other words between them are two rows, and one beside a worse match is still found."""
    rng = random.Random(12)
    new = lambda n: [f"n{rng.randrange(10**9)}" for _ in range(n)]
    p, q, r = new(60), new(70), new(55)
    loose = new(120)
    worse = [w if k % 7 < 5 else f"other{k}" for k, w in enumerate(loose)]
    texts = [p + new(90) + q, new(5) + p + new(110) + q + new(9), r + loose, new(30) + r + worse]
    rows = [(i, " ".join(t), "en", "s", 1) for i, t in enumerate(texts)]
    got = sorted((r["doc_id"], r["of_doc_id"], r["start_word"], r["end_word"]) for r in chaining.shared_passages(frame(spark, rows)).collect())
    assert got[:2] == [(1, 0, 5, 65), (1, 0, 175, 245)]
    assert any(x[:3] == (3, 2, 30) and x[3] >= 85 for x in got)


@pytest.mark.parametrize("step", [6, 8, 10])
def test_chaining_finds_evenly_edited_passages(spark, step):
    """Every ``step``-th word differs, so that no run is longer than ``step`` - 1 words."""
    rng = random.Random(13)
    new = lambda n: [f"n{rng.randrange(10**9)}" for _ in range(n)]
    texts = []
    for n in (60, 80, 100):
        p = new(n)
        texts += [new(20) + p + new(30), new(9) + [w if (k + 1) % step else f"other{k}" for k, w in enumerate(p)] + new(40)]
    got = chaining.shared_passages(frame(spark, [(i, " ".join(t), "en", "s", 1) for i, t in enumerate(texts)])).collect()
    assert {(r["doc_id"], r["of_doc_id"]) for r in got} == {(1, 0), (3, 2), (5, 4)}


@pytest.mark.parametrize("many", [32, 3])
def test_chaining_looks_past_excerpts(spark, many):
    """Documents of smaller id hold parts of a passage that are too short to count; those that hold it all are paired."""
    rng = random.Random(14)
    new = lambda n: [f"n{rng.randrange(10**9)}" for _ in range(n)]
    p = new(60)
    parts = [p[:45], p[15:], p[5:50], p[10:55], p[:45], p[12:]]
    texts = [new(20) + part + new(30) for part in parts] + [new(9) + p + new(20), new(15) + p[:40] + new(8), new(3) + p + new(9), new(40) + p]
    got = chaining.shared_passages(frame(spark, [(i, " ".join(t), "en", "s", 1) for i, t in enumerate(texts)]), chaining.Settings(many=many)).collect()
    assert {(r["doc_id"], r["of_doc_id"]) for r in got} >= {(8, 6), (9, 6)}
    assert {r["doc_id"] for r in got} | {r["of_doc_id"] for r in got} == {6, 8, 9}


@pytest.mark.parametrize("holders", [0, 60])
def test_chaining_finds_edited_passages_of_frequent_words(spark, holders):
    """Pairs that share an edited passage, of which many documents of smaller id hold parts that are too short to count."""
    rng, word = random.Random(6), lambda: f"w{rng.randrange(10**9)}"
    noise = lambda n: [word() for _ in range(n)]
    passages = [noise(100) for _ in range(10)]
    texts = [sum((noise(20) + p[at : at + 40] for p in passages for at in [rng.randrange(60)]), []) for _ in range(holders)]
    pairs = set()
    for p in passages:
        edited = p[:]
        for at in rng.sample(range(100), 10):
            edited[at] = word()
        pairs.add((len(texts) + 1, len(texts)))
        texts += [noise(30) + p + noise(30), noise(10) + edited + noise(50)]
    got = chaining.shared_passages(frame(spark, [(i, " ".join(t), "en", "s", 1) for i, t in enumerate(texts)])).collect()
    found = {(r["doc_id"], r["of_doc_id"]) for r in got}
    assert found >= pairs and all(r["similarity"] >= 0.8 and r["end_word"] - r["start_word"] >= 50 for r in got)


def test_chaining_empty(spark):
    assert chaining.shared_passages(frame(spark, [])).collect() == []
    assert chaining.shared_passages(frame(spark, awkward())).collect() == []


def test_chain_is_best_of_all():
    rng = np.random.default_rng(6)
    for _ in range(60):
        n = int(rng.integers(2, 9))
        runs = np.stack([rng.integers(0, 60, n), rng.integers(0, 60, n), rng.integers(6, 12, n)], axis=1)
        order = np.argsort(runs[:, 0], kind="stable")
        best = {}
        for i in order:
            a, b, size = runs[i]
            best[i] = size + max([0] + [best[j] - 0.25 * (a - runs[j, 0] - runs[j, 2] + b - runs[j, 1] - runs[j, 2]) for j in order if j in best and runs[j, 0] + runs[j, 2] <= a and runs[j, 1] + runs[j, 2] <= b])
        first = chaining.fenwick_chain(runs, 0.25)[0]
        score = sum(runs[i, 2] for i in first) - 0.25 * sum(
            runs[j, 0] - runs[i, 0] - runs[i, 2] + runs[j, 1] - runs[i, 1] - runs[i, 2] for i, j in zip(first, first[1:]))
        assert score == pytest.approx(max(best.values()))


def test_minimizers_cover_every_window():
    rng = np.random.default_rng(9)
    hashes = rng.integers(0, 1 << 63, 300).astype(np.uint64)
    offsets = np.array([0, 3, 3, 40, 47, 300])
    owner, place, _ = chaining.minimizers(offsets, hashes, 6, 10)
    for t in range(5):
        many = offsets[t + 1] - offsets[t] - 5
        at = set(place[owner == t].tolist())
        if many > 0:
            assert all(at & set(range(low, low + min(10, many))) for low in range(max(1, many - 9)))
        else:
            assert not at
    alone = chaining.minimizers(np.array([0, 37]), hashes[3:40], 6, 10)
    assert alone[1].tolist() == place[owner == 2].tolist()


def test_seeds_are_drawn_or_least_of_a_window():
    rng = np.random.default_rng(10)
    s = chaining.Settings(every=8, window=12)
    offsets = np.array([0, 20, 20, 90, 139, 600])
    hashes = rng.integers(0, 1 << 63, 600).astype(np.uint64)
    owner, place, values = chaining.seeds_of(offsets, hashes, s)
    for t in range(5):
        own = chaining.run_hashes(hashes[offsets[t] : offsets[t + 1]], s.k) if offsets[t + 1] - offsets[t] >= s.least else np.empty(0, np.uint64)
        drawn = {i for i, x in enumerate(own.tolist()) if x < 2**64 // s.every}
        lows = [set(range(low, low + s.window)) for low in range(len(own) - s.window + 1)]
        expected = drawn | {min(w, key=lambda i: own[i]) for w in lows if not w & drawn}
        assert set(place[owner == t].tolist()) == expected and all(w & expected for w in lows)
        assert (values[owner == t] == own[sorted(expected)] >> np.uint64(16)).all()


def test_word_hashes_tell_words_apart():
    import pyarrow as pa

    words = [w + x for w in ("", "a", "aa", "ab", "ba", "naïve", "x" * 5000) for x in ("", "1", "11", "é")]
    hashes = chaining.word_hashes(pa.array(words))
    assert len(set(hashes.tolist())) == len(set(words)) and (chaining.word_hashes(pa.array(["pad", *words]))[1:] == hashes).all()
    assert (chaining.word_hashes(pa.array(["pad", *words]).slice(1)) == hashes).all() and not len(chaining.word_hashes(pa.array([], pa.string())))


def test_windows_that_cannot_agree_are_not_aligned():
    """Runs of one word among other words hold no passage; all windows that have one, or go on, are still tried."""
    s, drawn = chaining.Settings(), np.random.default_rng(7)
    kind = pa.list_(pa.struct([("first", pa.int32()), ("words", pa.list_(pa.int32())), ("size", pa.int32())]))
    cases = []
    for n in range(300):
        one, two = drawn.integers(0, 400, 148), drawn.integers(0, 400, 148)
        one[64:84] = two[64:84] = -1 if n % 3 == 0 else drawn.integers(400, 500, 20)
        if n % 3 == 2:
            low, high = 64 - drawn.integers(0, 65), 84 + drawn.integers(0, 65)
            two[low:high] = one[low:high]
            two[drawn.integers(0, 148, 8)] = -2
        cases.append((one.astype(np.int32), two.astype(np.int32), bool(n % 2)))
    side = lambda k: pa.array([[{"first": 0 if c[2] else 9, "words": c[k].tolist(), "size": 148 if c[2] else 200}] for c in cases], kind)
    fine, on = chaining.hopeful((side(0), side(1)), s.margin, s)
    tried = [bool(on[i] or fine[i] and chaining.subsequence(one, two) >= 40) for i, (one, two, _) in enumerate(cases)]
    real = []
    for one, two, whole in cases:
        runs, ends = np.array([[64, 64, 4], [80, 80, 4]]), (whole,) * 4
        found = list(chaining.passages(one, two, runs, ends, s)) or [x for own in chaining.reseeded(one, two, s) for x in chaining.passages(one, two, own, ends, s)]
        real.append(bool(found))
    assert sum(real) > 50 and not any(r and not t for r, t in zip(real, tried))
    assert not any(tried[::3]) and sum(tried) < 110
