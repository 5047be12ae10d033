"""Reduction by levels with its memo, and re-anchored quotes."""

import hashlib
import random

import pytest

from inkspark.operators import anchors
from inkspark.plans import reduction


def books(seed=2):
    rng = random.Random(seed)
    return [(i, "\n".join("w" * rng.randrange(0, 60) for _ in range(n))) for i, n in enumerate([0, 1, 3, 40, 300, 900])] + [(50, None), (51, "x" * 1000), (52, "\n" * 500), (None, "no id\n" * 90)]


def plain(text, limit, analyse=reduction.head):
    try:
        return (*reduction.reduce_texts((text or "").split("\n"), limit, analyse), None)
    except ValueError:
        return None, None, "DID_NOT_CONVERGE"


@pytest.mark.parametrize("limit", [200, 90])
def test_levels_against_a_plain_fold(spark, tmp_path, limit):
    rows = books()
    got = {r["doc_id"]: (r["answer"], None if r["error"] else r["rounds"], r["error"]) for r in reduction.reduced(spark.createDataFrame(rows, "doc_id long, text string"), limit, memo=str(tmp_path / "m")).collect()}
    assert got == {i: plain(text, limit) for i, text in rows}
    assert len({rounds for _, rounds, _ in got.values()}) > 1


def never(texts):
    raise RuntimeError("asked again")


def test_second_run_asks_nothing_and_failures_are_resumed(spark, tmp_path):
    memo, rows = str(tmp_path / "memo"), spark.createDataFrame(books(3), "doc_id long, text string")

    def truncated(texts):
        if hashlib.sha256("".join(texts).encode()).digest()[0] % 2:
            raise RuntimeError("OUTPUT_TRUNCATED")
        return reduction.head(texts)

    with pytest.raises(reduction.ReductionFailed, match="OUTPUT_TRUNCATED"):
        reduction.reduced(rows, 200, truncated, memo)
    kept = spark.read.parquet(memo).count()

    def rest(texts):
        if not hashlib.sha256("".join(texts).encode()).digest()[0] % 2 and len(texts) > 3 and texts[0].startswith("w"):
            raise RuntimeError("asked again")
        return reduction.head(texts)

    assert kept > 0
    first = sorted(map(tuple, reduction.reduced(rows, 200, rest, memo).collect()), key=repr)
    assert sorted(map(tuple, reduction.reduced(rows, 200, never, memo).collect()), key=repr) == first
    # Another run, another stage and other inputs have answers of their own.
    with pytest.raises(reduction.ReductionFailed, match="asked again"):
        reduction.reduced(rows, 200, never, memo, run="other")
    assert reduction.reduced(rows.limit(0), 200, never, memo).collect() == []


def test_reanchored(spark, monkeypatch):
    monkeypatch.setattr(anchors, "QUOTES", 3)
    text = "a😀b the cat, the hat😀 the end"
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    blocks = spark.createDataFrame([("b", text), ("e", ""), ("n", None), ("unused", "x")], "block_id string, content string")
    cases = [
        (1, "b", 9, 12, "the", "old"), (2, "b", 0, 1, "hat😀", None), (3, "b", 1, 3, "dog", "old"), (4, "b", 1, 99, "dog", "old"), (5, "b", 1, 3, None, "kept"), (6, "b", None, 3, None, None),
        (7, "b", -1, 3, None, None), (8, "b", 4, 4, "", "h"), (9, "gone", 0, 1, "the", "h"), (10, "n", 0, 1, "x", "h"), (11, "e", 0, 1, None, None), (12, None, 0, 1, None, None), (13, "b", 0, 1, "the end", None),
        (14, "b", 0, 1, "😀", None), (14, "b", 0, 1, "😀", None), (15, "b", 0, len(text.encode("utf-16-le")) // 2, text, None)]
    evidence = spark.createDataFrame(cases, "evidence_id int, block_id string, first int, last int, quote string, quote_hash string")
    got = sorted((tuple(r) for r in anchors.reanchored(evidence, blocks).collect()), key=repr)
    units = len(text.encode("utf-16-le")) // 2
    at = lambda q: len(text[: text.index(q)].encode("utf-16-le")) // 2
    end = lambda q: at(q) + len(q.encode("utf-16-le")) // 2
    held = lambda i, q: (i, "b", at(q), end(q), q, sha(q), None)
    want = [held(1, "the"), held(2, "hat😀"), (3, "b", 1, 3, None, None, None), (4, "b", 1, 99, None, None, "RANGE"), (5, "b", 1, 3, None, "kept", None), (6, "b", None, 3, None, None, "RANGE"), (7, "b", -1, 3, None, None, "RANGE"),
            (8, "b", 4, 4, None, None, "RANGE"), (9, "gone", 0, 1, "the", "h", "LINEAGE"), (10, "n", 0, 1, "x", "h", "LINEAGE"), (11, "e", 0, 1, None, None, "RANGE"), (12, None, 0, 1, None, None, "LINEAGE"),
            held(13, "the end"), held(14, "😀"), held(14, "😀"), (15, "b", 0, units, text, sha(text), None)]
    assert got == sorted(want, key=repr)
    assert anchors.reanchored(evidence.limit(0), blocks).collect() == []


def test_first_places_against_find():
    rng = random.Random(5)
    for _ in range(300):
        text = "".join(rng.choice("abé😀") for _ in range(rng.randrange(60)))
        quotes = {"".join(rng.choice("abé😀") for _ in range(rng.randrange(1, 6))) for _ in range(rng.randrange(9))}
        want = {q: len(text[: text.index(q)].encode("utf-16-le")) // 2 for q in quotes if q in text}
        assert anchors.first_places(text, quotes) == want
