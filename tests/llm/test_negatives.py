import math
import random
from collections import defaultdict

import numpy as np
import pytest

from inkspark.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int, note string, score string, cell string"


def plain(rows, positives, wanted, every):
    fine = {(i, label, tuple(math.floor(256 * float(np.float32(x))) for x in v)) for i, v, label, *_ in rows
            if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    near, far = defaultdict(list), defaultdict(list)
    for i, label, v in fine:
        if i % every == 0:
            for j, other, w in fine:
                if i != j:
                    (near if label == other else far)[i].append((-dot(v, w), j))
    out = []
    for i, own in near.items():
        for p, positive in sorted(own)[:positives]:
            fits = sorted((n, j) for n, j in far[i] if 30 * -p <= 100 * -n <= 90 * -p)[:wanted]
            out += [(i, positive, k, j, -p, -n) for k, (n, j) in enumerate(fits, 1)]
    return sorted(out)


def vectors(n, seed, clusters=6, dim=12):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, dim))
    rows = []
    for i in range(n):
        c = int(rng.integers(clusters))
        v = centres[c] + rng.normal(scale=0.2, size=dim)
        rows.append((i, [float(x) for x in v], c if rng.random() < 0.7 else int(rng.integers(clusters)), "n", "s", "c"))
    return rows


def awkward():
    same = [0.5] * 12
    return [
        (5000, same, 1, None, None, None), *[(5001 + i, same, 2, None, None, None) for i in range(30)], *[(5040 + i, same, 1, None, None, None) for i in range(8)],
        (6000, None, 1, None, None, None), (6010, [None] + [1.0] * 11, 1, None, None, None), (6020, [float("nan")] * 12, 1, None, None, None), (6030, [float("inf")] * 12, 1, None, None, None),
        (6040, [1.0] * 12, None, None, None, None), (None, [1.0] * 12, 1, None, None, None), (6050, [0.0] * 12, 1, None, None, None), (6060, [], 2, None, None, None),
        (6070, [0.25, -0.5], 1, None, None, None), (6080, same, 1, "a", None, None), (6080, same, 1, "b", None, None)]


@pytest.mark.parametrize("anchors,block,asking", [(64, 1_000_000, 512), (2, 600, 3), (1, 120, 2)])
def test_hard_negatives(spark, monkeypatch, anchors, block, asking):
    for name, value in (("ANCHORS", anchors), ("BLOCK", block), ("ASKING", asking)):
        monkeypatch.setattr(negatives, name, value)
    rows = vectors(300, anchors) + awkward()
    got = negatives.hard_negatives(spark.createDataFrame(rows, SCHEMA), "id % 10 = 0")
    assert sorted(map(tuple, got.collect())) == plain(rows, 5, 10, 10)


def test_no_rows_and_few_rows(spark):
    assert negatives.hard_negatives(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = [(100, [1.0, 0.0], 1, None, None, None), (101, [1.0, 0.5], 1, None, None, None), (102, [0.5, 0.5], 2, None, None, None)]
    got = sorted(map(tuple, negatives.hard_negatives(spark.createDataFrame(rows, SCHEMA)).collect()))
    assert got == plain(rows, 5, 10, 100) == [(100, 101, 1, 102, 65536, 32768)]


def test_scores_beyond_doubles_are_exact(spark):
    rng = random.Random(8)
    rows = [(i, [rng.random() * 3e6, rng.random() * 3e6], i % 2, None, None, None) for i in range(40)]
    got = negatives.hard_negatives(spark.createDataFrame(rows, SCHEMA), "id % 10 = 0")
    assert sorted(map(tuple, got.collect())) == plain(rows, 5, 10, 10)


def test_cells_exclude_rows_but_no_neighbours(spark, monkeypatch):
    # Tight clusters: few rows leave their own cell.
    monkeypatch.setattr(negatives, "ANCHORS", 4)
    copies, dealt = [], negatives.candidates

    def seen(rows, cells, wanted):
        out = dealt(rows, cells, wanted)
        copies.append((out[0].count(), rows.count(), len(cells.pivots)))
        return out

    monkeypatch.setattr(negatives, "candidates", seen)
    rng = np.random.default_rng(1)
    centres = np.eye(12) * 3
    rows = [(i, [float(x) for x in centres[i % 12] + rng.normal(scale=0.02, size=12)], i % 24, None, None, None) for i in range(800)]
    got = negatives.hard_negatives(spark.createDataFrame(rows, SCHEMA), "id % 10 = 0")
    assert sorted(map(tuple, got.collect())) == plain(rows, 5, 10, 10)
    assert len(copies) == 4 and sum(c for c, *_ in copies) < 0.5 * sum(n * p for _, n, p in copies)
