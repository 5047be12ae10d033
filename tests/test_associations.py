"""The exact join of close vectors against all pairs."""

import numpy as np
import pytest

from inkspark.operators import associations


def rows_of(seed, n=260, dim=10, clusters=7):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, dim))
    rows = [(i, int(rng.integers(5)), [float(x) for x in centres[rng.integers(clusters)] * rng.uniform(0.5, 4) + rng.normal(scale=0.25, size=dim)]) for i in range(n)]
    same = [2.0] * dim
    rows += [(1000 + i, i % 2, same) for i in range(30)] + [(1100, 0, [4.0] * dim), (1101, 1, [-1.0] * dim)]
    return rows + [(2000, None, same), (None, 1, same), (2001, 1, None), (2002, 1, []), (2003, 1, [0.0] * dim), (2004, 1, [None] + same[1:]), (2005, 1, [float("nan")] * dim), (2006, 1, [1.0, 2.0]), (2007, 2, [2.0, 4.0]), (2008, 3, [1e308] * dim), (5, rows[5][1], rows[5][2])]


def plain(rows, least, k):
    fine = {i: (label, np.array(v) / max(map(abs, v))) for i, label, v in rows if None not in (i, label) and v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    fine = {i: (label, v / np.linalg.norm(v)) for i, (label, v) in fine.items()}
    out = []
    for i, (label, v) in fine.items():
        near = sorted((-round(float(v @ w), 9), j) for j, (other, w) in fine.items() if other != label and len(v) == len(w) and float(v @ w) >= least - 1e-12)[:k]
        out += [(i, j, r) for r, (_, j) in enumerate(near, 1)]
    return sorted(out)


@pytest.mark.parametrize("points,block,asking,least,k", [(2000, 2_000_000, 1024, 0.8, 3), (12, 300, 7, 0.9, 3), (5, 100, 3, 0.6, 24)])
def test_against_all_pairs(spark, monkeypatch, points, block, asking, least, k):
    for name, value in (("POINTS", points), ("BLOCK", block), ("ASKING", asking)):
        monkeypatch.setattr(associations, name, value)
    rows = rows_of(points)
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    got = associations.associated(df, least, k)
    assert sorted((r["left_id"], r["right_id"], r["rank"]) for r in got.collect()) == plain(rows, least, k)


def test_planes_exclude_cells_but_no_partners():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 64))
    v = centres[rng.integers(40, size=4000)] + rng.normal(scale=0.1, size=(4000, 64))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    pivots = associations.spread(v[:480], 60)
    home, inside = associations.visits(v, pivots, 0.4)
    assert inside[np.arange(len(v)), home].all() and inside.sum() < 3 * len(v)
    close = np.argwhere(v @ v.T >= 1 - 0.4**2 / 2)
    assert all(inside[j, home[i]] for i, j in close)


def test_revised_vectors(spark):
    rows = spark.createDataFrame([(1, 0, [1.0, 0.0]), (2, 1, [1.0, 0.0]), (3, 2, [1.0, 0.0])], "vec_id long, label int, embedding array<double>")
    revisions = spark.createDataFrame([(2, [0.0, 1.0]), (3, None)], "vec_id long, refreshed array<double>")
    got = {r["vec_id"]: r["embedding"] for r in associations.current_vectors(rows, revisions).collect()}
    assert got == {1: [1.0, 0.0], 2: [0.0, 1.0]}
    assert associations.associated(rows.limit(0)).collect() == []


def test_vectors_without_clusters_move_a_bounded_number_of_times():
    drawn = np.random.default_rng(5).normal(size=(400, 64))
    drawn /= np.linalg.norm(drawn, axis=1, keepdims=True)
    per, many, reach = associations.BLOCK // 64, 100_000, 0.4**0.5
    spread = associations.spread(drawn, 50)
    for pivots, most in ((associations.fewest(drawn, spread, many, reach, per), associations.MOVES), (spread, 60)):
        home, inside = associations.visits(drawn, pivots, reach)
        homes, insides = np.bincount(home, minlength=len(pivots)) * many / len(drawn), inside.sum(axis=0) * many / len(drawn)
        blocks, chunks = associations.tiles(homes, insides, per)
        moves = (homes * chunks + insides * blocks).sum() / many
        assert moves <= most
    assert moves > associations.MOVES  # a cell for each pivot
