"""Searches over embeddings against brute force over all pairs, in Python's integers."""

import math
import random

import numpy as np
import pytest

from tidemark.llm import negatives, pivots, vectors

SCHEMA = "vec_id long, embedding array<float>, label int, score string, rank long"


def _usable(row):
    return row[0] is not None and row[1] is not None and all(x is not None and math.isfinite(x) for x in row[1])


def _score(a, b):
    total = sum(math.floor(256 * float(np.float32(x))) * math.floor(256 * float(np.float32(y))) for x, y in zip(a, b))
    return max(-(2**63), min(2**63 - 1, total))


def _nearest(rows, every, k):
    rows = [r for r in rows if _usable(r)]
    out = []
    for q in {(r[0], tuple(r[1])) for r in rows if r[0] % every == 0}:
        others = [(-_score(q[1], r[1]), r[0]) for r in rows if r[0] != q[0] and len(r[1]) == len(q[1])]
        out += [(q[0], i + 1, v, -s) for i, (s, v) in enumerate(sorted(others)[:k])]
    return sorted(out)


def _mined(rows):
    moved = [(v, e, (lab + 1) % 10 if v % 7 == 0 else lab) for v, e, lab, *_ in rows if _usable((v, e)) and lab is not None]
    out = []
    for a in {(v, tuple(e), lab) for v, e, lab in moved if v % 100 == 0}:
        scored = sorted((-_score(a[1], e), v, lab) for v, e, lab in moved if len(e) == len(a[1]))
        own = [(-s, v) for s, v, lab in scored if lab == a[2] and v != a[0]][:5]
        for positive, at in own:
            fit = [(-s, v) for s, v, lab in scored if lab != a[2] and 80 * positive <= -100 * s <= 100 * positive]
            out += [(a[0], at, i + 1, v, positive, s) for i, (s, v) in enumerate(fit[:5])]
    return sorted(out)


def _rows(n, seed=0, centres=6, length=8):
    rng = random.Random(seed)
    middles = [[rng.gauss(0, 1) for _ in range(length)] for _ in range(centres)]
    rows = []
    for i in range(n):
        middle = rng.choice(middles)
        rows.append((i, [m + rng.gauss(0, 0.2) for m in middle], rng.randrange(4), "x", 1))
    return rows


def _odd(n):
    rows = _rows(n, seed=2)
    rows += [(n, None, 1, None, None), (None, [0.1] * 8, 1, None, None), (n + 1, [math.nan] * 8, 1, None, None)]
    rows += [(n + 2, [math.inf] * 8, 1, None, None), (n + 3, [None] * 8, 1, None, None), (n + 4, [0.5] * 8, None, None, None)]
    rows += [(100 * (n + 1), [], 1, None, None), (100 * (n + 2), [0.3, 0.4], 1, None, None), (7, [0.3, 0.5], 2, None, None)]
    rows += [rows[5]] * 3 + [rows[100]] * 2 + [(100, [0.2] * 8, 3, None, None)]
    # A vector that a third of all rows share.
    return rows + [(10_000 + i, [0.5] * 8, i % 4, None, None) for i in range(n // 2)]


def _frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.mark.parametrize("rows", [_rows(600), _odd(400), _rows(3), []], ids=["clusters", "odd", "few", "empty"])
def test_nearest_against_all_pairs(spark, rows):
    got = pivots.nearest(_frame(spark, rows))
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, got.collect())) == _nearest(rows, 50, 5)


@pytest.mark.parametrize("rows", [_rows(600), _odd(400), _rows(3), []], ids=["clusters", "odd", "few", "empty"])
def test_mining_against_all_pairs(spark, rows):
    got = negatives.mined_embeddings(_frame(spark, rows))
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, got.collect())) == _mined(rows)


def test_queries_in_several_slabs(spark, monkeypatch):
    monkeypatch.setattr(vectors, "SLAB_BYTES", 8 * 8 * 5)
    rows = _rows(700, seed=4)
    assert sorted(map(tuple, pivots.nearest(_frame(spark, rows)).collect())) == _nearest(rows, 50, 5)
    monkeypatch.setattr(vectors, "SLAB_BYTES", 8 * 8 * 3)
    assert sorted(map(tuple, negatives.mined_embeddings(_frame(spark, rows)).collect())) == _mined(rows)


def test_scores_that_doubles_would_round(spark):
    rows = [(50 * i, [3e7 + i, 1e6 * i, 1.0], i % 2, None, None) for i in range(8)] + [(9, [1e30, 1.0, 1.0], 1, None, None)]
    assert sorted(map(tuple, pivots.nearest(_frame(spark, rows)).collect())) == _nearest(rows, 50, 5)


def test_bounds_spare_candidates_and_stop_early():
    """On clustered vectors most candidates are never scored."""
    rng = np.random.default_rng(1)
    centres = rng.normal(0, 1, (20, 16))
    data = np.floor(256 * (centres[rng.integers(0, 20, 4000)] + rng.normal(0, 0.02, (4000, 16))))
    own = pivots.chosen_pivots(data[:500], 16)
    assert len(own) == 16 and len(np.unique(own, axis=0)) == 16
    far, ids = pivots.distances(data, own), np.arange(4000)
    queries = pivots._Queries(np.arange(5), ids[:5], data[:5], far[:5], 3)
    seen = []
    scored = vectors.products
    pivots.products = lambda a, b: seen.append(len(b)) or scored(a, b)
    try:
        for start in range(0, 4000, 1000):
            part = slice(start, start + 1000)
            queries.meet(ids[part], data[part], far[part])
    finally:
        pivots.products = scored
    assert sum(seen) < 0.6 * 5 * 4000
    for q in range(5):
        scores = (data @ data[q]).astype(np.int64)
        scores[q] = -(2**62)
        assert queries.found[q].tolist() == np.lexsort((ids, -scores))[:3].tolist()
