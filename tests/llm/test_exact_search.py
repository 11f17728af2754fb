import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from zonewatch.llm import knn, negatives
from zonewatch.llm import vectors as V

SCHEMA = "vec_id long, embedding array<float>, label int, query_id long, score string"


def whole(vec, scale):
    if vec is None or any(x is None or not math.isfinite(x) for x in vec):
        return None
    return [math.floor(scale * float(np.float32(x))) for x in vec]


def dot(a, b):
    return sum(x * y for x, y in zip(a, b))


def by_score(entries):
    return sorted(entries, key=lambda e: (-e[1], e[0] is None, e[0] or 0))


def neighbours(rows, k, asks):
    got = []
    valid = [(r[0], v) for r in rows if (v := whole(r[1], knn.SCALE)) is not None]
    for i, (a, q) in enumerate(valid):
        if a is not None and asks(a):
            best = by_score([(b, dot(q, x)) for j, (b, x) in enumerate(valid) if j != i])[:k]
            got += [(a, n + 1, b, s) for n, (b, s) in enumerate(best)]
    return sorted(got, key=str)


def hard(rows, asks, p=5, n=5):
    valid = [(r[0], r[2], v) for r in rows if r[2] is not None and (v := whole(r[1], negatives.SCALE)) is not None]
    got = []
    for i, (a, la, q) in enumerate(valid):
        if a is None or not asks(a):
            continue
        others = [(b, dot(q, x), lb == la) for j, (b, lb, x) in enumerate(valid) if j != i]
        for b, s, _ in by_score([e for e in others if e[2]])[:p]:
            window = by_score([e for e in others if not e[2] and 80 * s <= 100 * e[1] <= 100 * s])[:n]
            got += [(a, b, k + 1, c, s, t) for k, (c, t, _) in enumerate(window)]
    return sorted(got, key=str)


def table(rng, n, d=6, labels=3):
    rows = []
    centres = [[rng.gauss(0, 1) for _ in range(d)] for _ in range(4)]
    for i in range(n):
        c = rng.choice(centres)
        rows.append((i, [x + rng.gauss(0, 0.3) for x in c], rng.randrange(labels), i, "x"))
    return rows


CASES = {
    "clusters": lambda r: table(r, 400),
    "hot": lambda r: table(r, 200) + [(1000 + i, [1.0, 0.5, 0.0, 0.0, 0.0, 0.0], i % 2, 0, None) for i in range(150)],
    "odd": lambda r: table(r, 60) + [(100, None, 1, 0, ""), (110, [1.0, None, 0.0], 1, 0, ""), (120, [float("nan")] * 6, 1, 0, ""),
                                     (130, [], 1, 0, ""), (140, [2.0], 0, 0, ""), (140, [2.0], 0, 0, ""), (140, [3.0, 1.0], 1, 0, ""),
                                     (150, [0.5] * 9, None, 0, ""), (None, [2.0], 0, 0, ""), (None, [2.0], 1, 0, ""),
                                     (160, [float("inf")], 0, 0, ""), (9990, [1e30] * 6, 0, 0, "")],
    "zeros": lambda r: [(i, [0.0] * 4, i % 3, 0, "") for i in range(40)] + [(50, [-1.0, 0.0, 0.0, 0.0], 0, 0, "")],
    "few": lambda r: [(0, [1.0, 2.0], 1, 0, ""), (10, [1.0, 2.0], 1, 0, ""), (20, [1.0, 1.9], 2, 0, "")],
    "one": lambda r: [(0, [1.0], 1, 0, "")],
    "none": lambda r: [],
}


#: With True: pieces of a few rows, so that each query meets its rows in many tasks.
RUNS = [(c, True) for c in CASES if c != "one"] + [("one", False), ("odd", False)]


def pieces(monkeypatch, small):
    if small:
        monkeypatch.setattr(V, "CHUNK_ROWS", 40)
        monkeypatch.setattr(V, "BLOCK_QUERIES", 7)


@pytest.mark.parametrize("case,small", RUNS)
def test_nearest(spark, case, small, monkeypatch):
    pieces(monkeypatch, small)
    rows = CASES[case](random.Random(5))
    asks = lambda i: i % 10 == 0
    got = knn.nearest(spark.createDataFrame(rows, SCHEMA).repartition(3), F.col("vec_id") % 10 == 0, k=4)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    want = neighbours([r for r in rows if r[0] != 9990], 4, asks)
    assert sorted(map(tuple, got.collect()), key=str) == want


@pytest.mark.parametrize("case,small", RUNS)
def test_hard_negatives(spark, case, small, monkeypatch):
    pieces(monkeypatch, small)
    rows = CASES[case](random.Random(6))
    asks = lambda i: i % 10 == 0
    got = negatives.mine(spark.createDataFrame(rows, SCHEMA).repartition(3), F.col("vec_id") % 10 == 0)
    want = hard([r for r in rows if r[0] != 9990], asks)
    assert sorted((tuple(r[c] for c in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))
                   for r in got.collect()), key=str) == want


def test_bounds_leave_out_other_clusters(spark):
    """Of well separated clusters, a group of queries is sent its own."""
    rng = random.Random(1)
    rows = [(i, [100.0 * (c == i % 8) + rng.gauss(0, 0.1) for c in range(8)], 0, 0, "") for i in range(4000)]
    x = np.array([whole(r[1], knn.SCALE) for r in rows])
    cells = knn.Cells(x[:64], float((x.astype(float) ** 2).sum(1).max()))
    _, cell, d = cells.home(x)
    near = np.sort(np.array([np.append(d[cell == c], [np.inf] * 11)[:11] for c in range(64)]))
    q = x[:1]
    reach = np.sort((cells.distances(q, True)[0][:, None] + near).ravel())[10]
    kept = cells.distances(q, True)[0][cell] - d <= reach
    assert 11 <= kept.sum() <= 1000 and set(np.flatnonzero(kept) % 8) == {0}


@pytest.mark.parametrize("least", [-50.0, 0.0, 200.0, 900.0, 5000.0])
def test_pruned_index_finds_all_pairs(least):
    rng = np.random.default_rng(3)
    x, q = rng.integers(-20, 20, (700, 24)), rng.integers(-20, 20, (60, 24))
    x[::3] //= 4
    want = {(i, r) for i, r in zip(*np.nonzero(q @ x.T >= least))}
    got = [(a, b, c) for i, r, s in negatives.join_above(q, x, np.full(60, least)) for a, b, c in zip(i, r, s)]
    assert len(got) == len(want) and {(a, b) for a, b, _ in got} == want
    assert all(int(q[a] @ x[b]) == c for a, b, c in got)


def test_index_omits_what_lengths_cover():
    rng = np.random.default_rng(4)
    x = rng.normal(0, 1, (500, 16)) * 100 * (0.5 ** np.arange(16))
    cuts = list(range(0, 17, 2))
    index = negatives.Index(x.astype(np.int64), np.arange(16), cuts, np.array([100.0] * 8 + [0.0]), 2000.0)
    assert index.postings[0] > index.postings[1] > index.postings[-1] == 0


def test_products_beyond_doubles():
    a = np.array([[2 ** 30 + 1, 1], [-(2 ** 30), 7]])
    assert V.products(a, a).tolist() == [[dot(p, q) for q in a.tolist()] for p in a.tolist()]
