"""The inverted multi-index against brute force, and its defined cases."""

import heapq
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spindrift.llm import nearest
from spindrift.llm.common import Scratch

SHAPE = "vec_id long, embedding array<float>, node long, cell string"


def plain(rows, asks, k=5):
    """What takes part, compared pair by pair."""
    usable = [(i, v) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = []
    for at, (q, v) in enumerate(usable):
        if q is None or not asks(q):
            continue
        scored = []
        for other, (i, w) in enumerate(usable):
            if other != at and len(v) == len(w):
                dot = sum(x * y for x, y in zip(v, w, strict=True))
                scored.append((-dot / (math.sqrt(sum(x * x for x in v)) * math.sqrt(sum(x * x for x in w))), i is None, i or 0, i))
        out += [(q, n + 1, s[3], round(-s[0], 9)) for n, s in enumerate(heapq.nsmallest(k, scored))]
    return sorted(out, key=str)


def found(spark, rows, asks, **more):
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], SHAPE)
    return sorted([(r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in nearest.nearest(df, Scratch(spark), asks, **more).collect()], key=str)


def test_odd_vectors(spark):
    f = lambda *x: [float(np.float32(y)) for y in x]
    nan, inf = float("nan"), float("inf")
    rows = [(0, f(1, 2, 3)), (50, f(1, 2, 3)), (1, f(2, 4, 6)), (2, None), (100, f(0, 0, 0)), (150, f(nan, 1, 1)), (3, f(inf, 1, 1)), (200, [1.0, None, 2.0]), (250, [])]
    rows += [(4, f(3, 2, 1)), (5, f(-1, 0, 0)), (None, f(1, 2, 3)), (None, f(1, 2, 3.5)), (0, f(1, 2, 3)), (300, f(1, 2)), (6, f(2, 1)), (350, f(7)), (400, f(1, 0, 0)), (7, f(1e-30, 1e30, 0))]
    assert found(spark, rows, F.col("id") % 50 == 0, recall=1.0) == plain(rows, lambda i: i % 50 == 0)
    assert found(spark, rows[:1], F.col("id") == 0) == []
    assert found(spark, [], F.col("id") == 0) == []
    assert found(spark, [(1, None)], F.col("id") == 1) == []


def test_equal_vectors_beyond_a_region(spark, monkeypatch):
    monkeypatch.setattr(nearest, "REGION", 64)
    r = random.Random(2)
    near = [[float(np.float32(1 + r.random() / 50)) for _ in range(6)] for _ in range(300)]  # a cell that takes several regions
    rows = [(i, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0]) for i in range(400)] + [(1000 + i, v) for i, v in enumerate(near)]
    assert found(spark, rows, F.col("id") % 50 == 0, recall=1.0) == plain(rows, lambda i: i % 50 == 0)


def test_walk_is_in_order():
    rng = np.random.default_rng(1)
    one, other = rng.random(7), rng.random(9)
    counts = rng.integers(0, 3, 63).tolist()
    cells = nearest._walk(one, other, counts, 40)
    total = (one[:, None] + other[None, :]).ravel()
    order = [c for c in np.argsort(total, kind="stable").tolist() if counts[c]]
    assert cells == order[: len(cells)]
    held = np.cumsum([counts[c] for c in cells])
    assert held[-1] >= 40 > held[-2]
    assert sorted(nearest._walk(one, other, counts, 10**9)) == sorted(order)


@pytest.mark.parametrize("clusters", [0, 40])
def test_recall(spark, clusters):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(4000, 24))
    if clusters:
        x = x * 0.3 + rng.normal(size=(clusters, 24))[rng.integers(0, clusters, 4000)]
    x = x.astype(np.float32)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<float>")
    got = nearest.nearest(df, Scratch(spark), F.col("id") % 20 == 0).collect()
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    hits = 0
    for q in range(0, 4000, 20):
        score = unit @ unit[q]
        score[q] = -2
        mine = [r for r in got if r.query_id == q]
        assert sorted(r["rank"] for r in mine) == [1, 2, 3, 4, 5]
        assert all(abs(r.score - score[r.vec_id]) < 1e-12 for r in mine)
        hits += len({r.vec_id for r in mine} & set(np.argsort(-score)[:5].tolist()))
    assert hits >= 0.93 * 1000
