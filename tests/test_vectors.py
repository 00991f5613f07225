"""Rankings by blocked products against loops over all pairs."""

import math
import random

import pytest
from pyspark.sql import functions as F

from spindrift.operators import vectors as VEC

SHAPE = "id long, label string, vector array<float>"


def made(n, seed, first=0):
    r = random.Random(seed)
    some = [[float(r.randint(-3, 3)) for _ in range(5)] for _ in range(n // 3)]  # so equal scores are common
    out = [(first + i, r.choice("abc") if i % 9 else None, r.choice(some)) for i in range(n)]
    odd = [None, [], [0.0] * 5, [1.0, None, 1.0, 1.0, 1.0], [math.nan, 1.0, 1.0, 1.0, 1.0], [1.0, 2.0], [math.inf, 0.0, 0.0, 0.0, 0.0]]
    return out + [(first + n + i, "a", v) for i, v in enumerate(odd)]


def scored(q, candidates):
    """(-score, id, label) of what can be compared, in order."""
    def good(v):
        return bool(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)

    def cosine(a, b):
        return sum(x * y for x, y in zip(a, b, strict=True)) / math.sqrt(sum(x * x for x in a) * sum(x * x for x in b))

    return sorted((-round(cosine(q, v), 9), i, label or "") for i, label, v in candidates if good(q) and good(v) and len(v) == len(q))


@pytest.fixture(params=[(8192, 1024, 1), (7, 3, 5)])
def sides(spark, monkeypatch, request):
    rows, strip, parts = request.param
    monkeypatch.setattr(VEC, "BLOCK_ROWS", rows)
    monkeypatch.setattr(VEC, "STRIP", strip)
    q, c = made(30, 1), made(120, 2, 1000)
    return q, c, spark.createDataFrame(q, SHAPE), spark.createDataFrame(c, SHAPE).repartition(parts)


def test_top(sides):
    q, c, queries, candidates = sides
    for kind in ("all", "same", "other"):
        got = {}
        for r in VEC.top(queries, candidates, 4, kind).orderBy("id", "rank").collect():
            got.setdefault(r.id, []).append((-r.score, r.cand, r.cand_label or ""))
        for i, label, v in q:
            fits = [x for x in scored(v, c) if kind == "all" or (label is not None and (x[2] == label) == (kind == "same"))]
            if label is not None:
                assert got.get(i, []) == fits[:4], (kind, i)


def test_labels_and_first_hits(sides):
    q, c, queries, candidates = sides
    labels, ranks = {}, {r.id: (r.gold, r.gold_rank) for r in VEC.first_hits(queries.where("label IS NOT NULL"), candidates).collect()}
    for r in VEC.top_labels(queries, candidates.where("label IS NOT NULL"), 2).orderBy("id", "rank").collect():
        labels.setdefault(r.id, []).append((-r.score, r.label))
    for i, label, v in q:
        order = scored(v, c)
        best = {}
        for s, _, of in order:
            if of:
                best.setdefault(of, s)
        assert labels.get(i, []) == sorted((s, of) for of, s in best.items())[:2]
        if label is not None:
            at = next((k for k, x in enumerate(order) if x[2] == label), None)
            assert ranks[i] == ((None, None) if at is None else (order[at][1], at + 1))


def test_bad_rows_stay_in_their_place(sides, spark):
    q, c, queries, candidates = sides
    samples = queries.withColumn("position", F.col("id") + 5)
    rows = {r.position: r for r in VEC.rank_batch(samples, candidates, 3).collect()}
    assert sorted(rows) == [i + 5 for i, _, _ in q]
    for i, label, v in q:
        r, order = rows[i + 5], scored(v, c)
        assert (r.error is None) == bool(order) and len(r.ranking or []) == min(3, len(order))
        assert (r.correct is None) == (label is None or not order)
        assert r.prediction == (order[0][2] or None if order else None)
    none = VEC.rank_batch(samples, candidates.limit(0), 3).collect()
    assert len(none) == len(q) and all(r.error for r in none)
    assert VEC.rank_batch(samples.limit(0), candidates, 3).count() == 0


def test_no_pairs_in_the_plan(sides, monkeypatch):
    _, _, queries, candidates = sides
    plan = VEC.top(queries, candidates, 3)._jdf.queryExecution().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    monkeypatch.setattr(VEC, "MOST_BLOCKS", 0)
    with pytest.raises(ValueError):
        VEC.top(queries, candidates, 3)
