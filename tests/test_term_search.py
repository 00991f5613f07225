"""Bounded BM25 search against the score of every pair."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spindrift.functions.similarity import IDF, K1, B
from spindrift.operators import term_search as TS


def score(a, b):
    x, y, n, m = Counter(a), Counter(b), len(a), len(b)

    def gain(count, length, other):
        return IDF * (K1 + 1) * count / (count + K1 * (1 - B + 2 * B * length / (length + other)))

    raw = sum((x[t] * gain(y[t], m, n) + y[t] * gain(x[t], n, m)) / 2 for t in x.keys() & y.keys())
    return round(raw / (raw + 1), 6)


def made(n, seed, longest=40):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(30)]
    weights = [1 / (1 + i) for i in range(30)]
    return [(i, None if i % 19 == 18 else r.choices(words, weights, k=r.randint(0, longest))) for i in range(n)]


@pytest.mark.parametrize(("k", "above", "block", "items"), [(5, 0.5, 500_000, 4096), (3, 0.0, 40, 7), (1, 0.9, 500_000, 16), (200, 0.1, 500_000, 32)])
def test_against_every_pair(spark, monkeypatch, k, above, block, items):
    monkeypatch.setattr(TS, "BLOCK_TERMS", block)
    monkeypatch.setattr(TS, "ITEMS", items)
    q, c = made(25, 1), made(90, 2)
    shape = "id long, tokens array<string>"
    got = {}
    for r in TS.top_bm25(spark.createDataFrame(q, shape), spark.createDataFrame(c, shape).repartition(3), k, above).orderBy("id", "rank").collect():
        got.setdefault(r.id, []).append((-r.score, r.item))
    for i, tokens in q:
        every = sorted((-s, j) for j, other in c if (s := score(tokens or [], other or [])) > above)
        assert got.get(i, []) == every[:k]


def test_few_items_are_scored_to_the_end():
    q, c = made(200, 3, 60), made(4000, 4, 60)
    c = [(i, t or []) for i, t in c]
    postings = TS.Postings(np.arange(len(c)), pa.array([t for _, t in c]))
    scored = 0
    for i, tokens in q:
        counts = Counter(tokens or [])
        query = TS.Query(i, sum(counts.values()), list(counts), list(counts.values()), 5)
        scored += query.search(postings, 0.5) if counts else 0
    assert scored < 0.1 * len(q) * len(c)


def test_blocks_are_bounded(spark, monkeypatch):
    q = spark.createDataFrame(made(25, 1), "id long, tokens array<string>")
    monkeypatch.setattr(TS, "MOST_BLOCKS", 0)
    with pytest.raises(ValueError):
        TS.top_bm25(q, q, 5, 0.5)
    assert TS.top_bm25(q.where(F.lit(False)), q, 5, 0.5).count() == 0
