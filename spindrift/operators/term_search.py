"""The best items for each query text by symmetric BM25, without a row for any pair.

Queries, as counts of their terms, go to all tasks in blocks of about BLOCK_TERMS terms (one block in the driver's memory at a
time). Items stream past; each Arrow batch of them becomes postings with the highest gain that a term can give there. A query's terms
are added by falling bounds. Terms that together can't lift an item over the k-th best score so far (or over the least score
that counts) bring in no item, and items that the terms left can't lift so far go. Each task gives its k best of each query,
and nothing else is shuffled.

Scores are rounded to DIGITS digits; equal ones go by the item's id. Texts without a term find and are found by nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.similarity import IDF, K1, B
from .joins import term_counts

#: Terms of a block of queries, about, and blocks of a call at most.
BLOCK_TERMS, MOST_BLOCKS = 500_000, 256
#: Groups of a query's terms, each with half the bounds left.
HALVINGS = 9
#: Items of a set of postings.
ITEMS = 4096
DIGITS = 6


def _gain(count, length, other):
    return IDF * (K1 + 1) * count / (count + K1 * (1 - B + 2 * B * length / (length + other)))


def _part(x, y, n, m):
    """What a term gives that stands x times in a query of n terms and y times in an item of m."""
    return (x * _gain(y, m, n) + y * _gain(x, n, m)) / 2


def _score(raw):
    return raw / (raw + 1)


def _raw(score: float) -> float:
    return score / (1 - score) if score > 0 else 0.0


class Postings:
    """Where each term of some items stands, and how often."""

    def __init__(self, ids: np.ndarray, tokens: pa.ListArray):
        at = tokens.offsets.to_numpy()
        self.ids, self.sizes = ids, np.diff(at).astype(np.float64)
        coded = tokens.values.slice(at[0], at[-1] - at[0]).dictionary_encode()
        self.code = {t: i for i, t in enumerate(coded.dictionary.to_pylist())}
        spot, count = np.unique(coded.indices.to_numpy().astype(np.int64) * len(ids) + np.repeat(np.arange(len(ids)), np.diff(at)), return_counts=True)
        term, self.item = np.divmod(spot, len(ids))
        self.count = count.astype(np.float64)
        self.start = np.searchsorted(term, np.arange(len(self.code) + 1))
        self.most = np.maximum.reduceat(self.count, self.start[:-1]) if len(self.code) else np.zeros(0)
        held = self.sizes[self.sizes > 0]
        self.shortest, self.longest = (held.min(), held.max()) if len(held) else (1.0, 1.0)

    def _parts(self, codes: np.ndarray, x: np.ndarray, n: float, only: np.ndarray | None = None) -> np.ndarray:
        """Sums of the terms' parts for each item; only for some items."""
        width = self.start[codes + 1] - self.start[codes]
        at = np.arange(int(width.sum())) - np.repeat(np.cumsum(width) - width, width) + np.repeat(self.start[codes], width)
        x = np.repeat(x, width)
        if only is not None:
            keep = only[self.item[at]]
            at, x = at[keep], x[keep]
        item = self.item[at]
        return np.bincount(item, _part(x, self.count[at], n, self.sizes[item]), len(self.ids))

    def best(self, terms: list[str], counts: np.ndarray, n: float, k: int, above: float, least: float) -> tuple[np.ndarray, np.ndarray, int]:
        """Items and scores that may be among the k best, over `above` and not under `least`, and how many were scored by all terms.

        Terms go by falling bounds, in groups that halve what is left; after each group only those items stay open that the
        terms left could still lift to the k-th best score so far.
        """
        known = [(c, x) for t, x in zip(terms, counts, strict=True) if (c := self.code.get(t)) is not None]
        if not known:
            return np.zeros(0, dtype=np.int64), np.zeros(0), 0
        made = len(self.ids)
        codes, x = np.array([c for c, _ in known]), np.array([x for _, x in known])
        bound = _part(x, self.most[codes], n, np.array(self.shortest))
        bound = np.maximum(bound, (x * _gain(self.most[codes], self.shortest, n) + self.most[codes] * _gain(x, n, self.longest)) / 2)
        # scores are rounded, so what is as much as a rounding below still counts
        floor = _raw(max(above, least) - 10.0**-DIGITS)
        order = np.argsort(-bound, kind="stable")
        left = np.concatenate((np.cumsum(bound[order[::-1]])[::-1], [0.0]))  # what the terms from here on can still give
        idle = int(np.searchsorted(-left, -floor, side="left"))  # alone these can't lift an item over the floor
        cuts = sorted({0, idle, len(order), *(int(np.searchsorted(-left, -left[0] * 2.0**-h)) for h in range(1, HALVINGS))})
        raw, open_ = np.zeros(len(self.ids)), np.ones(len(self.ids), dtype=bool)
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            raw += self._parts(codes[order[a:b]], x[order[a:b]], n, open_)
            if b >= idle:
                open_ &= raw > 0
            if len(raw) > k:
                floor = max(floor, _raw(_score(np.partition(raw, -k)[-k]) - 10.0**-DIGITS))
            open_ &= raw + left[b] >= floor
            if b < len(order):
                made = int(open_.sum())
        items = np.flatnonzero(open_)
        return items, np.round(_score(raw[items]), DIGITS), made


class Query:
    """A query's terms and the best items that a task has found for it."""

    def __init__(self, id_, size: int, terms: list[str], counts: list[int], k: int):
        self.id, self.size, self.terms, self.counts, self.k = id_, float(size), terms, np.array(counts, dtype=np.float64), k
        self.best: list[tuple[float, int]] = []

    def search(self, postings: Postings, above: float) -> int:
        """Take what is better from some items; how many of them were scored."""
        least = -self.best[-1][0] if len(self.best) == self.k else 0.0
        items, scores, made = postings.best(self.terms, self.counts, self.size, self.k, above, least)
        keep = scores > above
        found = sorted(zip((-scores[keep]).tolist(), postings.ids[items[keep]].tolist(), strict=True))[: self.k]
        self.best = sorted([*self.best, *found])[: self.k]
        return made


def _blocks(queries: DataFrame) -> Iterator[list[tuple]]:
    counts = term_counts(queries, "id", "tokens").groupBy("id", "size").agg(F.collect_list(F.struct("token", "n")).alias("terms"))
    total = counts.agg(F.sum(F.size("terms"))).first()[0] or 0
    many = -(-total // BLOCK_TERMS)
    if many > MOST_BLOCKS:
        raise ValueError(f"queries need {many} blocks, over {MOST_BLOCKS}; deal them over several calls")
    for i in range(many):
        rows = counts.where(F.pmod(F.xxhash64("id"), F.lit(many)) == i).collect()
        yield [(r["id"], r["size"], [t["token"] for t in r["terms"]], [t["n"] for t in r["terms"]]) for r in rows]


def top_bm25(queries: DataFrame, items: DataFrame, k: int, above: float) -> DataFrame:
    """(id, item, score, rank): the k best items of each query with a score over `above`. Both tables are (id, tokens), ids whole numbers."""
    spark, out = queries.sparkSession, None
    shape = f"id {queries.schema['id'].dataType.simpleString()}, item {items.schema['id'].dataType.simpleString()}, score double"
    for block in _blocks(queries):
        held = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            own = [Query(*q, k) for q in held.value]
            for b in batches:
                for a in range(0, b.num_rows, ITEMS):
                    part = b.slice(a, ITEMS)
                    postings = Postings(part.column(0).to_numpy(), part.column(1))
                    for q in own:
                        q.search(postings, above)
            rows = [(q.id, item, -s) for q in own for s, item in q.best]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["id", "item", "score"])

        part = items.select("id", F.coalesce("tokens", F.array().cast("array<string>"))).mapInArrow(run, shape)
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], f"{shape}, rank int")
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "item"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k)
