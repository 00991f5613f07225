"""Rankings of every candidate vector for each query, by blocked matrix products.

Queries go to all tasks in blocks of at most BLOCK_ROWS rows and BLOCK_BYTES bytes (one block in the driver's memory at a time);
candidates stream past in Arrow batches, so nothing is shuffled but what a task keeps: the best of each query, or counts.
The work is queries times candidates, which every exact ranking costs. There is no pair of rows anywhere.

Scores are cosines rounded to DIGITS digits; equal ones go by the candidate's id. Vectors that are null, empty, zero or not
finite, or of another length than a query's, are no candidates of it; a query without a usable vector gets no row here.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Queries of a block, bytes of their vectors, and blocks of a call at most.
BLOCK_ROWS, BLOCK_BYTES, MOST_BLOCKS = 8192, 64 << 20, 256
#: Queries and candidates that are multiplied at once.
STRIP = 1024
DIGITS = 9


def _units(column: pa.Array) -> tuple[list[np.ndarray], np.ndarray]:
    """Unit vectors of the rows that have a usable one, and where these stand."""
    out, at = [], []
    for i, x in enumerate(column):
        if x.is_valid and len(x) and not x.values.null_count:
            v = x.values.to_numpy().astype(np.float64)
            top = np.abs(v).max()
            if np.isfinite(top) and top > 0:
                v = v / top
                out.append(v / np.sqrt(v @ v))
                at.append(i)
    return out, np.array(at, dtype=np.int64)


class Block:
    """Some queries with vectors of one length: ids, labels and unit vectors; a score and a candidate that they are held against."""

    def __init__(self, unit: np.ndarray, ids: np.ndarray, labels: np.ndarray, score: np.ndarray | None = None, cand: np.ndarray | None = None):
        self.unit, self.ids, self.labels, self.score, self.cand = unit, ids, labels, score, cand

    def products(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray]]:
        """(queries, scores, ids, labels) for strips of queries and of candidates (id, label, vector)."""
        for b in batches:
            for a in range(0, b.num_rows, STRIP):
                part = b.slice(a, STRIP)
                vectors, at = _units(part.column(2))
                fits = [i for i, v in enumerate(vectors) if len(v) == self.unit.shape[1]]
                if not fits:
                    continue
                unit, at = np.array([vectors[i] for i in fits]), at[fits]
                ids, labels = (part.column(c).to_numpy(zero_copy_only=False)[at] for c in (0, 1))
                for q in range(0, len(self.ids), STRIP):
                    rows = slice(q, q + STRIP)
                    yield rows, np.round(self.unit[rows] @ unit.T, DIGITS), ids, labels


def _blocks(queries: DataFrame) -> Iterator[Block]:
    """Queries (id, label, vector, and score and cand if there are) in blocks, one after the other through the driver."""
    n, size = queries.agg(F.count("*"), F.sum(8 * F.greatest(F.size("vector"), F.lit(0)))).first()
    many = max(-(-n // BLOCK_ROWS), -(-(size or 0) // BLOCK_BYTES))
    if many > MOST_BLOCKS:
        raise ValueError(f"queries need {many} blocks, over {MOST_BLOCKS}; deal them over several calls")
    names = ["id", "label", *[c for c in ("score", "cand") if c in queries.columns]]
    for i in range(many):
        table = queries.where(F.pmod(F.xxhash64("id"), F.lit(many)) == i).select("vector", *names).toArrow()
        if not table.num_rows:
            continue
        vectors, at = _units(table.column("vector").combine_chunks())
        columns = [table.column(c).to_numpy()[at] for c in names]
        sizes = np.array([len(v) for v in vectors])
        for length in sorted(set(sizes.tolist())):
            some = np.flatnonzero(sizes == length)
            yield Block(np.array([vectors[k] for k in some]), *[c[some] for c in columns])


def _over(queries: DataFrame, candidates: DataFrame, shape: str, work: Callable[[Block, Iterator[pa.RecordBatch]], list]) -> DataFrame:
    """The columns that work gives for each block of queries and each task's candidates."""
    spark, out = queries.sparkSession, None
    names = [x.split()[0] for x in shape.split(", ")]
    for block in _blocks(queries):
        held = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            if columns := work(held.value, batches):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)

        part = candidates.select("id", "label", "vector").mapInArrow(run, shape)
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], shape) if out is None else out


def _kind(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


class _Kept:
    """The k best candidates of each query so far."""

    def __init__(self, n: int, k: int, ids: np.ndarray, labels: np.ndarray):
        self.k, self.score = k, np.full((n, k), -np.inf)
        self.ids, self.labels = np.full((n, k), ids[0]), np.full((n, k), labels[0], dtype=labels.dtype)

    def take(self, rows: slice, score: np.ndarray, ids: np.ndarray, labels: np.ndarray, by_label: bool) -> None:
        hopeful = np.flatnonzero((score >= self.score[rows][:, -1:]).any(axis=0))
        score, ids, labels = score[:, hopeful], ids[hopeful], labels[hopeful]
        score = np.hstack([self.score[rows], score])
        ids = np.hstack([self.ids[rows], np.broadcast_to(ids, (len(score), len(ids)))])
        labels = np.hstack([self.labels[rows], np.broadcast_to(labels, (len(score), len(labels)))])
        if by_label:  # of each label only its best
            code = np.unique(labels, return_inverse=True)[1].reshape(labels.shape)
            order = np.lexsort((-score, code), axis=-1)
            sorted_ = np.take_along_axis(code, order, axis=1)
            again = np.zeros(score.shape, dtype=bool)
            np.put_along_axis(again, order[:, 1:], sorted_[:, 1:] == sorted_[:, :-1], axis=1)
            score, ids = np.where(again, -np.inf, score), code
        order = np.lexsort((ids, -score), axis=-1)[:, : self.k]
        self.score[rows], self.labels[rows] = (np.take_along_axis(x, order, axis=1) for x in (score, labels))
        if not by_label:
            self.ids[rows] = np.take_along_axis(ids, order, axis=1)


def _best(queries: DataFrame, candidates: DataFrame, k: int, labels: str) -> DataFrame:
    def work(block: Block, batches: Iterator[pa.RecordBatch]) -> list:
        kept = None
        for rows, score, ids, own in block.products(batches):
            kept = kept or _Kept(len(block.ids), k, ids, own)
            if labels in ("same", "other"):
                score = np.where((block.labels[rows][:, None] == own[None, :]) == (labels == "same"), score, -np.inf)
            kept.take(rows, score, ids, own, labels == "each")
        if kept is None:
            return []
        q, c = np.nonzero(np.isfinite(kept.score))
        return [block.ids[q], kept.ids[q, c], kept.labels[q, c], kept.score[q, c]]

    return _over(queries, candidates, f"id {_kind(queries, 'id')}, cand {_kind(candidates, 'id')}, cand_label {_kind(candidates, 'label')}, score double", work)


def top(queries: DataFrame, candidates: DataFrame, k: int, labels: str = "all") -> DataFrame:
    """(id, cand, cand_label, score, rank): the k best candidates of each query; of all, or of those whose label is the `same` or an `other`.

    Both tables are (id, label, vector), ids whole numbers. A task keeps k candidates for each query.
    """
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "cand"))
    return _best(queries, candidates, k, labels).withColumn("rank", rank).where(F.col("rank") <= k)


def top_labels(queries: DataFrame, candidates: DataFrame, k: int) -> DataFrame:
    """(id, label, score, rank): the k best different labels of each query, by their best candidate, then the label."""
    each = _best(queries, candidates, k, "each").groupBy("id", F.col("cand_label").alias("label")).agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "label"))
    return each.withColumn("rank", rank).where(F.col("rank") <= k)


def first_hits(queries: DataFrame, candidates: DataFrame) -> DataFrame:
    """(id, gold, gold_rank) of each query: its best candidate of the same label and that one's rank among all; null if there is none.

    No ranking is sorted: the best hit is found first, then those that stand before it are counted.
    """
    gold = top(queries, candidates, 1, "same").select("id", "cand", "score")

    def work(block: Block, batches: Iterator[pa.RecordBatch]) -> list:
        n = np.zeros(len(block.ids), dtype=np.int64)
        for rows, score, ids, _ in block.products(batches):
            at, own = block.score[rows][:, None], block.cand[rows][:, None]
            n[rows] += ((score > at) | ((score == at) & (ids[None, :] < own))).sum(axis=1)
        return [block.ids, n]

    before = _over(queries.join(gold, "id"), candidates, f"id {_kind(queries, 'id')}, n long", work)
    ranks = before.groupBy("id").agg((F.sum("n") + 1).alias("gold_rank")).join(gold.select("id", F.col("cand").alias("gold")), "id")
    return queries.select("id").join(ranks, "id", "left").select("id", "gold", "gold_rank")


def rank_batch(samples: DataFrame, candidates: DataFrame, k: int) -> DataFrame:
    """A row for each sample (position, id, label, vector), in its place: prediction, correct, gold_rank, ranking and error.

    A sample without a usable vector, or without any candidate, is an error row and no other sample's row moves for it.
    correct and gold_rank are null where the sample has no label.
    """
    best = top(samples, candidates, k)
    ranking = best.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("rank", "cand", "cand_label", "score"))).alias("ranking"))
    rows = samples.select("position", "id", "label").join(ranking, "id", "left").join(first_hits(samples, candidates), "id", "left")
    ranked, labelled = F.col("ranking").isNotNull(), F.col("label").isNotNull()
    return rows.select(
        "position",
        "id",
        "label",
        F.col("ranking")[0]["cand_label"].alias("prediction"),
        F.when(ranked & labelled, F.coalesce(F.col("gold_rank") == 1, F.lit(False))).alias("correct"),
        F.when(ranked & labelled, F.col("gold_rank")).alias("gold_rank"),
        "ranking",
        F.when(~ranked, "missing vector or candidates").alias("error"),
    )
