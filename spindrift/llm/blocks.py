"""Pairs among the members of groups, in blocks of bounded size and without a row for each pair.

A group's members fall by hash into chunks; a block is two chunks (or one). For each member it returns the weight of what it
is linked to there, and the edges of a forest that joins what is linked there. Rows made are members times chunks, results
are members and forest edges: neither holds the pairs. A task gets its blocks one after the other, in sorted runs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import frugal, least_reached

#: Members of a chunk, about.
CHUNK = 1024
#: Blocks of so many members are worked on together.
SHORT = 32
RESULT = "node binary, other binary, n long"


def in_blocks(members: DataFrame, group: list[str], chunks: Column) -> DataFrame:
    """members (with a `node`) with columns block_i, block_j and side: a row for each pair of chunks that a member's chunk is in."""
    chunk = F.pmod(F.xxhash64("node"), F.col("chunks_")).cast("int")
    placed = members.withColumn("chunks_", chunks.cast("int")).withColumn("chunk_", chunk)
    each = placed.withColumn("with_", F.explode(F.expr("sequence(0, chunks_ - 1)")))
    return each.select("*", F.least("chunk_", "with_").alias("block_i"), F.greatest("chunk_", "with_").alias("block_j"), F.col("chunk_").alias("side")).drop("chunks_", "chunk_", "with_")


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole blocks, whose rows stand together, and where each block begins (one more for the end)."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        table = pa.Table.from_batches(held)
        cuts = _cuts(table, keys)
        if len(cuts) > 2:  # the last block may go on in the next batch
            yield table.slice(0, int(cuts[-2])), cuts[:-1]
            held = table.slice(int(cuts[-2])).combine_chunks().to_batches()
    if held:
        table = pa.Table.from_batches(held)
        yield table, _cuts(table, keys)


def _cuts(table: pa.Table, keys: list[str]) -> np.ndarray:
    new = np.ones(table.num_rows, dtype=bool)
    new[1:] = False
    for k in keys:
        v = table.column(k).to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return np.append(np.flatnonzero(new), table.num_rows)


def _within(n: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs i < j of rows within each of several short stretches of n rows."""
    i = np.repeat(start, n) + _counted(n)
    left = np.repeat(start + n, n) - i - 1  # rows after i in its stretch
    return np.repeat(i, left), np.repeat(i, left) + 1 + _counted(left)


def _counted(n: np.ndarray) -> np.ndarray:
    """0 to n - 1 for each n, one after the other."""
    return np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)


def run_blocks(blocks: DataFrame, group: list[str], work: Callable[[pa.Table, np.ndarray, np.ndarray], pa.Table], shape: str) -> DataFrame:
    """work(rows, i, j) over rows of whole blocks and the pairs i < j of rows that are a block's own; short blocks go together."""
    keys = [*group, "block_i", "block_j"]

    def pairs(side: np.ndarray, across: bool) -> tuple[np.ndarray, np.ndarray]:
        if not across:
            return np.triu_indices(len(side), 1)
        one, other = np.flatnonzero(side == side[0]), np.flatnonzero(side != side[0])
        i, j = np.repeat(one, len(other)), np.tile(other, len(one))
        return np.minimum(i, j), np.maximum(i, j)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, cuts in _runs(batches, keys):
            n = np.diff(cuts)
            across = table.column("block_i").to_numpy()[cuts[:-1]] != table.column("block_j").to_numpy()[cuts[:-1]]
            short = (n <= SHORT) & ~across & (n > 1)
            tables = []
            if short.any():
                rows = np.repeat(short, n)
                some = table.filter(pa.array(rows)).combine_chunks()
                few = n[short]
                tables.append(work(some, *_within(few, np.cumsum(few) - few)))
            for k in np.flatnonzero(~short & (n > 1)):
                block = table.slice(int(cuts[k]), int(n[k])).combine_chunks()
                tables.append(work(block, *pairs(block.column("side").to_numpy(), bool(across[k]))))
            for t in tables:
                yield from t.to_batches()

    return blocks.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(frugal(run), shape)


def verify(blocks: DataFrame, group: list[str], linked: Callable[[pa.Table, np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """linked(rows, i, j) tells which pairs are links. Rows have a node, once in a block, and its weight `mult`."""

    def work(table: pa.Table, i: np.ndarray, j: np.ndarray) -> pa.Table:
        good = linked(table, i, j)
        i, j = i[good], j[good]
        mult = table.column("mult").to_numpy()
        weight = np.bincount(i, weights=mult[j], minlength=len(mult)) + np.bincount(j, weights=mult[i], minlength=len(mult))
        has = np.flatnonzero(weight)
        least = least_reached(len(mult), i, j)
        down = np.flatnonzero(least != np.arange(len(mult)))
        nodes = table.column("node").combine_chunks()
        nodes = nodes.chunk(0) if isinstance(nodes, pa.ChunkedArray) else nodes
        node = pa.concat_arrays([nodes.take(pa.array(has)), nodes.take(pa.array(down))])
        other = pa.concat_arrays([pa.nulls(len(has), pa.binary()), nodes.take(pa.array(least[down])).cast(pa.binary())])
        return pa.table({"node": node.cast(pa.binary()), "other": other, "n": pa.array(np.concatenate((weight[has], np.zeros(len(down)))).astype(np.int64))})

    return run_blocks(blocks, group, work, RESULT)


def per_node(verified: DataFrame) -> DataFrame:
    return verified.groupBy("node").agg(F.sum("n").alias("n"))


def edges(verified: DataFrame) -> DataFrame:
    return verified.where("other IS NOT NULL").select("node", "other")
