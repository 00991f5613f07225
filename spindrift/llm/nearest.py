"""Approximate nearest neighbours by an inverted multi-index.

1. Equal vectors are one node, with its k + 1 smallest members. All that follows works on nodes, so copies cost nothing.
2. Each half of the unit vectors is quantised by a codebook of its own (k-means on a bounded sample, see FIT_ROWS); a cell is a
   pair of centroids. Every node is put into its cell.
3. A query walks through the cells in order of its summed distance to their two centroids, with a heap that holds the next pairs
   (_walk), until the cells passed hold `reach` nodes.
4. `reach` is steered by the data: of a bounded sample of nodes the true neighbours among all nodes are found by blocked
   matrix products, and `reach` is the least number of nodes that holds at least RECALL of them. Where neighbours are near,
   few cells suffice; where vectors have no clusters, many do.
5. Cells are packed into regions of about REGION nodes (a larger cell takes several). A region's nodes are held by a task while
   the queries that walk through one of its cells stream past; the best of each query and region are reranked by the cosine
   in double precision, summed in the order of the components, so that no block size moves a last bit.

Nothing is dropped: each walked cell is compared whole. A region's queries are split over tasks beyond QUERIES of them.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components take no part, neither as queries nor as
candidates. Vectors are compared with those of the same length only; more than LENGTHS different lengths are refused. A query's
own row is no candidate, another row of the same id is. Of equal cosines the smaller id comes first, null last. A query with
fewer than k candidates gets all. A repeated query gets a ranking for each of its rows. An empty table gives no rows; extra
columns don't matter.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, first_by_hash, frugal, join_heavy, slices

K = 5
#: Rows, and bytes of their vectors, that the codebooks are fitted on at most.
FIT_ROWS, FIT_BYTES = 20_000, 32 << 20
#: Nodes whose true neighbours steer the reach, and the share of those that is asked for.
PROBES, RECALL = 256, 0.97
#: Nodes for each cell that the number of centroids aims at; most centroids of a half.
PER_CELL, CENTROIDS = 64, 256
#: Nodes of a region, about, and most bytes of their vectors.
REGION, REGION_BYTES = 4096, 32 << 20
#: Queries of a region, about, that one task compares.
QUERIES = 65_536
#: Queries and nodes that are multiplied at once.
BLOCK = 1024
LENGTHS = 16
ROUNDS = 12
#: Scores of a matrix product may differ so much from those summed in order.
NEAR = 1e-9


class Codebook:
    """Two codebooks for the halves of unit vectors of one length, with what is needed to walk their cells."""

    def __init__(self, first: np.ndarray, second: np.ndarray):
        self.first, self.second, self.half = first, second, first.shape[1]
        #: Nodes of each cell, and how many nodes a walk must hold; both come once all nodes have their cells.
        self.counts, self.reach = np.zeros(len(first) * len(second), dtype=np.int64), 0
        self.most = max(64, min(REGION, REGION_BYTES // (8 * (first.shape[1] + second.shape[1]))))

    def cells(self, unit: np.ndarray) -> np.ndarray:
        one, other = self.distances(unit)
        return one.argmin(axis=1) * len(self.second) + other.argmin(axis=1)

    def distances(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return tuple((c * c).sum(axis=1) - 2 * part @ c.T for part, c in ((unit[:, : self.half], self.first), (unit[:, self.half :], self.second)))

    def regions(self) -> tuple[np.ndarray, np.ndarray]:
        """First region of each cell, and in how many it lies."""
        n = self.counts
        split = np.maximum(1, -(-n // self.most))
        packed = np.cumsum(np.where(split > 1, 0, n)) // self.most
        # a large cell gets regions of its own after those of the packed ones
        own = packed[-1] + 1 + np.cumsum(np.where(split > 1, split, 0)) - split
        return np.where(split > 1, own, packed), split


def _walk(one: np.ndarray, other: np.ndarray, counts: list[int], reach: int) -> list[int]:
    """Cells that hold something, by rising summed distance, until they hold `reach` nodes together.

    A pair of ranks (i, j) goes onto the heap once its neighbours (i - 1, j) and (i, j - 1) have been taken, so pairs come off
    in order although few of them are ever on it.
    """
    by_one, by_other = np.argsort(one, kind="stable"), np.argsort(other, kind="stable")
    a, b = one[by_one].tolist(), other[by_other].tolist()
    width, rows, columns = len(b), by_one.tolist(), by_other.tolist()
    heap, taken, out, held = [(a[0] + b[0], 0, 0)], [0] * len(a), [], 0
    while heap and held < reach:
        _, i, j = heapq.heappop(heap)
        taken[i] = j + 1
        cell = rows[i] * width + columns[j]
        if counts[cell]:
            out.append(cell)
            held += counts[cell]
        if j + 1 < width and (i == 0 or taken[i - 1] > j + 1):
            heapq.heappush(heap, (a[i] + b[j + 1], i, j + 1))
        if i + 1 < len(a) and taken[i + 1] == j:
            heapq.heappush(heap, (a[i + 1] + b[j], i + 1, j))
    return out


def _means(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k-means: centroids start at rows of x, those that lose all their rows move to the row worst served."""
    c = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(ROUNDS if x.shape[1] else 0):
        far = (c * c).sum(axis=1) - 2 * x @ c.T
        at = far.argmin(axis=1)
        n = np.bincount(at, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, at, x)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
        empty = np.flatnonzero(n == 0)
        worst = np.argsort(-(far[np.arange(len(x)), at] + (x * x).sum(axis=1)), kind="stable")[: len(empty)]
        c[empty] = x[worst]
    return c


def _floats(column: pa.Array) -> list[np.ndarray | None]:
    """Vectors in double precision, None where one takes no part."""
    out: list[np.ndarray | None] = []
    for x in column:
        v = None
        if x.is_valid and len(x) and not x.values.null_count:
            v = x.values.to_numpy().astype(np.float64)
            v = v if np.isfinite(v).all() and v.any() else None
        out.append(v)
    return out


def _units(vectors: np.ndarray) -> np.ndarray:
    v = vectors / np.abs(vectors).max(axis=1, keepdims=True)  # first, so squares neither vanish nor overflow
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cosines of the rows of x with those of y, summed in the order of the components.

    Rows are first scaled by powers of two, which changes no bit of the result but keeps squares in range.
    """
    x, y = (np.ldexp(v, -np.frexp(np.abs(v).max(axis=1, keepdims=True))[1]) for v in (x, y))
    both, xx, yy = np.zeros(len(x)), np.zeros(len(x)), np.zeros(len(x))
    for k in range(x.shape[1]):
        both += x[:, k] * y[:, k]
        xx += x[:, k] * x[:, k]
        yy += y[:, k] * y[:, k]
    return both / (np.sqrt(xx) * np.sqrt(yy))


def _matrix(column: pa.Array) -> np.ndarray:
    column = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    at = column.offsets.to_numpy()
    return column.values.to_numpy()[at[0] : at[-1]].reshape(len(column), -1)


def _nodes(rows: DataFrame, scratch: Scratch, id_col: str, vector_col: str, k: int) -> tuple[DataFrame, DataFrame]:
    """(row, id, node, size): rows that take part. (node, size, vector, members): different vectors with their k + 1 smallest members."""
    kind = rows.schema[id_col].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1024):
            vectors = _floats(b.column(2))
            nodes = [None if v is None else xxhash.xxh3_128_digest((v + 0.0).tobytes()) for v in vectors]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(nodes, pa.binary()), pa.array([0 if v is None else len(v) for v in vectors], pa.int32()), pa.array(vectors, pa.list_(pa.float64()))], ["row", "id", "node", "size", "vector"])

    chosen = rows.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(vector_col).alias("vector"))
    all_rows = scratch.save(chosen.mapInArrow(frugal(read), f"row long, id {kind}, node binary, size int, vector array<double>").where("node IS NOT NULL"), "rows")
    by_id = Window.partitionBy("node").orderBy(F.col("id").asc_nulls_last(), "row")
    # only the k + 1 first of a node leave a task
    few = all_rows.select("row", "id", "node").withColumn("nth", F.row_number().over(by_id)).where(F.col("nth") <= k + 1)
    members = few.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("nth", "id", "row"))).alias("members"))
    vectors = all_rows.groupBy("node").agg(F.first("size").alias("size"), F.first("vector").alias("vector"))
    return all_rows.drop("vector"), vectors.join(members, "node")


def _best(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the k largest scores of each row, and of those as large but for NEAR."""
    if scores.shape[1] > k:
        least = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k] - NEAR
        return np.nonzero(scores >= least[:, None])
    return np.nonzero(np.ones_like(scores, dtype=bool))


def _fitted(nodes: DataFrame, n: int, size: int, seed: int) -> Codebook:
    sample = first_by_hash(nodes, ["node", "vector"], min(FIT_ROWS, max(1, FIT_BYTES // (8 * size)))).toArrow()
    unit = _units(_matrix(sample.column("vector")))
    k = int(min(CENTROIDS, max(2, np.ceil(np.sqrt(n / PER_CELL))), len(unit)))
    rng = np.random.default_rng(seed)
    return Codebook(_means(unit[:, : size // 2], k, rng), _means(unit[:, size // 2 :], k, rng))


def _reach(cells: DataFrame, book: Codebook, k: int, recall: float) -> int:
    """So many nodes must a walk hold, for the recall of the true neighbours of a sample of nodes."""
    sample = first_by_hash(cells, ["node", "vector"], PROBES).toArrow()
    asked = _units(_matrix(sample.column("vector")))

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, at = np.full((len(asked), k + 1), -np.inf), np.full((len(asked), k + 1), -1, dtype=np.int64)
        for b in slices(batches, BLOCK):
            scores = np.hstack([best, asked @ _units(_matrix(b.column(1))).T])
            found = np.hstack([at, np.broadcast_to(b.column(0).to_numpy(), (len(asked), b.num_rows))])
            keep = np.argpartition(-scores, k, axis=1)[:, : k + 1]
            best, at = np.take_along_axis(scores, keep, axis=1), np.take_along_axis(found, keep, axis=1)
        q, c = np.nonzero(at >= 0)
        yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(best[q, c]), pa.array(at[q, c])], ["q", "score", "cell"])

    found = cells.select("cell", "vector").mapInArrow(frugal(nearest), "q long, score double, cell long")
    order = Window.partitionBy("q").orderBy(F.col("score").desc())
    # a node is its own first neighbour
    top = found.withColumn("nth", F.row_number().over(order)).where((F.col("nth") > 1) & (F.col("nth") <= k + 1)).select("q", "cell").toArrow()
    one, other = book.distances(asked)
    needed = []
    for q in range(len(asked)):
        total = (one[q][:, None] + other[q][None, :]).ravel()
        order_ = np.argsort(total, kind="stable")
        before = np.empty(len(total), dtype=np.int64)
        before[order_] = np.cumsum(book.counts[order_]) - book.counts[order_]  # what a walk holds when it comes to the cell
        needed.append(before[top.column("cell").to_numpy()[top.column("q").to_numpy() == q]])
    needed = np.sort(np.concatenate(needed)) if needed else np.zeros(0, dtype=np.int64)
    return int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)]) + 1 if len(needed) else 1


def _ranked(nodes: DataFrame, asked: DataFrame, book: Codebook, scratch: Scratch, size: int, kind: str, k: int) -> DataFrame:
    """(node, nth, score, id, row): for each node asked for the k + 1 first members of the nodes of its walk, itself included."""
    first, split = book.regions()

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = book.counts.tolist()
        for b in slices(batches, BLOCK):
            distances = book.distances(_units(_matrix(b.column(1))))
            row, region, cells = [], [], []
            for i, (one, other) in enumerate(zip(*distances, strict=True)):
                by: dict[int, list[int]] = {}
                for cell in _walk(one, other, counts, book.reach):
                    for r in range(first[cell], first[cell] + split[cell]):
                        by.setdefault(r, []).append(cell)
                row += [i] * len(by)
                region += by.keys()
                cells += by.values()
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row, pa.int64())), pa.array(region, pa.int64()), pa.array(cells, pa.list_(pa.int64()))], ["node", "region", "cells"])

    each = scratch.save(asked.select("node", "vector").mapInArrow(frugal(visits), "node binary, region long, cells array<long>"), f"visits-{size}")
    crowds = each.groupBy("region").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("tasks"))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cell, some = b.column(0).to_numpy(), np.array([int.from_bytes(x[:6], "little") for x in b.column(1).to_pylist()], dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(first[cell] + some % split[cell]), *b.columns], ["region", "cell", "node", "vector", "members"])

    ids = f"array<struct<nth:int,id:{kind},row:bigint>>"
    dealt = nodes.select("cell", "node", "vector", "members").mapInArrow(frugal(placed), f"region long, cell long, node binary, vector array<double>, members {ids}")
    entries = dealt.join(crowds, "region").withColumn("task", F.explode(F.expr("sequence(0, tasks - 1)")))
    walkers = each.join(crowds, "region").withColumn("task", F.pmod(F.xxhash64("node"), "tasks").cast("int")).join(asked.select("node", "vector"), "node")
    both = entries.select("region", "task", F.lit(False).alias("asks"), "cell", F.expr("CAST(NULL AS array<long>)").alias("cells"), "node", "vector", "members").unionByName(
        walkers.select("region", "task", F.lit(True).alias("asks"), F.lit(0).cast("long").alias("cell"), "cells", "node", "vector", F.expr(f"CAST(NULL AS {ids})").alias("members"))
    )

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, held, ready = None, [], None
        for b in slices(batches, BLOCK):
            spot = list(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True))
            cuts = [0, *[i for i in range(1, len(spot)) if spot[i] != spot[i - 1]], len(spot)]
            for a, e in zip(cuts[:-1], cuts[1:], strict=True):
                part = b.slice(a, e - a)
                if here != spot[a][:2]:
                    here, held, ready = spot[a][:2], [], None
                if not spot[a][2]:
                    held.append(part)
                    continue
                if not held:
                    continue
                if ready is None:
                    table = pa.Table.from_batches(held)
                    vectors = _matrix(table.column("vector"))
                    ready = vectors, _units(vectors), table.column("cell").to_numpy(), pa.concat_arrays(table.column("members").chunks)
                yield _scored(part, *ready, k)

    shape = f"node binary, score double, id {kind}, row long"
    sorted_ = both.repartition("region", "task").sortWithinPartitions("region", "task", "asks")
    found = scratch.save(sorted_.mapInArrow(frugal(compared), shape), f"found-{size}")
    order = Window.partitionBy("node").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last(), "row")
    return found.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k + 1)


def _scored(part: pa.RecordBatch, vectors: np.ndarray, unit: np.ndarray, cell: np.ndarray, members: pa.Array, k: int) -> pa.RecordBatch:
    """The k + 1 first members in the walked cells of a region, for each query of a batch."""
    asked = _matrix(part.column(6))
    scores = _units(asked) @ unit.T
    walked = part.column(4)
    at, cells = walked.offsets.to_numpy(), walked.values.to_numpy()
    for i in range(len(asked)):
        scores[i, ~np.isin(cell, cells[at[i] : at[i + 1]])] = -np.inf
    q, c = _best(scores, k + 1)
    seen = np.isfinite(scores[q, c])
    q, c = q[seen], c[seen]
    exact = cosines(asked[q], vectors[c])
    lists = members.take(pa.array(c))
    n = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten()
    q, exact, ids, rows = np.repeat(q, n), np.repeat(exact, n), flat.field("id"), flat.field("row").to_numpy()
    by_id = pc.rank(ids, "ascending", null_placement="at_end", tiebreaker="dense").to_numpy()
    order = np.lexsort((rows, by_id, -exact, q))
    nth = np.arange(len(order)) - np.searchsorted(q[order], q[order], side="left")
    order = order[nth <= k]
    return pa.RecordBatch.from_arrays([part.column(5).take(pa.array(q[order])), pa.array(exact[order]), ids.take(pa.array(order)), pa.array(rows[order])], ["node", "score", "id", "row"])


def nearest(rows: DataFrame, scratch: Scratch, asks: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, recall: float = RECALL, seed: int = 13) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each row for which `asks` (of the id, called id) holds."""
    scratch = scratch.own()
    kind = rows.schema[id_col].dataType.simpleString()
    members, nodes = _nodes(rows, scratch, id_col, vector_col, k)
    nodes = scratch.save(nodes, "nodes")
    queries = scratch.save(members.where(asks).select("row", "id", "node"), "queries")
    sizes = {r["size"]: r["n"] for r in nodes.groupBy("size").agg(F.count("*").alias("n")).orderBy("size").limit(LENGTHS + 1).collect()}
    if len(sizes) > LENGTHS:
        raise ValueError(f"vectors have more than {LENGTHS} different lengths")
    found = None
    for size, n in sizes.items():
        some = nodes.where(F.col("size") == size)
        book = _fitted(some, n, size, seed)

        def placed(batches: Iterator[pa.RecordBatch], book: Codebook = book) -> Iterator[pa.RecordBatch]:
            for b in slices(batches, BLOCK):
                yield pa.RecordBatch.from_arrays([pa.array(book.cells(_units(_matrix(b.column(1))))), *b.columns], ["cell", "node", "vector", "members"])

        shape = f"cell long, node binary, vector array<double>, members array<struct<nth:int,id:{kind},row:bigint>>"
        cells = scratch.save(some.select("node", "vector", "members").mapInArrow(frugal(placed), shape), f"cells-{size}")
        # at most CENTROIDS squared numbers
        counts = cells.groupBy("cell").agg(F.count("*").alias("n")).toArrow()
        full = np.zeros(len(book.first) * len(book.second), dtype=np.int64)
        full[counts.column("cell").to_numpy()] = counts.column("n").to_numpy()
        book.counts = full
        book.reach = _reach(cells, book, k, recall)
        asked = cells.join(queries.select("node").distinct(), "node", "left_semi")
        one = _ranked(cells, asked, book, scratch, size, kind, k)
        found = one if found is None else found.unionByName(one)
    if found is None:
        return rows.sparkSession.createDataFrame([], f"query_id {kind}, rank int, vec_id {kind}, score double")
    # at most k + 1 members for each node asked for; a query's own row is among them or behind them
    near = found.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("nth", "score", "id", "row"))).alias("near"))
    each = queries.groupBy("node").agg(F.count("*").alias("n"))
    near = scratch.save(near.join(each, "node"), "near")
    scratch.keep_only("queries", "near")
    joined = join_heavy(queries.withColumnRenamed("row", "asking"), near, "node", "n", queries.count())
    others = F.slice(F.filter("near", lambda x: x["row"] != F.col("asking")), 1, k)
    ranks = joined.select(F.col("id").alias("query_id"), F.posexplode(others).alias("at", "one"))
    return ranks.select("query_id", (F.col("at") + 1).alias("rank"), F.col("one.id").alias("vec_id"), "one.score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), Scratch(spark), F.col("id") % 50 == 0)
