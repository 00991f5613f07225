"""Embedding near-duplicates by lattice hashing.

Each of `TABLES` tables projects the unit vector by Gaussian numbers onto `PARTS` times eight dimensions, shifts it, and
decodes each eight to the nearest point of the E8 lattice; the points together are the vector's home cell. It also probes
the `PROBES` neighbouring cells that lie nearest: those in which one part moves by one of the 240 shortest lattice vectors.
Two vectors meet in a table if one's home is among the other's cells.

Cells where vectors meet are worked through in blocks of bounded size: cosines in double precision, links counted from the
threshold on. A pair that meets in several cells is counted in one, the least cell of the first table in which it meets,
which each task finds from the vectors themselves. Blocks return counts and forests of links, so no row is made for a pair.
Components come from the forests. Equal vectors are one node with a weight.

At the threshold a pair meets in one table with a chance of about 0.5 (measured on random pairs), so eight tables miss about
4 in 1000; nearer pairs are missed less. The tests hold recall against brute force.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components link with nothing; vectors of
different length don't link; repeated rows count one by one; a null vec_id comes last in choosing the smallest id; near_dedup
keeps one row of each component, and of rows that are equal in id and vector, so a table loaded twice gives what it gives
once; an empty table gives no rows; extra columns don't matter.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import blocks
from .common import BASE, Scratch, connected_components, frugal, join_heavy, mix, one_of_each, per_worker, slices

THRESHOLD = 0.95
TABLES = 8
PARTS = 2
PROBES = 6
#: Size of projected unit vectors in each dimension; the lattice's shortest vectors have length 1.41.
SPREAD = 0.6
SEED = 5
#: Pairs that are looked at at once.
STRIP = 1 << 14
#: So far from the threshold no order of summing matters.
NEAR = 1e-9


def _shortest() -> np.ndarray:
    """The 240 shortest vectors of E8: two entries of 1 or -1, or all of a half with an even number of minus signs."""
    pairs = [[(i, a), (j, b)] for i, j in itertools.combinations(range(8), 2) for a in (1, -1) for b in (1, -1)]
    whole = np.zeros((len(pairs), 8))
    for k, pair in enumerate(pairs):
        for i, a in pair:
            whole[k, i] = a
    halves = np.array([x for x in itertools.product((0.5, -0.5), repeat=8) if sum(y < 0 for y in x) % 2 == 0])
    return np.vstack([whole, halves])


def _nearest_d8(x: np.ndarray) -> np.ndarray:
    """Nearest integer points with an even sum: where the sum is odd, the worst rounded entry goes the other way."""
    r = np.rint(x)
    e = x - r
    odd = np.flatnonzero(r.sum(axis=1) % 2)
    k = np.abs(e[odd]).argmax(axis=1)
    r[odd, k] += np.where(e[odd, k] >= 0, 1.0, -1.0)
    return r


def nearest_e8(x: np.ndarray) -> np.ndarray:
    a, b = _nearest_d8(x), _nearest_d8(x - 0.5) + 0.5
    nearer = ((x - a) ** 2).sum(axis=1) <= ((x - b) ** 2).sum(axis=1)
    return np.where(nearer[:, None], a, b)


class Lattice:
    """Cells of unit vectors of one length."""

    def __init__(self, size: int, tables: int, parts: int, probes: int, spread: float, seed: int):
        rng = np.random.default_rng([seed, size])
        self.shape, self.probes = (tables, parts), probes
        self.by, self.shift = rng.normal(size=(size, tables * parts * 8)) * spread, rng.uniform(size=tables * parts * 8)
        self.near = _shortest()
        self.salt = mix(np.arange(1, tables + 1, dtype=np.uint64) * np.uint64(BASE) + np.uint64(size))
        self.powers = mix(np.arange(1, parts * 8 + 1, dtype=np.uint64) * np.uint64(BASE)) | np.uint64(1)

    def cells(self, unit: np.ndarray, only: range | None = None) -> np.ndarray:
        """Cells as 64-bit numbers: vectors x tables x (1 + probes), home first."""
        tables, parts = self.shape
        n, chosen = len(unit), only if only is not None else range(tables)
        out = np.empty((n, len(chosen), 1 + self.probes), dtype=np.int64)
        for o, t in enumerate(chosen):
            a = t * parts * 8
            x = unit @ self.by[:, a : a + parts * 8] + self.shift[a : a + parts * 8]
            home = np.hstack([nearest_e8(x[:, p * 8 : p * 8 + 8]) for p in range(parts)])
            # 2 r.v is largest where the neighbour at v is nearest
            gain = np.hstack([(x - home)[:, p * 8 : p * 8 + 8] @ self.near.T for p in range(parts)])
            best = np.argpartition(-gain, self.probes, axis=1)[:, : self.probes]
            doubled = (2 * home).astype(np.int64).view(np.uint64)
            base = (doubled * self.powers).sum(axis=1, dtype=np.uint64)
            step = (2 * self.near).astype(np.int64).view(np.uint64)
            moved = np.concatenate([(step * self.powers[p * 8 : p * 8 + 8]).sum(axis=1, dtype=np.uint64) for p in range(parts)])
            cells = np.column_stack([base, base[:, None] + moved[best]])
            out[:, o] = mix(cells + self.salt[t]).view(np.int64)
        return out


def units(column: pa.Array) -> tuple[list[np.ndarray | None], np.ndarray]:
    """Unit vectors in double precision, None where a vector can link with nothing; their lengths (0 for None)."""
    out: list[np.ndarray | None] = []
    for x in column:
        v = None
        if x.is_valid and len(x) and not x.values.null_count:
            v = x.values.to_numpy().astype(np.float64)
            top = np.abs(v).max()
            v = v / top if np.isfinite(v).all() and top > 0 else None  # scaled first, so squares neither vanish nor overflow
            v = v / np.linalg.norm(v) if v is not None else None
        out.append(v)
    return out, np.array([0 if v is None else len(v) for v in out])


def _digest(vector: Column) -> Column:
    """Of a vector as it stands, to tell rows of one id apart."""
    return F.unhex(F.md5(F.coalesce(vector.cast("string"), F.lit("")).cast("binary")))


def _padded(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as the rows of a matrix, with zeros after the shorter ones, and their lengths."""
    held = pa.concat_arrays(column.chunks)
    at, values = held.offsets.to_numpy(), held.values.to_numpy()
    sizes = np.diff(at)
    if len(set(sizes.tolist())) == 1:
        return values[at[0] : at[-1]].reshape(len(sizes), -1), sizes
    out = np.zeros((len(sizes), int(sizes.max())))
    out[np.arange(out.shape[1])[None, :] < sizes[:, None]] = values[at[0] : at[-1]]
    return out, sizes


def linked_pairs(unit: np.ndarray, i: np.ndarray, j: np.ndarray, threshold: float) -> np.ndarray:
    """Whether the cosine of rows i and j is at least the threshold. Near it they are summed in the order of the components, so that
    it doesn't matter which rows are looked at together."""
    found = _cosines(unit, i, j)
    near = np.flatnonzero(np.abs(found - threshold) < NEAR)
    for a in range(0, len(near), STRIP):
        some = near[a : a + STRIP]
        x, y, total = unit[i[some]], unit[j[some]], np.zeros(len(some))
        for k in range(unit.shape[1]):
            total += x[:, k] * y[:, k]
        found[some] = total
    return found >= threshold


def _cosines(unit: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    if len(i) > 8 * len(unit) and len(unit) <= 4 * blocks.CHUNK:
        return (unit @ unit.T)[i, j]
    out = np.empty(len(i))
    for a in range(0, len(i), STRIP):
        out[a : a + STRIP] = np.einsum("ij,ij->i", unit[i[a : a + STRIP]], unit[j[a : a + STRIP]])
    return out


def _similar(rows: DataFrame, scratch: Scratch, id_col: str, vector_col: str, threshold: float, tables: int, parts: int, probes: int, spread: float, seed: int) -> DataFrame:
    """Rows of similar_vectors with the digest of the vector."""
    scratch = scratch.own()
    kind = rows.schema[id_col].dataType.simpleString()

    def lattice(size: int) -> Lattice:
        return per_worker(("lattice", size, tables, parts, probes, spread, seed), lambda: Lattice(size, tables, parts, probes, spread, seed))

    def cells_of(vectors: list[np.ndarray], sizes: np.ndarray, only: range) -> np.ndarray:
        out = np.zeros((len(vectors), len(only), 1 + probes), dtype=np.int64)
        for size in set(sizes.tolist()) - {0}:
            some = np.flatnonzero(sizes == size)
            out[some] = lattice(size).cells(np.array([vectors[i][:size] for i in some]), only)
        return out

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1024):
            vectors, sizes = units(b.column(2))
            cells = cells_of(vectors, sizes, range(tables))
            nodes = [None if v is None else xxhash.xxh3_128_digest(v.tobytes()) for v in vectors]
            made = [None if v is None else c.ravel() for v, c in zip(vectors, cells, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(nodes, pa.binary()), pa.array(vectors, pa.list_(pa.float64())), pa.array(made, pa.list_(pa.int64()))], ["vec_id", "digest", "node", "vector", "cells"])

    chosen = rows.select(F.col(id_col).alias("vec_id"), _digest(F.col(vector_col)).alias("digest"), F.col(vector_col).alias("vector"))
    found = scratch.save(chosen.mapInArrow(frugal(hashed), f"vec_id {kind}, digest binary, node binary, vector array<double>, cells array<long>"), "vectors")
    known = found.where("node IS NOT NULL")
    nodes = scratch.save(known.groupBy("node").agg(F.min(F.struct(F.col("vec_id").isNull().alias("unknown"), "vec_id", "digest")).alias("best"), F.count("*").alias("mult"), F.first("vector").alias("vector"), F.first("cells").alias("cells")).withColumn("rep", F.col("best.vec_id")), "nodes")

    # a cell's number tells its table too
    each = nodes.select("node", F.posexplode("cells").alias("at", "cell")).select("node", "cell", F.expr(f"at DIV {1 + probes}").cast("int").alias("tab"), (F.col("at") % (1 + probes) == 0).alias("home"))
    meets = scratch.save(each.groupBy("cell").agg(F.count("*").alias("n"), F.max("home").alias("some_home")).where("n > 1 AND some_home").drop("some_home"), "meets")
    members = join_heavy(each.drop("home"), meets, "cell", "n", nodes.count() * tables * (1 + probes)).join(nodes.select("node", "mult", "vector"), "node")
    dealt = blocks.in_blocks(members, ["cell"], F.ceil(F.col("n") / blocks.CHUNK))

    def linked(table: pa.Table, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        unit, sizes = _padded(table.column("vector"))
        good = np.flatnonzero(linked_pairs(unit, i, j, threshold) & (sizes[i] == sizes[j]))
        out = np.zeros(len(i), dtype=bool)
        tab, cell = table.column("tab").to_numpy(), table.column("cell").to_numpy()
        for t in range(tables):  # a pair counts in the first table in which it meets, so few are left after each
            good = good[tab[i[good]] >= t]
            if not len(good):
                break
            use, at = np.unique(np.concatenate((i[good], j[good])), return_inverse=True)
            cells = cells_of(list(unit[use]), sizes[use], range(t, t + 1))[:, 0]
            met = np.zeros(len(good), dtype=bool)
            for a in range(0, len(good), STRIP):
                x, y = at[: len(good)][a : a + STRIP], at[len(good) :][a : a + STRIP]
                most = np.iinfo(np.int64).max
                one = np.where((cells[x, :1] == cells[y]).any(axis=1), cells[x, 0], most)
                other = np.where((cells[y, :1] == cells[x]).any(axis=1), cells[y, 0], most)
                least = np.minimum(one, other)  # of the cells of this table in which they meet
                met[a : a + STRIP] = least != most
                here = i[good[a : a + STRIP]]
                out[good[a : a + STRIP]] = (tab[here] == t) & (least == cell[here])
            good = good[~met]
        return out

    verified = scratch.save(blocks.verify(dealt, ["cell"], linked), "verified")
    groups = connected_components(blocks.edges(verified), scratch, "links").join(nodes.select("node", "best"), "node")
    least = groups.groupBy("root").agg(F.min("best").alias("component"))
    grouped = groups.join(least, "root").select("node", "component")
    of_node = nodes.select("node", "best", "mult").join(blocks.per_node(verified), "node", "left").join(grouped, "node", "left")
    of_node = of_node.select("node", "mult", (F.col("mult") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component", "best").alias("won"))
    of_node = of_node.select("node", "mult", "n_links", F.col("won.vec_id").alias("component_id"), F.col("won.digest").alias("component_digest"))
    of_node = scratch.save(of_node, "of-node")
    scratch.keep_only("vectors", "of-node")
    total = of_node.agg(F.sum("mult")).first()[0] or 0
    columns = ["vec_id", "digest", "n_links", "component_id", "component_digest"]
    alone = found.where("node IS NULL").select("vec_id", "digest", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("digest").alias("component_digest"))
    return join_heavy(known.select("vec_id", "digest", "node"), of_node, "node", "mult", total).select(*columns).unionByName(alone)


def similar_vectors(rows: DataFrame, scratch: Scratch, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD, tables: int = TABLES, parts: int = PARTS, probes: int = PROBES, spread: float = SPREAD, seed: int = SEED) -> DataFrame:
    """(vec_id, n_links, component_id), a row for each row."""
    return _similar(rows, scratch, id_col, vector_col, threshold, tables, parts, probes, spread, seed).drop("digest", "component_digest")


def near_dedup(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """One row of each component, that of the smallest id, with all its columns."""
    scratch = Scratch(rows.sparkSession)
    found = _similar(rows, scratch, id_col, vector_col, threshold, TABLES, PARTS, PROBES, SPREAD, SEED)
    stays = F.col("vec_id").eqNullSafe(F.col("component_id")) & (F.col("digest") == F.col("component_digest"))
    marks = found.groupBy("vec_id", "digest").agg(F.first(stays).alias("again"), F.count("*").alias("n")).where("n > 1 OR NOT again")
    marks = scratch.save(marks.select("vec_id", "digest", "again"), "marks")
    return one_of_each(rows, {"vec_id": F.col(id_col), "digest": _digest(F.col(vector_col))}, marks)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = similar_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), Scratch(spark))
    return found.select("*", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
