"""N-gram Jaccard join with a MinHash LSH forest and exact verification.

1. Texts become sets of hashed five-word shingles (64 bits; words split at white space, ASCII letters in lower case). Texts
   with equal sets are one class, a node with a weight; the rest works on nodes.
2. The forest has `TREES` prefix tries. A node's signature in a tree is `DEPTH` min-hash values; a trie node is a prefix of it.
   Each node starts with its whole signature in every tree and counts whom it would meet at shorter prefixes, down to `SHORT`
   values. Only trees in which it meets anyone count. There prefixes are shortened by one value at a time, always where the
   crowd is small, and then by growing crowds until a pair at the threshold meets in one of these trees with a chance of
   `RECALL` (see `depths`). Crowds of one size class are taken in a random order, so that a partner, who makes each crowd that
   it is in larger by one, can't thereby lose its place.
3. Two nodes are candidates in the first tree in which they share a whole signature, or a shorter prefix that one of them was
   shortened to. Trie nodes are worked through in sorted runs, in blocks of bounded size. First, over signatures alone: a pair
   that agrees in less than half of all values goes (at a similarity of 0.8 the chance of that is 1e-11). No pair is written.
4. Shingle sets of nodes that are still in a candidate pair are made from their texts and compared exactly, in blocks that
   return counts of links and forests of them.
5. Connected components of the links, the only ones made, are the near-duplicate groups.

A group of m different texts that are all alike is compared by its square, dealt over its blocks; that is what exact counts of
links cost. A 64-bit collision of shingles is the only way to a wrong count.

Defined cases: texts of fewer than five words have one shingle of all their words; null texts and texts without a word have
no shingle and link with nothing, not even each other. Rows repeated with one doc_id count one by one as copies; near_dedup
keeps one row of each group, and of rows that are equal in doc_id and text, so a table loaded twice gives what it gives once.
A null doc_id comes last in choosing a class's or group's smallest id. An empty table gives no rows; extra columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import blocks
from .common import BASE, Scratch, connected_components, documents, frugal, join_heavy, mix, one_of_each, parts, shingle_hashes, slices

WIDTH = 5
THRESHOLD = 0.8
TREES = 16
#: Values of a whole signature of a tree, and of the shortest prefix that it is shortened to.
DEPTH = 6
SHORT = 4
RECALL = 0.998
LEVELS = range(SHORT, DEPTH + 1)
#: Crowds of at most so many nodes are always worth a shorter prefix.
FEW = 64
#: Shingles of a chunk, about.
CHUNK_SHINGLES = 500_000
#: Shingles that are turned into a matrix at once.
STRIP = 2048
#: Pairs that are looked at at once.
PAIRS = 1 << 14


def depths(crowds: np.ndarray, salt: int, threshold: float = THRESHOLD, recall: float = RECALL) -> np.ndarray:
    """How many values each tree's prefix of a node keeps. crowds: nodes that share its prefixes of SHORT, SHORT + 1, ... values, by tree.

    All trees given have a crowd, so a partner may be in each. A pair at the threshold meets at d values with a chance of
    threshold ** d; prefixes fall by one value at a time, in the order of the crowd's power of two, until the chance that it
    meets in no tree is 1 - recall at most.
    """
    kept = np.full(len(crowds), DEPTH)
    if crowds[:, 0].max(initial=0) <= FEW:
        return np.full(len(crowds), SHORT)
    missed = (1 - threshold**DEPTH) ** len(crowds)
    tree, level = np.divmod(np.arange(crowds.size), crowds.shape[1])
    depth = SHORT + level
    tie = mix((np.arange(crowds.size, dtype=np.uint64) + np.uint64(salt)) * np.uint64(BASE))
    size = np.maximum(np.ceil(np.log2(np.maximum(crowds.ravel(), 1))), np.log2(FEW))
    for k in np.lexsort((tie, -depth, size)):
        if size[k] > np.log2(FEW) and missed <= 1 - recall:
            break
        if depth[k] < kept[tree[k]]:
            missed *= (1 - threshold ** int(depth[k])) / (1 - threshold ** int(kept[tree[k]]))
            kept[tree[k]] = depth[k]
    return kept


def trees_for(threshold: float, recall: float = RECALL) -> int:
    """At least TREES, and as many as the threshold needs; raises if not even the most are enough."""
    n = TREES
    while 1 - (1 - threshold**SHORT) ** n < recall:
        n += 1
        if n > 62:
            raise ValueError(f"62 trees don't reach a recall of {recall} at {threshold}")
    return n


def shingle_sets(column: pa.Array, width: int) -> list[np.ndarray]:
    held, at = shingle_hashes(column, width)
    return [np.unique(held[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]


def node_of(shingles: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(shingles.tobytes())


def signatures_of(sets: list[np.ndarray], trees: int) -> np.ndarray:
    """Min-hash values of sets that are not empty, cut to 16 bits: sets x trees x DEPTH."""
    n = trees * DEPTH
    by = mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(BASE)).astype(np.uint32) | np.uint32(1)
    out = np.empty((len(sets), n), dtype=np.uint16)
    if sets:
        values = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
        start = np.concatenate(([0], np.cumsum([len(s) for s in sets])[:-1]))
        product = np.empty_like(values)
        for k in range(n):
            np.multiply(values, by[k], out=product)
            out[:, k] = np.minimum.reduceat(product, start) * np.uint32(0x9E3779B1) >> np.uint32(16)
    return out.reshape(len(sets), trees, DEPTH)


def prefixes(signature: np.ndarray, tree: np.ndarray, length: int) -> np.ndarray:
    """A number for each signature's (n x DEPTH) prefix of a length in a tree."""
    h = (tree.astype(np.uint64) + np.uint64(1)) * np.uint64(BASE) + np.uint64(length)
    for i in range(length):
        h = mix(h * np.uint64(BASE) + signature[:, i])
    return h.view(np.int64)


def signatures(docs: DataFrame, id_col: str, text_col: str, width: int, trees: int) -> DataFrame:
    """(doc_id, digest, node, size, signature), a row for each row of docs; node is null where there is no shingle."""
    text = F.col(text_col)
    chosen = docs.select(F.col(id_col).alias("doc_id"), F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary"))).alias("digest"), text.alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches, 2):
            sets = shingle_sets(b.column(2), width)
            found = iter(signatures_of([s for s in sets if len(s)], trees))
            made = [next(found).tobytes() if len(s) else None for s in sets]
            nodes = [node_of(s) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(nodes, pa.binary()), pa.array([len(s) for s in sets], pa.int64()), pa.array(made, pa.binary())], ["doc_id", "digest", "node", "size", "signature"])

    return chosen.mapInArrow(frugal(run), f"doc_id {chosen.schema['doc_id'].dataType.simpleString()}, digest binary, node binary, size long, signature binary")


def stacked(column: pa.Array, trees: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint16).reshape(-1, trees, DEPTH)


def in_trees(nodes: DataFrame, trees: int) -> DataFrame:
    """(node, tree, at_4, at_5, ...): numbers of the prefixes of each node in each tree, of SHORT values to DEPTH."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 2048):
            flat = stacked(b.column(1), trees).reshape(-1, DEPTH)
            at, tree = np.divmod(np.arange(len(flat)), trees)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), pa.array(tree, pa.int32()), *[pa.array(prefixes(flat, tree, d)) for d in LEVELS]], ["node", "tree", *[f"at_{d}" for d in LEVELS]])

    return nodes.select("node", "signature").mapInArrow(frugal(run), "node binary, tree int, " + ", ".join(f"at_{d} long" for d in LEVELS))


def shortened_to(per: DataFrame, threshold: float, recall: float) -> DataFrame:
    """(node, to_4, to_5, ...) of (node, crowds): bits of the trees in which a node's prefix has at most so many values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bits = np.zeros((len(LEVELS) - 1, b.num_rows), dtype=np.int64)
            crowds, salts = b.column(1), [int.from_bytes(x[:7], "little") for x in b.column(0).to_pylist()]
            at, each = crowds.offsets.to_numpy(), crowds.values
            tree, counts = each.field("tree").to_numpy().astype(np.int64), np.column_stack([each.field(f"n_{d}").to_numpy() for d in LEVELS[:-1]])
            for i in range(b.num_rows):
                mine = slice(at[i], at[i + 1])
                kept = depths(counts[mine], salts[i], threshold, recall)
                for k, d in enumerate(LEVELS[:-1]):
                    bits[k, i] = np.bitwise_or.reduce(np.int64(1) << tree[mine][kept <= d], initial=0)
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(x) for x in bits]], ["node", *[f"to_{d}" for d in LEVELS[:-1]]])

    return per.mapInArrow(frugal(run), "node binary, " + ", ".join(f"to_{d} long" for d in LEVELS[:-1]))


def trie_nodes(nodes: DataFrame, scratch: Scratch, threshold: float, recall: float, trees: int) -> tuple[DataFrame, DataFrame]:
    """(node, to_4, to_5): bits of the trees in which a node's prefix is shortened. (trie, tree, node, n): trie nodes with n > 1 nodes each."""
    each = in_trees(nodes, trees)
    total = trees * nodes.count()
    for d in LEVELS[:-1]:  # whoever is alone at a short prefix is alone at a longer one
        crowds = scratch.save(each.groupBy(f"at_{d}").agg(F.count("*").alias(f"n_{d}")).where(f"n_{d} > 1" if d == SHORT else "true"), f"crowds-{d}")
        each = scratch.save(join_heavy(each, crowds, f"at_{d}", f"n_{d}", total), f"met-{d}")
    per = each.groupBy("node").agg(F.collect_list(F.struct("tree", *[f"n_{d}" for d in LEVELS[:-1]])).alias("crowds"))
    shortened = scratch.save(shortened_to(per, threshold, recall), "shortened")
    bit = F.expr("shiftleft(1L, tree)")
    rows = each.join(shortened, "node")
    rows = scratch.save(rows.select("node", "tree", *[f"at_{d}" for d in LEVELS], *[f"n_{d}" for d in LEVELS[:-1]], *[(F.col(f"to_{d}").bitwiseAND(bit) != 0).alias(f"to_{d}") for d in LEVELS[:-1]]), "placed")
    placed = None
    for d in LEVELS:
        # a prefix is a trie node to work through if anyone was shortened to it; else the next longer ones are
        at, n = f"at_{d}", f"n_{d}"
        counted = rows.groupBy(at).agg(F.max(f"to_{d}").alias("used"), F.max(n).alias("n")).where("used") if d < DEPTH else rows.groupBy(at).agg(F.count("*").alias("n"))
        used = scratch.save(counted.where("n > 1").select(at, "n"), f"used-{d}")
        here = join_heavy(rows.select(at, "tree", "node"), used, at, "n", total).select(F.col(at).alias("trie"), "tree", "node", "n")
        placed = here if placed is None else placed.unionByName(here)
        if d < DEPTH:
            rows = scratch.save(rows.join(used.select(at), at, "left_anti"), f"rest-{d}")
    return shortened, placed


def candidates(signature: np.ndarray, shortened: list[np.ndarray], tree: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which pairs of rows are candidates in their tree and in none before it, and agree in half of all values at least.

    shortened: bits of the trees in which a row's prefix has SHORT values, SHORT + 1 at most, and so on.
    """
    n, trees, _ = signature.shape
    short = np.ascontiguousarray(signature[:, :, :SHORT]).view(np.uint64).reshape(n, trees)
    flat, bits = signature.reshape(n, -1), np.int64(1) << np.arange(trees, dtype=np.int64)
    out = np.zeros(len(i), dtype=bool)
    for a in range(0, len(i), PAIRS):
        x, y = i[a : a + PAIRS], j[a : a + PAIRS]
        shared = short[x] == short[y]
        meets = np.zeros_like(shared)
        for k in range(DEPTH - SHORT):
            meets |= shared & ((shortened[k][x] | shortened[k][y])[:, None] & bits != 0)
            shared = shared & (signature[x, :, SHORT + k] == signature[y, :, SHORT + k])
        meets |= shared
        good = np.flatnonzero((meets.argmax(axis=1) == tree[x]) & meets.any(axis=1))
        good = good[2 * (flat[x[good]] == flat[y[good]]).sum(axis=1) >= flat.shape[1]]
        out[a + good] = True
    return out


def common_counts(values: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """How many values each two owners have in common. values are distinct for each owner."""
    order = np.argsort(values, kind="stable")
    v, d = values[order], owner[order]
    new = np.concatenate(([True], v[1:] != v[:-1]))
    run = np.cumsum(new) - 1
    length = np.bincount(run)
    shared = length[run] > 1
    d, run = d[shared], run[shared]
    out = np.zeros((n, n), dtype=np.float32)
    if not len(d):
        return out
    number = np.cumsum(np.concatenate(([True], run[1:] != run[:-1]))) - 1
    for a in range(0, int(number[-1]) + 1, STRIP):
        lo, hi = np.searchsorted(number, [a, a + STRIP])
        m = np.zeros((n, min(STRIP, int(number[-1]) + 1 - a)), dtype=np.float32)
        m[d[lo:hi], number[lo:hi] - a] = 1
        out += m @ m.T
    return out


def similar(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs of sets (sorted) have the similarity."""
    sizes = np.array([len(s) for s in sets])
    if len(i) > 4 * len(sets) and len(sets) <= 4 * blocks.CHUNK:
        both = common_counts(np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes), len(sets))[i, j].astype(np.float64)
    else:
        both = np.array([len(np.intersect1d(sets[x], sets[y], assume_unique=True)) for x, y in zip(i.tolist(), j.tolist(), strict=True)], dtype=np.float64)
    return both >= threshold * (sizes[i] + sizes[j] - both) - 1e-9


def _lists(column: pa.ChunkedArray) -> list[np.ndarray]:
    column = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    values, at = column.values.to_numpy(), column.offsets.to_numpy()
    return [values[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


def _similarity(docs: DataFrame, scratch: Scratch, id_col: str, text_col: str, width: int, threshold: float, recall: float) -> DataFrame:
    """Rows of similarity_groups with the digest of the text."""
    scratch = scratch.own()
    trees = trees_for(threshold, recall)
    rows = scratch.save(signatures(docs, id_col, text_col, width, trees), "signatures")
    known = rows.where("node IS NOT NULL")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "digest"))
    nodes = known.groupBy("node").agg(first.alias("first"), F.count("*").alias("mult"), F.first("size").alias("size"), F.first("signature").alias("signature"))
    nodes = scratch.save(nodes.select("node", F.col("first.doc_id").alias("rep"), F.col("first.digest").alias("rep_digest"), "mult", "size", "signature"), "nodes")

    shortened, placed = trie_nodes(nodes, scratch, threshold, recall, trees)
    to = [f"to_{d}" for d in LEVELS[:-1]]
    signed = nodes.join(shortened, "node").select("node", "signature", *to)

    def checked(table: pa.Table, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return candidates(stacked(table.column("signature"), trees), [table.column(c).to_numpy() for c in to], table.column("tree").to_numpy(), i, j)

    def met(table: pa.Table, i: np.ndarray, j: np.ndarray) -> pa.Table:
        good = checked(table, i, j)
        return table.select(["trie", "tree", "node", "signature", *to]).take(np.unique(np.concatenate((i[good], j[good]))))

    dealt = blocks.in_blocks(placed.join(signed, "node"), ["trie"], F.ceil(F.col("n") / blocks.CHUNK))
    needed = blocks.run_blocks(dealt, ["trie"], met, "trie long, tree int, node binary, signature binary, " + ", ".join(f"{c} long" for c in to))
    needed = scratch.save(needed.dropDuplicates(["trie", "node"]).join(nodes.select("node", "size", "mult"), "node"), "needed")

    wanted = nodes.join(needed.select("node").distinct(), "node", "left_semi").select("node", "rep", "rep_digest")
    digest = F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary")))
    text = docs.select(F.col(id_col).alias("text_id"), digest.alias("text_digest"), F.col(text_col).alias("text"))
    texts = text.join(wanted, text["text_id"].eqNullSafe(wanted["rep"]) & (text["text_digest"] == wanted["rep_digest"])).dropDuplicates(["text_id", "text_digest"]).select("node", "text")

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches, 1):
            sets = shingle_sets(b.column(1), width)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["node", "shingles"])

    sets = texts.mapInArrow(frugal(again), "node binary, shingles array<long>")
    sums = scratch.save(needed.groupBy("trie").agg(F.sum("size").alias("total"), F.count("*").alias("n")), "sums")
    held = join_heavy(needed.select("trie", "tree", "node", "signature", *to, "mult"), sums, "trie", "n", needed.count()).join(sets, "node")
    count = F.greatest(F.ceil(F.col("total") / CHUNK_SHINGLES), F.ceil(F.col("n") / blocks.CHUNK))

    def linked(table: pa.Table, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        good = np.flatnonzero(checked(table, i, j))
        out = np.zeros(len(i), dtype=bool)
        sets = _lists(table.column("shingles"))
        out[good] = similar(sets, i[good], j[good], threshold)
        return out

    verified = scratch.save(blocks.verify(blocks.in_blocks(held, ["trie"], count).drop("total", "n"), ["trie"], linked), "verified")

    groups = connected_components(blocks.edges(verified), scratch, "links")
    first = F.struct(F.col("rep").isNull().alias("unknown"), "rep", "rep_digest")
    groups = groups.join(nodes.select("node", first.alias("first")), "node")
    least = groups.groupBy("root").agg(F.min("first").alias("component"))
    grouped = groups.join(least, "root").select("node", "component")
    of_node = nodes.select("node", "rep", "mult", first.alias("first")).join(blocks.per_node(verified), "node", "left").join(grouped, "node", "left")
    of_node = of_node.select("node", "mult", F.col("rep").alias("class_id"), (F.col("mult") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component", "first").alias("won"))
    of_node = of_node.select("node", "mult", "class_id", "n_links", F.col("won.rep").alias("component_id"), F.col("won.rep_digest").alias("component_digest"))
    of_node = scratch.save(of_node, "of-node")
    scratch.keep_only("signatures", "of-node")
    total = of_node.agg(F.sum("mult")).first()[0] or 0
    columns = ["doc_id", "digest", "class_id", "n_links", "component_id", "component_digest"]
    found = join_heavy(known.select("doc_id", "digest", "node"), of_node, "node", "mult", total).select(*columns)
    alone = rows.where("node IS NULL").select("doc_id", "digest", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.col("doc_id").alias("component_id"), F.col("digest").alias("component_digest"))
    return found.unionByName(alone)


def similarity_groups(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """(doc_id, class_id, n_links, component_id), a row for each row of docs.

    class_id: smallest doc_id with the same shingle set. n_links: other rows with a similarity of at least the threshold.
    component_id: smallest doc_id reachable by links.
    """
    return _similarity(docs, scratch, id_col, text_col, width, threshold, recall).drop("digest", "component_digest")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, threshold: float = THRESHOLD) -> DataFrame:
    """One row of each group, that of the smallest doc_id, with all its columns."""
    scratch = Scratch(docs.sparkSession)
    found = _similarity(docs, scratch, id_col, text_col, width, threshold, RECALL)
    stays = F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("digest") == F.col("component_digest"))
    marks = found.groupBy("doc_id", "digest").agg(F.first(stays).alias("again"), F.count("*").alias("n")).where("n > 1 OR NOT again")
    marks = scratch.save(marks.select("doc_id", "digest", "again"), "marks")
    digest = F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary")))
    return one_of_each(docs, {"doc_id": F.col(id_col), "digest": digest}, marks)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = similarity_groups(documents(spark, sf_dir), Scratch(spark))
    return found.select("*", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
