"""How far the sources of a language diverge in their words, over an integer dictionary.

1. Texts are read once. Each task counts terms by (lang, source) in bounded dictionaries; sums of those are one row for each
   (lang, source, term), with the number of documents.
2. Each language keeps the terms of at least MIN_DOCS of its documents. Rows of kept terms are range-partitioned and sorted by
   (lang, term): each stretch of at most CHUNK kept terms becomes a sorted array, in which searchsorted finds the ids of the
   rows' terms, and bincount makes a dense vector of counts for each group. Chunks are numbered in order, so ids preserve the
   UTF-8 order of terms over all partitions.
3. Pairs of sources are compared chunk by chunk, in blocks of at most BLOCK sources a side, and summed up. The ten most
   overused terms of a group come from its best ten of each chunk; equal values go by id, which is UTF-8 order.

A hot source or language is counted where its texts are read; no task sees a whole language or a whole dictionary. All pairs
of sources are the result; their number is what the result asks for.

Arithmetic is exact: shares are divided in steps of a thousand (_shares), so counts may reach 10**15.

Defined cases: null text, lang and source are ''. A group without kept terms takes part with counts of zero. Repeated rows
count one by one. Terms of any length count; texts of any length are cut at blanks while they are counted. An empty table gives
no rows; extra columns don't matter.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, documents, frugal, parts

#: Documents of a language that hold a kept term.
MIN_DOCS = 10
TOP = 10
#: Kept terms of a chunk, at most.
CHUNK = 1024
#: Sources of a side of a block, about.
BLOCK = 64
#: Entries of a task's dictionaries before they are given out, and bytes of text that are split at once.
HELD, PIECE = 400_000, 1 << 20
#: Over so many tasks a language's chunks are dealt where its groups join them.
SALTS = 64
SCALE = 1_000_000_000
#: What is no letter and no byte of a longer code point becomes a blank; A-Z become a-z.
TO_TERMS = bytes(c if c >= 128 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def _pieces(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, some at a time."""
    text, at = text.translate(TO_TERMS), 0
    while at < len(text):
        end = text.find(b" ", at + PIECE)
        end = len(text) if end < 0 else end
        yield text[at:end].split()
        at = end


def term_counts(docs: DataFrame, lang_col: str, source_col: str, text_col: str) -> DataFrame:
    """(lang, source, term, n, docs): rows to be summed up. A row without a term tells that a group occurs."""

    def text(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(""))

    names = ["lang", "source", "term", "n", "docs"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: dict[tuple, Counter] = defaultdict(Counter)
        docs: dict[tuple, Counter] = defaultdict(Counter)

        def given() -> Iterator[pa.RecordBatch]:
            for group, counts in n.items():
                rows, in_docs = len(counts), docs[group]
                yield pa.RecordBatch.from_arrays([pa.repeat(group[0], rows), pa.repeat(group[1], rows), pa.array(counts.keys(), pa.binary()), pa.array(counts.values(), pa.int64()), pa.array([in_docs[t] for t in counts], pa.int64())], names)
            n.clear()
            docs.clear()

        met, held = set(), 0
        for b in parts(batches, 2):
            for lang, source, words in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).cast(pa.large_binary()).to_pylist(), strict=True):
                group = lang, source
                met.add(group)
                counts, distinct = n[group], set()
                held -= len(counts)
                for piece in _pieces(words):
                    counts.update(piece)
                    distinct.update(piece)
                docs[group].update(distinct)
                held += len(counts)
                if held > HELD:
                    yield from given()
                    held = 0
        yield from given()
        none = [None] * len(met)
        yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in met], pa.string()), pa.array([g[1] for g in met], pa.string()), pa.array(none, pa.binary()), pa.array([0] * len(met), pa.int64()), pa.array([0] * len(met), pa.int64())], names)

    return docs.select(text(lang_col).alias("lang"), text(source_col).alias("source"), text(text_col).alias("text")).mapInArrow(frugal(run), "lang string, source string, term binary, n long, docs long")


def encode(rows: DataFrame) -> DataFrame:
    """(lang, source, chunk, total, counts, terms) of rows (lang, source, term, n).

    counts: a vector over the chunk's terms. The language's own row of a chunk has no source, and the terms in order.
    """
    shape = "lang string, source string, chunk long, total long, counts array<long>, terms array<binary>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        lang, held = None, []  # rows of one language, in the order of their terms
        terms = 0

        def made() -> pa.RecordBatch:
            nonlocal number
            chunk, number = (part << 33) + number, number + 1
            table = pa.Table.from_batches(held)
            words = np.array(table.column("term").to_pylist(), dtype=object)
            kept = words[np.concatenate(([True], words[1:] != words[:-1]))]
            ids = np.searchsorted(kept, words)
            source = table.column("source").combine_chunks().dictionary_encode()
            source = source.chunk(0) if isinstance(source, pa.ChunkedArray) else source
            row, n = source.indices.to_numpy(), table.column("n").to_numpy()
            dense = np.zeros((len(source.dictionary) + 1, len(kept)), dtype=np.int64)
            for g in range(len(source.dictionary)):
                mine = row == g
                dense[g] = _bincount(ids[mine], n[mine], len(kept))
            dense[-1] = dense[:-1].sum(axis=0)
            rows = len(dense)
            offsets = pa.array(np.arange(rows + 1) * len(kept), pa.int32())
            words_at = pa.array([0] * rows + [len(kept)], pa.int32())
            return pa.RecordBatch.from_arrays(
                [pa.repeat(pa.scalar(lang, pa.string()), rows), pa.concat_arrays([source.dictionary.cast(pa.string()), pa.nulls(1, pa.string())]), pa.array([chunk] * rows, pa.int64()), pa.array(dense.sum(axis=1)), pa.ListArray.from_arrays(offsets, pa.array(dense.ravel())), pa.ListArray.from_arrays(words_at, pa.array(kept.tolist(), pa.binary()))],
                ["lang", "source", "chunk", "total", "counts", "terms"],
            )

        last = None
        for b in batches:
            langs, words = b.column(0).to_pylist(), b.column(2).to_pylist()
            at = 0
            for i in range(len(words)):
                new = words[i] != last or langs[i] != lang
                if new and (terms == CHUNK or langs[i] != lang):
                    if i > at:
                        held.append(b.slice(at, i - at))
                    if held:
                        yield made()
                    held, at, terms, lang = [], i, 0, langs[i]
                terms += new
                last = words[i]
            if at < len(words):
                held.append(b.slice(at))
        if held:
            yield made()

    ordered = rows.select("lang", "source", "term", "n").repartitionByRange("lang", "term").sortWithinPartitions("lang", "term")
    return ordered.mapInArrow(frugal(run), shape)


def _bincount(ids: np.ndarray, n: np.ndarray, size: int) -> np.ndarray:
    """np.bincount with whole numbers as weights: its own weights are doubles, exact to 2**53 only, so halves are added."""
    low, high = np.bincount(ids, n & 0xFFFFFFF, size), np.bincount(ids, n >> 28, size)
    return low.astype(np.int64) + (high.astype(np.int64) << 28)


def _shares(counts: np.ndarray, total: int, terms: int) -> np.ndarray:
    """1 + floor(SCALE * (count + 2) / (total + 2 * terms)), by long division with base 1000."""
    over = total + 2 * terms
    whole, rest = np.divmod(counts + 2, over)
    for _ in range(3):
        more, rest = np.divmod(rest * 1000, over)
        whole = whole * 1000 + more
    return whole + 1


def _apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def pair_sums(halves: DataFrame) -> DataFrame:
    """(lang, source, other, value), the lesser source first, of values of chunks that name a pair either way round.

    Rows of a block stand in the order in which a shuffle brings them, so one chunk may have (a, b) and another (b, a).
    """
    either = halves.select("lang", F.least("source", "other").alias("source"), F.greatest("source", "other").alias("other"), "value")
    return either.groupBy("lang", "source", "other").agg(F.sum("value").alias("value"))


def _vectors(column: pa.Array) -> np.ndarray:
    column = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    at = column.offsets.to_numpy()
    return column.values.to_numpy()[at[0] : at[-1]].reshape(len(column), -1)


def audit(docs: DataFrame, scratch: Scratch, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", min_docs: int = MIN_DOCS, top: int = TOP) -> tuple[DataFrame, DataFrame]:
    """Pairs (lang, source, other, value), for each source and each other one of its language, and terms (lang, source, term, value, rank)."""
    scratch = scratch.own()
    summed = term_counts(docs, lang_col, source_col, text_col).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    counts = scratch.save(summed, "counts")
    groups = counts.where("term IS NULL").select("lang", "source")
    kept = scratch.save(counts.where("term IS NOT NULL").groupBy("lang", "term").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs).select("lang", "term"), "kept")
    encoded = scratch.save(encode(counts.join(kept, ["lang", "term"])), "encoded")

    sizes = encoded.groupBy("lang", "source").agg(F.sum("total").alias("total"))
    langs = kept.groupBy("lang").agg(F.count("*").cast("long").alias("terms")).join(sizes.where("source IS NULL").select("lang", F.col("total").alias("lang_total")), "lang")
    langs = scratch.save(langs, "langs")
    known = groups.groupBy("lang").agg(F.count("*").alias("sources"))
    of_group = groups.join(sizes, ["lang", "source"], "left").join(langs, "lang").join(known, "lang")
    # (lang, source, total, terms, lang_total, sources) of the groups of languages with a kept term
    of_group = scratch.save(of_group.withColumn("total", F.coalesce("total", F.lit(0))), "groups")

    # a group without terms in a chunk still has its shares there
    chunks = encoded.where("source IS NULL").select("lang", "chunk", F.size("counts").alias("width"), F.col("counts").alias("lang_counts"), "terms")
    own = encoded.where("source IS NOT NULL").select("lang", "source", "chunk", "counts")
    # few languages: their chunks are dealt by a second key too, to which all groups go
    dealt = chunks.select("lang", "chunk", "width", F.pmod(F.xxhash64("chunk"), F.lit(SALTS)).cast("int").alias("salt"))
    spots = of_group.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).join(dealt, ["lang", "salt"])
    dense = spots.join(own, ["lang", "source", "chunk"], "left").withColumn("counts", F.coalesce("counts", F.expr("array_repeat(0L, width)")))
    dense = scratch.save(dense.select("lang", "source", "chunk", "counts", "total", F.col("terms"), "lang_total", "sources"), "dense")

    def paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _blocks(batches, ["lang", "chunk", "block_i", "block_j"]):
            total, terms, side = table.column("total").to_pylist(), table.column("terms")[0].as_py(), table.column("side").to_numpy()
            p = np.vstack([_shares(c, n, terms) for c, n in zip(_vectors(table.column("counts")), total, strict=True)])
            across = table.column("block_i")[0].as_py() != table.column("block_j")[0].as_py()
            one = np.flatnonzero(side == table.column("block_i")[0].as_py())
            other = np.flatnonzero(side == table.column("block_j")[0].as_py()) if across else one
            i, j = np.repeat(one, len(other)), np.tile(other, len(one))
            i, j = (i, j) if across else (i[i < j], j[i < j])
            # a row of p at a time, so that work stays as small as a block
            value = np.array([int(_apart(p[a], p[b]).sum()) for a, b in zip(i.tolist(), j.tolist(), strict=True)], dtype=np.int64)
            source = pa.concat_arrays(table.column("source").chunks)
            yield pa.RecordBatch.from_arrays([pa.repeat(table.column("lang")[0], len(i)), source.take(pa.array(i)), source.take(pa.array(j)), pa.array(value)], ["lang", "source", "other", "value"])

    placed = dense.withColumn("sides", F.ceil(F.col("sources") / BLOCK).cast("int")).withColumn("side", F.pmod(F.xxhash64("source"), "sides").cast("int"))
    placed = placed.withColumn("with", F.explode(F.expr("sequence(0, sides - 1)"))).withColumn("block_i", F.least("side", "with")).withColumn("block_j", F.greatest("side", "with"))
    placed = placed.select("lang", "chunk", "block_i", "block_j", "side", "source", "counts", "total", "terms")
    keys = ["lang", "chunk", "block_i", "block_j"]
    halves = placed.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(frugal(paired), "lang string, source string, other string, value long")
    halves = scratch.save(pair_sums(halves), "halves")
    both = halves.unionByName(halves.select("lang", F.col("other").alias("source"), F.col("source").alias("other"), "value"))
    # languages without a kept term: their sources differ by nothing
    bare = groups.join(langs.select("lang"), "lang", "left_anti")
    zero = bare.join(bare.select("lang", F.col("source").alias("other")), "lang").where("source <> other").select("lang", "source", "other", F.lit(0).cast("long").alias("value"))
    pairs = both.unionByName(zero)

    def overused(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lang, source, chunk, ids, value, term = [], [], [], [], [], []
            for k in range(b.num_rows):
                one = {name: b.column(name)[k] for name in b.schema.names}
                counts, terms = one["counts"].values.to_numpy(), one["terms"].as_py()
                p = _shares(counts, one["total"].as_py(), terms)
                q = _shares(one["lang_counts"].values.to_numpy(), one["lang_total"].as_py(), terms)
                over = np.flatnonzero((counts > 0) & (p > q))
                f = _apart(p[over], q[over])
                for x in np.lexsort((over, -f))[:top].tolist():
                    lang.append(one["lang"].as_py())
                    source.append(one["source"].as_py())
                    chunk.append(one["chunk"].as_py())
                    ids.append(int(over[x]))
                    value.append(int(f[x]))
                    term.append(one["words"][int(over[x])].as_py())
            yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(source, pa.string()), pa.array(chunk, pa.int64()), pa.array(ids, pa.int32()), pa.array(value, pa.int64()), pa.array(term, pa.binary())], ["lang", "source", "chunk", "id", "value", "term"])

    with_lang = dense.join(chunks.select("lang", "chunk", "lang_counts", F.col("terms").alias("words")), ["lang", "chunk"])
    best = scratch.save(with_lang.mapInArrow(frugal(overused), "lang string, source string, chunk long, id int, value long, term binary"), "overused")
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "chunk", "id")
    terms = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("lang", "source", F.decode("term", "UTF-8").alias("term"), "value", "rank")
    scratch.drop("encoded", "dense")
    return pairs, terms


def _blocks(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of rows that stand together and have the same keys."""
    here, held = None, []
    for b in batches:
        spots = list(zip(*(b.column(k).to_pylist() for k in keys), strict=True))
        at = 0
        for i, spot in enumerate(spots):
            if spot != here:
                if i > at:
                    held.append(b.slice(at, i - at))
                if held:
                    yield pa.Table.from_batches(held)
                here, held, at = spot, [], i
        if at < len(spots):
            held.append(b.slice(at))
    if held:
        yield pa.Table.from_batches(held)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs, terms = audit(documents(spark, sf_dir), Scratch(spark))
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "other")
    ranked = pairs.select("lang", "source", F.lit("pair").alias("part"), F.col("other").alias("item"), "value", F.row_number().over(order).alias("rank"))
    return ranked.unionByName(terms.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank"))


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words
  FROM documents
), g AS (
  SELECT DISTINCT lang, source FROM d
), e AS (
  SELECT r, lang, source, unnest(words) AS term FROM d
), kept AS (
  SELECT lang, term, count(*) AS n FROM e GROUP BY lang, term HAVING count(DISTINCT r) >= 10
), l AS (
  SELECT lang, sum(n)::HUGEINT AS total, count(*)::HUGEINT AS v FROM kept GROUP BY lang
), c AS (
  SELECT lang, source, term, count(*) AS n FROM e JOIN kept USING (lang, term) GROUP BY lang, source, term
), s AS (
  SELECT lang, source, coalesce(sum(c.n), 0)::HUGEINT AS total FROM g LEFT JOIN c USING (lang, source) GROUP BY lang, source
), p AS (
  SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS n,
         1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (s.total + 2 * l.v) AS p,
         1 + (1000000000::HUGEINT * (k.n + 2)) // (l.total + 2 * l.v) AS q
  FROM s JOIN l USING (lang) JOIN kept k ON k.lang = s.lang LEFT JOIN c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p))::BIGINT AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source
  UNION ALL
  SELECT a.lang, a.source, b.source, 0 FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source WHERE a.lang NOT IN (SELECT lang FROM l)
), terms AS (
  SELECT lang, source, term AS item, ((p - q) * (p - q) // (p + q))::BIGINT AS value FROM p WHERE n > 0 AND p > q
)
SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INTEGER AS rank FROM pairs
UNION ALL
SELECT lang, source, 'term', item, value, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INTEGER AS rank FROM terms) WHERE rank <= 10
"""
