"""What several operators share: scratch tables, worker-wide caches, word hashes and connected components."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import sys
import tempfile
import types
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

WHITE = np.zeros(256, dtype=bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True
#: One more than each byte, ASCII letters in lower case.
LOWER = np.frombuffer(bytes(range(256)).lower(), dtype=np.uint8).astype(np.uint64) + np.uint64(1)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def fresh(df: DataFrame, *names: str) -> str:
    """A prefix for helper columns that clashes with no column of the table."""
    prefix, have = "_", {c.lower() for c in df.columns}
    while any(f"{prefix}{n}".lower() in have for n in names):
        prefix += "_"
    return prefix


#: Most bytes of an Arrow batch while scratch tables are made; each task holds some in the JVM and some in Python.
BATCH_KEY, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20


@contextlib.contextmanager
def small_batches(spark: SparkSession):
    """Batches of rows for Python are at most BATCH_BYTES here; the session's setting comes back after."""
    was = spark.conf.get(BATCH_KEY, None)
    spark.conf.set(BATCH_KEY, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.unset(BATCH_KEY) if was is None else spark.conf.set(BATCH_KEY, was)


class Scratch:
    """Tables written to the folder that all executors share, so a lost executor loses none of them.

    The folder is spark.checkpoint.dir; only where that is unset (local runs, tests) a temporary folder is taken.
    Tables go when dropped, those that a result still reads when the driver ends.
    """

    def __init__(self, spark: SparkSession):
        root = spark.conf.get("spark.checkpoint.dir", None)
        if root is None:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            root = f"file://{tempfile.gettempdir()}/spindrift-scratch"
        self.spark, self.root, self.names = spark, f"{root}/spindrift-{uuid.uuid4().hex}", set()
        atexit.register(self._delete, self.root)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        self.names.add(name)
        with small_batches(self.spark):
            df.write.mode("overwrite").parquet(f"{self.root}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def drop(self, *names: str) -> None:
        for name in names:
            self.names.discard(name)
            self._delete(f"{self.root}/{name}")

    def own(self) -> Scratch:
        """A folder for one run of an operator, whose tables meet no other's of the same name."""
        return Scratch(self.spark)

    def keep_only(self, *names: str) -> None:
        """Drop the tables that a result doesn't read."""
        self.drop(*(self.names - set(names)))

    def _delete(self, path: str) -> None:
        with contextlib.suppress(Exception):  # at exit the session may be gone
            jvm = self.spark._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


def _let_go(store: dict) -> None:
    store.pop(store.get("large"), None)
    store["large"] = None


def _store(key) -> dict:
    """What a worker process keeps between tasks. Only the large thing used last stays: asking for another key lets it go."""
    store = sys.modules.setdefault("_spindrift_worker", types.ModuleType("_spindrift_worker")).__dict__
    if key is None:
        return store
    if (large := store.get("large")) is not None and large != key:
        _let_go(store)
    store["touched"] = store.get("touched") or store.get("large") is not None
    return store


def per_worker(key, make, large: bool = False):
    """make() once in each Python worker process, which Spark reuses for many tasks."""
    store = _store(key)
    if key not in store:
        store[key] = make()
    if large:
        store["large"], store["touched"] = key, True
    return store[key]


def slices(batches, rows: int):
    """The batches in parts of at most so many rows, so what is worked out for a part stays small."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def parts(batches, column: int, size: int = 1 << 20, rows: int = 4096):
    """The batches in parts of at most `rows` rows whose texts in a column have at most `size` bytes, or of one longer text."""
    for b in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < b.num_rows:
            before = int(ends[at - 1]) if at else 0
            stop = min(max(at + 1, int(np.searchsorted(ends, before + size, side="right"))), at + rows)
            yield b.slice(at, stop - at)
            at = stop


def give_back() -> None:
    """Return freed memory of this process to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries
        ctypes.CDLL(None).malloc_trim(0)


def frugal(run):
    """A function of Arrow batches that gives freed memory back when its task ends, for the worker process lives on.

    The large thing that an earlier task left in the process goes with it, if this task has not asked for it.
    """

    def each(batches):
        store = _store(None)
        store["touched"] = False
        try:
            yield from run(batches)
        finally:
            if not store["touched"]:
                _let_go(store)
            give_back()

    return each


class BoundedCache(dict):
    """A dict of at most `limit` entries, emptied when full: memory stays bounded, lookups stay plain dict lookups."""

    def __init__(self, limit: int):
        super().__init__()
        self.limit = limit

    def make_room(self, n: int) -> None:
        if len(self) + n > self.limit:
            self.clear()


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    def make():
        return np.ones(1, dtype=np.uint64)

    held = per_worker(("powers", base), lambda: [make()])
    if len(held[0]) < n:
        size = max(n + n // 8, 1 << 16)
        p = np.full(size, base, dtype=np.uint64)
        p[0] = 1
        held[0] = np.multiply.accumulate(p)
    return held[0][:n]


def words_of(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first byte and end byte of each word (run of bytes other than ASCII white space); ASCII letters count as lower case.

    A word's hash is a polynomial in its bytes modulo 2**64, from prefix sums, then mixed.
    """
    b = np.frombuffer(data.lower(), dtype=np.uint8)
    edge = np.diff(np.concatenate(([1], WHITE[b].view(np.int8), [1])))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(start):
        return np.zeros(0, dtype=np.uint64), start, end
    total = np.zeros(len(b) + 1, dtype=np.uint64)
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * _powers(BASE, len(b)), out=total[1:])
    return mix((total[end] - total[start]) * _powers(INVERSE, len(b))[start]), start, end


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts of a column, one after the other, and where each begins (one more for the end). Null is empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    held = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return held[at[0] : at[-1]], at - at[0]


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts of a column, as words_of gives them, and where each text's begin (one more for the end)."""
    data, at = text_bytes(column)
    if not len(data):
        return np.zeros(0, dtype=np.uint64), np.zeros(len(at), dtype=np.int64)
    white = WHITE[data]
    first = np.zeros(len(data) + 1, dtype=bool)
    first[at] = True
    start = np.flatnonzero(~white & (first[:-1] | np.concatenate(([True], white[:-1]))))
    end = np.flatnonzero(~white & (first[1:] | np.concatenate((white[1:], [True])))) + 1
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.multiply(LOWER[data], _powers(BASE, len(data)), out=total[1:])
    np.cumsum(total, out=total)
    return mix((total[end] - total[start]) * _powers(INVERSE, len(data))[start]), np.searchsorted(start, at)


def shingle_hashes(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of all texts of a column, as shingles_of gives them, and where each text's begin (one more for the end)."""
    words, at = word_hashes(column)
    counts = np.diff(at)
    sizes = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    to = np.concatenate(([0], np.cumsum(sizes)))
    out = np.zeros(int(to[-1]), dtype=np.uint64)
    full = counts >= width
    if full.any():
        n = len(words) - width + 1
        h = np.zeros(n, dtype=np.uint64)
        for i in range(width):
            h *= np.uint64(BASE)
            h += words[i : i + n]
        text = np.repeat(np.arange(len(counts)), counts)
        keep = text[:n] == text[width - 1 :]
        out[np.repeat(full, sizes)] = mix(h[keep])
    for i in np.flatnonzero(~full & (counts > 0)):
        out[to[i]] = shingles_of(words[at[i] : at[i + 1]], width)[0]
    return out, to


def shingles_of(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of `width` words in place; a shorter text has one shingle of all its words."""
    if not len(words):
        return words
    width = min(width, len(words))
    n = len(words) - width + 1
    h = np.zeros(n, dtype=np.uint64)
    for i in range(width):
        h = h * np.uint64(BASE) + words[i : i + n]
    return mix(h)


#: Most rows of the heavy side of join_heavy.
HEAVY = 1024


def join_heavy(rows: DataFrame, keyed: DataFrame, key: str, weight: str, total: int) -> DataFrame:
    """rows joined with keyed, which has each key once, with the number of rows that have it (or more) in `weight`.

    Keys with over total / HEAVY rows, at most HEAVY of them if weights sum up to total, are broadcast, so rows of a hot key
    never meet in a task; the others are joined by a shuffle.
    """
    hot = F.col(weight) * HEAVY > total
    heavy, light = F.broadcast(keyed.where(hot)), keyed.where(~hot)
    joined = rows.join(heavy, key)
    return joined.unionByName(rows.join(F.broadcast(keyed.where(hot).select(key)), key, "left_anti").join(light, key))


#: Rounds of connected_components; each shrinks paths to half their length or less, so 60 serve any table.
ROUNDS = 60


def connected_components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, root) of every node that has an edge; root is the smallest node reached. edges: two long columns.

    Large-star and small-star rounds until nothing changes; all in joins and aggregates, one scratch table a round.
    """
    a, b = edges.columns
    kept = None
    now = edges.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).where("hi <> lo").distinct()
    was = None
    for i in range(ROUNDS):
        if i:
            both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(now.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
            least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
            large = join_heavy(both.where("v > u"), least, "u", "n", 2 * was[0]).select(F.col("v").alias("hi"), F.col("m").alias("lo"))
            down = large.groupBy("hi").agg(F.min("lo").alias("m"))
            small = large.join(down, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
            now = small.unionByName(down.select("hi", F.col("m").alias("lo"))).distinct()
        table = f"{name}-{i}"
        now = scratch.save(now, table)
        if kept:
            scratch.drop(kept)
        kept = table
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first())
        if state == was or not state[0]:
            break
        was = state
    else:
        raise RuntimeError(f"components of {name} haven't converged after {ROUNDS} rounds")
    stars = now.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
    return stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())


def one_of_each(rows: DataFrame, keys: dict[str, Column], marks: DataFrame) -> DataFrame:
    """rows without those that marks names, but one row of those that it names as `again`.

    keys: names in marks (which has each combination once, null being a value) and the columns of rows they stand for. Only rows
    that are named as repeated are put together, combined on the map side; of these the one with the least hash stays.
    """
    p = fresh(rows, *keys, "again", "row")
    named = marks.select(*[F.col(k).alias(f"{p}{k}") for k in keys], F.col("again").alias(f"{p}again"))
    own = rows.select("*", *[c.alias(f"{p}{p}{k}") for k, c in keys.items()])
    drop = [f"{p}{p}{k}" for k in keys]

    def same(found: DataFrame):
        on = None
        for k in keys:
            each = own[f"{p}{p}{k}"].eqNullSafe(found[f"{p}{k}"])
            on = each if on is None else on & each
        return on

    repeated = named.where(f"{p}again")
    more = own.join(repeated, same(repeated), "left_semi")
    hashed = [c for c in rows.columns if not isinstance(rows.schema[c].dataType, (T.MapType, T.VariantType))]
    first = F.min_by(F.struct(*[F.col(c) for c in rows.columns]), F.xxhash64(*hashed) if hashed else F.lit(0)).alias(f"{p}row")
    named = named.hint("merge")  # marks grow with the rows, so they are never broadcast
    return own.join(named, same(named), "left_anti").drop(*drop).unionByName(more.groupBy(*drop).agg(first).select(f"{p}row.*"))


def least_reached(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n rows the first one that the links i - j reach from it."""
    least = np.arange(n)
    while True:
        m = np.minimum(least[i], least[j])
        now = least.copy()
        np.minimum.at(now, i, m)
        np.minimum.at(now, j, m)
        now = now[now]
        if np.array_equal(now, least):
            return least
        least = now


def latest_in_worker(name: str, version: str, make):
    """make() once in each Python worker process for this version; an older version, like anything large, is let go."""
    store = _store(name)
    if store.get(name, ("",))[0] != version:
        store.pop(name, None)
        store[name] = (version, make())
        store["large"] = name
    store["touched"] = True
    return store[name][1]


def share(column):
    """A number of at most 2**32 from a hash of the column as text, for seeded choices that no partitioning changes."""
    return F.crc32(F.md5(F.coalesce(column.cast("string"), F.lit(""))).cast("binary"))


def first_by_hash(df: DataFrame, columns: list[str], n: int) -> DataFrame:
    """At most n rows of two or so narrow columns, those with the smallest hashes of the first; few more than n rows meet."""
    total = df.count()
    h = share(F.col(columns[0]))
    few = df.select(*columns).where(h <= 2.0**32 * min(1.0, (2 * n + 100) / max(1, total)))
    return few.orderBy(h, *columns).limit(n)
