"""Quality classification by co-training on two views of a document.

The text view is the mean of hashed word and word-shape features of the whole text (long runs without white space are cut into
pieces), and its share of repeated words; the metadata view is source, language and length. Each has a logistic classifier.
In each round both, calibrated on a held-out part of the labelled rows, label all unlabelled documents in a distributed pass,
and what one is sure of joins the other's training rows. At the end the calibrated views are added as log odds (less the prior
once) and score all documents.

Texts are read once, into a scratch table of features. Labelled rows are the only sample: at most `LABELLED` of them, those
with the smallest hashes. Of unlabelled rows all that a view is sure of count: their features are added up by label and by
`CELLS` cells of metadata, and a sum is one training row with a weight, so the driver gets at most 2 x `CELLS` rows a view. All
of them together weigh at most as much as the labelled rows. The model is `FEATURES` + `META` weights.

Defined cases: a null or empty text has no features (its text view says the prior); null metadata is a value of its own;
repeated rows are scored one by one and train once; conflicting labels of a doc_id count each; with labels of one class only,
every score is that class's share of all; with no labels every score is 0.5 and every row is kept; an empty table gives no
rows; extra columns don't matter.
"""

from __future__ import annotations

import operator
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BoundedCache, Scratch, documents, first_by_hash, frugal, parts, per_worker

LABELLED = 4000
ROUNDS = 4
#: Calibrated probability from which a pseudo-label is passed on.
SURE = 0.95
FEATURES = 2048
#: The last feature is the share of repeated words.
REPEATS = FEATURES - 1
META = 512
#: Cells of metadata by which pseudo-labelled rows are added up.
CELLS = 32
CACHED = 200_000
#: Word features are means of counts; this brings them to the size of the others.
SCALE = 20.0
#: Labelled ids that are broadcast, at most; more are joined.
KNOWN = 1 << 20

#: Runs of more characters than LONG without white space are cut into pieces, which are words then.
LONG = 64
PIECE = 2

RUNS = re.compile(r"(.)\1+")


def words_in(text: str | None) -> list[str]:
    words = (text or "").split()
    if any(len(x) > LONG for x in words):
        words = [p for x in words for p in ([x] if len(x) <= LONG else (x[i : i + PIECE] for i in range(0, len(x), PIECE)))]
    return words


def shape_of(word: str) -> str:
    """Classes of a word's characters, runs as one: `Haus!!` is `Xx!`."""
    s = "".join("X" if c.isupper() else "x" if c.isalpha() else "9" if c.isdigit() else c for c in word)
    return RUNS.sub(r"\1", s)


def features(word: str) -> tuple[int, int]:
    core = "".join(filter(str.isalnum, word)).lower()
    return zlib.crc32(shape_of(word).encode("utf-8", "replace")) % (FEATURES // 4), FEATURES // 4 + zlib.crc32(core.encode("utf-8", "replace")) % (REPEATS - FEATURES // 4)


def text_features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each text's features begin (one more for the end), their numbers and means, of many texts at once."""
    cache = per_worker(("quality", CACHED), lambda: BoundedCache(CACHED))
    words = [words_in(t) for t in texts]
    flat = [w for x in words for w in x]
    n = np.array([len(x) for x in words], dtype=np.int64)
    text = np.repeat(np.arange(len(words)), n)
    new = {w for w in flat if w not in cache}
    if len(cache) + len(new) > CACHED:
        cache.clear()
        new = set(flat)
    made = {w: (f := features(w))[0] << 16 | f[1] for w in new}
    if len(made) <= CACHED:
        cache.update(made)
        made = cache
    both = np.fromiter(map(made.__getitem__, flat), dtype=np.int64, count=len(flat))
    keys, times = np.unique(np.concatenate((text * FEATURES + (both >> 16), text * FEATURES + (both & 0xFFFF))), return_counts=True)
    again = np.fromiter(map(operator.eq, flat, flat[1:]), dtype=bool, count=max(0, len(flat) - 1)) & (text[1:] == text[:-1])
    again = np.bincount(text[1:][again], minlength=len(n))
    some = np.flatnonzero(again)
    keys, times = np.concatenate((keys, some * FEATURES + REPEATS)), np.concatenate((times, again[some])).astype(np.float64)
    order = np.argsort(keys, kind="stable")
    of, at = np.divmod(keys[order], FEATURES)
    return np.searchsorted(of, np.arange(len(n) + 1)), at, times[order] * SCALE / np.maximum(n, 1)[of]


def meta_features(values: list) -> list[int]:
    """One number for each metadata value, and its position; numbers are taken by their power of two."""
    out = []
    for i, v in enumerate(values):
        if isinstance(v, (int, float)) and not isinstance(v, bool):
            v = int(np.log2(max(float(v), 0) + 1)) if np.isfinite(v) else "?"
        out.append(zlib.crc32(f"{i}:{v}".encode("utf-8", "replace")) % META)
    return out


class Logistic:
    """Weighted ridge logistic regression by Adam, then Platt scaling."""

    def __init__(self, size: int):
        self.w, self.b, self.a, self.c = np.zeros(size), 0.0, 1.0, 0.0

    @staticmethod
    def prob(z: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-4, steps: int = 200) -> None:
        share = weight / weight.sum()
        mean = float(share @ y)
        self.w[:], self.b = 0, float(np.log((mean + 1e-3) / (1 - mean + 1e-3)))
        m, v = np.zeros(len(self.w) + 1), np.zeros(len(self.w) + 1)
        for t in range(1, steps + 1):  # whole batch
            e = (self.prob((x @ self.w.astype(x.dtype)).astype(np.float64) + self.b) - y) * share
            g = np.append((x.T @ e.astype(x.dtype)).astype(np.float64) + ridge * self.w, e.sum())
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            step = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
            self.w -= step[:-1]
            self.b -= float(step[-1])

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        """Slope and offset of the log odds that fit held-out rows best, drawn to 1 and 0 where there are few."""
        z = np.clip(x @ self.w + self.b, -30, 30)
        self.a, self.c = 1.0, 0.0
        for _ in range(50):
            p = self.prob(self.a * z + self.c)
            g = np.array([((p - y) * z).sum() + (self.a - 1), (p - y).sum() + self.c])
            q = p * (1 - p)
            h = np.array([[(q * z * z).sum() + 1, (q * z).sum()], [(q * z).sum(), q.sum() + 1]])
            step = np.linalg.solve(h, g)
            self.a, self.c = self.a - step[0], self.c - step[1]
            if np.abs(step).max() < 1e-6:
                break

    def odds(self, x: np.ndarray) -> np.ndarray:
        return self.a * np.clip(x @ self.w + self.b, -30, 30) + self.c

    def sparse_odds(self, begin: np.ndarray, at: np.ndarray, value: np.ndarray) -> np.ndarray:
        """Of rows given by where each begins, and numbers and values of its features."""
        total = np.concatenate(([0.0], np.cumsum(self.w[at] * value)))
        return self.a * np.clip(total[begin[1:]] - total[begin[:-1]] + self.b, -30, 30) + self.c


class Model:
    def __init__(self, text: Logistic, meta: Logistic, prior: float):
        self.text, self.meta, self.prior = text, meta, prior

    def view_odds(self, b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        """Log odds of both views of rows of a feature table; the text view of a text without features is the prior."""
        (begin, at, mean), (m_begin, m_at) = _sparse(b)
        text = np.where(np.diff(begin) > 0, self.text.sparse_odds(begin, at, mean), self.prior)
        return text, self.meta.sparse_odds(m_begin, m_at, np.ones(len(m_at)))


def _sparse(b: pa.RecordBatch) -> tuple[tuple, tuple]:
    at, mean, meta = (b.column(b.schema.get_field_index(n)) for n in ("at", "mean", "meta"))
    begin, m_begin = (x.offsets.to_numpy().astype(np.int64) for x in (at, meta))
    return (begin - begin[0], at.flatten().to_numpy().astype(np.int64), mean.flatten().to_numpy().astype(np.float64)), (m_begin - m_begin[0], meta.flatten().to_numpy().astype(np.int64))


def featured(docs: DataFrame, id_col: str, text_col: str, meta_cols: tuple[str, ...]) -> DataFrame:
    """(doc_id, row, at, mean, meta) of each row: its id, a hash of all that is read of it, and its features."""
    metas = [F.col(c) for c in meta_cols]
    chosen = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(id_col), F.col(text_col), *metas).alias("row"), F.col(text_col).alias("text"), F.struct(*[m.alias(f"m{i}") for i, m in enumerate(metas)]).alias("meta"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches, 2):
            begin, at, mean = text_features(b.column(2).to_pylist())
            lists = [pa.ListArray.from_arrays(pa.array(begin, pa.int32()), pa.array(x, k)) for x, k in ((at, pa.int16()), (mean, pa.float32()))]
            metas = pa.array([sorted(set(meta_features(list(x.values())))) for x in b.column(3).to_pylist()], pa.list_(pa.int16()))
            yield pa.RecordBatch.from_arrays([*b.columns[:2], *lists, metas], ["doc_id", "row", "at", "mean", "meta"])

    return chosen.mapInArrow(frugal(run), f"doc_id {chosen.schema['doc_id'].dataType.simpleString()}, row long, at array<short>, mean array<float>, meta array<short>")


def _matrices(rows) -> tuple[np.ndarray, np.ndarray]:
    text, meta = np.zeros((len(rows), FEATURES), dtype=np.float32), np.zeros((len(rows), META), dtype=np.float32)
    for i, r in enumerate(rows):
        text[i, r["at"]] = r["mean"]
        meta[i, r["meta"]] = 1
    return text, meta


def pseudo_labelled(free: DataFrame, model: Model) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For the text view, then the metadata view: rows, labels and weights of what the other view is sure of, added up by label and cell."""
    held = free.sparkSession.sparkContext.broadcast(model)
    shape = "view int, label int, cell int, n long, sums binary"

    def packed(sums: dict) -> pa.RecordBatch:
        keys = sorted(sums)
        columns = [pa.array([k[i] for k in keys], pa.int32()) for i in range(3)]
        return pa.RecordBatch.from_arrays([*columns, pa.array([sums[k][0] for k in keys], pa.int64()), pa.array([sums[k][1].tobytes() for k in keys], pa.binary())], ["view", "label", "cell", "n", "sums"])

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, sums = held.value, {}
        for b in batches:
            if not b.num_rows:
                continue
            (begin, at, mean), (m_begin, m_at) = _sparse(b)
            cell = np.bincount(np.repeat(np.arange(b.num_rows), np.diff(m_begin)), weights=m_at * 7919 % 65521, minlength=b.num_rows).astype(np.int64) % CELLS
            for view, odds, (start, numbers, values, size) in zip((1, 0), m.view_odds(b), ((m_begin, m_at, np.ones(len(m_at)), META), (begin, at, mean, FEATURES)), strict=True):
                p = Logistic.prob(odds)
                for y, sure in ((1, p >= SURE), (0, 1 - p >= SURE)):
                    rows = np.flatnonzero(sure)
                    if not len(rows):
                        continue
                    n = np.diff(start)[rows]
                    where = np.repeat(start[rows] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(int(n.sum()))
                    total = np.bincount(np.repeat(cell[rows], n) * size + numbers[where], weights=values[where], minlength=CELLS * size).reshape(CELLS, size)
                    counts = np.bincount(cell[rows], minlength=CELLS)
                    for c in np.flatnonzero(counts):
                        was = sums.get((view, y, int(c)), (0, 0))
                        sums[view, y, int(c)] = (was[0] + int(counts[c]), was[1] + total[c])
        if sums:
            yield packed(sums)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}
        for b in batches:
            for r in b.to_pylist():
                key = r["view"], r["label"], r["cell"]
                was = sums.get(key, (0, 0))
                sums[key] = (was[0] + r["n"], was[1] + np.frombuffer(r["sums"]))
        if sums:
            yield packed(sums)

    found = free.select("at", "mean", "meta").mapInArrow(frugal(label), shape).repartition("view", "label", "cell").mapInArrow(frugal(add), shape).collect()
    out = []
    for view, size in enumerate((FEATURES, META)):
        mine = sorted((r for r in found if r["view"] == view), key=lambda r: (r["label"], r["cell"]))
        x = np.array([np.frombuffer(r["sums"]) / r["n"] for r in mine], dtype=np.float32).reshape(-1, size)
        out.append((x, np.array([r["label"] for r in mine], dtype=float), np.array([r["n"] for r in mine], dtype=float)))
    return out


def co_train(text: np.ndarray, meta: np.ndarray, y: np.ndarray, label, rounds: int = ROUNDS) -> Model:
    """y: 0 or 1. label(model) gives what each view learns from the other's. Every fourth labelled row calibrates."""
    held = np.arange(len(y)) % 4 == 3
    if held.sum() < 20:
        held[:] = False
    fits = ~held
    check = held if held.any() else fits
    prior = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    views = (Logistic(text.shape[1]), text), (Logistic(meta.shape[1]), meta)
    model = Model(views[0][0], views[1][0], prior)
    more = [(x[:0], y[:0], y[:0]) for _, x in views]
    for turn in range(rounds + 1):
        for (view, x), (rows, labels, n) in zip(views, more, strict=True):
            weight = n * min(1.0, fits.sum() / max(1.0, n.sum()))
            view.fit(np.vstack([x[fits], rows]), np.append(y[fits], labels), np.append(np.ones(fits.sum()), weight))
            view.calibrate(x[check], y[check])
        if turn == rounds:
            break
        more = label(model)
        if not any(len(labels) for _, labels, _ in more):
            break
    return model


def train(rows: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", labelled: int = LABELLED, rounds: int = ROUNDS) -> Model | float:
    """The model from a feature table (saved) and labels, or the one score of all rows where labels have a single class or none."""
    known = labels.select(F.col(id_col).alias("k_id"), F.col(label_col).cast("int").alias("k_y")).where("k_y IN (0, 1) AND k_id IS NOT NULL").distinct()
    each = rows.select("doc_id", "row").join(known, F.col("doc_id") == F.col("k_id")).select("row", "k_y").distinct()
    first = F.broadcast(first_by_hash(each, ["row", "k_y"], labelled))
    taken = rows.join(first, "row").dropDuplicates(["row", "k_y"]).collect()
    if not taken:
        return 0.5
    y = np.array([r["k_y"] for r in taken], dtype=float)
    if y.min() == y.max():
        return float(y[0])
    ids = known.select(F.col("k_id").alias("doc_id")).distinct()
    free = rows.join(F.broadcast(ids) if ids.limit(KNOWN + 1).count() <= KNOWN else ids, "doc_id", "left_anti")
    order = sorted(range(len(taken)), key=lambda i: (zlib.crc32(str(taken[i]["row"]).encode()), taken[i]["row"], y[i]))
    text, meta = _matrices([taken[i] for i in order])
    return co_train(text, meta, y[order], lambda model: pseudo_labelled(free, model), rounds)


def scored(rows: DataFrame, model: Model | float, threshold: float = 0.5) -> DataFrame:
    """(doc_id, text_score, meta_score, score, kept), a row for each row of a feature table."""
    if isinstance(model, float):
        same = [F.lit(model).alias(x) for x in ("text_score", "meta_score", "score")]
        return rows.select("doc_id", *same, F.lit(model >= threshold).alias("kept"))
    held = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                text, meta = held.value.view_odds(b)
                both = Logistic.prob(text + meta - held.value.prior)
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, pa.float64()) for x in (Logistic.prob(text), Logistic.prob(meta), both)), pa.array(both >= threshold, pa.bool_())], ["doc_id", "text_score", "meta_score", "score", "kept"])

    return rows.select("doc_id", "at", "mean", "meta").mapInArrow(frugal(run), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text_score double, meta_score double, score double, kept boolean")


META_COLS = ("source", "lang", "n_chars")


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", meta_cols: tuple[str, ...] = META_COLS, label_col: str = "quality", labelled: int = LABELLED, rounds: int = ROUNDS) -> Model | float:
    """The model, or the one score of all rows where labels have a single class or none."""
    scratch = Scratch(docs.sparkSession)
    model = train(scratch.save(featured(docs, id_col, text_col, meta_cols), "features"), labels, id_col, label_col, labelled, rounds)
    scratch.drop("features")
    return model


def score(docs: DataFrame, model: Model | float, id_col: str = "doc_id", text_col: str = "text", meta_cols: tuple[str, ...] = META_COLS, threshold: float = 0.5) -> DataFrame:
    """(doc_id, text_score, meta_score, score, kept), a row for each row of docs."""
    return scored(featured(docs, id_col, text_col, meta_cols), model, threshold)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = Scratch(spark).save(featured(documents(spark, sf_dir), "doc_id", "text", META_COLS), "features")
    return scored(rows, train(rows, spark.read.parquet(f"{sf_dir}/labels.parquet")))
