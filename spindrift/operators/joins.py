"""Join semantics of symbol resolution and retrieval, as equi-joins with residual conditions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.similarity import dice, gain, normalise_score
from .name_search import Bound, Texts, letter_counts, ratio_bound

#: Lines of a bin in range joins.
BIN = 64
#: Most rows of a query set that is sent to every task.
MOST_QUERIES = 100_000
#: Most bytes of their texts.
MOST_BYTES = 64 << 20
#: Most terms (some 50 bytes each) of a table that is sent to every task.
MOST_TERMS = 1_000_000


def unique_by(df: DataFrame, keys: list[str], value: str, alias: str) -> DataFrame:
    """The value of each key that a single row has."""
    return df.groupBy(*keys).agg(F.count("*").alias("n_"), F.min(value).alias(alias)).where("n_ = 1").drop("n_")


def priority_join(left: DataFrame, steps: list[tuple[DataFrame, list[str], str]], alias: str) -> DataFrame:
    """Left joins with each (right side, keys, value) in turn; alias is the first value found."""
    out = left
    for i, (right, keys, value) in enumerate(steps):
        out = out.join(right.select(*keys, F.col(value).alias(f"step_{i}")), keys, "left")
    names = [f"step_{i}" for i in range(len(steps))]
    return out.withColumn(alias, F.coalesce(*names)).drop(*names)


def union_lookup(left: DataFrame, right: DataFrame, keys: list[tuple[Column, str]], columns: list[str]) -> DataFrame:
    """Rows of right that any of the keys finds, once for each key that does: a union, not a fallback."""
    out = None
    for value, name in keys:
        part = left.withColumn("key_", value).join(right.withColumnRenamed(name, "key_"), "key_").select(*columns)
        out = part if out is None else out.unionByName(part)
    return out


def guarded_fallback(left: DataFrame, right: DataFrame, exact: tuple[str, str], loose: tuple[str, str], columns: list[str]) -> DataFrame:
    """Matches by the exact key; rows without one are matched by the loose key."""
    first = left.join(right, left[exact[0]] == right[exact[1]])
    rest = left.join(right.select(F.col(exact[1]).alias("exact_")).distinct(), left[exact[0]] == F.col("exact_"), "left_anti")
    second = rest.join(right, rest[loose[0]] == right[loose[1]])
    return first.select(*columns).unionByName(second.select(*columns))


def range_join(points: DataFrame, spans: DataFrame, keys: list[str], point: str, start: str, end: str, size: int = BIN) -> DataFrame:
    """Pairs with equal keys and start <= point <= end. Spans are laid out over bins, so the join stays an equi-join."""
    binned = spans.withColumn("bin_", F.explode(F.sequence(F.floor(F.col(start) / size), F.floor(F.col(end) / size))))
    return points.withColumn("bin_", F.floor(F.col(point) / size)).join(binned, [*keys, "bin_"]).where(F.col(point).between(F.col(start), F.col(end))).drop("bin_")


def different_pairs(left: DataFrame, right: DataFrame, key: str, one: str, other: str) -> DataFrame:
    """(key, one, other): each pair of different values that share a key, once, however many rows have them."""
    values = right.select(key, other).distinct()
    return left.select(key, one).distinct().join(values.hint("merge"), key)


def innermost(points: DataFrame, spans: DataFrame, keys: list[str], point: str, start: str, end: str, value: str, row: list[str]) -> DataFrame:
    """Of the spans around each point the shortest, then the first."""
    found = range_join(points, spans, keys, point, start, end)
    best = F.min(F.struct((F.col(end) - F.col(start)).alias("span"), F.col(start).alias("start"), F.col(value).alias("value"))).alias("best")
    return found.groupBy(*row).agg(best).select(*row, F.col("best.value").alias(value))


def first_by_phase(targets: DataFrame, key: list[str], name: str, phases: list[tuple[DataFrame, list[str]]], candidate: str, place: str, above: float) -> DataFrame:
    """key and the first candidate, by phase and place, whose name equals the target's in any case or is more similar than `above`.

    Each phase is a table of candidates and the columns that it shares with the targets, so candidates are found by equal keys.
    """
    out = None
    for i, (table, on) in enumerate(phases):
        near = targets.join(table, on).withColumn("score_", F.round(dice(F.col(name), F.col(candidate)), 6))
        near = near.where((F.lower(name) == F.lower(candidate)) | (F.col("score_") > above)).select(*key, F.lit(i).alias("phase_"), place, candidate)
        out = near if out is None else out.unionByName(near)
    return out.groupBy(*key).agg(F.min_by(candidate, F.struct("phase_", place)).alias(candidate))


def until_exact(targets: DataFrame, key: list[str], name: str, candidates: DataFrame, on: list[str], candidate: str, place: str, above: float) -> DataFrame:
    """key, candidate and place of candidates more similar than `above`, in order of place up to the first that is equal."""
    near = targets.join(candidates, on).withColumn("score_", F.round(dice(F.col(name), F.col(candidate)), 6)).where(F.col("score_") > above)
    stop = F.min(F.when(F.lower(name) == F.lower(candidate), F.col(place))).over(Window.partitionBy(*key))
    return near.withColumn("stop_", stop).where(F.col("stop_").isNull() | (F.col(place) <= F.col("stop_"))).select(*key, candidate, place)


def term_counts(df: DataFrame, key: str, tokens: str) -> DataFrame:
    """(key, size, token, n): how often each row's array holds each token, and the array's length."""
    each = df.select(key, F.size(tokens).alias("size"), F.explode(tokens).alias("token"))
    return each.groupBy(key, "size", "token").agg(F.count("*").alias("n"))


def bm25_scores(a: DataFrame, a_key: str, b: DataFrame, b_key: str) -> DataFrame:
    """(a_key, b_key, score): symmetric BM25, normalised, of all pairs of two tables of term_counts that share a token.

    A pair's score is a sum over its common tokens, each worked out from counts and lengths, so nothing but sums of partial
    scores is shuffled. Where b has at most MOST_TERMS terms it goes to all tasks, and all partial scores of a row of a meet
    in its own task; else both meet by token.
    """
    right = b.select(b_key, F.col("size").alias("size_b"), F.col("token"), F.col("n").alias("n_b"))
    if right.limit(MOST_TERMS + 1).count() <= MOST_TERMS:
        right = F.broadcast(right)
    x, y, n, m = (F.col(c).cast("double") for c in ("n", "n_b", "size", "size_b"))
    part = F.sum((x * gain(y, m, n) + y * gain(x, n, m)) / 2)
    return a.join(right, "token").groupBy(a_key, b_key).agg(part.alias("raw")).select(a_key, b_key, normalise_score(F.col("raw")).alias("score"))


def top_similar(queries: DataFrame, candidates: DataFrame, query: str, candidate: str, order: str, score: Callable[[str, str], float], above: float, top: int, bound: Bound = ratio_bound) -> DataFrame:
    """(query, candidate, order, score) of the `top` candidates above a score for each query text, ties in the order given.

    For scores that no shared key prunes. The query set is stated and bounded (checked against MOST_QUERIES and MOST_BYTES), and
    goes to every task; a task keeps the best `top` of its own candidates for each query, so what is shuffled is bounded by that.
    `bound` gives the most that the score may be, from letters in common and lengths, so few scores are worked out.
    """
    each = queries.select(query).distinct()
    n, size = each.agg(F.count("*"), F.sum(F.octet_length(query))).first()
    if n > MOST_QUERIES or (size or 0) > MOST_BYTES:
        raise ValueError(f"over {MOST_QUERIES} queries or {MOST_BYTES} bytes; deal them over several calls")
    held = [r[0] for r in each.collect()]
    texts = queries.sparkSession.sparkContext.broadcast(sorted(x for x in held if x is not None))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: dict[str, list] = {q: [] for q in texts.value}
        counts = letter_counts(texts.value)
        for f in frames:
            f = f[f["c"].notna()]
            held = Texts(f["c"].tolist(), f["o"].tolist())
            for q, own in zip(texts.value, counts, strict=True):
                best[q], _ = held.best(q, own, score, bound, above, top, best[q])
        yield pd.DataFrame([(q, c, o, -s) for q, x in best.items() for s, o, c in x], columns=["q", "c", "o", "s"])

    kept = candidates.select(F.col(candidate).alias("c"), F.col(order).cast("long").alias("o")).mapInPandas(run, "q string, c string, o long, s double")
    ranked = kept.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("s"), "o", "c"))).where(F.col("rank") <= top)
    return ranked.select(F.col("q").alias(query), F.col("c").alias(candidate), F.col("o").alias(order), F.col("s").alias("score"), "rank")
