"""Windows, top-k and set operations whose order is part of the result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def occurrence(df: DataFrame, keys: list[str], order: str, alias: str = "occurrence") -> DataFrame:
    """How many earlier rows have the same keys."""
    return df.withColumn(alias, F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1)


def first_n(df: DataFrame, keys: list[str], order: list, n: int) -> DataFrame:
    return df.withColumn("n_", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("n_") <= n).drop("n_")


def union_first_wins(frames: list[DataFrame], keys: list[Column], order: list[str]) -> DataFrame:
    """Rows of all frames, of equal keys only the one of the earliest frame, then by order."""
    out = None
    for i, f in enumerate(frames):
        part = f.withColumn("frame_", F.lit(i))
        out = part if out is None else out.unionByName(part)
    names = [f"key_{i}" for i in range(len(keys))]
    keyed = out.select("*", *[k.alias(n) for k, n in zip(keys, names, strict=True)])
    return first_n(keyed, names, ["frame_", *order], 1).drop("frame_", *names)


def prepend_union(frames: list[DataFrame], key: str, order: str) -> DataFrame:
    """Later frames stand before earlier ones, each in its own order; of equal keys the first place counts. Adds `place`."""
    out = None
    for i, f in enumerate(frames):
        part = f.withColumn("generation_", F.lit(-i))
        out = part if out is None else out.unionByName(part)
    best = out.groupBy(key).agg(F.min(F.struct("generation_", order)).alias("b"))
    return best.select(key, F.col("b.generation_").alias("generation"), F.col(f"b.{order}").alias(order))


def preferred(first: DataFrame, second: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """All keys of both; columns come from the first where it has the key."""
    a, b = first.select(*keys, F.struct(*columns).alias("a_")), second.select(*keys, F.struct(*columns).alias("b_"))
    return a.join(b, keys, "full").withColumn("c_", F.coalesce("a_", "b_")).select(*keys, *[f"c_.{c}" for c in columns])


def fill_up(have: DataFrame, pool: DataFrame, group: str, key: str, least: int, salt: str) -> DataFrame:
    """Adds rows of the group's pool, in the order of a salted hash, until the group has `least`; rows it has don't count twice."""
    counts = have.groupBy(group).agg(F.count("*").alias("have_"))
    fresh = pool.join(have.select(group, key), [group, key], "left_anti")
    order = F.md5(F.concat(F.lit(f"{salt}:"), F.col(key).cast("string")))
    ranked = fresh.withColumn("n_", F.row_number().over(Window.partitionBy(group).orderBy(order, key))).join(counts, group, "left")
    return ranked.where(F.col("n_") <= least - F.coalesce("have_", F.lit(0))).select(group, key)
