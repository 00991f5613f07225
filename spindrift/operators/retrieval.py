"""Scoring and choosing of knowledge-base records."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Kinds of records that can be candidates (fixed values).
CANDIDATE_KINDS = ["class", "type_alias", "reexport_alias"]
#: Rank of a record that no retriever named, and the weights of a score (fixed values).
UNSEEDED, TARGET_WEIGHT, SLICE_MOST, NAMED_WEIGHT = 10_000, 40, 25, 100


def kb_scores(kb: DataFrame, seeds: DataFrame, target: DataFrame) -> DataFrame:
    """kb with seed_rank and score. seeds: (project, seed, rank); target: (project, target_tokens, slice_tokens); kb has words."""
    best = seeds.groupBy("project", F.lower("seed").alias("seed")).agg(F.min("rank").alias("r"))
    by_qualified = best.select("project", F.col("seed").alias("low_qualified"), F.col("r").alias("r_qualified"))
    by_name = best.select("project", F.col("seed").alias("low_name"), F.col("r").alias("r_name"))
    out = kb.join(target, "project").withColumn("low_qualified", F.lower("qualified_name")).withColumn("low_name", F.lower("name"))
    out = out.join(by_qualified, ["project", "low_qualified"], "left").join(by_name, ["project", "low_name"], "left")
    rank = F.least(F.coalesce("r_qualified", F.lit(UNSEEDED)), F.coalesce("r_name", F.lit(UNSEEDED)))
    score = (
        F.when(rank < UNSEEDED, UNSEEDED - rank).otherwise(0)
        + TARGET_WEIGHT * F.size(F.array_intersect("target_tokens", "words"))
        + F.least(F.lit(SLICE_MOST), F.size(F.array_intersect("slice_tokens", "words")))
        + F.when(F.array_contains("slice_tokens", F.col("low_name")), NAMED_WEIGHT).otherwise(0)
    )
    return out.select(*kb.columns, rank.alias("seed_rank"), score.cast("long").alias("score"))


def top_types(scored: DataFrame, limit: int) -> DataFrame:
    """Best records of each project, each qualified name once whatever its case."""
    name = F.lower("qualified_name")
    first = F.row_number().over(Window.partitionBy("project", name).orderBy(F.desc("score"), "key"))
    rank = F.row_number().over(Window.partitionBy("project").orderBy(F.desc("score"), name, "key"))
    return scored.withColumn("first_", first).where("first_ = 1").withColumn("rank", rank).where(F.col("rank") <= limit).drop("first_")


def prefix_join(queries: DataFrame, query: str, records: DataFrame, name: str) -> DataFrame:
    """Records whose name begins with a query text: an equi-join on every prefix of the names."""
    longest = queries.agg(F.max(F.length(query)).alias("longest_"))
    each = records.crossJoin(F.broadcast(longest))  # one row
    each = each.withColumn("prefix_", F.explode(F.transform(F.sequence(F.lit(1), F.least(F.length(name), F.col("longest_"))), lambda i: F.substring(F.col(name), F.lit(1), i))))
    return queries.join(each, F.col(query) == F.col("prefix_")).drop("prefix_", "longest_").distinct()
