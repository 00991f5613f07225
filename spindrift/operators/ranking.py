"""Ranking of candidates and its evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.similarity import pad_right


def contrastive_loss(df: DataFrame, group: str, score: str, positive: str, temperature: float = 0.07) -> DataFrame:
    """Softmax cross-entropy of the positive among a group's scores; groups without a positive have none."""
    scaled = df.select(group, (F.col(score) / temperature).alias("s"), positive)
    top = scaled.groupBy(group).agg(F.max("s").alias("m"), F.max(F.when(F.col(positive), F.col("s"))).alias("p")).where("p IS NOT NULL")
    sums = scaled.join(top, group).groupBy(group, "m", "p").agg(F.sum(F.exp(F.col("s") - F.col("m"))).alias("z"))
    return sums.select(group, (F.log("z") + F.col("m") - F.col("p")).alias("loss"))


def padded_candidates(df: DataFrame, group: str, order: str, value: str, positive: str, width: int) -> DataFrame:
    """A group's candidates in order as an array of at least `width`, and the position of its first positive (-1 if none).

    A group is one query's candidate list, which its retriever bounds.
    """
    held = df.groupBy(group).agg(F.sort_array(F.collect_list(F.struct(F.col(order), F.col(value).alias("v"), F.col(positive).alias("p")))).alias("c"))
    return held.select(
        group,
        F.size("c").cast("long").alias("candidates"),
        pad_right(F.transform("c", lambda x: x["v"]), F.lit(width), F.lit(None).cast(df.schema[value].dataType)).alias("padded"),
        (F.coalesce(F.array_position(F.transform("c", lambda x: x["p"]), True), F.lit(0)) - 1).alias("positive"),
    )


def ranked(df: DataFrame, query: str, score: Column, ties: list, top: int | None = None) -> DataFrame:
    """Rows with their rank within the query: best score first, then ties; only the first `top`."""
    out = df.withColumn("rank", F.row_number().over(Window.partitionBy(query).orderBy(score.desc(), *ties)))
    return out.where(F.col("rank") <= top) if top else out


def first_hit(ranking: DataFrame, query: str, hit: Column) -> DataFrame:
    """The rank of the first hit of each query; null if none."""
    return ranking.groupBy(query).agg(F.min(F.when(hit, F.col("rank"))).alias("gold_rank"))


def rates(hits: DataFrame, groups: list[str], rank: str = "gold_rank", ks: tuple[int, ...] = (1, 3, 5), mrr_at: int = 5) -> DataFrame:
    """Top-k accuracy and mean reciprocal rank over all rows of a group; an empty group gives no row."""
    within = [F.avg(F.when(F.col(rank) <= k, 1.0).otherwise(0.0)).alias(f"top{k}") for k in ks]
    mrr = F.avg(F.when(F.col(rank) <= mrr_at, 1.0 / F.col(rank)).otherwise(0.0)).alias(f"mrr{mrr_at}")
    return hits.groupBy(*groups).agg(F.count("*").alias("n"), *within, mrr)
