"""Aggregates of the dataset build and of evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import canonical_type_name


def share_percent(part: Column, whole: Column) -> Column:
    """Percentage to two decimals; 0.0 of nothing."""
    return F.coalesce(F.round(F.try_divide(100.0 * part, whole), 2), F.lit(0.0))


def coverage(df: DataFrame, group: str, found: Column) -> DataFrame:
    n, k = F.count("*"), F.count_if(found)
    return df.groupBy(group).agg(n.alias("total"), k.alias("found"), (n - k).alias("missing"), share_percent(k, n).alias("percentage"))


def same_type(a: Column, b: Column) -> Column:
    return canonical_type_name(a) == canonical_type_name(b)


def base_name(c: Column) -> Column:
    """A type without its arguments."""
    return F.split(canonical_type_name(c), r"[\[<]", 2)[0]


def hit_rank(predictions: Column, truth: Column, base: bool = False) -> Column:
    """Place of the first prediction (array of struct(type, score)) that is the true type; null if none."""
    f = base_name if base else canonical_type_name
    hits = F.transform(predictions, lambda p: f(p["type"]) == f(truth))
    return F.nullif(F.array_position(hits, True), F.lit(0).cast("long"))


def lifted(predictions: Column) -> Column:
    """Plain texts as struct(type, score) with no score."""
    return F.transform(predictions, lambda p: F.struct(p.alias("type"), F.lit(None).cast("double").alias("score")))


def metric_groups(scope: Column, cat: Column, generic: Column | None) -> Column:
    """The groups of a row: its scope, its category and all; without `generic` there is no gen."""
    where = F.when(scope.isin("local", "var"), "var").when(scope == "arg", "arg").when(scope.isin("return", "ret"), "ret")
    what = F.when(cat == "user-defined", "usr").otherwise("ele")
    if generic is not None:
        what = F.when(generic, "gen").otherwise(what)
    return F.filter(F.array(where, what, F.lit("all")), lambda x: x.isNotNull())


def metrics(df: DataFrame, rank: str, groups: Column, ks: tuple[int, ...] = (1, 3, 5), mrr_at: int = 5) -> DataFrame:
    """Rates of each of the overlapping groups: a row goes to all of its groups before one aggregation."""
    each = df.select(F.explode(groups).alias("cat"), F.col(rank).alias("r"))
    within = [F.avg(F.when(F.col("r") <= k, 1.0).otherwise(0.0)).alias(f"top{k}") for k in ks]
    return each.groupBy("cat").agg(F.count("*").alias("n"), *within, F.avg(F.when(F.col("r") <= mrr_at, 1.0 / F.col("r")).otherwise(0.0)).alias("mrr"))


def token_stats(df: DataFrame, length: Column, limit: int, groups: list[str]) -> DataFrame:
    return df.groupBy(*groups).agg(
        F.count(length).alias("samples"), F.avg(length).alias("avg"), F.min(length).alias("min"), F.max(length).alias("max"), F.count_if(length > limit).alias("over"), share_percent(F.count_if(length > limit), F.count(length)).alias("over_pct")
    )


def truncation(df: DataFrame, group: str, length: str, limits: list[int]) -> DataFrame:
    """For each group and limit: texts cut and what is cut off. Each row meets each of the few limits once."""
    each = df.select(group, length, F.explode(F.array(*map(F.lit, limits))).alias("limit"))
    over = F.greatest(F.lit(0), F.col(length) - F.col("limit"))
    return each.groupBy(group, "limit").agg(F.count_if(over > 0).alias("cut"), share_percent(F.count_if(over > 0), F.count("*")).alias("cut_pct"), F.sum(over).alias("removed"))


def votes(df: DataFrame, group: str, answer: str, order: str) -> DataFrame:
    """Answers of each group by descending frequency, then first seen; score is votes / 20."""
    from pyspark.sql import Window

    counted = df.groupBy(group, answer).agg(F.count("*").alias("votes"), F.min(order).alias("first_seen"))
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("votes"), "first_seen"))
    return counted.select(group, answer, "votes", (F.col("votes") / 20.0).alias("score"), rank.alias("rank"))


def first_wins(df: DataFrame, keys: list[str], order: str, columns: list[str]) -> DataFrame:
    """The row with the smallest order for each key, combined on the map side."""
    return df.groupBy(*keys).agg(F.min(F.struct(order, *columns)).alias("b")).select(*keys, *[f"b.{c}" for c in columns])


def pooled(df: DataFrame, keys: list[str], vector: str, mask: str) -> DataFrame:
    """(keys, place, mean): mean of each place of the vectors whose mask holds, 0 if none does. Sums are combined before rows of a key meet."""
    each = df.select(*keys, mask, F.posexplode(vector).alias("place", "value"))
    kept = F.when(F.col(mask), F.col("value").cast("double"))
    found = each.groupBy(*keys, "place").agg(F.sum(kept).alias("sum_"), F.count(kept).alias("n_"))
    return found.select(*keys, "place", (F.coalesce("sum_", F.lit(0.0)) / F.greatest("n_", F.lit(1))).alias("mean"))
