"""Checks of datasets: contracts of rows, completeness, checksums, coverage of residues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_error(df: DataFrame, group: str, order: str, rules: list[tuple[str, Column]]) -> DataFrame:
    """For each group the first row that breaks a rule and the first rule that it breaks; nulls where all hold."""
    error = F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules])
    found = df.select(group, F.when(error.isNotNull(), F.struct(F.col(order).alias("first_bad"), error.alias("error"))).alias("bad"))
    return found.groupBy(group).agg(F.min("bad").alias("bad")).select(group, "bad.first_bad", "bad.error")


def missing(expected: DataFrame, have: DataFrame, key: str) -> DataFrame:
    return expected.select(key).distinct().join(have.select(key).distinct(), key, "left_anti")


def completeness(expected: DataFrame, have: DataFrame, shard: str, key: str) -> DataFrame:
    """(shard, expected, done, missing, first_missing): how many keys of each shard there are, and the first that isn't."""
    done = have.select(shard, key).distinct().withColumn("done_", F.lit(True))
    each = expected.select(shard, key).distinct().join(done, [shard, key], "left")
    lost = F.when(F.col("done_").isNull(), F.col(key))
    return each.groupBy(shard).agg(F.count("*").alias("expected"), F.count("done_").alias("done"), F.count(lost).alias("missing"), F.min(lost).alias("first_missing"))


def residue_faults(parts: DataFrame, shard: str = "shard", residue: str = "residue", modulus: str = "modulus", cycle: int = 90) -> DataFrame:
    """Residues modulo `cycle` that the parts don't cover exactly once, with how often they do."""
    spark = parts.sparkSession
    covered = parts.select(F.explode(F.sequence(F.col(residue).cast("long"), F.lit(cycle - 1).cast("long"), F.col(modulus).cast("long"))).alias("r"))
    counts = spark.range(cycle).withColumnRenamed("id", "r").join(covered.groupBy("r").agg(F.count("*").alias("n")), "r", "left")
    return counts.select("r", F.coalesce("n", F.lit(0)).alias("n")).where("n <> 1")


def checksum_conflicts(files: DataFrame, path: str, checksum: str) -> DataFrame:
    """Paths that stand for different contents."""
    return files.groupBy(path).agg(F.count_distinct(checksum).alias("n")).where("n > 1")


def path_collisions(files: DataFrame, path: str) -> DataFrame:
    """Paths that are equal but for case, and files that are also a folder of another path."""
    low = files.select(F.lower(path).alias("p"))
    same = low.groupBy("p").agg(F.count("*").alias("n")).where("n > 1").select("p", F.lit("case").alias("fault"))
    parts = F.split("p", "/")
    folders = low.select(F.explode(F.transform(F.slice(F.sequence(F.lit(1), F.size(parts)), F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))).alias("p")).where("p <> ''").distinct()
    folder = low.distinct().join(folders, "p", "left_semi").select("p", F.lit("folder").alias("fault"))
    return same.unionByName(folder)


def safe_members(files: DataFrame, path: str) -> DataFrame:
    """Members of an archive that may be unpacked: relative, without parent steps, and no other differs by case alone."""
    from pyspark.sql import Window

    ok = ~F.col(path).startswith("/") & ~F.array_contains(F.split(path, "/"), "..")
    n = F.count("*").over(Window.partitionBy(F.lower(path)))
    return files.withColumn("n_", n).where(ok & (F.col("n_") == 1)).drop("n_")
