"""Leakage-free splits by project."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import stable_number


def project_splits(rows: DataFrame, seed: int = 13, test_projects: int = 100, validation_ratio: float = 0.1) -> DataFrame:
    """(project, split) from a column `project`: 7000 of 10000 hashes train, part of those validation, the first of the rest test."""
    p = rows.select("project").where("project IS NOT NULL").distinct()
    train = stable_number(F.col("project"), seed) % 10_000 < 7_000
    held = stable_number(F.col("project"), seed + 2) % 10_000 < int(validation_ratio * 10_000)
    rest = p.where(~train)
    test = rest.orderBy(stable_number(F.col("project"), seed + 1)).limit(test_projects) if test_projects else rest
    return p.where(train).withColumn("split", F.when(held, "validation").otherwise("train")).unionByName(test.withColumn("split", F.lit("test")))
