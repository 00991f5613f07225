"""Row predicates of the dataset build."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def timeout_for(project: Column, seconds: int, only: list[str]) -> Column:
    """The time limit of a project: none unless listed; an empty list means all."""
    if seconds <= 0:
        return F.lit(0)
    return F.when(project.isin(only), seconds).otherwise(0) if only else F.lit(seconds)


#: Paths of a shard's payload (fixed values).
PAYLOAD = r"^(raw_slices/.*\.jsonl|project_status/.*\.json|project_kb/(.*/)?knowledge_base\.json|metadata/.*\.json|runtime_manifest\.json|shard_manifest\.json)$"


def payload_path(path: Column) -> Column:
    return path.rlike(PAYLOAD)


def valid_dataset_id(c: Column) -> Column:
    """owner/slug by the hosting service's rules."""
    parts = F.split(F.coalesce(c, F.lit("")), "/")
    return (F.size(parts) == 2) & F.trim(parts[0]).rlike("^[A-Za-z0-9][A-Za-z0-9_-]{1,49}$") & F.coalesce(F.trim(F.get(parts, F.lit(1))), F.lit("")).rlike("^[a-z0-9][a-z0-9-]{2,49}$")


def valid_title(c: Column) -> Column:
    return F.length(F.trim(F.coalesce(c, F.lit("")))).between(6, 50)


def not_done(work: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Work that has no finished output yet."""
    return work.join(done.select(key).distinct(), key, "left_anti")


def coordinates_match(df: DataFrame, expected: dict) -> DataFrame:
    """Rows whose columns equal what is expected, nulls included."""
    keep = F.lit(True)
    for c, v in expected.items():
        keep = keep & F.col(c).eqNullSafe(F.lit(v))
    return df.where(keep)
