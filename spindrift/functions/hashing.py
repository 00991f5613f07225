"""Stable hashes of text and what is decided by them: splits, shards and orders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def stable_number(value: Column, seed: int) -> Column:
    """The first 16 hexadecimal digits of SHA-1 of `seed:value`, as decimal(20,0): it can exceed a long."""
    return F.conv(F.substring(F.sha1(F.concat(F.lit(f"{seed}:"), value)), 1, 16), 16, 10).cast("decimal(20,0)")


def _bands(share: Column, train: float, validation: float) -> Column:
    return F.when(share < train, "train").when(share < train + validation, "validation").otherwise("test")


def sha1_share(value: Column) -> Column:
    """Eight hexadecimal digits of SHA-1 over 0xFFFFFFFF, so the last value is 1."""
    return F.conv(F.substring(F.sha1(value), 1, 8), 16, 10).cast("bigint") / F.lit(0xFFFFFFFF)


def sha256_share(value: Column) -> Column:
    """Sixteen hexadecimal digits of SHA-256 over 16 ** 16."""
    return F.conv(F.substring(F.sha2(value, 256), 1, 16), 16, 10).cast("decimal(20,0)").cast("double") / F.lit(float(2**64))


def deterministic_split(project: Column, train: float = 0.7, validation: float = 0.1) -> Column:
    return _bands(sha1_share(project), train, validation)


def stable_split(project: Column, train: float = 0.7, validation: float = 0.1) -> Column:
    return _bands(sha256_share(project), train, validation)


def source_split(told: Column, project: Column) -> Column:
    """An explicit split is kept, its short names are mapped, else the hash decides."""
    t = F.lower(F.coalesce(told, F.lit("")))
    return F.when(t.isin("train", "validation", "test"), t).when(t.isin("valid", "val", "dev"), "validation").otherwise(deterministic_split(project))


def in_shard(project: Column, seed: int, shards: int, shard: int) -> Column:
    return (stable_number(project, seed + 4) % shards) == shard


#: Parts of the logical shards that are cut further; shard 9 into residues of its own (fixed values).
PARTS = {2: 2, 3: 3, 7: 2}
OWN_PARTS = {9: [(9, 30), (19, 30), (29, 90), (59, 90), (89, 90)]}
LOGICAL = 10


def physical_parts(shard: Column) -> Column:
    """Array of struct(residue, modulus) that tile a logical shard."""

    def pair(residue: Column, modulus: Column) -> Column:
        return F.struct(residue.cast("int").alias("residue"), modulus.cast("int").alias("modulus"))

    n = F.lit(1)
    for k, parts in PARTS.items():
        n = F.when(shard == k, parts).otherwise(n)
    out = F.transform(F.sequence(F.lit(0), n - 1), lambda i: pair(shard + LOGICAL * i, LOGICAL * n))
    for k, residues in OWN_PARTS.items():
        out = F.when(shard == k, F.array(*[pair(F.lit(a), F.lit(b)) for a, b in residues])).otherwise(out)
    return out
