"""Sharding by proportional stratified interleaving, in DataFrame functions only.

Rows are shuffled by a seeded hash and ranked within their source; (rank - 1/2) / rows of the source spreads each source
evenly over [0, 1). Rows sorted by that fraction have the mixture of the whole table in every stretch, so stretches of
equal length are shards with the mixture, each within one row of the ideal count a source at either end.

Ranks need no task that sees a whole source. Hashes (then fractions) fall into `BUCKETS` ranges; a rank is the rows in
earlier ranges, from counts, plus the rank within the range. A source with a third of all rows is spread over all ranges.

Defined cases: a null text has no bytes; rows of null source form a stratum of their own; repeated rows are placed one by
one; ties of the hash are broken by doc_id (nulls first), size and checksum; an empty table gives no rows; extra columns
don't matter. With fewer rows than shards, some shards are empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, documents, fresh

SHARDS = 40
SEED = 17
#: Ranges of hashes and of fractions; three hexadecimal digits of the hash.
BUCKETS = 4096
#: Added to a text's bytes for its size.
OVERHEAD = 16


def _ranked(rows: DataFrame, keys: list[str], bucket: Column, order: list, name: str) -> DataFrame:
    """rows with the rank (from 1) by bucket, then order, within keys (none: within the table), and the rows of the key."""
    rows = rows.withColumn("bucket", bucket)
    counts = rows.groupBy(*keys, "bucket").agg(F.count("*").alias("n"))
    # without keys there are BUCKETS counts at most
    upto = Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    ahead = counts.select(*keys, "bucket", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("ahead"), F.sum("n").over(Window.partitionBy(*keys)).alias(f"{name}_rows"))
    local = rows.withColumn("local", F.row_number().over(Window.partitionBy(*keys, "bucket").orderBy(*order)))
    return local.join(ahead, [*keys, "bucket"]).withColumn(name, F.col("ahead") + F.col("local")).drop("bucket", "local", "ahead")


def shard(df: DataFrame, strata: str = "source", id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS, seed: int = SEED, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, stratum, size, text_crc32, shard, slot) and what is to be kept, a row for each row of df; counts of shards differ by one at most."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(
        F.col(id_col).alias("doc_id"),
        F.when(F.col(strata).isNull(), "-").otherwise(F.concat(F.lit("+"), F.col(strata).cast("string"))).alias("stratum"),
        (F.octet_length(text) + OVERHEAD).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        *keep,
        F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))).alias("h"),
    )
    ties = ["h", F.col("doc_id").asc_nulls_first(), "size", "text_crc32"]
    within = _ranked(rows, ["stratum"], F.conv(F.substring("h", 1, 3), 16, 10).cast("int"), ties, "rank")
    spread = within.withColumn("part", (F.col("rank") - 0.5) / F.col("rank_rows"))
    placed = _ranked(spread, [], F.floor(F.col("part") * BUCKETS).cast("int"), ["part", *ties, "stratum"], "place")
    # place is 1 to n; shard s follows the first floor(s * n / shards) places, so counts are the floor or ceiling of n / shards
    number = F.expr(f"CAST((({shards} * place - 1) DIV place_rows) AS INT)")
    first = F.expr(f"((CAST(shard AS BIGINT) * place_rows) DIV {shards})")
    return placed.withColumn("shard", number).withColumn("slot", F.col("place") - 1 - first).select("doc_id", "stratum", "size", "text_crc32", *keep, "shard", "slot")


def write_shards(df: DataFrame, path: str, strata: str = "source", id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS, seed: int = SEED) -> None:
    """Write all rows of df as a folder of Parquet files for each shard (shard_number), in slot order.

    Rows are numbered first, in a scratch table, so null and repeated doc_ids lose nothing. A column of df named shard_number
    would be hidden by the folders' and is refused.
    """
    if "shard_number" in {c.lower() for c in df.columns}:
        raise ValueError("a column is named shard_number")
    p = fresh(df, "row", "shard", "slot")
    scratch = Scratch(df.sparkSession)
    rows = scratch.save(df.withColumn(f"{p}row", F.monotonically_increasing_id()), "rows")
    placed = shard(rows, strata, id_col, text_col, shards, seed, (f"{p}row",)).select(f"{p}row", F.col("shard").alias("shard_number"), F.col("slot").alias(f"{p}slot"))
    joined = rows.join(placed, f"{p}row").repartition(shards, "shard_number").sortWithinPartitions("shard_number", f"{p}slot")
    joined.select(*df.columns, "shard_number").write.partitionBy("shard_number").parquet(path)
    scratch.drop("rows")


def query(spark, sf_dir: str) -> DataFrame:
    found = shard(documents(spark, sf_dir))
    return found.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "stratum")
