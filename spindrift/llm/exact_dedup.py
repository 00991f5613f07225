"""Exact deduplication with a heavy-hitter split.

1. A narrow table (doc_id, digest, length) is written once to the shared folder: texts are read and hashed once.
2. Misra-Gries summaries of `heavy` counters find every digest that more than rows / (heavy + 1) rows share;
   summaries merge in two levels, the second of at most `FAN` summaries, so the last task gets a bounded number of counters.
3. Exact counts verify the candidates. The winners (at most `heavy` rows) are broadcast, and rows of those digests
   are settled on the map side. They never meet in one task.
4. The other digests are settled by ordinary aggregation, combined on the map side, and a join that may be split.

Defined cases: a null text counts as empty, and all empty texts are one group. Of equal lengths the smallest doc_id stays;
a null doc_id comes after all others. Rows repeated with one doc_id count one by one in group_size. `exact_dedup` decides on
each (doc_id, text, length) by itself, so null and repeated doc_ids lose no text, and of rows that are equal in all three one
stays: a table loaded twice gives what it gives once. An empty table gives an empty result. Extra columns are kept by `exact_dedup` and don't matter.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, one_of_each

#: Deleted before texts are compared: space and U+0009 to U+000D.
BLANKS = " \t\n\x0b\x0c\r"
#: Counters of a Misra-Gries summary; also the most rows that are broadcast.
HEAVY = 1024
#: Summaries merge in so many groups before the last merge.
FAN = 64


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), BLANKS, "")


def _merge(into: Counter, more: dict, heavy: int) -> None:
    """Misra-Gries merge: add, then take the (heavy + 1)th largest count from all, keeping what stays above zero."""
    into.update(more)
    if len(into) > heavy:
        cut = sorted(into.values(), reverse=True)[heavy]
        for k in [k for k, v in into.items() if v <= cut]:
            del into[k]
        for k in into:
            into[k] -= cut


def misra_gries(df: DataFrame, column: str, heavy: int = HEAVY) -> DataFrame:
    """At most `heavy` rows (digest, low): all values of a binary column that more than rows / (heavy + 1) rows have are in it."""

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for b in batches:
            counts = b.column(0).value_counts()
            _merge(held, dict(zip(counts.field("values").to_pylist(), counts.field("counts").to_pylist(), strict=True)), heavy)
        if held:
            yield pa.RecordBatch.from_pydict({"digest": pa.array(list(held), pa.binary()), "low": pa.array(list(held.values()), pa.int64())})

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for b in batches:
            counts: Counter = Counter()
            for k, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                counts[k] += v
            _merge(held, counts, heavy)
        if held:
            yield pa.RecordBatch.from_pydict({"digest": pa.array(list(held), pa.binary()), "low": pa.array(list(held.values()), pa.int64())})

    shape = "digest binary, low long"
    each = df.select(column).mapInArrow(summarise, shape)
    # by digest, so AQE may join small groups; each unit of error is still paid for by heavy + 1 counts taken off somewhere
    groups = each.repartition(F.pmod(F.xxhash64("digest"), F.lit(FAN)))
    return groups.mapInArrow(merge, shape).repartition(1).mapInArrow(merge, shape)


def _hashed(docs: DataFrame, id_col: str, text_col: str) -> list[Column]:
    text = F.col(text_col)
    return [F.col(id_col).alias("doc_id"), F.unhex(F.sha2(normalised(text), 256)).alias("digest"), F.length(F.coalesce(text, F.lit(""))).cast("long").alias("length")]


def _classes(docs: DataFrame, scratch: Scratch, id_col: str, text_col: str, heavy: int) -> DataFrame:
    """(doc_id, digest, length, keep_id, keep_length, group_size), a row for each row of docs."""
    scratch = scratch.own()
    rows = scratch.save(docs.select(*_hashed(docs, id_col, text_col)), "digests")
    # the longest, then the smallest known doc_id
    best = F.min(F.struct((-F.col("length")).alias("short"), F.col("doc_id").isNull().alias("unknown"), "doc_id")).alias("best")
    won = ["digest", F.col("best.doc_id").alias("keep_id"), (-F.col("best.short")).alias("keep_length"), "group_size"]

    def settle(some: DataFrame) -> DataFrame:
        return some.groupBy("digest").agg(best, F.count("*").alias("group_size")).select(*won)

    candidates = F.broadcast(misra_gries(rows, "digest", heavy).select("digest"))
    winners = scratch.save(settle(rows.join(candidates, "digest", "left_semi")).where("group_size > 1"), "winners")
    heavy_rows = rows.join(F.broadcast(winners), "digest")
    rest = rows.join(F.broadcast(winners.select("digest")), "digest", "left_anti")
    light_rows = rest.join(settle(rest), "digest")
    return heavy_rows.unionByName(light_rows)


def classes(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", heavy: int = HEAVY) -> DataFrame:
    """(doc_id, digest, keep_id, group_size), a row for each row of docs."""
    return _classes(docs, scratch, id_col, text_col, heavy).select("doc_id", "digest", "keep_id", "group_size")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", heavy: int = HEAVY) -> DataFrame:
    """One row of each group, with all its columns."""
    scratch = Scratch(docs.sparkSession)
    keys = ["doc_id", "digest", "length"]
    stays = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("length") == F.col("keep_length"))
    found = _classes(docs, scratch, id_col, text_col, heavy).groupBy(*keys).agg(F.first(stays).alias("again"), F.count("*").alias("n"))
    marks = scratch.save(found.where("n > 1 OR NOT again").select(*keys, "again"), "marks")
    return one_of_each(docs, dict(zip(keys, _hashed(docs, id_col, text_col), strict=True)), marks)


def query(spark, sf_dir: str) -> DataFrame:
    from .common import documents

    found = classes(documents(spark, sf_dir), Scratch(spark))
    return found.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS len,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents
), w AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY len DESC, doc_id ASC NULLS LAST
                                      ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS keep_id,
         count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM d
)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256 FROM w
"""
