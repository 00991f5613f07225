"""Finalizing, merging and verifying datasets by digests that no order of rows changes.

The digest of some rows is the sum of a 60-bit hash of each: it is made by map-side sums, is the same over any partitioning, and
unlike a set's it tells a doubled row from a single one. One pass over a dataset gives its digests and its first
broken rule, another over its recommendations alone what is outside its knowledge base; no text is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hexadecimal digits of MD5 that a row's hash has.
DIGITS = 15
SEPARATOR, NULL = "\x1f", "\x00"


def row_hash(columns: list[str]) -> Column:
    """60 bits of a row's columns as text, null being no text."""
    text = F.concat_ws(SEPARATOR, *[F.coalesce(F.col(c).cast("string"), F.lit(NULL)) for c in columns])
    return F.conv(F.substring(F.md5(text), 1, DIGITS), 16, 10).cast("decimal(38,0)")


def digest(columns: list[str]) -> Column:
    return F.sum(row_hash(columns)).cast("string")


def manifest(rows: DataFrame, split: str, project: str, columns: list[str]) -> DataFrame:
    """(split, rows, projects, digest) of each split."""
    return rows.groupBy(split).agg(F.count("*").alias("rows"), F.count_distinct(project).alias("projects"), digest(columns).alias("digest"))


def finalize(rows: DataFrame, expected: DataFrame, statuses: DataFrame, split: str, project: str, columns: list[str], allow_partial: bool = False, strict: bool = False) -> DataFrame:
    """The manifest of rows with the numbers of failed and of missing projects of each split; refused where the gate says so.

    expected: (split, project) of the plan; statuses: (project, error) of what was attempted. Projects that were never
    attempted refuse the dataset unless it may be partial; failed ones do if it is strict. Only numbers come to the driver.
    """
    tried = statuses.groupBy(project).agg(F.max(F.col("error").isNotNull()).alias("failed"))
    plan = expected.select(split, project).distinct().join(tried, project, "left")
    gate = plan.groupBy(split).agg(F.count_if(F.col("failed").isNull()).alias("missing"), F.count_if(F.col("failed")).alias("failures"))
    missing, failures = gate.agg(F.coalesce(F.sum("missing"), F.lit(0)), F.coalesce(F.sum("failures"), F.lit(0))).first()
    if missing and not allow_partial:
        raise ValueError(f"dataset is incomplete: {missing} projects were not attempted")
    if failures and strict:
        raise ValueError(f"dataset has {failures} failed projects")
    made = manifest(rows, split, project, columns)
    return gate.join(made, split, "left").na.fill(0, ["rows", "projects"]).select(split, "rows", "projects", "digest", "missing", "failures")


def merge_shards(files: DataFrame, manifests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Merged files (path, checksum, copies) and faults (fault, of).

    files: (shard, path, checksum); manifests: (shard, and the columns of its rows). A path that several shards have is merged
    once if its checksums are equal and is a fault if not; a shard whose manifest's digest is not the first shard's is a fault.
    """
    by_path = files.groupBy("path").agg(F.count("*").alias("copies"), F.min("checksum").alias("checksum"), F.max("checksum").alias("last"))
    columns = [c for c in manifests.columns if c != "shard"]
    shards = files.select("shard").distinct().join(manifests.groupBy("shard").agg(digest(columns).alias("digest")), "shard", "left")
    # one row a shard
    reference = shards.agg(F.min_by("digest", "shard").alias("reference"))
    other = shards.join(F.broadcast(reference)).where(~F.col("digest").eqNullSafe(F.col("reference"))).select(F.lit("manifest differs").alias("fault"), F.col("shard").cast("string").alias("of"))
    conflict = by_path.where("checksum <> last").select(F.lit("conflicting file").alias("fault"), F.col("path").cast("string").alias("of"))
    return by_path.where("checksum = last").select("path", "checksum", "copies"), other.unionByName(conflict)


def verify(rows: DataFrame, expected: DataFrame, kb: DataFrame, split: str, order: str, columns: list[str], rules: list[tuple[str, Column]], recommended: str) -> DataFrame:
    """(split, rows, fewer_or_more, changed, first_bad, error, outside, first_outside) of each split that is there or expected.

    expected: (split, rows, digest); kb: (project, key in lower case). fewer_or_more: rows that are too many (or, negative,
    missing); changed: whether the digest is not the expected one; first_bad: the first row that breaks a rule, with the rule;
    outside: rows with a recommendation that their project's knowledge base hasn't, and the first of them.
    """
    known = kb.select("project", F.lower("key").alias("key_")).distinct()
    error = F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules])
    found = rows.groupBy(split).agg(
        F.count("*").alias("rows"),
        digest(columns).alias("digest"),
        F.min(F.when(error.isNotNull(), F.struct(F.col(order).alias("at"), error.alias("error")))).alias("bad"),
    )
    # recommendations are looked up without the texts of their rows; rows are counted by number, without a table of distinct ones
    each = rows.select(split, "project", F.col(order).alias("at_"), F.col(recommended).alias("all_"), F.monotonically_increasing_id().alias("row_"))
    each = each.select("*", F.explode("all_").alias("one_")).drop("all_").where("one_ IS NOT NULL").withColumn("key_", F.lower("one_")).join(known, ["project", "key_"], "left_anti")
    out = each.groupBy(split, "row_").agg(F.min("at_").alias("at_")).groupBy(split).agg(F.count("*").alias("outside"), F.min("at_").alias("first_outside"))
    found = found.join(out.withColumnRenamed(split, "split_"), F.col(split).eqNullSafe(F.col("split_")), "left").drop("split_")
    want = expected.select(split, F.col("rows").alias("want_rows"), F.col("digest").alias("want_digest"))
    both = found.join(want, split, "full").na.fill(0, ["rows", "want_rows", "outside"])
    return both.select(split, "rows", (F.col("rows") - F.col("want_rows")).alias("fewer_or_more"), (~F.col("digest").eqNullSafe(F.col("want_digest"))).alias("changed"), F.col("bad.at").alias("first_bad"), F.col("bad.error").alias("error"), "outside", "first_outside")


def prepared(records: DataFrame) -> DataFrame:
    """(id, query, names, label) of records that are processed or raw.

    A record with a query and a list of candidates is taken as it is, but for candidates without a name or text; any other is
    made from its slice (the first field that has one) and its recommendations. Without a slice its query is empty.
    """
    from ..functions import text as X

    ready = (F.coalesce("query", F.lit("")) != "") & F.col("candidates").isNotNull()
    whole = F.filter("candidates", lambda c: (F.coalesce(c["name"], F.lit("")) != "") & (F.coalesce(c["text"], F.lit("")) != ""))
    code = F.trim(X.truthy(F.col("slice"), F.col("code"), F.lit("")))
    made = F.when(code != "", X.query_text(F.col("language"), F.col("scope"), F.col("name"), code)).otherwise("")
    drawn = F.transform("recommendations", lambda r: F.struct(r["name"].alias("name"), X.candidate_text(r["name"], r["definition"]).alias("text")))
    chosen = F.coalesce(F.when(ready, whole).otherwise(drawn), F.array().cast("array<struct<name:string,text:string>>"))
    return records.select("id", F.when(ready, F.col("query")).otherwise(made).alias("query"), chosen.alias("candidates"), F.trim(F.coalesce("label", F.lit(""))).alias("label"))


def truncated(pairs: DataFrame, prompt: str, sequence: str, prompt_limit: int, completion_limit: int) -> DataFrame:
    """pairs with prompt_ids, completion_ids and error, from arrays of token ids of a prompt and of the prompt with its answer.

    The prompt keeps its first ids, the completion those that follow the whole prompt in the sequence. A sequence that does not
    begin with its prompt is an error row, for cutting it would give an answer's ids to the prompt or the other way round.
    """
    size = F.size(prompt)
    kept = F.slice(sequence, F.lit(1), size) == F.col(prompt)
    return pairs.select(
        "*",
        F.when(kept, F.slice(prompt, 1, prompt_limit)).alias("prompt_ids"),
        F.when(kept, F.slice(sequence, size + 1, F.lit(completion_limit))).alias("completion_ids"),
        F.when(~F.coalesce(kept, F.lit(False)), "prompt is no prefix").alias("error"),
    )
