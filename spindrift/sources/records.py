"""Readers and sinks of record files. Schemas are stated, never inferred; a field that a file lacks is null."""

from __future__ import annotations

import contextlib
import uuid
import weakref
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders that a walk of sources leaves out (fixed values).
SKIPPED = [".git", ".hg", ".svn", ".tox", ".venv", "__pycache__", "build", "dist", "env", "node_modules", "site-packages", "venv"]

ANNOTATION = "file string, loc string, name string, scope string, cat string, origttype string, gttype string, processed_gttype string, generic boolean, type_depth int, url string, split string"
KB_RECORD = "name string, qualified_name string, package string, module string, kind string, source string, definition string"


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines of a file, or of all .jsonl files below a folder; blank lines give no row. Adds `position`: file, then place."""
    at = "_metadata.file_path"
    df = spark.read.schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json*").json(path)
    return df.withColumn("file_", F.col(at)).withColumn("position", F.struct("file_", F.monotonically_increasing_id().alias("n"))).drop("file_")


def read_json_list(spark: SparkSession, path: str, schema: str, wrapper: str | None = None) -> DataFrame:
    """A file that holds one list of objects, or an object that holds it under `wrapper`. Another form fails."""
    reader = spark.read.option("multiLine", True).option("mode", "FAILFAST")
    if wrapper:
        return reader.schema(f"{wrapper} array<struct<{', '.join(': '.join(x.split(' ', 1)) for x in schema.split(', '))}>>").json(path).select(F.explode(wrapper).alias("x")).select("x.*")
    return reader.schema(schema).json(path)


def read_kb(spark: SparkSession, path: str, packages: list[str] | DataFrame | None = None, strict: bool = False) -> DataFrame:
    """Knowledge-base records partitioned by package; only the packages asked for are read. Bad files are left out, or fail if strict."""
    kb = spark.read.schema(KB_RECORD).option("mode", "FAILFAST" if strict else "DROPMALFORMED").option("basePath", path).json(path)
    if packages is None:
        return kb
    if isinstance(packages, DataFrame):
        return kb.join(packages.select("package").distinct(), "package", "left_semi")
    return kb.where(F.col("package").isin(list(packages)))


def walk(spark: SparkSession, path: str, suffixes: tuple[str, ...] = (".py",), skip: list[str] | None = None, hidden: bool = False) -> DataFrame:
    """(path, content) of source files below a folder, without skipped and hidden folders."""
    skip = SKIPPED if skip is None else skip
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content", "length")
    relative = F.substring_index("path", path.rstrip("/").split("/")[-1] + "/", -1)
    return files.where(wanted(relative, suffixes, skip, hidden))


def wanted(path: Column, suffixes: tuple[str, ...], skip: list[str], hidden: bool = False) -> Column:
    parts = F.split(path, "/")
    folders = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))
    keep = F.lit(False)
    for x in suffixes:
        keep = keep | path.endswith(x)
    if skip:
        keep = keep & ~F.arrays_overlap(folders, F.array(*map(F.lit, skip)))
    return keep if hidden else keep & ~F.exists(parts, lambda x: x.startswith("."))


def write_jsonl(df: DataFrame, path: str, partition_by: tuple[str, ...] = (), mode: str = "error") -> None:
    """JSON lines, a folder for each value of partition_by. `overwrite` with partitions replaces only those that df has."""
    w = df.write.mode(mode).option("ignoreNullFields", False)
    (w.option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by) if partition_by else w).json(path)


def append_rows(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_metrics(df: DataFrame, path: str) -> None:
    """One CSV file with a header; for the few rows of a metric table."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def publish(df: DataFrame, path: str) -> None:
    """Readers see the old table or the whole new one: it is written beside the old one and then takes its name."""
    spark = df.sparkSession
    fresh = f"{path.rstrip('/')}.{uuid.uuid4().hex}"
    df.write.parquet(fresh)
    P = spark._jvm.org.apache.hadoop.fs.Path
    fs = P(path).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    old = P(f"{fresh}.old")
    had = fs.exists(P(path)) and fs.rename(P(path), old)
    if not fs.rename(P(fresh), P(path)):
        raise OSError(f"could not publish {path}")
    if had:
        fs.delete(old, True)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder if it is there; at exit the session may be gone."""
    with contextlib.suppress(Exception):
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


def in_memory(df: DataFrame, use: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """use(df) with df kept in memory, and on disk where it doesn't fit, as long as the result is referred to."""
    held = df.persist()
    made = use(held)
    weakref.finalize(made, _release, held)
    return made


def _release(df: DataFrame) -> None:
    with contextlib.suppress(Exception):  # the session may be gone
        df.unpersist()


def count_lines(spark: SparkSession, path: str) -> int:
    return spark.read.text(path).where(F.trim("value") != "").count()


def sha256_of_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"), "length")


def preview(df: DataFrame, n: int, most: int = 1600) -> DataFrame:
    """The first n rows as JSON texts of limited length."""
    return df.limit(n).select(F.to_json(F.struct(*df.columns)).alias("json")).select(F.when((F.lit(most) > 0) & (F.length("json") > most), F.concat(F.substring("json", 1, most), F.lit("..."))).otherwise(F.col("json")).alias("json"))


def with_index(df: DataFrame, order: str) -> DataFrame:
    """A gapless index by order: counts of ranges first, so no task gets all rows."""
    from pyspark.sql import Window

    spread = df.repartitionByRange(F.col(order)).withColumn("part_", F.spark_partition_id())
    counts = spread.groupBy("part_").agg(F.count("*").alias("n_"))
    ahead = counts.select("part_", F.coalesce(F.sum("n_").over(Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead_"))
    local = F.row_number().over(Window.partitionBy("part_").orderBy(order)) - 1
    return spread.withColumn("local_", local).join(F.broadcast(ahead), "part_").withColumn("index", F.col("ahead_") + F.col("local_")).drop("part_", "local_", "ahead_")
