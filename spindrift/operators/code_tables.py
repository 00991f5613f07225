"""Table functions over source files: one row a file in, rows of findings out; a file that fails gives an error row."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions import code, slices
from ..functions.syntax import tree_of
from .shared import Rounds
from .type_flow import recommended_types

DEFINITION = "name string, qualified_name string, class_name string, start int, end int, source_code string"
CALL = "name string, written string, qualified_name string, scope string, line int, source_code string"
CLASS = "name string, kind string, signature string, bases array<string>"
IMPORT = "module string, name string, alias string, used boolean"


#: Most rows, and about the most characters in them, that are held before they are given out.
MOST_ROWS, MOST_CHARS = 4096, 4 << 20


def _arrow(shape: str) -> pa.Schema:
    """Arrow's types of a table; what is found goes to Spark in them, not by way of pandas, which takes longer than parsing."""
    return to_arrow_schema(StructType.fromDDL(shape))


def _chars(row) -> int:
    return sum(len(x) if isinstance(x, str) else len(x.get("source_code") or "") if isinstance(x, dict) else 0 for x in row)


def _batches(rows: Iterator, schema: pa.Schema, chars: Callable[..., int] = _chars) -> Iterator[pa.RecordBatch]:
    """Rows in batches; `chars` tells about how many characters a row has."""
    held, size = [], 0

    def made() -> pa.RecordBatch:
        columns = zip(*held, strict=True) if held else [()] * len(schema)
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, schema, strict=True)], schema=schema)

    for r in rows:
        held.append(r)
        size += chars(r)
        if len(held) >= MOST_ROWS or size >= MOST_CHARS:
            yield made()
            held, size = [], 0
    yield made()


def each_file(files: DataFrame, find: Callable[..., list[dict]], shape: str, takes: tuple[str, ...] = ("source",), keep: tuple[str, ...] = ("project", "path")) -> DataFrame:
    """keep, the columns of shape and `error`, a row for each finding of find(*takes); a file that can't be parsed has an error."""
    names = [x.split(" ")[0] for x in shape.replace("array<", "array_").split(", ")]

    kinds = ", ".join(f"{k} {files.schema[k].dataType.simpleString()}" for k in keep)
    shape = f"{kinds}, {shape}, error string"
    schema = _arrow(shape)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[list]:
            for b in batches:
                for row in b.to_pylist():
                    head = [row[k] for k in keep]
                    if tree_of(row["source"] or "") is None:
                        yield [*head, *[None] * len(names), "does not parse"]
                    else:
                        yield from ([*head, *(x.get(n) for n in names), None] for x in find(*(row[t] for t in takes)))

        yield from _batches(each(), schema)

    return files.select(*dict.fromkeys((*keep, *takes, "source"))).mapInArrow(run, shape)


#: What a scan tags its rows with, and the shape of each kind.
SCANNED = {"definition": DEFINITION, "call": CALL, "class": CLASS}


FIND = {"definition": code.definitions, "call": code.call_sites, "class": lambda module, source: code.classes(source)}


def scan(files: DataFrame, kinds: tuple[str, ...] = tuple(SCANNED)) -> DataFrame:
    """(project, path, kind, a struct for each of kinds, error): all that is found in files (project, path, module, source), each read and parsed once.

    kind tells which of the structs a row has; a file that can't be parsed has one row with an error.
    """

    structs = ", ".join(f"{kind} struct<{SCANNED[kind].replace(' ', ': ').replace(',:', ',')}>" for kind in kinds)
    head = ", ".join(f"{k} {files.schema[k].dataType.simpleString()}" for k in ("project", "path"))
    shape = f"{head}, kind string, {structs}, error string"
    schema = _arrow(shape)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple]:
            for b in batches:
                for project, path, module, source in zip(*(x.to_pylist() for x in b.columns), strict=True):
                    source = source or ""
                    if tree_of(source) is None:
                        yield (project, path, None, *[None] * len(kinds), "does not parse")
                        continue
                    for kind in kinds:
                        yield from ((project, path, kind, *(x if k == kind else None for k in kinds), None) for x in FIND[kind](module, source))

        yield from _batches(each(), schema)

    return files.select("project", "path", "module", "source").mapInArrow(run, shape)


def project_index(files: DataFrame, kinds: tuple[str, ...] = tuple(SCANNED)) -> tuple[DataFrame, ...]:
    """Findings of each of kinds (definitions, calls and classes) of all files (project, path, module, source); a file that can't be parsed has an error in each.

    Several kinds come from one scan, which is written, so no file is parsed again for each table that is read.
    """
    scanned = scan(files, kinds)
    if len(kinds) > 1:
        scanned = Rounds(files.sparkSession).add("scan", scanned)
    return tuple(scanned.where((F.col("kind") == kind) | F.col("error").isNotNull()).select("project", "path", f"{kind}.*", "error") for kind in kinds)


def definitions(files: DataFrame) -> DataFrame:
    return project_index(files, ("definition",))[0]


def classes(files: DataFrame) -> DataFrame:
    return project_index(files, ("class",))[0]


def with_origin(imports: DataFrame, local: DataFrame) -> DataFrame:
    """imports (module) with `origin`: local if relative or its top package is in the table `local` (top), stdlib, else third_party."""
    top = F.split_part("module", F.lit("."), F.lit(1))
    known = local.select("top").distinct().withColumn("local_", F.lit(True)).hint("merge")  # grows with the projects, so it isn't sent to all tasks
    stdlib = top.isin(*sorted(code.STANDARD))
    origin = F.when(F.col("module").startswith(".") | F.col("local_"), "local").when(stdlib, "stdlib").otherwise("third_party")
    return imports.withColumn("top", top).join(known, "top", "left").withColumn("origin", origin).drop("top", "local_")


def resolved_calls(calls: DataFrame, definitions: DataFrame) -> DataFrame:
    """calls with `target`: by its qualified name, else by its name where one function of the project has it; else empty."""
    d = definitions.where("error IS NULL")
    exact = d.select(F.col("project").alias("p1_"), F.col("qualified_name").alias("q_"), F.lit(True).alias("exact_")).distinct()
    single = d.groupBy(F.col("project").alias("p2_"), F.col("name").alias("n_")).agg(F.count("*").alias("c_"), F.min("qualified_name").alias("only_")).where("c_ = 1").drop("c_")
    c = calls.where("error IS NULL")
    c = c.join(exact.hint("merge"), (F.col("project") == F.col("p1_")) & (F.col("qualified_name") == F.col("q_")), "left")
    c = c.join(single.hint("merge"), (F.col("project") == F.col("p2_")) & (F.col("name") == F.col("n_")), "left")
    return c.withColumn("target", F.coalesce(F.when(F.col("exact_"), F.col("qualified_name")), "only_", F.lit(""))).drop("exact_", "p1_", "q_", "p2_", "n_", "only_")


def project_kb(classes: DataFrame, definitions: DataFrame) -> DataFrame:
    """One record for each (kind, name) of a project whatever its case: classes and aliases, functions and their return types."""
    c = classes.where("error IS NULL").select("project", "kind", "name", F.col("name").alias("qualified_name"), F.col("signature").alias("definition"), "path")
    d = definitions.where("error IS NULL").select("project", F.lit("function").alias("kind"), "name", "qualified_name", F.col("source_code").alias("definition"), "path")
    both = c.unionByName(d)
    best = F.min(F.struct("path", "name", "qualified_name", "definition")).alias("b")
    return both.groupBy("project", "kind", F.lower("qualified_name").alias("key")).agg(best).select("project", "kind", "b.name", "b.qualified_name", "b.definition")


def package_scan(classes: DataFrame, most_files: int, most_records: int) -> DataFrame:
    """Classes of a package's first files (by path), longest text for each name, within the limits, and how many were left out."""
    from pyspark.sql import Window

    file_rank = F.dense_rank().over(Window.partitionBy("project").orderBy("path"))
    c = classes.where("error IS NULL").withColumn("file_", file_rank)
    best = c.where(F.col("file_") <= most_files).groupBy("project", "kind", "name").agg(F.max_by("signature", F.struct(F.length("signature"), -F.col("file_"))).alias("definition"))
    rank = F.row_number().over(Window.partitionBy("project").orderBy("kind", "name"))
    total = F.count("*").over(Window.partitionBy("project"))
    return best.withColumn("k_", rank).withColumn("left_out", F.greatest(F.lit(0), total - most_records)).where(F.col("k_") <= most_records).drop("k_")


EXPORT = "slice string, hints array<string>, target_function string, qualified string, shown array<string>"


def sliced(files: DataFrame, targets: DataFrame) -> DataFrame:
    """(targets' columns, EXPORT, error): the slice of each target (project, path, scope, name, function, line) and the types it shows.

    A target that isn't there, or whose file doesn't parse, has an error. The files of one repository are looked up in one task, in
    the order of the column `place` where files have it, then of their paths; callers stand in that order, whatever the shuffle gives.
    """
    columns = ["path", "scope", "name", "function", "line"]
    order = [c for c in ("place", "path") if c in files.columns]

    # the number of tasks is stated, for slices take long and their texts are small: sizes would put all in a few tasks
    spark = files.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)

    shape = f"project {files.schema['project'].dataType.simpleString()}, path string, scope string, name string, function string, line int, {EXPORT}, error string"
    schema = _arrow(shape)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple]:
            rows = (row for b in batches for row in zip(*(x.to_pylist() for x in b.columns), strict=True))
            for key, group in groupby(rows, itemgetter(0)):
                held = list(group)
                wanted = [t for _, f, t in held if t is not None]
                if not wanted:
                    continue
                project = slices.Project((f["path"], f["module"], f["source"]) for _, f, _ in held if f is not None)
                for target in wanted:
                    t = [target[c] for c in columns]
                    made = project.slice(t[0], t[1], t[2], t[3] or "", t[4])
                    if made is None:
                        yield (key, *t, None, None, None, None, None, "no target")
                    else:
                        yield (key, *t, made["slice"], made["hints"], made["target_function"], made["qualified"], slices.shown_types(made["slice"]), None)

        yield from _batches(each(), schema)

    # a project's files in their order, then its targets, as one stream
    held = files.select("project", F.struct(*order, *[c for c in ("path", "module", "source") if c not in order]).alias("file"))
    rows = held.unionByName(targets.select("project", F.struct(*columns).alias("target")), allowMissingColumns=True)
    rows = rows.repartition(tasks, "project").sortWithinPartitions("project", F.col("file").isNull(), *[f"file.{c}" for c in order])
    return rows.select("project", "file", "target").mapInArrow(run, shape)


def exported(files: DataFrame, targets: DataFrame, limit: int = 10) -> DataFrame:
    """(targets' columns, slice, hints, target_function, qualified, types, error): slices with up to `limit` types, those that flow
    to the target first, then those that its slice shows."""
    made = sliced(files, targets)
    key = ["project", "path", "name", "function"]
    flows = recommended_types(files, targets.where("scope <> 'return'"), limit).groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("place", "type"))).alias("known"))
    made = made.withColumn("function_", F.col("function")).withColumn("function", F.coalesce("function", F.lit(""))).join(flows, key, "left")
    known = F.when(F.col("scope") != "return", F.transform("known", lambda x: x["type"]))
    types = F.slice(F.array_distinct(F.concat(F.coalesce(known, F.array().cast("array<string>")), "shown")), 1, limit)
    return made.select("project", "path", "scope", "name", F.col("function_").alias("function"), "line", "slice", "hints", "target_function", "qualified", F.when(F.col("error").isNull(), types).alias("types"), "error")
