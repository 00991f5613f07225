"""Where packages lie, from a table of the files that are there: installed packages, stubs and a project's own modules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def folders(files: DataFrame, path: str = "path") -> DataFrame:
    """(path) of every folder above a file, each once."""
    parts = F.split(path, "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    return files.select(F.explode(above).alias("path")).where("path <> ''").distinct()


def _first(candidates: DataFrame, keys: list[str]) -> DataFrame:
    return candidates.withColumn("k_", F.row_number().over(Window.partitionBy(*keys).orderBy("rank"))).where("k_ = 1").drop("k_", "rank")


def _candidates(names: DataFrame, name: str, made: list[tuple[Column, Column]]) -> DataFrame:
    """names with a row for each (path that must be there, root that it stands for), by rank."""
    each = F.array(*[F.struct(F.lit(i).alias("rank"), there.alias("there"), root.alias("root")) for i, (there, root) in enumerate(made)])
    return names.select(name, F.explode(each).alias("c")).select(name, "c.*")


def installed_roots(names: DataFrame, name: str, files: DataFrame, search: list[str]) -> DataFrame:
    """(name, root): the package's folder, else the module's file, in the first place of the search path that has one. Folders without an `__init__` are none."""
    n, made = F.col(name), []
    for place in search:
        folder = F.concat(F.lit(f"{place}/"), n)
        made += [(F.concat(folder, F.lit("/__init__.py")), folder), *((F.concat(folder, F.lit(end)), F.concat(folder, F.lit(end))) for end in (".py", ".pyi"))]
    found = _candidates(names, name, made).join(files.select(F.col("path").alias("there")).distinct().hint("merge"), "there")  # paths grow with the names, so they aren't sent to all tasks
    return _first(found, [name]).select(name, "root")


def stub_roots(names: DataFrame, name: str, files: DataFrame, bases: list[str]) -> DataFrame:
    """(name, root, place): all stubs of a name, of the standard library first, then in the base itself, then of distributions by name."""
    n, made = F.col(name), []
    for base in bases:
        made += [(p, p) for inner in ("stdlib/", "") for end in (".pyi", "") for p in [F.concat(F.lit(f"{base}/{inner}"), n, F.lit(end))]]
    there = files.select("path").union(folders(files)).distinct()
    direct = _candidates(names, name, made).join(there.withColumnRenamed("path", "there").hint("merge"), "there").select(name, "root", F.struct("rank", F.lit("").alias("of")).alias("order"))
    out = direct
    for i, base in enumerate(bases):
        # <base>/stubs/<distribution>/<name>[.pyi], found by the last part of the path
        inside = there.where(F.col("path").rlike(f"^{base}/stubs/[^/]+/[^/]+$")).select("path", F.regexp_replace(F.substring_index("path", "/", -1), r"\.pyi$", "").alias(name))
        more = names.join(inside.hint("merge"), name).select(name, F.col("path").alias("root"), F.struct(F.lit(4 * i + 3).alias("rank"), F.col("path").alias("of")).alias("order"))
        out = out.unionByName(more)
    return out.dropDuplicates([name, "root"]).withColumn("place", F.row_number().over(Window.partitionBy(name).orderBy("order", "root"))).drop("order")


def local_modules(files: DataFrame, project: str = "project") -> DataFrame:
    """(project, name) of a project's own modules and packages, at its top or in `src`. files: path within the project."""
    inner = F.regexp_replace("path", "^src/", "")
    package = F.regexp_extract(inner, r"^([^/]+)/__init__\.py$", 1)
    module = F.regexp_extract(inner, r"^([^/]+)\.py$", 1)
    return files.select(project, F.when(package != "", package).otherwise(module).alias("name")).where("name <> ''").distinct()
