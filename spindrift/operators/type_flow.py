"""Types that flow through the code of projects of any size: facts of files as one table, rules and joins over it."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions import type_flow as facts
from ..functions.syntax import LOWER_TYPES
from .shared import Rounds, closure, least_fixed_point

#: Methods that make an object of the class they are called on (fixed values).
FACTORY_METHODS = {"build", "construct", "create", "factory", "from_dict", "from_json", "from_orm", "load", "make", "model_validate", "new", "parse_obj"}
#: Classes of objects that stand in for others (fixed values).
STAND_INS = ["MagicMock", "Mock"]
FACTORY, MANAGER, QUERY = "Factory", "objects", "query"
MOST_RECOMMENDATIONS = 120
#: Facts that are given out at once, about.
ROWS = 4096
FACT = "kind string, a string, b string, c string"


def type_facts(files: DataFrame) -> DataFrame:
    """(project, FACT) of all files (project, path, module, source), each parsed once; files that don't parse give none.

    They are written, for rules and rounds read them again and again.
    """

    shape = f"project {files.schema['project'].dataType.simpleString()}, {FACT}"
    schema = to_arrow_schema(StructType.fromDDL(shape))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True) if rows else [()] * len(schema), schema, strict=True)], schema=schema)

        rows: list[tuple] = []
        for b in batches:
            for p, path, module, source in zip(*(x.to_pylist() for x in b.columns), strict=True):
                rows += [(p, *x) for x in facts.facts(path, module, source or "")]
                if len(rows) >= ROWS:
                    yield made(rows)
                    rows = []
        yield made(rows)

    found = files.select("project", "path", "module", "source").mapInArrow(run, shape)
    return Rounds(files.sparkSession).add("facts", found)


def is_type(name: Column) -> Column:
    return name.rlike(r"(?U)^\p{Lu}\w*$") | name.isin(*sorted(LOWER_TYPES))


def shown_types(chain: Column, stands_for: Column) -> Column:
    """Array of the types that a chain of links shows: one rule for each way, over the links and what they were given."""
    links = F.split(chain, facts.LINK)
    last, owner = F.element_at(links, -1), F.try_element_at(links, F.lit(-2))
    inner = F.slice(links, 1, F.size(links) - 1)
    none = F.array().cast("array<string>")
    bare = F.regexp_replace(owner, f"(?<=.){FACTORY}$", "")
    before = F.transform(inner, lambda link, i: F.when((link == MANAGER) & (i > 0), F.get(inner, i - 1)))
    asked = F.transform(inner, lambda link: F.when(link.startswith(f"{QUERY}{facts.GIVEN}"), F.substring_index(link, facts.GIVEN, -1)))
    rules = [
        F.array(last),  # what is called, as a class
        F.when(last.isin(*sorted(FACTORY_METHODS)) & is_type(owner), F.array(bare)).otherwise(none),
        before,  # the class whose manager it is
        asked,  # the class that is asked for
        F.when(last.isin(*STAND_INS), F.split(stands_for, facts.LINK)).otherwise(none),
    ]
    return F.filter(F.array_distinct(F.concat(*rules)), lambda t: F.coalesce(is_type(t), F.lit(False)))


def _place(*parts) -> Column:
    return F.concat_ws(" ", *parts)


def flow_edges(all_facts: DataFrame) -> DataFrame:
    """(project, place, to): where what a place holds goes."""
    f = {k: all_facts.where(F.col("kind") == k) for k in ("flow", "chain", "argument", "parameter", "fixture")}
    plain = f["flow"].select("project", F.col("a").alias("place"), F.col("b").alias("to"))
    callee = F.element_at(F.split("a", facts.LINK), -1)
    calls = f["chain"].select("project", _place(F.lit("return"), callee).alias("place"), F.col("b").alias("to"))
    by_place = f["parameter"].select("project", F.col("a").alias("function"), F.col("b").alias("where"), F.col("c").alias("name")).distinct()
    by_name = by_place.where("where <> ''").select("project", "function", F.col("name").alias("where"), "name").distinct()
    given = f["argument"].select("project", F.col("a").alias("function"), F.col("b").alias("where"), F.col("c").alias("place"))
    into = _place(F.lit("parameter"), "function", "name").alias("to")
    arguments = given.join(by_place.where("where <> ''").unionByName(by_name), ["project", "function", "where"]).select("project", "place", into)
    fixtures = by_place.join(f["fixture"].select("project", F.col("a").alias("name")).distinct(), ["project", "name"]).select("project", _place(F.lit("return"), "name").alias("place"), into)
    return plain.unionByName(calls).unionByName(arguments).unionByName(fixtures)


def held_types(all_facts: DataFrame) -> DataFrame:
    """(project, place, type): the least fixed point of the facts."""
    said = all_facts.where("kind = 'type'").select("project", F.col("b").alias("place"), F.col("a").alias("type"))
    shown = all_facts.where("kind = 'chain'").select("project", F.col("b").alias("place"), F.explode(shown_types(F.col("a"), F.col("c"))).alias("type"))
    return least_fixed_point(said.unionByName(shown), flow_edges(all_facts), "place", "to")


def type_flow_of(files: DataFrame) -> DataFrame:
    """(project, kind, function, name, type) of what functions return, of parameters and of variables; local places are left out."""
    parts = F.split("place", " ")
    kind, function, name = parts[0], F.get(parts, 1), F.element_at(parts, -1)
    named = (F.size(parts) == F.when(kind == "parameter", 3).otherwise(2)) & kind.isin("return", "parameter", "variable") & (function != "")
    rows = held_types(type_facts(files)).where(named)
    return rows.select("project", kind.alias("kind"), F.when(kind == "variable", "").otherwise(function).alias("function"), F.when(kind == "return", "").otherwise(name).alias("name"), "type")


def imported_names(all_facts: DataFrame) -> DataFrame:
    """(project, path, name) of what files import, with all that star imports pass on, through any number of modules."""
    own = all_facts.where("kind = 'import'").select("project", F.col("b").alias("path"), F.col("a").alias("name"))
    stars = all_facts.where("kind = 'star'").select("project", F.col("a").alias("target"), F.col("b").alias("path"), F.col("c").alias("module"))
    public = all_facts.where("kind = 'symbol'").where("a NOT LIKE '\\\\_%'").select("project", F.col("b").alias("of"), F.col("a").alias("name")).distinct()
    reached = closure(stars.select("project", F.col("module").alias("from"), F.col("target").alias("of")), "from", "of")
    sources = stars.select("project", "path", F.col("target").alias("of")).unionByName(stars.join(reached, [stars["project"] == reached["project"], F.col("target") == F.col("from")]).select(stars["project"], "path", "of"))
    return own.unionByName(sources.distinct().join(public, ["project", "of"]).select("project", "path", "name")).distinct()


def recommended_types(files: DataFrame, targets: DataFrame, limit: int = MOST_RECOMMENDATIONS) -> DataFrame:
    """(project, path, name, function, place, type, kind, module): at most `limit` ranked types of each target (project, path, name, function).

    Types of the parameter come first, then those of variables of that name, then what the file imports; each by name, and once.
    """
    all_facts = type_facts(files)
    types, key = held_types(all_facts), ["project", "path", "name", "function"]
    wanted = targets.select("project", "path", "name", F.coalesce("function", F.lit("")).alias("function")).distinct()
    imports = imported_names(all_facts).withColumnRenamed("name", "type")

    def at(place: Column, among: DataFrame, group: int) -> DataFrame:
        return among.withColumn("place", place).join(types, ["project", "place"]).select(*key, F.lit(group).alias("group"), "type")

    found = at(_place(F.lit("parameter"), "function", "name"), wanted.where("function <> ''"), 0)
    found = found.unionByName(at(_place(F.lit("variable"), "name"), wanted, 1)).unionByName(wanted.join(imports, ["project", "path"]).select(*key, F.lit(2).alias("group"), "type"))
    first = found.groupBy(*key, "type").agg(F.min("group").alias("group"))
    definitions = all_facts.where("kind = 'definition'").select("project", F.col("a").alias("type"), F.col("b").alias("kind"), F.col("c").alias("module")).distinct()
    known = first.join(definitions, ["project", "type"], "left").where(F.col("kind").isNotNull() | is_type(F.col("type")))
    known = known.withColumn("kind", F.coalesce("kind", F.lit("inferred"))).withColumn("module", F.coalesce("module", F.lit("")))
    place = F.row_number().over(Window.partitionBy(*key).orderBy("group", "type", "kind", "module")) - 1
    return known.select(*key, place.alias("place"), "type", "kind", "module").where(F.col("place") < limit)
