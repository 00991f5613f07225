"""Tables of a run in the folder that all executors share, for operators that go on in rounds; a lost executor loses none of them."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.records import remove


#: Edges that a round follows; more make fewer rounds and more rows that were known.
HOPS = 4


class Rounds:
    """Parts of a growing table, one a round; the folder goes when the driver ends."""

    def __init__(self, spark: SparkSession):
        root = spark.conf.get("spark.checkpoint.dir", None)
        if root is None:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            root = f"file://{tempfile.gettempdir()}/spindrift-scratch"
        self.spark, self.root = spark, f"{root}/rounds-{uuid.uuid4().hex}"
        self.parts: dict[str, list[str]] = {}
        atexit.register(remove, spark, self.root)

    def add(self, name: str, part: DataFrame) -> DataFrame:
        """Write a part of a table and read it again."""
        held = self.parts.setdefault(name, [])
        held.append(f"{self.root}/{name}/{len(held)}")
        part.write.parquet(held[-1])
        return self.spark.read.schema(part.schema).parquet(held[-1])

    def all(self, name: str, like: DataFrame) -> DataFrame:
        return self.spark.read.schema(like.schema).parquet(*self.parts[name])


def least_fixed_point(seeds: DataFrame, edges: DataFrame, at: str, to: str) -> DataFrame:
    """All that seeds reach: where a row stands at `at`, edges (with the other columns of `edges` as keys) put it at `to` as well.

    Semi-naive: a round joins only the rows that the round before found, over HOPS edges, and keeps those that are new; it ends
    when there are none. The columns that both tables have, besides `to`, are what is joined on.
    """
    rounds = Rounds(seeds.sparkSession)
    keys = [c for c in edges.columns if c != to]
    if at not in keys or set(keys) - set(seeds.columns):
        raise ValueError(f"edges must have {at}, {to} and keys of the seeds")
    edges = rounds.add("edges", edges.distinct())
    fresh = rounds.add("found", seeds.distinct())
    while not fresh.isEmpty():
        step, moved = fresh, None
        for _ in range(HOPS):
            step = step.join(edges, keys).drop(at).withColumnRenamed(to, at).select(*seeds.columns).distinct()
            moved = step if moved is None else moved.unionByName(step)
        fresh = rounds.add("found", moved.distinct().join(rounds.all("found", seeds), seeds.columns, "left_anti"))
    return rounds.all("found", seeds)


def closure(edges: DataFrame, one: str, other: str) -> DataFrame:
    """Edges and all paths of them, from `one` to `other`, by pointer doubling: paths of up to 2 ** n edges after n rounds."""
    keys = [c for c in edges.columns if c not in (one, other)]
    rounds = Rounds(edges.sparkSession)
    now = rounds.add("round-0", edges.distinct())
    n = now.count()
    while True:
        ahead = now.select(*keys, now[one].alias("via_"), now[other].alias("end_"))
        longer = now.withColumnRenamed(other, "via_").join(ahead, [*keys, "via_"]).select(*keys, one, F.col("end_").alias(other))
        now = rounds.add(f"round-{len(rounds.parts)}", now.unionByName(longer).distinct())
        was, n = n, now.count()
        if n == was:
            return now
