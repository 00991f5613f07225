"""Digests, gates, merges and checks of datasets: each planted fault is found, and nothing else."""

import pytest
from pyspark.sql import functions as F

from spindrift.operators import verification as VER

ROWS = [(1, "train", "a", "x", ["K"]), (2, "train", "b", "y", ["K", "L"]), (3, "test", "a", None, []), (4, "test", "a", "z", None), (5, "dev", "c", "w", ["M", "K"])]
SHAPE = "id long, split string, project string, text string, names array<string>"
KB = [("a", "k"), ("b", "K"), ("b", "l"), ("c", "m"), ("c", "m")]


@pytest.fixture
def table(spark):
    def made(rows):
        return spark.createDataFrame(rows, SHAPE)

    return made


def checked(spark, table, rows, rules=()):
    want = VER.manifest(table(ROWS), "split", "project", ["id", "text"])
    kb = spark.createDataFrame(KB, "project string, key string")
    return {r.split: r for r in VER.verify(table(rows), want, kb, "split", "id", ["id", "text"], [("text", F.col("text").isNotNull()), *rules], "names").collect()}


def test_digests_know_rows_but_no_order(table):
    def of(rows, parts=1):
        return [tuple(r) for r in VER.manifest(table(rows).repartition(parts), "split", "project", ["id", "text"]).orderBy("split").collect()]

    assert of(ROWS) == of(ROWS[::-1], 3)
    assert of(ROWS) != of([*ROWS, ROWS[0]]) and of([*ROWS, ROWS[0]]) != of([*ROWS, ROWS[0], ROWS[0]])
    assert of([(1, "s", "p", None, [])]) != of([(1, "s", "p", "", [])])


def test_each_fault_is_found(spark, table):
    good = checked(spark, table, ROWS)
    assert all(r.fewer_or_more == 0 and not r.changed for r in good.values()) and good["dev"].outside == 1 == len([r for r in good.values() if r.outside]) and good["dev"].first_outside == 5
    assert (good["test"].first_bad, good["test"].error, good["train"].error) == (3, "text", None)
    doubled, missing, changed = checked(spark, table, [*ROWS, ROWS[1]]), checked(spark, table, ROWS[1:]), checked(spark, table, [(1, "train", "a", "X", ["K"]), *ROWS[1:]])
    assert (doubled["train"].rows, doubled["train"].fewer_or_more, doubled["train"].changed, doubled["dev"].changed) == (3, 1, True, False)
    assert (missing["train"].fewer_or_more, missing["train"].changed) == (-1, True) and (changed["train"].fewer_or_more, changed["train"].changed) == (0, True)
    swapped = checked(spark, table, [*ROWS[1:2] * 2, *ROWS[2:]])
    assert (swapped["train"].fewer_or_more, swapped["train"].changed) == (0, True)
    gone = checked(spark, table, ROWS[:4])
    assert (gone["dev"].rows, gone["dev"].fewer_or_more, gone["dev"].changed) == (0, -1, True)
    more = checked(spark, table, [*ROWS, (9, "new", "a", "x", ["q", "Q", "q", "k", "k"])])
    assert (more["new"].rows, more["new"].fewer_or_more, more["new"].changed, more["new"].outside, more["new"].first_outside) == (1, 1, True, 1, 9)


def test_the_gate_refuses(spark, table):
    plan, tried = table(ROWS), spark.createDataFrame([("a", None), ("b", "timeout")], "project string, error string")
    with pytest.raises(ValueError, match="1 projects were not attempted"):
        VER.finalize(plan, plan, tried, "split", "project", ["id"])
    with pytest.raises(ValueError, match="1 failed"):
        VER.finalize(plan, plan, tried, "split", "project", ["id"], allow_partial=True, strict=True)
    got = {r.split: r for r in VER.finalize(plan.where("project = 'a'"), plan, tried, "split", "project", ["id"], allow_partial=True).collect()}
    assert {k: (r.rows, r.projects, r.missing, r.failures) for k, r in got.items()} == {"train": (1, 1, 0, 1), "test": (2, 1, 0, 0), "dev": (0, 0, 1, 0)}


def test_shards_merge_if_they_agree(spark):
    files = spark.createDataFrame([(0, "a", 1), (1, "a", 1), (1, "b", 2), (2, "b", 3), (2, "c", 4)], "shard long, path string, checksum long")
    plan = [(s, split, p) for s in (0, 1, 2) for split, p in (("train", "x"), ("test", "y"))]
    merged, faults = VER.merge_shards(files, spark.createDataFrame(plan[::-1], "shard long, split string, project string"))
    assert {tuple(r) for r in merged.collect()} == {("a", 1, 2), ("c", 4, 1)} and [tuple(r) for r in faults.collect()] == [("conflicting file", "b")]
    _, faults = VER.merge_shards(files, spark.createDataFrame(plan[:-1], "shard long, split string, project string"))
    assert {tuple(r) for r in faults.collect()} == {("conflicting file", "b"), ("manifest differs", "2")}
    _, faults = VER.merge_shards(files, spark.createDataFrame(plan[:4], "shard long, split string, project string"))
    assert ("manifest differs", "2") in {tuple(r) for r in faults.collect()}


def test_prompts_are_prefixes(spark):
    rows = [(1, [1, 2, 3], [1, 2, 3, 4, 5, 6]), (2, [1, 2], [1, 3, 4]), (3, [1, 2], [1]), (4, [], [7]), (5, None, [1])]
    got = {r.id: r for r in VER.truncated(spark.createDataFrame(rows, "id int, p array<int>, s array<int>"), "p", "s", 2, 2).collect()}
    assert (got[1].prompt_ids, got[1].completion_ids, got[1].error) == ([1, 2], [4, 5], None) and (got[4].prompt_ids, got[4].completion_ids) == ([], [7])
    assert all(got[i].prompt_ids is None and got[i].completion_ids is None and got[i].error for i in (2, 3, 5))
