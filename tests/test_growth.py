"""Joins whose rows would grow with the product of two tables, and tables too large for the driver."""

import pytest

import __spark_entry__ as entry
from spindrift.functions.ts_syntax import File
from spindrift.operators import joins as J

SF = "/root/testdata/sf0.001"


def plan(spark, name):
    return entry.queries()[name](spark, SF)._jdf.queryExecution()


def test_pairs_are_different_ones(spark):
    left = spark.createDataFrame([("p", "a", 1), ("p", "a", 2), ("q", "a", 3)], "k string, x string, id int")
    right = spark.createDataFrame([("p", "b"), ("p", "b"), ("p", "c"), ("r", "b")], "k string, y string")
    assert sorted(map(tuple, J.different_pairs(left, right, "k", "x", "y").collect())) == [("p", "a", "b"), ("p", "a", "c")]


@pytest.mark.parametrize("name", ["J10_similar_class_of_file", "J15_module_inventory"])
def test_ratios_are_worked_out_for_different_pairs(spark, name):
    """Below the ratio there are names and packages only, no files and no keys."""
    lines = plan(spark, name).optimizedPlan().toString().split("\n")
    at = next(i for i, x in enumerate(lines) if "EvalPython" in x)
    below = [x for x in lines[at + 1 :] if len(x) - len(x.lstrip(" :+-")) > len(lines[at]) - len(lines[at].lstrip(" :+-"))]
    assert sum("Aggregate [package" in x for x in below) == 2 and not any("file#" in x.split("Project")[0] for x in below)


def test_spans_and_records_are_counted_before_they_are_joined(spark):
    spans = plan(spark, "J24_nodes_spanning_line").optimizedPlan().toString()
    assert "count(1)" not in spans[: spans.index("Join")]
    records = plan(spark, "J38_alias_to_package").optimizedPlan().toString()
    assert "count(1)" not in records[: records.index("Join")]


@pytest.mark.parametrize("name", ["C11_installed_roots", "C11_stub_roots"])
def test_paths_are_not_sent_to_the_driver(spark, name):
    assert "Broadcast" not in plan(spark, name).executedPlan().toString()


def test_verification_looks_recommendations_up_without_texts(spark):
    lines = plan(spark, "O05_verify_dataset").optimizedPlan().toString().split("\n")
    at = next(i for i, x in enumerate(lines) if "Join LeftAnti" in x)
    assert not any("text#" in x for x in lines[at:] if "Explode" in x or "explode" in x or "Generate" in x) and "Expand" not in "".join(lines)


@pytest.mark.parametrize("name", ["C26_exported_annotations", "C29_typescript_slices", "C33_assembled_lines"])
def test_what_is_found_in_files_goes_to_spark_as_arrow(spark, monkeypatch, name):
    def slow(*_):
        raise AssertionError("rows by way of pandas, or a group of them for each project")

    frame = type(spark.range(1))
    monkeypatch.setattr(frame, "mapInPandas", slow)
    monkeypatch.setattr(type(spark.range(1).groupBy("id").cogroup(spark.range(1).groupBy("id"))), "applyInPandas", slow)
    assert "InPandas" not in plan(spark, name).optimizedPlan().toString()


def test_names_of_a_stretch_are_looked_for_there_alone():
    class Counted(list):
        looks = 0

        def __iter__(self):
            Counted.looks += len(self)
            return super().__iter__()

        def __getitem__(self, i):
            Counted.looks += 1
            return super().__getitem__(i)

    source = "".join(f"const a{i} = f(b{i});\n" for i in range(500))
    file = File(source)
    at = source.index("b7)")
    file.kinds = Counted(file.kinds)
    assert file.names(at - 2, at + 2) == ["f", "b7"]
    assert Counted.looks < 20
