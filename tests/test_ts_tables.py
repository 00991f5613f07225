"""The TypeScript reader, and scopes, names and slices as tables, held against hand-worked values."""

import pytest

from pyspark.sql import functions as F

from spindrift.functions.ts_syntax import File
from spindrift.operators import ts_tables as T

SOURCE = """import { Account } from './account';
/* class Gone { } */
export abstract class Box<T> extends Thing implements Shape {
  private side: number = 1;
  items: Map<string, T[]> = new Map();
  @dec() static count = 0
  constructor(private readonly acc: Account, size = 3) { super(); this.size = size; }
  get area() { return this.side }
  async grow(scale: number, {a, b}: Opts = {}): Promise<number> {
    const raw = helper(this.side, scale);
    let total: number = raw * 2, rest = other.call(x => x + 1);
    for (const item of this.items.values()) {
      total += item.length
    }
    return total
  }
}
type Id = string | { a: number };
export const arrow = (y: string) => helper(y.length);
function helper(x: number, y?): number {
  let name = `a ${x} b`
  const cb = async (e, f: string): Promise<void> => { console.log(e, f); };
  list.filter((i) => i.ok).map(function (q) { return q.z; });
  name = cb
  return new Box<number>(acc, 2).grow(y);
}
"""
SHADOWED = "const v = 1;\nfunction f(v) {\n  if (v) {\n    let v = g(v);\n    use(v);\n  }\n  return v;\n}\nfunction g(w) { return v + w; }\nclass v2 { v = 2; m() { return this.v + v; } }\n"


def nodes(file, kind):
    return [n.name for n in file.root.walk() if n.kind == kind]


def test_reader_finds_declarations_and_calls():
    f = File(SOURCE)
    assert nodes(f, "class") == ["Box"] and nodes(f, "alias") == ["Id"] and nodes(f, "method") == ["constructor", "area", "grow"]
    assert nodes(f, "function") == ["helper", ""] and nodes(f, "property") == ["side", "items", "count"]
    assert nodes(f, "variable") == ["raw", "total", "rest", "item", "arrow", "name", "cb"]
    assert nodes(f, "parameter") == ["acc", "size", "scale", "a", "b", "x", "y", "x", "y", "e", "f", "i", "q"]
    assert [n.name for n in f.root.walk() if n.kind == "call"] == ["Map", "helper", "other.call", "this.items.values", "helper", "console.log", "list.filter", "list.filter((i) => i.ok).map", "Box", "Box<number>(acc, 2).grow"]
    types = {n.name: n.more["type"] for n in f.root.walk() if n.kind in ("variable", "property", "method", "parameter") and n.more["type"]}
    assert types == {"side": "number", "items": "Map<string, T[]>", "acc": "Account", "scale": "number", "a": "Opts", "b": "Opts", "grow": "Promise<number>", "total": "number", "y": "string", "x": "number", "f": "string"}


@pytest.mark.parametrize("text", ["class {", "}{)(", "const = ; function ( { => ", "`${", "a ? b : c; x<y>(z); enum", "import", "type", "for (const", "class A { [k: string]: x; get a() { return 1 } #p = 2 }", "", "(" * 200, "'", "/* x", "@", "export default", "a = b => c => d", "if (", "new", "=>", "x: y"])
def test_odd_texts_give_rows_and_no_error(text):
    f = File(text)
    assert f.root.kind == "file" and all(0 <= n.start <= n.end <= len(text) or n.kind for n in f.root.walk())
    assert all(r["text"] is not None for r in T.nodes_of(text)) and isinstance(T.uses_of(text), list)


def test_masks_take_the_place_of_types():
    masked = {(r["kind"], r["name"]): r["masked"] for r in T.nodes_of(SOURCE)}
    assert masked["variable", "total"].startswith("let total: <mask> = raw * 2") and "const raw: <mask> = helper(this.side, scale)" == masked["variable", "raw"]
    assert "helper(x: <mask>, y?): number {" in masked["parameter", "x"] or "(x: <mask>" in masked["parameter", "x"]
    assert "Opts = {}): <mask> {" in masked["method", "grow"] and "y?): <mask> {" in masked["function", "helper"] and "get area(): <mask> {" in masked["method", "area"]


@pytest.fixture(scope="module")
def tables(spark):
    files = spark.createDataFrame([("p", "a.ts", SHADOWED), ("p", "b.ts", "const v = 9;\n"), ("q", "a.ts", "let v = f();\n")], "project string, path string, source string")
    return T.nodes(files), T.uses(files)


def test_names_mean_the_deepest_scope(tables):
    declared, used = tables
    at = {SHADOWED.index(x): x for x in ("v) {\n    let", "v);\n    use", "v);\n  }", "v;\n}", "v + w", "v; } }")}
    kinds = {r["start"]: r["kind"] for r in declared.where("project = 'p' AND path = 'a.ts' AND name = 'v'").collect()}
    got = {r["at"]: kinds[r["of"]] for r in T.resolved(used, declared).where("project = 'p' AND path = 'a.ts' AND name = 'v'").collect()}
    assert {x: got[i] for i, x in at.items()} == {"v) {\n    let": "parameter", "v);\n    use": "variable", "v);\n  }": "variable", "v;\n}": "parameter", "v + w": "variable", "v; } }": "variable"}


def test_occurrences_and_outward(tables, spark):
    declared, _ = tables
    targets = spark.createDataFrame([("p", "a.ts", "var", "v", i) for i in range(3)] + [("p", "b.ts", "var", "v", 0), ("q", "a.ts", "arg", "v", 0)], "project string, path string, scope string, name string, occurrence int")
    assert {(r.path, r.scope, r.occurrence): r.line for r in T.occurrences(declared, targets).collect()} == {("a.ts", "var", 0): 1, ("a.ts", "var", 1): 4, ("a.ts", "var", 2): None, ("b.ts", "var", 0): 1, ("a.ts", "arg", 0): None}
    wanted = spark.createDataFrame([("p", "a.ts", "f", "v"), ("p", "a.ts", "g", "v"), ("p", "a.ts", "g", "f"), ("p", "a.ts", "f", "w"), ("p", "a.ts", "none", "v")], "project string, path string, function string, name string")
    got = {(r.function, r.name): r.declaration for r in T.outward(declared, wanted).collect()}
    assert got["f", "v"] == "v" and got["g", "v"] == "const v = 1" and got["g", "f"].startswith("function f(v) {") and got["f", "w"] is None and got["none", "v"] is None


def test_no_project_meets_in_a_task(tables, spark):
    declared, used = tables
    targets = spark.createDataFrame([("p", "a.ts", "var", "v", 0)], "project string, path string, scope string, name string, occurrence int")
    plan = T.slices(declared, used, targets)._jdf.queryExecution().toString()
    assert "GroupsIn" not in plan and "CoGroup" not in plan and "Cartesian" not in plan
    assert T.slices(declared.limit(0), used.limit(0), targets).first().slice is None


def test_files_are_read_once_and_no_table_is_sent_to_all_tasks(spark):
    source = "function f(a: string) {\n  const b = a;\n  return b;\n}\n"
    files = spark.createDataFrame([("p", "a.ts", source), ("p", "b.ts", None)], "project string, path string, source string")
    declared, used = T.nodes_and_uses(files)
    assert sorted(map(repr, declared.collect())) == sorted(map(repr, T.nodes(files).collect()))
    assert sorted(map(repr, used.collect())) == sorted(map(repr, T.uses(files).collect()))
    targets = spark.createDataFrame([("p", "a.ts", "arg", "a", 0)], "project string, path string, scope string, name string, occurrence int")
    made = T.slices(declared, used, targets)
    assert made.first().slice.endswith("return b;\n}\nconst b = a")
    functions = targets.withColumn("function", F.lit("f"))
    for found in (made, T.block_names(declared, used, targets), T.outward(declared, functions.select("project", "path", "function", "name")), T.tracked(declared, used, functions.select("project", "path", "function", "name"))):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "Broadcast" not in plan and "MapInPandas" not in plan


def told(spark, *sources):
    return T.all_told(spark.createDataFrame([("p", f"{i}.ts", x) for i, x in enumerate(sources)], "project string, path string, source string"))


CHAIN = "function f(a: string, z) {\n  const b = h(a);\n  let c = b;\n  c.keep = a;\n  if (z) {\n    const c = b;\n    this.items.push(c);\n  }\n  return c;\n}\nfunction h(x) { return x; }\nconst r = f('1', 2);\nshow(r);\n"


def test_texts_follow_values_and_inner_declarations(spark):
    """What a block tells holds definitions of what is called, inner declarations of the name, and the names that the value goes on to."""
    declared, used, _ = told(spark, CHAIN)
    targets = spark.createDataFrame([("p", "0.ts", "arg", "a", 0), ("p", "0.ts", "var", "c", 0)], "project string, path string, scope string, name string, occurrence int")
    got = {}
    for r in T.block_texts(declared, used, targets).collect():
        got.setdefault(r.name, set()).add(r.text)
    led = {"function h(x) { return x; }", "const b = h(a)", "let c = b", "c.keep = a;", "const c = b", "this.items.push(c)", "return c;"}
    assert got == {"a": led, "c": {"let c: <mask> = b", "c.keep = a;", "const c = b", "this.items.push(c)", "return c;"}}
    functions = spark.createDataFrame([("p", "0.ts", "f", "a")], "project string, path string, function string, name string")
    assert {r.text for r in T.tracked_texts(declared, used, functions).collect()} == led


def test_whole_slices_hold_callers_and_what_becomes_of_them(spark):
    declared, used, calls = told(spark, CHAIN, "export const other = f('2', 3);\n")
    targets = spark.createDataFrame([("p", "0.ts", "arg", "a", 0), ("p", "0.ts", "ret", "h", 0), ("p", "0.ts", "var", "b", 0), ("p", "0.ts", "var", "b", 1)], "project string, path string, scope string, name string, occurrence int")
    got = {(r.scope, r.occurrence): r.slice for r in T.whole_slices(declared, used, calls, targets).collect()}
    file, f = "this is a snippet from the file 0.ts\n", CHAIN.split("\nfunction h")[0].replace("a: string", "a: <mask>")
    led = "let c = b\nc.keep = a;\nconst c = b\nthis.items.push(c)\nreturn c;"
    assert got["arg", 0] == f"{file}{f}\nfunction h(x) {{ return x; }}\nconst b = h(a)\n{led}\nconst r = f('1', 2)\nshow(r)\nf('2', 3)"
    assert got["ret", 0] == f"{file}function h(x): <mask> {{ return x; }}\na: string\nconst b = h(a)\n{led}"
    assert got["var", 0].startswith(f"{file}function h(x) {{ return x; }}\nconst b: <mask> = h(a)\nlet c = b\nc.keep = a;\n") and got["var", 0].endswith("return c;\na: string") and got["var", 1] is None
