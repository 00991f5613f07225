"""Types that flow through projects, held against hand-worked values; each case is a project of one table."""

from collections import defaultdict

import pytest

from spindrift.functions import type_flow as T
from spindrift.operators import shared
from spindrift.operators import type_flow as TF

CHAIN = "def f0() -> 'Deep': ...\n" + "".join(f"def f{i}():\n    return f{i - 1}()\n" for i in range(1, 52))
EXPRESSIONS = "def f(a):\n    b = await g()\n    c = (a and K()) or [L(), {M(): 1}]\n    d = {N()}\n    e = 'x' if a else O()\n    h = Thing.from_json(a)\n    i = ThingFactory.build()\n    j = Factory.make()\n    k = db.session.query(m.Row).filter(1).all()\n    l = pkg.User.objects.filter(x).first()\n    n = Mock(spec_set=m.Real)\n    o = a.b\n    p = datetime()\n    q = x[0].First().make()\n"
PROJECTS = {
    "order": {"m.py": "def f():\n    y = x\n    x = A()\n    z = x\n    x = B()\n    return z\n"},
    "expressions": {"m.py": EXPRESSIONS},
    "arguments": {"a.py": "def f(x, /, y, *, z):\n    return f(y, x, z=z)\n\nclass C:\n    def f(self, q):\n        return q\n", "b.py": "import a\na.f(A(), y=B(), z=Z())\na.f(1, C(), D())\n"},
    "chain": {"a.py": CHAIN, "b.py": "def ("},
    "fixtures": {"t.py": "@fixture()\ndef db() -> Base:\n    return Real()\n\ndef test(db: Secret, other: Secret = None):\n    x: Hidden = db\n"},
    "stars": {"a.py": "class A: pass\nclass _Hidden: pass\n", "b.py": "from a import *\n", "c.py": "from b import *\nfrom a import A as Z\n", "x.py": "from y import *\nclass X: pass\n", "y.py": "from x import *\n"},
    "exports": {f"m{i}.py": f"from m{i - 1} import *\n" if i else "class Deep: pass\n" for i in range(11)},
    "ranking": {"m.py": "from typing import Zed\nclass K: pass\ndef f(p):\n    p = K()\n    return p\nf(B())\nf(A())\n"},
    "many": {"m.py": "\n".join(f"x = T{i:03}()" for i in range(200))},
}


@pytest.fixture(scope="module")
def files(spark):
    rows = [(p, path, path.removesuffix(".py"), source) for p, found in PROJECTS.items() for path, source in found.items()]
    return spark.createDataFrame(rows, "project string, path string, module string, source string").repartition(3)


@pytest.fixture(scope="module")
def short(files):
    """All but the project that takes many rounds."""
    return files.where("project <> 'chain'")


@pytest.fixture(scope="module")
def flow(files):
    out = defaultdict(lambda: defaultdict(set))
    for r in TF.type_flow_of(files).collect():
        out[r.project][r.kind, r.function, r.name].add(r.type)
    return {k: dict(v) for k, v in out.items()}


def test_order_of_assignments_counts(flow):
    assert flow["order"] == {("return", "f", ""): {"A"}, ("variable", "", "x"): {"A", "B"}, ("variable", "", "z"): {"A"}}


def test_forms_of_expressions(flow):
    want = {"c": {"K", "L"}, "d": {"N"}, "e": {"O"}, "h": {"Thing"}, "i": {"Thing"}, "j": {"Factory"}, "k": {"Row"}, "l": {"User"}, "n": {"Mock", "Real"}, "p": {"datetime"}}
    assert {n: t for (kind, _, n), t in flow["expressions"].items() if kind == "variable"} == want


def test_arguments_by_place_and_keyword_and_recursion(flow):
    f = flow["arguments"]
    assert f["parameter", "f", "x"] == {"A", "B", "C"} and f["parameter", "f", "y"] == {"A", "B", "C"} and ("parameter", "f", "z") not in f and ("parameter", "f", "q") not in f


def test_long_chains_and_broken_files(flow):
    assert flow["chain"]["return", "f51", ""] == {"Deep"}


def test_fixtures_and_labels(flow):
    assert flow["fixtures"] == {("return", "db", ""): {"Base", "Real"}, ("parameter", "test", "db"): {"Base", "Real"}, ("variable", "", "x"): {"Base", "Real"}}


def test_modules_of_imports():
    assert [T.absolute("a.b.c", "x/c.py", n, "q") for n in range(5)] == ["q", "a.b.q", "a.q", "q", "q"]
    assert T.absolute("a.b", "x/__init__.py", 1, "q") == "a.b.q" and T.absolute("a.b", "x/b.py", 1, "") == "a"


def test_star_imports_pass_on(files):
    found = defaultdict(set)
    for r in TF.imported_names(TF.type_facts(files)).collect():
        found[r.project, r.path].add(r.name)
    assert found["stars", "c.py"] == {"A", "Z"} and found["stars", "b.py"] >= {"A"} and "_Hidden" not in found["stars", "b.py"] and found["stars", "y.py"] == {"X"}
    assert all(found["exports", f"m{i}.py"] == {"Deep"} for i in range(1, 11)) and ("exports", "m0.py") not in found


def test_ranking_and_bound(short, spark):
    targets = [("ranking", "m.py", "p", "f"), ("ranking", "m.py", "p", ""), ("ranking", "no.py", "q", None), ("many", "m.py", "x", ""), ("exports", "m10.py", "q", "")]
    got = defaultdict(list)
    for r in TF.recommended_types(short, spark.createDataFrame(targets, "project string, path string, name string, function string")).orderBy("place").collect():
        got[r.project, r.function].append((r.type, r.kind, r.module))
    assert got["ranking", "f"] == [("A", "inferred", ""), ("B", "inferred", ""), ("K", "class", "m"), ("Zed", "reexported_import", "typing")]
    assert got["ranking", ""] == [("K", "class", "m"), ("Zed", "reexported_import", "typing")]
    assert len(got["many", ""]) == 120 == len(set(got["many", ""])) and got["exports", ""] == [("Deep", "class", "m0")]


def test_nothing_meets_by_project(short):
    plan = TF.flow_edges(TF.type_facts(short))._jdf.queryExecution().toString()
    assert "GroupsIn" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


def test_fixed_points_and_closures(spark):
    seeds = spark.createDataFrame([("p", "a", 1), ("q", "a", 2)], "k string, at string, v int")
    edges = spark.createDataFrame([("p", "a", "b"), ("p", "b", "c"), ("p", "c", "a"), ("q", "x", "y")], "k string, at string, to string")
    assert {tuple(r) for r in shared.least_fixed_point(seeds, edges, "at", "to").collect()} == {("p", "a", 1), ("p", "b", 1), ("p", "c", 1), ("q", "a", 2)}
    path = spark.createDataFrame([(i, i + 1) for i in range(20)], "a int, b int")
    assert {tuple(r) for r in shared.closure(path, "a", "b").collect()} == {(i, j) for i in range(21) for j in range(i + 1, 21)}
    assert shared.closure(path.limit(0), "a", "b").count() == 0 and shared.least_fixed_point(seeds.limit(0), edges, "at", "to").count() == 0
    with pytest.raises(ValueError):
        shared.least_fixed_point(seeds, edges, "no", "to")
