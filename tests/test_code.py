from pyspark.sql import functions as F

from spindrift.functions import code as C
from spindrift.operators import code_tables

SOURCE = '''
import os, typing as t
from a.b import Thing, gone

class Outer(Base, metaclass=Meta):
    x: int = 1
    y = [1]

    class Inner:
        def go(self, a, *rest, k: "pkg.Key" = None) -> t.Optional[Thing]:
            self.z = a
            return make(a)

    async def run(self):
        return await self.go2(os)


def make(value):
    left, right = value
    made = Thing(left)
    return made
'''


def test_definitions_and_calls():
    d = {x["qualified_name"]: x for x in C.definitions("m", SOURCE)}
    assert set(d) == {"m.Outer.Inner.go", "m.Outer.run", "m.make"}
    assert d["m.make"]["source_code"].startswith("def make(value):") and d["m.Outer.Inner.go"]["source_code"] == "function go(self, a, *rest, k: 'pkg.Key' = None) -> t.Optional[Thing]"
    calls = {x["written"]: x for x in C.call_sites("m", SOURCE)}
    assert calls["self.go2"]["qualified_name"] == "m.Outer.go2" and calls["make"]["scope"] == "Outer.Inner.go" and calls["Thing"]["qualified_name"] == ""


def test_classes_and_imports():
    c = {x["name"]: x["signature"] for x in C.classes(SOURCE)}
    assert c["Outer"].splitlines() == ["class Outer(Base, metaclass=Meta):", "    # fields", "    x: int = 1", "    y = [1]", "    # methods", "    def run(self):"]
    assert c["Inner"].splitlines()[-1] == "    def go(self, a, *rest, k) -> t.Optional[Thing]:"
    assert [x["name"] for x in C.classes("A = list[int]\nb = 1\nC: TypeAlias = int\n")] == ["A", "C"]
    assert [(x["module"], x["name"], x["used"]) for x in C.imports(SOURCE)] == [("os", "", True), ("typing", "", True), ("a.b", "Thing", True), ("a.b", "gone", False)]
    assert [C.package_origin(m, {"mine"}) for m in ("os.path", "mine.x", ".y", "numpy")] == ["stdlib", "local", "local", "third_party"]


def test_type_names_and_signals():
    names = lambda s: C.type_names(C.parsed(s).body[0].value)
    assert names("Optional[a.b.C]") == ["a.b.C"] and names("Dict[str, 'X']") == ["str"] and names("'q.X | None'") == ["q.X"] and C.type_names(None) == []
    assert {x["name"]: x["kind"] for x in C.type_signals(SOURCE)} == {"Thing": "import_symbol", "Outer": "visible_class", "Base": "base_class", "Key": "annotation", "Inner": "visible_class", "Optional": "qualified_attribute"}
    broken = "from x import A\nclass B(:\n isinstance(y, C)\n"
    assert {x["name"] for x in C.type_signals(broken)} >= {"A", "B", "C"} and C.declared_classes(broken) == ["B"]
    assert C.type_signals("x: <mask> = 1") == []


def test_slices_never_show_the_target():
    source = "def f(a: Secret, b) -> Hidden:\n    x: Local = a.run()\n    y = x\n    return y\n"
    for scope, name in (("arg", "a"), ("return", "f"), ("local", "x")):
        made = C.slice_of(source, scope, name, "f", 2)
        assert "<mask>" in made
        assert {"arg": "Secret", "return": "Hidden", "local": "Local"}[scope] not in made
    assert C.slice_of(source, "arg", "a", "g") is None and C.slice_of("def (", "local", "x") is None


def test_innermost_function():
    tree = C.parsed("def f():\n    def f():\n        pass\n    return 1\n")
    assert C._function(tree, "f", 3).lineno == 2 and C._function(tree, "f", 4).lineno == 1 and C._function(tree, "f", None) is None


def test_small_rewrites():
    assert C.split_unpacking("a, b = f()") == "a = f()[0]\nb = f()[1]" and C.split_unpacking("a, = (") == "a, = ("
    assert C.without_annotations("def f(a: int = 1) -> str:\n    b: int\n    c: int = 2") == "def f(a=1):\n    b = None\n    c = 2"
    assert [C.masked_assignment(x) for x in ("a = b = 1", "a: int = 2", "a: int", "a += 1", "f()")] == ["a = b: <mask> = 1", "a: <mask> = 2", "a: <mask>", "a += 1", None]
    assert [x["type"] for x in C.assigned_types("class K: pass\na = 1\nb = [1]\nc = K()\nd = g()\ne = 'x' + y\nf = z")] == ["int", "List", "class K", "The return value of g or class g", "str", "Any"]


def test_statements_expand_one_level():
    tree = C.parsed("a = 1\nb = a\nc = b\nd = c\nprint(d)\n")
    assert [n for n, _ in C.statements_for(tree, "c")] == [2, 3, 4] and [n for n, _ in C.statements_for(tree, "c", False)] == [3, 4]


def test_recommendations_are_bounded():
    code = "\n".join(f"x{i} = Type{i}()" for i in range(200))
    assert len(C.recommendations(code)) == C.MOST_RECOMMENDATIONS
    assert C.recommendations("use(widget, Gadget)", ["m.Gadget", "m.Other"]) == [{"name": "Gadget", "kind": "project"}]


def test_self_fields_and_callers():
    assert {(x["method"], x["field"], x["written"]) for x in C.self_fields(SOURCE)} == {("go", "z", True), ("run", "go2", False)}
    assert C.caller_context("v = 1\nw = v\nmake(w, k=v)\n", "make") == ["v = 1\nw = v\nmake(w, k=v)"]


def test_every_wrapper_is_no_type():
    from spindrift.functions import syntax

    assert len(syntax.WRAPPERS) == 24
    for w in syntax.WRAPPERS:
        assert [x["name"] for x in C.type_signals(f"x: {w}[str, m.Foo]")] == ["Foo"], w


def test_signals_of_code_that_does_not_parse():
    text = "from Pkg.mod import (Alpha,\n  beta, Gamma)\nfrom x import Delta as d\nclass Kind(\n y = cast(Cast, 1) + isinstance(a.b, Inst) + m.Attr + Plain\n <mask> ="
    got = {x["name"]: x["kind"] for x in C.type_signals(text)}
    assert got == {"Pkg": "import_symbol", "Alpha": "import_symbol", "Gamma": "import_symbol", "Delta": "import_symbol", "Kind": "tolerant_syntax", "Cast": "tolerant_syntax", "Inst": "tolerant_syntax", "Attr": "tolerant_syntax"}


def test_signals_by_kind():
    text = """from m import Imp as Al, low
class K(Base, metaclass=Meta):
    f: 'Anno'
    async def g(self, a: P1, /, b: P2, *, c: P3, **d: P4) -> list[Ret]:
        isinstance(a, (I1, I2)); issubclass(b, S1); cast(C1, b); Con(); m.Q; Mock(spec=Sp); open(); <mask>()
"""
    got = {x["name"]: x["kind"] for x in C.type_signals(text)}
    want = {"Al": "import_symbol", "K": "visible_class", "Base": "base_class", "Anno": "annotation", "P1": "annotation", "P2": "annotation", "P3": "annotation", "Ret": "return_annotation", "I1": "isinstance", "I2": "isinstance", "S1": "issubclass", "C1": "cast", "Con": "constructor", "Q": "qualified_attribute", "Mock": "constructor", "Sp": "mock_spec"}
    assert got == want


def test_literal_types_and_unpacking():
    import ast

    kinds = {"1": "int", "'a'": "str", "None": "NoneType", "[1]": "List", "(1,)": "Tuple", "{1}": "Set", "{}": "Dict", "K()": "class K", "f()": "The return value of f or class f", "m.f()": "Any", "[1] + x": "List", "1 - 2 + f()": "int", "x": "Any"}
    for text, want in kinds.items():
        assert C.literal_type(ast.parse(text, mode="eval").body, {"K"}) == want
    assert C.split_unpacking("if a:\n    x, (y, z) = f()\nelse:\n    p = q = 1, 2\ntry:\n    [m] = n\nexcept E:\n    u, v = w").splitlines() == ["if a:", "    x = f()[0]", "    y, z = f()[1]", "else:", "    p = q = (1, 2)", "try:", "    m = n[0]", "except E:", "    u = w[0]", "    v = w[1]"]


def test_a_file_is_parsed_once(spark, monkeypatch):
    from spindrift.functions import syntax
    from spindrift.operators import code_tables

    times = []
    real = syntax.parsed
    monkeypatch.setattr(syntax, "parsed", lambda s: times.append(s) or real(s))
    syntax.tree_of.cache_clear()
    for source in ("class A: pass\ndef f(): return A()", "def ("):
        for find in (lambda: C.definitions("m", source), lambda: C.call_sites("m", source), lambda: C.classes(source), lambda: C.imports(source), lambda: C.self_fields(source)):
            find()
    assert len(times) == 2
    df = spark.createDataFrame([(1, "a.py", "a", "class A: pass\ndef f(): return A()"), (1, "b.py", "b", "def ("), (2, "c.py", "c", None)], "project long, path string, module string, source string")
    definitions, calls, classes = (x.collect() for x in code_tables.project_index(df))
    assert [(x.path, x.name, x.error) for x in definitions] == [("a.py", "f", None), ("b.py", None, "does not parse")] and [x.written for x in calls if not x.error] == ["A"] and [x.name for x in classes if not x.error] == ["A"]


def test_roots_of_packages(spark):
    from spindrift.operators import roots

    paths = ["/a/x/__init__.py", "/b/x.py", "/b/y.pyi", "/b/y.py", "/a/z/core.py", "/t/stdlib/x.pyi", "/t/x/__init__.pyi", "/t/stubs/d2/x/__init__.pyi", "/t/stubs/d1/x.pyi", "/u/stdlib/x/__init__.pyi", "/t/stubs/d1/xx.pyi"]
    files = spark.createDataFrame([(p,) for p in paths], "path string")
    names = spark.createDataFrame([(n,) for n in ("x", "y", "z", "w")], "name string")
    assert {(r.name, r.root) for r in roots.installed_roots(names, "name", files, ["/a", "/b"]).collect()} == {("x", "/a/x"), ("y", "/b/y.py")}
    assert [r.root for r in roots.stub_roots(names, "name", files, ["/t", "/u"]).orderBy("place").collect()] == ["/t/stdlib/x.pyi", "/t/x", "/t/stubs/d1/x.pyi", "/t/stubs/d2/x", "/u/stdlib/x"]
    own = spark.createDataFrame([(1, p) for p in ("a.py", "src/b.py", "p/__init__.py", "src/q/__init__.py", "deep/c.py", "src/r/d.py", "e.txt")], "project long, path string")
    assert {r.name for r in roots.local_modules(own).collect()} == {"a", "b", "p", "q"}


def test_sources_are_dealt_over_tasks(spark):
    from spindrift.plans import modules, q_code

    for made in (q_code.files, q_code.ts_files, modules.project_files, modules.typescript_files):
        assert made(spark, "/root/testdata/sf0.001").select(F.spark_partition_id()).distinct().count() > 1


def test_several_kinds_of_findings_parse_files_once(spark):
    files = spark.createDataFrame([("p", "a.py", "a", "def f(x):\n    return f(1)\n"), ("p", "b.py", "b", "def broken(:")], "project string, path string, module string, source string")
    definitions, calls = code_tables.project_index(files, ("definition", "call"))
    found = code_tables.resolved_calls(calls, definitions)
    assert "MapInPandas" not in found._jdf.queryExecution().toString()
    assert [(r.written, r.target) for r in found.collect()] == [("f", "a.f")]
    assert code_tables.classes(files).where("error IS NULL").count() == 0 and code_tables.classes(files).count() == 1


def test_callers_stand_in_the_order_of_their_files(spark):
    files = [("p", f"{m}.py", m, s, i) for i, (m, s) in enumerate([("f", "def f(x):\n    return x\n"), ("z", "f(1)\n"), ("y", "f(2)\n"), ("x", "f(3)\n")])]
    targets = spark.createDataFrame([("p", "f.py", "arg", "x", "f", None)], "project string, path string, scope string, name string, function string, line int")
    for place, calls in (("place", ["f(1)", "f(2)", "f(3)"]), ("other", ["f(3)", "f(2)", "f(1)"])):
        for parts in (1, 4):
            dealt = spark.createDataFrame(files[::-1], f"project string, path string, module string, source string, {place} int").repartition(parts)
            assert code_tables.sliced(dealt, targets).first().slice.split("\n")[-3:] == calls


def test_functions_and_calls_are_those_of_all_nodes():
    import ast

    from spindrift.functions import code

    source = "@deco(1)\nclass A(base()):\n    x = [f(y) for y in g()]\n    async def m(self, a: T = d()) -> R:\n        def inner(*, k=h()): return lambda z: i(z)(j)\n        class B:\n            def n(self): self.m(k=inner())\n        return inner\nmain(**o())\n"
    want = [x for x in code.scoped(ast.parse(source)) if isinstance(x[0], (*code.FUNCTIONS, ast.Call))]
    got = code._functions_and_calls(source)
    assert [(ast.dump(n, include_attributes=True), *x) for n, *x in got] == [(ast.dump(n, include_attributes=True), *x) for n, *x in want] and len(got) == 15
