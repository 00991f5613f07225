"""Semantics that the queries' data don't reach."""

from pyspark.sql import functions as F

from spindrift.functions import hashing as H
from spindrift.functions import python_udfs as P
from spindrift.functions import similarity as S
from spindrift.functions import text as X
from spindrift.functions.names import fuzzy, ratio
from spindrift.operators import aggregates as G
from spindrift.operators import checks as C
from spindrift.operators import joins as J
from spindrift.operators import projects as O
from spindrift.operators import retrieval as R
from spindrift.operators import sets as U
from spindrift.operators.splits import project_splits


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_eligibility_and_builtin(spark):
    b = X.is_builtin(F.lit("builtins"), F.lit(""), F.lit("Foo"), F.lit(""))
    assert one(spark, X.rejection(F.lit("arg"), F.lit(False), F.lit("Foo")), X.rejection(F.lit("return"), F.lit(False), F.lit("Foo")), X.rejection(F.lit("arg"), b, F.lit("Foo")), X.rejection(F.lit("arg"), F.lit(False), F.lit(" "))) == ("eligible", "non_parameter", "builtin", "missing_ground_truth")
    test = lambda cat, o, label: X.is_builtin(F.lit(cat), F.lit(o), F.lit(label), F.lit(None))
    assert one(spark, test("", "builtins.int", "x"), test("user", "", "int"), test("", "", "list[int]"), test("", "", "typing.Dict"), test(None, None, "Foo")) == (True, False, True, True, False)


def test_names_and_projects(spark):
    assert one(spark, *map(X.canonical_type_name, map(F.lit, ("typing.pkg.Response", "list[a.B]", None, " A b ")))) == ("response", "b]", "", "ab")
    n = F.lit(None).cast("string")
    assert one(spark, X.strict_project(F.lit("repos/a/b/c.py")), X.strict_project(F.lit("a\\b")), X.strict_project(F.lit("a")), X.strict_project(F.lit("a!/b"))) == ("a/b", "a/b", None, None)
    assert one(spark, X.url_project(F.lit("http://h/a/b/"), n), X.url_project(n, F.lit("x/repos/o/r/f")), X.url_project(n, n), X.url_project(F.lit("solo"), n)) == ("a/b", "o/r", "unknown", "solo")
    assert one(spark, X.loose_project(F.lit("h//b"), n), X.loose_project(n, F.lit("repos/o")), X.loose_project(n, F.lit("repos/o/r"))) == ("/b", "repos", "o/r")
    assert one(spark, *X.location(F.lit("f@12")), *X.location(F.lit("f@x")), *X.location(F.lit(None).cast("string"))) == ("f", 12, "f", None, "global", None)


def test_generated_types(spark):
    cases = {"string[]": "list[Union[Any, str]]", "List[a.B]": "list[Union[Any, a.B]]", "Array<number>": "list[Union[Any, int]]", "{x: 1}": "dict", "number | boolean": "typing.Union[int, bool]", "Record<string, any>": "dict[union[any, str], any]", "tuple[int]": "tuple[Union[Any, int]]", "mask: Foo": "Foo"}
    got = one(spark, *[X.fix_generated_type(F.lit(k)) for k in cases])
    assert list(got) == list(cases.values())


def test_answers_and_unions(spark):
    cases = {'"a"|"b"|"c"': "string", '"x"|y|"z"': '"x"|y|"z"', "any": "object", "(A)": "A", "<mask>RefObject<T> RefObject": "MutableRefObject<T> RefObject", "mask: mask: A": "mask: A"}
    assert list(one(spark, *[X.fix_answer(F.lit(k)) for k in cases])) == list(cases.values())


def test_windows_and_names(spark):
    assert one(spark, *X.window_around(F.lit("abcdefghij"), F.lit(5), 2), *X.window_around(F.lit("abc"), F.lit(99), 2)) == ("...de", "fgh...", "...bc", "")
    assert one(spark, X.file_name(F.lit("a/b.py?x#y")), X.file_name(F.lit("/")), X.file_name(F.lit(None).cast("string")), X.module_name(F.lit("src/a/__init__.py"))) == ("b.py", "", "", "a")


def test_hashes(spark):
    import hashlib

    n = int(hashlib.sha1(b"13:a/b").hexdigest()[:16], 16)
    assert int(one(spark, H.stable_number(F.lit("a/b"), 13))[0]) == n
    parts = spark.range(10).select(F.col("id").alias("shard"), F.explode(H.physical_parts(F.col("id"))).alias("p")).select("p.*")
    assert parts.count() == 18 and C.residue_faults(parts).count() == 0 and C.residue_faults(parts.where("residue <> 29")).collect() == [(29, 0)]


def test_splits_are_disjoint(spark):
    rows = spark.createDataFrame([(f"o/r{i}",) for i in range(300)] * 2 + [(None,)], "project string")
    got = project_splits(rows, test_projects=20).collect()
    assert len({r.project for r in got}) == len(got) and sum(r.split == "test" for r in got) == 20 and {r.split for r in got} == {"train", "validation", "test"}


def test_similarities(spark):
    e = F.array().cast("array<string>")
    t = lambda s: S.tokens(F.lit(s))
    assert one(spark, S.bm25(e, e), S.bm25_raw(e, e), S.bm25(e, t("a")), S.bm25_directed(e, e)) == (1.0, 0.0, 0.0, 0.0)
    assert one(spark, S.dice(F.lit("night"), F.lit("nacht")), S.dice(F.lit("A b"), F.lit("ab")), S.dice(F.lit("a"), F.lit("b")), S.dice(F.lit("aaaa"), F.lit("aa"))) == (0.25, 1.0, 0.0, 0.5)
    assert one(spark, S.levenshtein_ratio(F.lit(""), F.lit("")), S.count_cosine(t("a b"), t("c")), S.jaccard(e, e)) == (1.0, 0.5, 0.0)
    assert ratio("Abc", "abc") == 1.0 and fuzzy("ab", "xxabxx") == 0.8 and fuzzy("A", "a") == 1.0


def test_coverage_numbers(spark):
    df = spark.createDataFrame([("train", True)] * 3 + [("train", False), ("test", True), ("test", False), ("test", False)], "s string, f boolean")
    got = {r.s: r.percentage for r in G.coverage(df, "s", F.col("f")).collect()}
    assert got == {"train": 75.0, "test": 33.33} and G.coverage(df.limit(0), "s", F.col("f")).count() == 0


def test_hit_ranks(spark):
    p = G.lifted(F.array(F.lit("a.X"), F.lit("Y"), F.lit("list[int]")))
    assert one(spark, G.hit_rank(p, F.lit("x")), G.hit_rank(p, F.lit("Z")), G.hit_rank(p, F.lit("list[str]")), G.hit_rank(p, F.lit("list[str]"), base=True)) == (1, None, None, 3)


def test_declarations_and_prompts():
    assert [x["name"] for x in P.declarations("class A: x\nexport interface B {}\n type C = 1")] == ["A", "B"]
    assert [x["name"] for x in P.declarations("- Foo\n\n,a b!")] == ["Foo", "a b!"]
    found = P.recommendations(None, f"x {X.PROMPT_STARTS[1]}\nclass P: a\nclass P: b\n{X.PROMPT_END} class Q: c")
    assert [x["name"] for x in found] == ["P"]
    assert P.recommendations('[{"signature": "class S: x"}, {"name": ""}, 5]', None) == [{"name": "S", "definition": "class S: x", "qualified_name": None}]


def test_joins(spark):
    p = spark.createDataFrame([("f", 5), ("f", 70), ("f", 200), ("g", 5)], "file string, line int")
    s = spark.createDataFrame([("f", "a", 1, 100), ("f", "b", 60, 80), ("f", "c", 0, 5)], "file string, fn string, start int, stop int")
    got = {(r.file, r.line): r.fn for r in J.innermost(p, s, ["file"], "line", "start", "stop", "fn", ["file", "line"]).collect()}
    assert got == {("f", 5): "c", ("f", 70): "b"}
    q = spark.createDataFrame([("Ou",), ("Outer",)], "q string")
    assert {(r.q, r.name) for r in R.prefix_join(q, "q", spark.createDataFrame([("Outer",), ("O",), (None,)], "name string"), "name").collect()} == {("Ou", "Outer"), ("Outer", "Outer")}


def test_seeds_outside_the_kb_are_never_returned(spark):
    kb = spark.createDataFrame([(1, 7, "A", "m.A", ["a"])], "project int, key long, name string, qualified_name string, words array<string>")
    seeds = spark.createDataFrame([(1, "m.Missing", 0), (1, "M.a", 3)], "project int, seed string, rank int")
    target = spark.createDataFrame([(1, ["a"], ["a", "b"])], "project int, target_tokens array<string>, slice_tokens array<string>")
    got = R.top_types(R.kb_scores(kb, seeds, target), 10).collect()
    assert [(r.key, r.seed_rank, r.score) for r in got] == [(7, 3, 9997 + 40 + 1 + 100)]


def test_sets(spark):
    a, b = spark.createDataFrame([("X", 2), ("y", 1)], "name string, key long"), spark.createDataFrame([("x", 0), ("Z", 5)], "name string, key long")
    assert sorted(r.name for r in U.union_first_wins([a, b], [F.lower("name")], ["key"]).collect()) == ["X", "Z", "y"]
    assert {r.name: r.generation for r in U.prepend_union([a, b], "name", "key").collect()} == {"X": 0, "y": 0, "x": -1, "Z": -1}


def test_failures_become_rows(spark):
    df = spark.createDataFrame([("p", 1), ("p", 0)], "project string, x int")
    got = {r.result: r.error for r in O.by_row(df, ["project"], "x", lambda v: 10 // v, "long").collect()}
    assert got[10] is None and "ZeroDivisionError" in got[None]


def test_sources(spark, tmp_path):
    from spindrift.sources import records as S

    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.jsonl").write_text('{"id": 1}\n\n{"id": 2, "other": 3}\n')
    (tmp_path / "list.json").write_text('[{"id": 5}, {"id": 6}]')
    (tmp_path / "wrapped.json").write_text('{"data": [{"id": 7}]}')
    assert [r.id for r in S.read_jsonl(spark, str(tmp_path / "a"), "id long, name string").orderBy("position").collect()] == [1, 2]
    assert sorted(r.id for r in S.read_json_list(spark, str(tmp_path / "list.json"), "id long").collect()) == [5, 6]
    assert [r.id for r in S.read_json_list(spark, str(tmp_path / "wrapped.json"), "id long", "data").collect()] == [7]
    (tmp_path / "src" / "node_modules").mkdir(parents=True)
    for p in ("a.py", "b.txt", ".c.py", "node_modules/d.py"):
        (tmp_path / "src" / p).write_text("x")
    assert [r.path.rpartition("/")[2] for r in S.walk(spark, str(tmp_path / "src")).collect()] == ["a.py"]
    assert S.sha256_of_files(spark, str(tmp_path / "src" / "a.py")).first().sha256 == "2d711642b726b04401627ca9fbac32f5c8530fb1903cc4db02258717921a4881"


def test_each_flat_dict_is_wrapped(spark):
    cases = {
        "tuple[dict[a, b], dict[c, any]]": "tuple[dict[union[any, a], union[any, b]], dict[union[any, c], any]]",
        "dict[a, dict[b, c]]": "dict[a, dict[union[any, b], union[any, c]]]",
        "dict[ str , any, k7]": "dict[union[any, str], any, union[any, k7]]",
        "dict[": "dict[", "dict[]": "dict[]", "dict[ ]": "dict[ ]", "list[a]": "list[a]", "": "", "x dict[a": "x dict[a",
    }
    got = one(spark, *[X.dict_with_any(F.lit(k)) for k in cases])
    assert got == tuple(cases.values())


def test_each_list_gets_the_first_type(spark):
    assert one(spark, X._with_any(F.lit("list[a.b] | list[ c ]"), "list"), X._with_any(F.lit("list[]"), "list")) == ("list[Union[Any, a.b]] | list[Union[Any, a.b]]", "list[]")


def test_declared_names_are_scanned(spark):
    from spindrift.functions import declarations as D

    cases = {
        "class Foo:": "Foo", "  export default abstract CLASS Foo.Bar extends X": "Foo.Bar", "declare interface $a$ {": "$a", "type  T=1": "T", "classFoo": "classFoo", "class": "class",
        "enum 1a": "enum 1a", "x = 1": "", "List[int | str]": "List[int | str]", "a\nclass B": "B", "": "", "\n\n": "", "class Ünï": "class Ünï", "interface Été_1": "interface Été_1", "class Aé.b!": "Aé.b", "type A. = 1": "A", "x!\ntype": "",
    }
    for text, want in cases.items():
        assert D.declared(text) == want, text
        if text.isascii():
            assert one(spark, X.declared_name(F.lit(text))) == (want,), text
    assert D.declarations("export class A {\n x\n}\nabstract\nclass B") == [{"name": "A", "definition": "export class A {\n x\n}"}, {"name": "B", "definition": "abstract\nclass B"}]
    assert D.declarations(" - int,\n\n x y!\n") == [{"name": "int", "definition": "int"}, {"name": "x y!", "definition": "x y!"}]


def test_recommendation_fields():
    from spindrift.functions.python_udfs import recommendations as r

    assert [x["name"] for x in r('["class A: pass", {"name": "B"}, {"code": "class C"}, {"x": 1}, 7, {"name": "a", "qualified_name": "m.A"}]', None)] == ["A", "B", "C", "a"]
    assert r("class A\nclass a", None) == [{"name": "A", "definition": "class A", "qualified_name": None}]
    assert r('"typing.List"', None)[0]["name"] == "typing.List" and r(None, None) == [] and r("5", None) == [] and r("null", None) == []
    prompt = "x The possible types analyzed from the import information are:\nclass P\nThe code you need to make a prediction is: y"
    assert [x["name"] for x in r("[]", prompt)] == ["P"]
