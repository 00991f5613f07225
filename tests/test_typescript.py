from spindrift.functions import typescript as T


def test_comments_and_strings_hide_nothing_real():
    src = "const s = 'class A {}'; // function f() {}\nclass B<T> extends C { m(a: string): void { g('(') } }\ntype X = { a: { b: 1 } };\ntype y = 1\nconst type = 2;\n"
    assert [(x["name"], x["kind"]) for x in T.declarations(src)] == [("B", "class"), ("X", "type"), ("y", "type")]
    assert T.declarations(src)[0]["definition"].endswith("} }") and T.declarations(src)[1]["definition"] == "type X = { a: { b: 1 } }"
    assert [(x["name"], x["code"]) for x in T.calls(src)] == [("g", "g('(')")]
    assert T.declarations("class Open {") and T.calls("f(") and T.declarations("") == []


def test_initializers():
    cases = {"1_000": "number", "0xff": "number", "`a`": "string", "true": "boolean", "null": "null", "{}": "object", "function () {}": "Function", "await f()": "any"}
    assert {k: T.initializer_type(k) for k in cases} == cases
