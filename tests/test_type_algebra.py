import pytest

from spindrift.functions.type_algebra import alternatives, base_match, canonical, exact_match, split


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("", ""), ("?", ""), ("(string)", "string"), ("string[]", "Array<string>"), ("array<number>", "Array<number>"), ("(string | number)[]", "Array<string | number>"), ("Array<string | any>", "Array<any>"),
        ("A | any", "any"), ("A & B", ""), ("number?", "number?"), ("Foo?", "Foo?"), ("Map<string, A.B>", "Map<string,A.B>"), ("Map<string>", "Map<any,any>"), ("Record<string, number | Foo>", "Record<string,number | Foo>"),
        ("[a, b]", "[a, b]"), ("{}", "object"), ("{a: string; b?: number}", "{a: string, b: number} | {a: string}"), ("(x: string, y) => void", "(x: string, y: any) => void"), ("function", "Function"), ("a.b.C<X>", "a.b.C"),
        ("{a: A} | {b: B}", "{a: A} | {b: B} | {a: A, b: B}"), ("Array<A> | B", "B | Array<A>"), ("Foo<A, B>", "Foo"), ("promise", "Promise"),
    ],
)
def test_canonical(text, want):
    assert canonical(text) == want


@pytest.mark.parametrize(
    ("truth", "predicted", "exact", "base"),
    [
        ("string", "string", True, True), ("string", "number", False, False), ("a.Foo", "Foo", True, True), ("Object", "string", True, True), ("string", "Object", False, True), ("object", "Foo", True, True), ("Foo", "object", False, False),
        ("object", "string", False, False), ("any", "Foo", True, True), ("Foo", "any", False, False), ("Array", "string[]", True, True), ("string[]", "Array", False, True), ("string[]", "number[]", False, True), ("Array<any>", "Array", False, True),
        ("A | B", "B | A", True, True), ("A | B", "A", False, True), ("A", "A | B", False, False), ("Function", "(a: string) => void", True, True), ("(a: string) => void", "Function", False, False),
        ("(a: string) => void", "(a: string) => void", True, True), ("(a: string) => void", "(b: string) => void", False, True), ("[A, B]", "Array", True, True), ("[A, B]", "A[]", False, True), ("{a: A, b: B}", "{b: B, a: A}", True, True),
        ("Map<string, A>", "Map<string, A>", True, True), ("Map<string, A>", "Map<number, B>", False, True), ("Promise<A>", "Promise<b.A>", True, True), ("", "A", False, False),
    ],
)
def test_matches(truth, predicted, exact, base):
    assert (exact_match(truth, predicted), base_match(truth, predicted)) == (exact, base)


def test_split_and_bounds():
    assert split("a<b,c>, d", ",") == ["a<b,c>", "d"]
    wide = "{" + ", ".join(f"a{i}?: A | B" for i in range(9)) + "}"
    with pytest.raises(ValueError, match="alternatives"):
        alternatives(wide)
