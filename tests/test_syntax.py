"""Walks over syntax trees, held against Python's own."""

import ast
import inspect
import textwrap

import pytest

from spindrift.functions import code, syntax

TEXTS = [inspect.getsource(ast), inspect.getsource(textwrap), "def f(*, a=None, b): return {**a, 'é': b}\n\n\nasync def g[T](x: T, /) -> 'ü':\r\n    ä = {}; return [i async for i in x]\n", "match x:\n    case {'a': [1, *r], **k} | None: pass\n", "x = '''\n\x0c\u2028'''; y = lambda: 'é'\n"]


@pytest.mark.parametrize("text", TEXTS)
def test_walks_meet_the_nodes_that_python_meets(text):
    tree = ast.parse(text)
    assert list(syntax.walk(tree)) == [n for n in ast.walk(tree) if not isinstance(n, ast.expr_context)]
    assert all(syntax.children(n) == [c for c in ast.iter_child_nodes(n) if not isinstance(c, ast.expr_context)] for n in ast.walk(tree))


@pytest.mark.parametrize("text", TEXTS)
def test_segments_are_those_that_python_gives(text):
    placed = [n for n in ast.walk(ast.parse(text)) if hasattr(n, "end_lineno")]
    assert placed and all(code.segment(text, n) == ast.get_source_segment(text, n) for n in placed[::7])


def test_deep_texts_and_many_functions_are_walked_without_recursion(monkeypatch):
    deep = "f(" * 80 + ")" * 80
    assert len(code.call_sites("m", deep)) == 80
    met = []
    monkeypatch.setattr(code, "scoped", lambda tree, real=code.scoped: met.append(tree) or real(tree))
    text = "def only_here(x):\n    return only_there(x)\n"
    assert [len(code.definitions("m", text)), len(code.call_sites("m", text)), len(met)] == [1, 1, 1]  # one walk for both
