"""Types that a piece of Python code shows, from one walk over its syntax that knows what each part stands for.

Code that doesn't parse as a whole, as slices put together from several places often don't, is taken apart into logical lines;
those that parse are walked in the same way, and of the others the names are taken that stand where only a type stands.
"""

from __future__ import annotations

import ast
import functools
import io
import tokenize
from collections import deque
from collections.abc import Iterator

from .syntax import FUNCTIONS, MASK, chain_of, is_type_name, leaf_of, node_fields, parsed, tree_of, type_names

#: Stands for the mask while code is parsed.
HIDDEN = "MASKED_TYPE"
#: What a type expression in a field is called.
FIELDS = {(ast.ClassDef, "bases"): "base_class", (ast.AnnAssign, "annotation"): "annotation", (ast.arg, "annotation"): "annotation"} | {(f, "returns"): "return_annotation" for f in FUNCTIONS}
#: Fields whose nodes are looked at together with their parent, and those that are not looked at.
INLINE, UNSEEN = {(f, "args") for f in FUNCTIONS} | {(ast.arguments, x) for x in ("posonlyargs", "args", "kwonlyargs")}, {(ast.arguments, "vararg"), (ast.arguments, "kwarg")}
#: Calls that name a type, with the argument that does; classes that stand in for others, with the keywords that tell (fixed values).
NAMING = {"isinstance": 1, "issubclass": 1, "cast": 0}
STAND_INS, SPECIFIED_BY = {"MagicMock", "Mock"}, {"spec", "spec_set"}
#: Kinds of signs that are trusted in a logical line of code that doesn't parse.
TELLING = {"visible_class", "qualified_attribute", "isinstance", "cast"}
Sign = tuple[str, str]
#: Nodes that show something by themselves.
SHOWING = (ast.alias, ast.ClassDef, ast.Attribute, ast.Call)


def _own(node: ast.AST) -> Iterator[Sign]:
    """What a node shows by itself."""
    if isinstance(node, ast.alias) and node.name != "*":
        yield node.asname or node.name, "import_symbol"
    elif isinstance(node, ast.ClassDef):
        yield node.name, "visible_class"
    elif isinstance(node, ast.Attribute):
        yield node.attr, "qualified_attribute"
    elif isinstance(node, ast.Call):
        name = (chain_of(node.func) or ("",))[-1]
        at = NAMING.get(name)
        if at is None:
            yield name, "constructor"
        elif at < len(node.args):
            yield from ((t, name) for t in type_names(node.args[at]))
        if name in STAND_INS:
            yield from ((chain_of(k.value)[-1], "mock_spec") for k in node.keywords if k.arg in SPECIFIED_BY and chain_of(k.value))


@functools.cache
def _looked_at(kind: type[ast.AST]) -> tuple[tuple[str, str | None, bool, bool], ...]:
    """Fields of a kind of node that hold nodes: what a type there is called, whether they are looked at with the node, or later."""
    return tuple((f, FIELDS.get((kind, f)), (kind, f) in INLINE or (kind, f) == (ast.ImportFrom, "names"), (kind, f) not in UNSEEN and kind is not ast.Import) for f in node_fields(kind))


def signs(tree: ast.AST) -> Iterator[Sign]:
    """(name, kind) level by level. A field that holds types tells its kind before what stands in it is looked at."""
    level = deque([tree])
    while level:
        now = deque([level.popleft()])
        while now:
            node = now.popleft()
            if isinstance(node, SHOWING):
                yield from _own(node)
            for field, called, with_it, later in _looked_at(node.__class__):
                value = getattr(node, field, None)
                inner = [x for x in value if x is not None] if value.__class__ is list else [] if value is None else [value]
                if called:
                    yield from ((t, called) for x in inner for t in type_names(x))
                if with_it:
                    now.extend(inner)
                elif later:
                    level.extend(inner)


def logical_lines(code: str) -> list[list[str]]:
    """Words of each logical line; a line that the tokenizer can't read ends with its last word."""
    out: list[list[str]] = [[]]
    left = code.splitlines(keepends=True)
    while left:
        read = 0
        try:
            for t in tokenize.generate_tokens(io.StringIO("".join(left)).readline):
                read = t.end[0]
                if t.type == tokenize.NEWLINE:
                    out.append([])
                elif t.type in (tokenize.NAME, tokenize.OP, tokenize.NUMBER, tokenize.STRING):
                    out[-1].append(t.string)
            break
        except (tokenize.TokenError, SyntaxError):
            out.append([])
            left = [x.lstrip() for x in left[max(1, read) :]]
    return [x for x in out if x]


def _calls(words: list[str]) -> Iterator[str]:
    """The calls of NAMING in a line, each up to the bracket that ends it."""
    for at, word in enumerate(words):
        if word in NAMING:
            depth = 0
            for end in range(at + 1, len(words)):
                depth += (words[end] in "([{") - (words[end] in ")]}")
                if depth <= 0:
                    yield " ".join(words[at : end + 1])
                    break


def _recovered(code: str) -> Iterator[Sign]:
    imported, others = [], []
    for words in logical_lines(code):
        if words[0] == "from" and "import" in words:
            imported += words
            continue
        pieces = [t for text in (" ".join(words), " ".join(words) + " pass") if (t := parsed(text))][:1]
        if not pieces:
            others += [w for before, w in zip(words[:-1], words[1:], strict=True) if before in (".", "class")]
            pieces = [t for text in _calls(words) if (t := parsed(text))]
        others += [n for tree in pieces for n, kind in signs(tree) if kind in TELLING]
    for names, kind in ((imported, "import_symbol"), (others, "tolerant_syntax")):
        yield from ((n, kind) for n in names if n[:1].isascii() and n[:1].isupper())


def type_signals(code: str) -> list[dict]:
    """Types that a slice shows, with the kind of the first sign of each."""
    tree = tree_of(code.replace(MASK, HIDDEN))
    seen: dict[str, str] = {}
    for name, kind in _recovered(code.replace(MASK, HIDDEN)) if tree is None else signs(tree):
        leaf = leaf_of(name)
        if leaf != HIDDEN and is_type_name(leaf):
            seen.setdefault(leaf, kind)
    return [{"name": n, "kind": k} for n, k in seen.items()]
