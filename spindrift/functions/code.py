"""Analysis of Python source texts. Each function takes texts and gives plain rows; none reads files.

What the label of a target says is never read as a signal: the caller masks it first.
"""

from __future__ import annotations

import ast
import functools
import re
import sys
from collections.abc import Iterable, Iterator

from .signals import type_signals
from .syntax import FIELDS, FUNCTIONS, MASK, children, dotted, parsed, tree_of, type_names, walk  # noqa: F401  names in types are part of this module's interface

STATEMENTS = (ast.Assign, ast.AnnAssign, ast.AugAssign, ast.Expr, ast.Return, ast.If, ast.For, ast.While, ast.With, ast.Assert, ast.Raise, ast.Delete)
MOST_RECOMMENDATIONS = 120


def scoped(tree: ast.AST, outer: tuple[str, ...] = (), inside: str = "") -> Iterator[tuple[ast.AST, tuple[str, ...], str]]:
    """Every node with the names of the definitions around it and the class that it is directly in a function of."""
    todo = [(x, outer, inside) for x in reversed(children(tree))]
    while todo:
        node, outer, inside = found = todo.pop()
        yield found
        if inner := children(node):
            if isinstance(node, ast.ClassDef):
                outer, inside = (*outer, node.name), node.name
            elif isinstance(node, FUNCTIONS):
                outer = (*outer, node.name)
            todo += [(x, outer, inside) for x in reversed(inner)]


def parameters(args: ast.arguments, full: bool = True) -> list[str]:
    """Parameters as written; only their names if not full."""
    plain = [*args.posonlyargs, *args.args]
    defaults = [None] * (len(plain) - len(args.defaults)) + list(args.defaults)
    stars = [("*", args.vararg)] if args.vararg else []
    order = [("", a, d) for a, d in zip(plain, defaults, strict=True)] + [(s, a, None) for s, a in stars] + [("", a, d) for a, d in zip(args.kwonlyargs, args.kw_defaults, strict=True)]
    order += [("**", args.kwarg, None)] if args.kwarg else []
    out = []
    for star, a, default in order:
        text = star + a.arg
        if full and a.annotation:
            text += f": {ast.unparse(a.annotation)}"
        if full and default is not None:
            text += f" = {ast.unparse(default)}"
        out.append(text)
    return out


def annotated(node: ast.AST) -> bool:
    a = node.args
    return bool(node.returns or any(x.annotation for x in [*a.posonlyargs, *a.args, *a.kwonlyargs, *filter(None, (a.vararg, a.kwarg))]))


@functools.lru_cache(maxsize=8)
def _lines(source: str) -> list[str]:
    return re.findall(r"[^\r\n]*(?:\r\n|\n|\r)|[^\r\n]+", source)


def segment(source: str, node: ast.AST) -> str:
    """As ast.get_source_segment, which splits the whole text into lines for every node."""
    lines = _lines(source)[node.lineno - 1 : node.end_lineno]
    lines[-1] = lines[-1].encode()[: node.end_col_offset].decode()
    lines[0] = lines[0].encode()[node.col_offset :].decode()
    return "".join(lines)


@functools.lru_cache(maxsize=8)
def _functions_and_calls(source: str) -> list[tuple[ast.AST, tuple[str, ...], str]]:
    """Those of a text in their order with what scoped says of them, found once for all that is asked of a file."""
    tree = tree_of(source)
    todo, out = [(x, (), "") for x in reversed(children(tree))] if tree else [], []
    while todo:
        node, outer, inside = found = todo.pop()
        kind = node.__class__
        if kind is ast.Call:
            out.append(found)
        elif kind in FUNCTIONS:
            out.append(found)
            outer = (*outer, node.name)
        elif kind is ast.ClassDef:
            outer, inside = (*outer, node.name), node.name
        todo += [(x, outer, inside) for x in reversed(children(node)) if FIELDS[x.__class__]]  # the others hold no nodes and are no calls
    return out


def function_text(source: str, node: ast.AST) -> str:
    """The source of a function without annotations, else its signature."""
    if not annotated(node):
        return segment(source, node) or ast.unparse(node)
    back = f" -> {ast.unparse(node.returns)}" if node.returns else ""
    return f"function {node.name}({', '.join(parameters(node.args))}){back}"


def definitions(module: str, source: str) -> list[dict]:
    """Functions of all levels with qualified names."""
    return [
        {"name": n.name, "qualified_name": ".".join(filter(None, (module, *outer, n.name))), "class_name": inside, "start": n.lineno, "end": n.end_lineno, "source_code": function_text(source, n)}
        for n, outer, inside in _functions_and_calls(source)
        if isinstance(n, FUNCTIONS)
    ]


def call_sites(module: str, source: str) -> list[dict]:
    """Calls with the name as written, and the qualified name that self and cls stand for; super() stays as it is."""
    out = []
    for node, outer, inside in _functions_and_calls(source):
        if isinstance(node, ast.Call) and (name := dotted(node.func)):
            head, _, rest = name.partition(".")
            known = f"{module}.{inside}.{rest}" if head in ("self", "cls") and inside and rest else ""
            out.append({"name": name.rpartition(".")[2], "written": name, "qualified_name": known, "scope": ".".join(outer), "line": node.lineno, "source_code": ast.unparse(node)})
    return out


def alias_of(node: ast.AST) -> tuple[str, str] | None:
    """(name, value) of a type alias at module level."""
    if isinstance(node, getattr(ast, "TypeAlias", ())):
        return node.name.id, ast.unparse(node.value)
    if isinstance(node, ast.AnnAssign) and isinstance(node.target, ast.Name) and node.value is not None and dotted(node.annotation).rpartition(".")[2] == "TypeAlias":
        return node.target.id, ast.unparse(node.value)
    if isinstance(node, ast.Assign) and len(node.targets) == 1 and isinstance(node.targets[0], ast.Name) and node.targets[0].id[:1].isupper() and isinstance(node.value, (ast.Subscript, ast.BinOp)):
        return node.targets[0].id, ast.unparse(node.value)
    return None


def class_summary(node: ast.ClassDef) -> str:
    """Decorators, bases, fields and method signatures of a class, a line each."""
    bases = [*map(ast.unparse, node.bases), *(f"{k.arg}={ast.unparse(k.value)}" if k.arg else f"**{ast.unparse(k.value)}" for k in node.keywords)]
    lines = [*(f"@{ast.unparse(x)}" for x in node.decorator_list), f"class {node.name}{f'({", ".join(bases)})' if bases else ''}:"]
    if fields := [ast.unparse(x) for x in node.body if isinstance(x, (ast.Assign, ast.AnnAssign))]:
        lines += ["    # fields", *(f"    {x}" for x in fields)]
    methods = [f"def {x.name}({', '.join(parameters(x.args, False))}){f' -> {ast.unparse(x.returns)}' if x.returns else ''}:" for x in node.body if isinstance(x, FUNCTIONS)]
    if methods:
        lines += ["    # methods", *(f"    {x}" for x in methods)]
    return "\n".join(lines)


def classes(source: str) -> list[dict]:
    """Classes of all levels and type aliases, the latter as classes without a body."""
    tree = tree_of(source)
    if tree is None:
        return []
    out = [{"name": n.name, "kind": "class", "signature": class_summary(n), "bases": [b for x in n.bases if (b := dotted(x))]} for n in walk(tree) if isinstance(n, ast.ClassDef)]
    out += [{"name": a[0], "kind": "type_alias", "signature": f"class {a[0]}:\n    # type alias: {a[1]}", "bases": []} for n in tree.body if (a := alias_of(n))]
    return out


def imports(source: str) -> list[dict]:
    """Imported names of the module level, and whether the file uses them."""
    tree = tree_of(source)
    if tree is None:
        return []
    used = {n.id for n in walk(tree) if isinstance(n, ast.Name)}
    out = []
    for node in tree.body:
        if isinstance(node, ast.Import):
            out += [{"module": a.name, "name": "", "alias": a.asname, "used": (a.asname or a.name.partition(".")[0]) in used} for a in node.names]
        elif isinstance(node, ast.ImportFrom):
            out += [{"module": "." * node.level + (node.module or ""), "name": a.name, "alias": a.asname, "used": (a.asname or a.name) in used} for a in node.names]
    return out


#: Modules of the standard library of the Python that runs here.
STANDARD = sys.stdlib_module_names


def package_origin(module: str, local: set[str]) -> str:
    top = module.partition(".")[0]
    return "local" if module.startswith(".") or top in local else "stdlib" if top in STANDARD else "third_party"


def declared_classes(code: str) -> list[str]:
    """Names of classes and aliases in a slice; one that doesn't parse is searched for class lines."""
    if tree := tree_of(code):
        return [x["name"] for x in classes(code)] if tree.body else []
    return list(dict.fromkeys(re.findall(r"(?m)^\s*class\s+([A-Za-z_]\w*)", code)))


def names_in(node: ast.AST) -> set[str]:
    return {x.id for x in walk(node) if isinstance(x, ast.Name)}


def statement_index(source: str) -> list[dict]:
    """Variable, line and text of the statements that name it."""
    tree = tree_of(split_unpacking(source))
    nodes = [n for n in walk(tree) if isinstance(n, STATEMENTS)] if tree else []
    return [{"name": v, "line": n.lineno, "statement": ast.unparse(n)} for n in nodes for v in sorted(names_in(n))]


def statements_for(tree: ast.AST, name: str, expand: bool = True) -> list[tuple[int, str]]:
    """Statements that name a variable, a line once; for assignments to it also those of the names on the right."""
    nodes = [n for n in walk(tree) if isinstance(n, STATEMENTS)]
    mine = [n for n in nodes if name in names_in(n)]
    if expand:
        right = {v for n in mine if isinstance(n, (ast.Assign, ast.AnnAssign)) and n.value is not None for v in names_in(n.value)} - {name}
        mine += [n for n in nodes if isinstance(n, (ast.Assign, ast.AnnAssign)) and any(dotted(t) in right for t in (n.targets if isinstance(n, ast.Assign) else [n.target]))]
    first: dict[int, str] = {}
    for n in sorted(mine, key=lambda n: n.lineno):
        first.setdefault(n.lineno, ast.unparse(n))
    return sorted(first.items())


def _imports_text(tree: ast.Module) -> list[str]:
    return [ast.unparse(n) for n in tree.body if isinstance(n, (ast.Import, ast.ImportFrom))]


def _function(tree: ast.AST, name: str, line: int | None):
    same = [n for n in walk(tree) if isinstance(n, FUNCTIONS) and n.name == name]
    around = [n for n in same if line is not None and n.lineno <= line <= n.end_lineno]
    if around:
        return min(around, key=lambda n: (n.end_lineno - n.lineno, n.lineno))
    return same[0] if len(same) == 1 else None


def slice_of(source: str, scope: str, name: str, function: str = "", line: int | None = None, callers: Iterable[str] = ()) -> str | None:
    """The slice of a variable (scope local), a parameter (arg) or a return value (return); None if the target isn't there.

    A target's own annotation is masked in it.
    """
    tree = parsed(source)
    if tree is None:
        return None
    holder = _function(tree, function, line) if function else None
    if scope != "local" and holder is None:
        return None
    if holder is not None:
        for a in [*holder.args.posonlyargs, *holder.args.args, *holder.args.kwonlyargs]:
            if scope == "arg" and a.arg == name:
                a.annotation = ast.Name("MASKED_TYPE")
        if scope == "return":
            holder.returns = ast.Name("MASKED_TYPE")
    for n in walk(tree):
        if scope == "local" and isinstance(n, ast.AnnAssign) and dotted(n.target) == name:
            n.annotation = ast.Name("MASKED_TYPE")
    parts = _imports_text(tree)
    if scope == "local":
        parts += [text for _, text in statements_for(holder or tree, name)]
    else:
        parts.append(ast.unparse(holder))
        parts += callers
    return "\n".join(dict.fromkeys(parts)).replace("MASKED_TYPE", MASK)


def caller_context(source: str, function: str) -> list[str]:
    """Texts of calls to a function, each after the statements of its arguments."""
    tree = tree_of(source)
    out = []
    for n in walk(tree) if tree else ():
        if isinstance(n, ast.Call) and dotted(n.func).rpartition(".")[2] == function:
            given = {v for a in [*n.args, *(k.value for k in n.keywords)] for v in names_in(a)}
            before = [t for v in sorted(given) for line, t in statements_for(tree, v, False) if line < n.lineno]
            out.append("\n".join([*dict.fromkeys(before), ast.unparse(n)]))
    return out


#: What an expression of a form is taken for (fixed values).
FORMS = {ast.List: "List", ast.Tuple: "Tuple", ast.Set: "Set", ast.Dict: "Dict"}
CLASS_FORM, CALL_FORM, OTHER_FORM = "class {0}", "The return value of {0} or class {0}", "Any"


def literal_type(node: ast.AST, known: set[str] = frozenset()) -> str:
    """A guess from the form of an expression; sums and the like are taken for their first operand."""
    while isinstance(node, ast.BinOp):
        node = node.left
    if isinstance(node, ast.Constant):
        return type(node.value).__name__
    if isinstance(node, ast.Call) and isinstance(node.func, ast.Name):
        return (CLASS_FORM if node.func.id in known else CALL_FORM).format(node.func.id)
    return FORMS.get(type(node), OTHER_FORM)


def assigned_types(source: str) -> list[dict]:
    tree = tree_of(source)
    if tree is None:
        return []
    nodes = list(walk(tree))
    known = {n.name for n in nodes if isinstance(n, ast.ClassDef)}
    pairs = [(t, n) for n in nodes if isinstance(n, ast.Assign) for t in n.targets if isinstance(t, (ast.Name, ast.Attribute))]
    return [{"name": dotted(t).rpartition(".")[2], "line": n.lineno, "type": literal_type(n.value, known)} for t, n in pairs]


def _spread(statement: ast.stmt) -> list[ast.stmt]:
    """An unpacking as one assignment for each name, by index; another statement as it is, with what is inside it spread."""
    for field in ("body", "orelse", "finalbody"):
        if isinstance(inner := getattr(statement, field, None), list):
            setattr(statement, field, [x for s in inner for x in _spread(s)])
    for inner in (*getattr(statement, "handlers", ()), *getattr(statement, "cases", ())):
        inner.body = [x for s in inner.body for x in _spread(s)]
    match statement:
        case ast.Assign(targets=[ast.Tuple(elts=names) | ast.List(elts=names)], value=value) if names:
            return [ast.copy_location(ast.Assign([name], ast.Subscript(value, ast.Constant(k), ast.Load())), statement) for k, name in enumerate(names)]
    return [statement]


def split_unpacking(source: str) -> str:
    """Each name of an unpacking gets an assignment of its own; texts that don't parse stay."""
    tree = parsed(source)
    if tree is None:
        return source
    tree.body = [x for s in tree.body for x in _spread(s)]
    return ast.unparse(tree)


def self_fields(source: str) -> list[dict]:
    """Fields that methods read or write through self, for each class."""
    tree = tree_of(source)
    out = []
    for c in walk(tree) if tree else ():
        if isinstance(c, ast.ClassDef):
            for m in c.body:
                if isinstance(m, FUNCTIONS):
                    out += [{"class_name": c.name, "method": m.name, "field": n.attr, "line": n.lineno, "written": isinstance(n.ctx, ast.Store)} for n in walk(m) if isinstance(n, ast.Attribute) and dotted(n.value) == "self"]
    return out


class _Bare(ast.NodeTransformer):
    def visit_arg(self, node: ast.arg):
        node.annotation = None
        return node

    def visit_FunctionDef(self, node):
        node.returns = None
        return self.generic_visit(node)

    visit_AsyncFunctionDef = visit_FunctionDef

    def visit_AnnAssign(self, node: ast.AnnAssign):
        value = node.value if node.value is not None else ast.Constant(None)
        return ast.copy_location(ast.Assign([node.target], value), node)


def without_annotations(source: str) -> str:
    tree = parsed(source)
    return source if tree is None else ast.unparse(_Bare().visit(tree))


def masked_assignment(statement: str) -> str | None:
    """An assignment with its type masked; one in place stays; None for another statement."""
    tree = parsed(statement)
    match tree.body[0] if tree and tree.body else None:
        case ast.Assign(targets=targets, value=value):
            return f"{' = '.join(map(ast.unparse, targets))}: {MASK} = {ast.unparse(value)}"
        case ast.AnnAssign(target=target, value=value):
            return f"{ast.unparse(target)}: {MASK}" + (f" = {ast.unparse(value)}" if value is not None else "")
        case ast.AugAssign() as node:
            return ast.unparse(node)
    return None


def recommendations(code: str, project_types: Iterable[str] = ()) -> list[dict]:
    """Types that a slice shows, then those of the project that it names, at most MOST_RECOMMENDATIONS."""
    words = set(re.findall(r"[A-Za-z_]\w*", code))
    seen = {x["name"]: x["kind"] for x in type_signals(code)}
    for t in project_types:
        if t.rpartition(".")[2] in words:
            seen.setdefault(t.rpartition(".")[2], "project")
    return [{"name": n, "kind": k} for n, k in list(seen.items())[:MOST_RECOMMENDATIONS]]
