"""Slices around annotation targets of a project: what a reader would look up to tell a type, with the label masked.

A `Project` parses each file once and answers by name: definitions of what is called, classes that a name may mean, callers.
"""

from __future__ import annotations

import ast
from collections import defaultdict
from collections.abc import Iterable

from . import code
from .names import ratio
from .signals import HIDDEN, type_signals
from .syntax import FUNCTIONS, MASK, dotted, leaf_of, parsed, walk

#: Statements that slices are made of (fixed values).
STATEMENTS = (ast.Assign, ast.AugAssign, ast.AnnAssign, ast.Expr, ast.Global, ast.Return)
#: Above this ratio a class's name is taken for a variable's (a fixed value).
LIKE = 0.78
#: Callers of a function that the slice of its return value shows; that of a parameter shows all.
CALLERS = 4
#: What a slice's reader is told of the form of an assignment (fixed values).
FORM_HINT, CLASS_HINT = "The type that initially passes static analysis is {}", "The possible type of target is a class"


class _Index:
    """Statements of a tree by the names in them, in the order of the text."""

    def __init__(self, tree: ast.AST):
        self.by_name: dict[str, list[ast.stmt]] = defaultdict(list)
        for node in walk(tree):
            if isinstance(node, STATEMENTS):
                for n in code.names_in(node):
                    self.by_name[n].append(node)

    def around(self, name: str, expand: bool) -> list[ast.stmt]:
        """Statements that name it; with expand also those of the names that its assignments read, and of what is assigned from it. A line once."""
        found = list(self.by_name.get(name, ()))
        if expand:
            for node in self.by_name.get(name, ()):
                if isinstance(node, ast.Assign):
                    given = {n for t in node.targets for n in code.names_in(t)}
                    others = code.names_in(node) if name in given or isinstance(node.value, ast.BinOp) else given
                    found += [s for n in sorted(others - {name}) for s in self.by_name[n]]
        lines: dict[int, ast.stmt] = {}
        for node in sorted(found, key=lambda s: s.lineno):
            lines.setdefault(node.lineno, node)
        return list(lines.values())


def _called(node: ast.stmt) -> list[str]:
    """The name that a statement calls, if it is a call or keeps what a call gives."""
    value = getattr(node, "value", None)
    return [leaf_of(dotted(value.func))] if isinstance(value, ast.Call) else []


class Project:
    def __init__(self, files: Iterable[tuple[str, str, str]]):
        """files: (path, module, source); those that don't parse are left out."""
        self.sources, self.trees = {}, {}
        self.functions: dict[str, list[dict]] = defaultdict(list)
        self.classes: list[tuple[str, str, str]] = []
        self.uses: dict[str, list[tuple[str, str]]] = defaultdict(list)
        self.resolved: set[str] = set()  # names of calls of which it is known whose they are
        self._texts: dict[str, _Index] = {}
        calls = []
        for path, module, source in files:
            tree = parsed(source)
            if tree is None:
                continue
            self.sources[path], self.trees[path] = source, tree
            for d in code.definitions(module, source):
                self.functions[d["name"]].append(d | {"path": path})
            self.classes += [(path, c["name"], c["signature"]) for c in code.classes(source)]
            calls += [(path, c) for c in code.call_sites(module, source)]
        known = {d["qualified_name"] for found in self.functions.values() for d in found}
        for path, c in calls:
            single = self.functions.get(c["name"], ())
            target = c["qualified_name"] if c["qualified_name"] in known else single[0]["qualified_name"] if len(single) == 1 else c["name"]
            self.uses[target].append((path, c["source_code"]))
            if target in known:
                self.resolved.add(c["name"])

    def definitions_of(self, names: Iterable[str]) -> list[str]:
        """Texts of the functions, then of the classes, that have the names."""
        out: dict[str, None] = {}
        for n in names:
            out.update((d["source_code"], None) for d in self.functions.get(n, ()))
            out.update((text, None) for _, name, text in self.classes if name == n)
        return list(out)

    def class_like(self, path: str, name: str) -> list[str]:
        """The class of the file, else one that it imports by name, whose name is most likely meant."""
        imported = {x["name"] or x["module"] for x in code.imports(self.sources[path])}
        for mine in ([c for c in self.classes if c[0] == path], [c for c in self.classes if c[1] in imported]):
            for _, n, text in mine:
                if n.lower() == name.lower() or ratio(n.lower(), name.lower()) > LIKE:
                    return [text]
        return []

    def statements(self, path: str) -> _Index:
        """Of a whole file, unpackings spread."""
        if path not in self._texts:
            self._texts[path] = _Index(parsed(code.split_unpacking(self.sources[path])))
        return self._texts[path]

    def callers(self, qualified: str, but: Iterable[str] = (), most: int | None = None) -> list[str]:
        """Definitions that callers use beside the function, the calls and the statements of their arguments; of the first `most` calls, if stated."""
        out: dict[str, None] = {}
        own, skipped = (f"def {leaf_of(qualified)}(", f"function {leaf_of(qualified)}("), set(but)
        leaf = leaf_of(qualified)
        uses = self.uses.get(qualified) or (self.uses.get(leaf, ()) if leaf not in self.resolved else ())
        for path, text in uses[:most]:
            call = parsed(text)
            given = {n for c in walk(call) if isinstance(c, ast.Call) for a in [*c.args, *(k.value for k in c.keywords)] for n in code.names_in(a)} if call else set()
            nodes = [s for n in sorted(given) for s in self.statements(path).around(n, False)]
            near = [d for d in self.definitions_of(n for s in nodes for n in _called(s)) if d not in skipped and not any(x in d for x in own)]
            out.update((x, None) for x in [*near, text, *(ast.unparse(s) for s in nodes)])
        return list(out)

    def imports(self, path: str) -> list[str]:
        return [ast.unparse(n) for n in walk(self.trees[path]) if isinstance(n, (ast.Import, ast.ImportFrom))]

    def target(self, path: str, function: str, line: int | None):
        """The function of a target with the classes around it, never by name alone if several have it; None if it isn't there."""
        holder = code._function(self.trees[path], function, line)
        around = next((outer for node, outer, _ in code.scoped(self.trees[path]) if node is holder), ())
        inside = {n.name for n in walk(self.trees[path]) if isinstance(n, ast.ClassDef)}
        return holder, ".".join(n for n in around if n in inside)

    def slice(self, path: str, scope: str, name: str, function: str = "", line: int | None = None) -> dict | None:
        """The slice of a variable (scope local), a parameter (arg) or a return value (return), and hints; None if the target isn't there."""
        if path not in self.trees:
            return None
        holder, owner = self.target(path, function, line) if function else (None, "")
        if function and holder is None or scope != "local" and holder is None:
            return None
        label = ".".join(filter(None, (owner, holder.name if holder is not None else "")))
        qualified = next((d["qualified_name"] for d in self.functions.get(holder.name, ()) if d["path"] == path and d["start"] == holder.lineno), label) if holder is not None else ""
        parts = self._variable(path, name, holder) if scope == "local" else self._parameter(path, name, holder, qualified) if scope == "arg" else self._returned(path, name, holder, qualified)
        if parts is None:
            return None
        texts, hints = parts
        made = "\n".join(dict.fromkeys(texts)).replace(HIDDEN, MASK)
        return {"slice": made, "hints": hints, "target_function": label, "qualified": qualified}

    def _variable(self, path: str, name: str, holder) -> tuple[list[str], list[str]] | None:
        tree = holder if holder is not None else self.trees[path]
        inner = {id(x) for n in walk(tree) if isinstance(n, FUNCTIONS) and n is not tree for x in walk(n)}
        for node in walk(tree):
            if isinstance(node, (ast.Assign, ast.AnnAssign, ast.AugAssign)) and id(node) not in inner:
                given = [dotted(x) for t in (node.targets if isinstance(node, ast.Assign) else [node.target]) for x in ([t, *t.elts] if isinstance(t, (ast.Tuple, ast.List)) else [t])]
                if name in given:
                    break
        else:
            return None
        known = {c[1] for c in self.classes}
        form = code.literal_type(node.value, known) if isinstance(node, ast.Assign) and len(given) == 1 else "Any"
        hints = [FORM_HINT.format(form)] * (form != "Any") + [CLASS_HINT] * form.startswith("class ")
        found = _Index(tree).around(name.partition(".")[0], True)
        labelled = [s for s in found if s.lineno == node.lineno and type(s) is type(node) or isinstance(s, ast.AnnAssign) and dotted(s.target) == name]
        texts = [code.masked_assignment(ast.unparse(s)) if s in labelled else ast.unparse(s) for s in found]
        return [*self.class_like(path, name), *self.imports(path), *self.definitions_of(n for s in found for n in _called(s)), *texts], hints

    def _masked(self, holder, name: str = "") -> str | None:
        """The function's text with the annotation of a parameter, or of what it returns, masked."""
        copy = parsed(ast.unparse(holder)).body[0]
        if not name:
            copy.returns = ast.Name(HIDDEN)
            return ast.unparse(copy)
        a = copy.args
        mine = [p for p in [*a.posonlyargs, *a.args, *a.kwonlyargs, *filter(None, (a.vararg, a.kwarg))] if p.arg == name]
        if not mine:
            return None
        mine[0].annotation = ast.Name(HIDDEN)
        return ast.unparse(copy)

    def _parameter(self, path: str, name: str, holder, qualified: str) -> tuple[list[str], list[str]] | None:
        text = self._masked(holder, name)
        if text is None:
            return None
        near = self.definitions_of(n for s in _Index(holder).around(name, True) for n in _called(s) if n != holder.name)
        return [*self.imports(path), *self.class_like(path, name), *near, text, *self.callers(qualified, near)], []

    def _returned(self, path: str, name: str, holder, qualified: str) -> tuple[list[str], list[str]] | None:
        if name != holder.name:
            return None
        near = self.definitions_of(dict.fromkeys(leaf_of(dotted(c.func)) for c in walk(holder) if isinstance(c, ast.Call) and dotted(c.func) and leaf_of(dotted(c.func)) != name))
        text = self._masked(holder)
        return [*self.imports(path), *near, text, *self.callers(qualified, near, CALLERS)], []


def shown_types(text: str) -> list[str]:
    return [x["name"] for x in type_signals(text)]
