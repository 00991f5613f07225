"""Types in TypeScript notation: parsing to alternatives, exact and base match. The truth is the left side; neither relation is symmetric.

A text stands for a list of alternatives: a union for its members (and for each two object types together), an intersection
for none, an object type or function for every choice of its members' alternatives.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import combinations, product

#: Names of builtin types, and of those that are no objects (fixed values).
BUILTIN = {"number", "string", "boolean", "any", "void", "null", "undefined", "never", "object", "Object", "unknown", "symbol", "bigint"}
PRIMITIVE = {"number", "string", "boolean", "null", "undefined", "symbol", "bigint"}
#: Containers that are compared by their arguments (fixed values).
CONTAINERS = {"Array", "Record", "Promise", "Map", "Set"}
#: Texts of one mark that are no type (fixed values).
MARKS = set("?*-/|&^%$#@!~`:;,.<>")
#: Most alternatives that one object type or function may unfold into.
MOST = 4096


@dataclass(frozen=True)
class Type:
    """args: of containers and tuples; of objects (name, type). kind: builtin, user, function or tuple."""

    name: str
    kind: str = "builtin"
    args: tuple = ()
    keys: tuple = ()
    values: tuple = ()
    params: tuple = ()
    returns: Type | None = None

    def __str__(self) -> str:
        inner = ", ".join(map(str, self.args))
        if self.name == "Record" and self.keys and self.values:
            return f"Record<{self.keys[0]},{self.values[0]}>"
        if self.name == "Function" and (self.params or self.returns):
            return f"({', '.join(f'{n}: {t}' for n, t in self.params)}) => {self.returns}"
        if not self.args:
            return self.name
        if self.name == "object":
            return "{" + ", ".join(f"{n}: {t}" for n, t in self.args) + "}"
        if self.name in ("Union", "Optional", "Tuple"):
            return {"Union": " | ".join(map(str, self.args)), "Optional": f"{self.args[0]}?", "Tuple": f"[{inner}]"}[self.name]
        return f"{self.name}<{','.join(map(str, self.args))}>" if self.name in CONTAINERS else self.name

    @property
    def bare(self) -> bool:
        return not (self.args or self.keys or self.values)

    @property
    def open_function(self) -> bool:
        return self.name == "Function" and not self.params and not self.returns


ANY = Type("any")


def split(text: str, by: str, brackets: str = "<[{(>]})") -> list[str]:
    """Parts between separators outside all brackets. The `>` of an arrow counts as one, so unions of functions may be cut early."""
    half = len(brackets) // 2
    parts, depth, last = [], 0, 0
    for i, c in enumerate(text):
        if c in brackets[:half]:
            depth += 1
        elif c in brackets[half:]:
            depth -= 1
        elif c == by and depth == 0:
            parts.append(text[last:i])
            last = i + 1
    return [p for x in [*parts, text[last:]] if (p := x.strip())]


def unwrapped(text: str) -> str:
    """Without the round brackets around the whole."""
    while text.startswith("(") and text.endswith(")"):
        depth = 0
        for i, c in enumerate(text):
            depth += (c == "(") - (c == ")")
            if depth == 0:
                break
        if i != len(text) - 1:
            break
        text = text[1:-1].strip()
    return text


def settled(types: list[Type]) -> list[Type]:
    """any swallows the others; containers come last, each sort together."""
    if anys := [t for t in types if t.name == "any"]:
        return anys
    order = list(dict.fromkeys(t.name for t in types if t.name in CONTAINERS))
    return [t for t in types if t.name not in CONTAINERS] + [t for n in order for t in types if t.name == n]


def argument(text: str) -> Type | None:
    """The one type of an argument: a union of the members' first alternatives (any if one is), else the first alternative."""
    if "|" not in text:
        return next(iter(alternatives(text)), None)
    members = [t for p in split(unwrapped(text.strip()), "|") if (t := next(iter(alternatives(p)), None))]
    return (ANY if ANY.name in {t.name for t in members} else Type("Union", args=tuple(members))) if members else None


def _container(name: str, inner: str) -> list[Type]:
    parts = split(inner, ",")
    kind = next((c for c in CONTAINERS if c.lower() == name.lower()), None)
    if kind in ("Record", "Map"):
        key, value = (argument(p) for p in parts) if len(parts) == 2 else (ANY, ANY)
        if not key or not value:
            return []
        return [Type("Record", keys=(key,), values=(value,)) if kind == "Record" else Type("Map", args=(key, value))]
    if kind:
        if len(parts) != 1:
            return [Type(kind, args=(ANY,))]
        if "|" in parts[0] and (union := argument(parts[0])):
            return [Type(kind, args=(union,))]
        return [Type(kind, args=(t,)) for t in alternatives(parts[0])]
    return [Type(name, args=tuple(argument(p) or ANY for p in parts) or (ANY,))]


def _chosen(lists: list[list]) -> list[tuple]:
    size = 1
    for x in lists:
        size *= len(x)
    if size > MOST:
        raise ValueError(f"a type of {size} alternatives")
    return list(product(*lists))


def _function(inner: str, returned: str) -> list[Type]:
    back = alternatives(returned)
    if not back:
        return []
    names, choices = [], []
    for p in split(inner, ",", "<[(>])"):
        name, colon, text = p.partition(":")
        found = alternatives(text) if colon else []
        names.append(name.strip())
        choices.append(list(found[0].args) if len(found) == 1 and found[0].name == "Union" else found or [ANY])
    return [Type("Function", "function", params=tuple(zip(names, c, strict=True)), returns=back[0]) for c in _chosen(choices)]


def _object(inner: str) -> list[Type]:
    choices = []
    for p in split(inner.replace(";", ","), ","):
        name, colon, text = p.partition(":")
        if colon:
            bare = name.strip().removesuffix("?").strip()
            found: list = [(bare, t) for t in alternatives(text) or [ANY]]
            choices.append([*found, None] if name.strip().endswith("?") else found)
    made = [tuple(m for m in c if m) for c in _chosen(choices)]
    return [Type("object", args=m) for m in made if len({n for n, _ in m}) == len(m)]


def alternatives(text: str) -> list[Type]:
    text = text.strip()
    if not text or text in MARKS or not (text := unwrapped(text)):
        return []
    if arrow := re.match(r"^\((.*?)\)\s*=>\s*(.+)$", text):
        return settled(_function(*arrow.groups()))
    if text.startswith("[") and text.endswith("]"):
        return [Type("Tuple", "tuple", tuple(f[0] for p in split(text[1:-1], ",") if (f := alternatives(p))))]
    if "|" in text and (parts := split(text, "|")) != [text]:
        found = [t for p in parts for t in alternatives(p)]
        objects = [t for t in found if t.name == "object" and t.args]
        joined = [Type("object", args=a.args + b.args) for a, b in combinations(objects, 2)]
        return settled([*objects, *joined, *[t for t in found if t not in objects]])
    if generic := re.match(r"^(\w+)<(.+)>$", text):
        return settled(_container(generic[1][0].upper() + generic[1][1:], generic[2]))
    if "&" in text:
        return []
    if text.endswith("?"):
        if text[:-1] in BUILTIN:
            return [Type(text, "user")]
        return [Type("Optional", args=(f[0],)) for f in [alternatives(text[:-1])] if f]
    if text.endswith("[]"):
        return settled(_container("Array", text[:-2]))
    if text.startswith("{") and text.endswith("}"):
        return settled(_object(text[1:-1])) if text[1:-1].strip() else [Type("object")]
    if "." in text:
        return [Type(text.split("<")[0].strip(), "user")]
    if named := next((c for c in CONTAINERS if c.lower() == text.lower()), None):
        return [Type(named)]
    if text.lower() == "function":
        return [Type("Function", "function")]
    return [Type(text, "builtin" if text in BUILTIN else "user")]


def leaves(types: list[Type]) -> list[Type]:
    out: list[Type] = []
    for t in types:
        out += leaves(list(t.args)) if t.name == "Union" else [t]
    return settled(out)


def _last(name: str) -> str:
    return name.rpartition(".")[2]


def _same(a: tuple, b: tuple) -> bool:
    return len(a) == len(b) and all(identical(x, y) for x, y in zip(a, b, strict=True))


def identical(l: Type | None, r: Type | None) -> bool:  # noqa: E741
    """One type against one. Object on the left takes everything, object everything but primitives."""
    if l is None or r is None:
        return False
    if "Object" in (l.name, r.name):
        return l.name == "Object"
    if "object" in (l.name, r.name):
        return l.name == "object" and r.name not in PRIMITIVE
    if l.name == r.name == "Function":
        if l.open_function:
            return True
        full = l.params and r.params and l.returns and r.returns
        return bool(full) and [n for n, _ in l.params] == [n for n, _ in r.params] and _same(tuple(t for _, t in l.params), tuple(t for _, t in r.params)) and identical(l.returns, r.returns)
    if l.kind == r.kind == "user" and _last(l.name) == _last(r.name):
        return True
    if {l.name, r.name} == {"Tuple", "Array"}:
        return not (l if l.name == "Array" else r).args
    if l.name != r.name or l.kind != r.kind:
        return False
    if l.name in CONTAINERS:
        blank = all(t.name == "any" for x in (l, r) for t in (*x.args, *x.keys, *x.values))
        return blank or _same(l.args, r.args) and _same(l.keys, r.keys) and _same(l.values, r.values)
    if l.name == "Union":
        return set(map(str, l.args)) == set(map(str, r.args))
    if l.args or r.args:
        return _same(l.args, r.args)
    return l.kind == "builtin"


def _objects_identical(l: Type, r: Type) -> bool:  # noqa: E741
    """Object types by their properties, whatever the order; others as they are."""
    if l.name == r.name == "object" and l.args and r.args:
        a, b = dict(l.args), dict(r.args)
        return set(a) == set(b) and all(identical(a[n], b[n]) for n in a)
    return identical(l, r)


def exact(truth: list[Type], found: list[Type]) -> bool:
    """Whether the predicted alternatives are the true ones."""
    truth, found = settled(truth), settled(found)
    names = {t.name for t in found}
    if len(truth) == 1 and len(found) > 1:
        t = truth[0]
        if t.name == "object" and not names & PRIMITIVE:
            return True
        if t.name in CONTAINERS and names == {t.name} and not all(x.bare for x in found):
            return True
        if t.open_function and all(x.name == "Function" and not x.open_function for x in found):
            return True
    loose = any(t.name.lower() == "any" for t in truth)
    if "object" in names and not loose and all(t.name != "object" for t in truth):
        return False
    if loose or any(t.name.lower() == "any" for t in found):
        return loose
    if len(truth) == len(found) == 1:
        t, f = truth[0], found[0]
        if t.name == f.name and t.name in CONTAINERS and t.bare != f.bare:
            return t.bare
        if t.name == f.name == "Function" or {t.name, f.name} == {"Tuple", "Array"}:
            return identical(t, f)
        if t.name == f.name == "object" and t.args and f.args and str(t) != str(f):
            return _objects_identical(t, f)
        return str(t) == str(f) or identical(t, f)
    if {str(t) for t in truth} == {str(f) for f in found}:
        return True
    return bool(truth and found) and all(any(_objects_identical(t, f) for f in found) for t in truth) and all(any(_objects_identical(f, t) for t in truth) for f in found)


def included(l: Type | None, r: Type | None) -> bool:  # noqa: E741
    """Whether a predicted type is part of a true one: some argument in common is enough for containers."""
    if l is None or r is None:
        return False
    if "Object" in (l.name, r.name):
        return l.name == "Object"
    if l.name == r.name == "Function":
        if l.open_function:
            return True
        full = l.params and r.params and l.returns and r.returns
        return bool(full) and len(l.params) == len(r.params) and all(a == b and included(x, y) for (a, x), (b, y) in zip(l.params, r.params, strict=True)) and included(l.returns, r.returns)
    if l.name == "object" and r.name not in PRIMITIVE:
        return True
    if r.name == "object":
        return l.name in ("object", "any")
    if (l.name == "any") != (r.name == "any"):
        return False
    if {l.name, r.name} == {"Tuple", "Array"}:
        return True
    if l.name in CONTAINERS and r.name in CONTAINERS:
        return any(b.name == "any" or included(a, b) for x, y in ((l.args, r.args), (l.keys, r.keys), (l.values, r.values)) for a in x for b in y)
    if l.name == r.name:
        if l.name == "Union" and set(map(str, l.args)) & set(map(str, r.args)):
            return True
        return any(b.name != "any" and included(a, b) for a in l.args for b in r.args)
    if r.name == "Union":
        return any(included(l, b) for b in r.args)
    return r.name == "Optional" and bool(r.args) and included(l, r.args[0])


def _covered(f: Type, truth: list[Type]) -> bool:
    """A predicted leaf is covered by one that is identical, of the same name, or includes it."""
    for t in truth:
        if identical(f, t) or {f.name, t.name} == {"Tuple", "Array"}:
            return True
        if f.name.lower() == t.name.lower() and (f.name.lower() != "object" or not f.args and not t.args):
            return True
        if {f.name, t.name} <= {"number", "float", "int"} or f.kind == t.kind == "user" and _last(f.name) == _last(t.name):
            return True
    return any(included(t, f) for t in truth)


def base(truth: list[Type], found: list[Type]) -> bool:
    """Whether every predicted leaf is covered by some true leaf. A union of primitives and others on one side alone is no match."""
    if len(truth) == 1 and truth[0].name == "Function" and found and all(f.name == "Function" for f in found):
        if truth[0].open_function and not any(f.open_function for f in found):
            return True
        if not truth[0].open_function and all(f.open_function for f in found):
            return False
    if len(found) == 1 and len(truth) > 1 and found[0].open_function and all(t.name == "Function" and not t.open_function for t in truth):
        return False
    if len(truth) == 1 and len(found) == 1:
        t, f = truth[0], found[0]
        if f.name == "Union" or t.name == "Union":
            members = {x.name for x in (f if f.name == "Union" else t).args}
            return bool(members - PRIMITIVE) if t.name == "object" else not members & PRIMITIVE
    elif len(truth) == 1 and truth[0].name == "object" and found:
        return any(f.name not in PRIMITIVE for f in found)
    truth, found = leaves(truth), leaves(found)
    loose = any(t.name.lower() == "any" for t in truth)
    if any(f.name.lower() == "any" for f in found) and not loose:
        return False
    if any(f.name == "object" for f in found) and not loose and all(t.name != "object" for t in truth):
        return False
    if exact(truth, found):
        return True
    if len(truth) == len(found) == 1 and truth[0].name == found[0].name and truth[0].name in CONTAINERS and truth[0].bare != found[0].bare:
        return True
    return all(_covered(f, truth) for f in found)


def exact_match(truth: str, predicted: str) -> bool:
    return exact(alternatives(truth), alternatives(predicted))


def base_match(truth: str, predicted: str) -> bool:
    return base(alternatives(truth), alternatives(predicted))


def canonical(text: str) -> str:
    return " | ".join(map(str, alternatives(text)))
