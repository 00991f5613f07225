"""A small reader of TypeScript: tokens with matched brackets, and from them scopes, declarations, statements and calls.

It knows what slicing needs and takes all else as expressions. Text that is not TypeScript gives odd nodes, never an error.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

TOKEN = re.compile(
    r"(?P<space>\s+|//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<text>'(?:\\.|[^'\\\n])*'?|\"(?:\\.|[^\"\\\n])*\"?|`(?:\\.|[^`\\])*`?)|(?P<number>\d[\w.]*)|(?P<name>[A-Za-z_$\u0080-￿][\w$]*)"
    r"|(?P<mark>=>|\.\.\.|\?\?=|\?\?|\?\.|===|!==|==|!=|<=|>=|&&=|\|\|=|&&|\|\||\+\+|--|\*\*|[-+*/%&|^]=|.)",
    re.S,
)
OPEN, CLOSE = {"(": ")", "[": "]", "{": "}"}, {")", "]", "}"}
MODIFIERS = {"export", "default", "declare", "abstract", "async", "public", "private", "protected", "static", "readonly", "override"}
#: Marks after which, or before which, a statement goes on in the next line.
GOES_ON_AFTER = {"=", "=>", ".", "?.", ",", "+", "-", "*", "/", "%", "&&", "||", "??", "?", ":", "(", "[", "{", "<", "|", "&", "==", "===", "!=", "!==", "+=", "-=", "of", "in", "extends", "implements", "new", "return", "await", "typeof", "as"}
GOES_ON_BEFORE = {".", "?.", ",", "+", "*", "/", "%", "&&", "||", "??", "?", ":", "=", "=>", ")", "]", "}", "|", "&", "==", "===", "!=", "!==", "+=", "-=", "of", "in", "extends", "implements", "as", "else", "catch", "finally"}
NOT_CALLED = {"if", "for", "while", "switch", "catch", "return", "typeof", "function", "super", "await", "new", "import"}


class Node:
    """kind: file, class, interface, enum, alias, function, method, arrow, block, parameter, variable, property, import, statement, return or call."""

    __slots__ = ("kind", "name", "start", "end", "parent", "children", "more")

    def __init__(self, kind: str, name: str, start: int, end: int, parent: Node | None, **more):
        self.kind, self.name, self.start, self.end, self.parent, self.children, self.more = kind, name, start, end, parent, [], more
        if parent is not None:
            parent.children.append(self)

    def walk(self) -> Iterator[Node]:
        left = [self]
        while left:
            node = left.pop()
            yield node
            left += reversed(node.children)

    def up(self, *kinds: str) -> Node | None:
        """The nearest of the kinds around the node."""
        node = self.parent
        while node is not None and node.kind not in kinds:
            node = node.parent
        return node

    def within(self, other: Node) -> bool:
        node = self.parent
        while node is not None and node is not other:
            node = node.parent
        return node is other


class File:
    def __init__(self, source: str):
        self.source = source
        found = [(m.lastgroup, m[0], m.start(), m.end()) for m in TOKEN.finditer(source) if m.lastgroup != "space"]
        self.kinds, self.texts, self.starts, self.ends = ([t[k] for t in found] for k in range(4))
        self.match: dict[int, int] = {}
        held: list[int] = []
        for i, t in enumerate(self.texts):
            if self.kinds[i] != "mark":
                continue
            if t in OPEN:
                held.append(i)
            elif t in CLOSE and held and OPEN[self.texts[held[-1]]] == t:
                at = held.pop()
                self.match[at], self.match[i] = i, at
        for i in held:
            self.match[i] = len(found)
        self.root = Node("file", "", 0, len(source), None)
        self._block(0, len(found), self.root)

    def text(self, node: Node) -> str:
        return self.source[node.start : node.end]

    # places of tokens
    def _t(self, i: int) -> str:
        return self.texts[i] if 0 <= i < len(self.texts) else ""

    def _end(self, i: int) -> int:
        """Where the text of the tokens before i ends."""
        return self.ends[min(i, len(self.ends)) - 1] if self.ends and i > 0 else 0

    def _start(self, i: int) -> int:
        return self.starts[i] if i < len(self.starts) else len(self.source)

    def _next(self, i: int) -> int:
        """The token after i, or after the bracket that opens there."""
        return self.match.get(i, i) + 1 if self._t(i) in OPEN else i + 1

    def _find(self, marks: set[str], i: int, hi: int) -> int:
        """The first of the marks outside brackets, hi if there is none."""
        while i < hi and self._t(i) not in marks:
            i = self._next(i)
        return min(i, hi)

    def _type_end(self, i: int, hi: int, stop: set[str]) -> int:
        """Where a type ends that begins at i: at one of the marks outside brackets of all kinds."""
        depth = 0
        while i < hi:
            t = self._t(i)
            if depth <= 0 and t in stop and not (t == "=" and depth):
                return i
            depth += (t == "<") - (t == ">")
            i = self._next(i) if t != "{" or self._t(i - 1) in (":", "|", "&", "<", ",", "(") else hi if "{" in stop else self._next(i)
        return hi

    def _statement_end(self, i: int, hi: int) -> int:
        """The token after a statement without its semicolon."""
        first = i
        while i < hi:
            t = self._t(i)
            if t == ";":
                return i
            if i > first and "\n" in self.source[self._end(i) : self._start(i)] and self._t(i - 1) not in GOES_ON_AFTER and t not in GOES_ON_BEFORE:
                return i
            i = self._next(i)
        return hi

    # statements
    def _block(self, i: int, hi: int, parent: Node) -> None:
        while i < hi:
            i = max(i + 1, self._statement(i, hi, parent))

    def _statement(self, i: int, hi: int, parent: Node) -> int:
        t, begin = self._t(i), i
        if t in (";", ","):
            return i + 1
        while self._t(i) in MODIFIERS and self.kinds[i] == "name" and self._t(i + 1) not in ("=", "(", ".", ":", ";", ",", "=>"):
            i += 1
        t = self._t(i)
        if t in ("class", "interface", "enum", "namespace", "module") and i + 1 < hi and (self.kinds[i + 1] == "name" or t == "class"):
            return self._type_like(begin, i, hi, parent)
        if t == "type" and i + 2 < hi and self.kinds[i + 1] == "name" and self._t(i + 2) in ("=", "<"):
            end = self._statement_end(i, hi)
            Node("alias", self._t(i + 1), self._start(begin), self._end(end), parent)
            return end
        if t == "function" and i + 1 < hi:
            at = i + 1 + (self._t(i + 1) == "*")
            named = self.kinds[at] == "name" if at < hi else False
            return self._function("function", self._t(at) if named else "", begin, at + named, hi, parent)
        if t in ("const", "let", "var"):
            return self._variables(begin, i + 1, self._statement_end(i, hi), parent)
        if t == "import" and self._t(i + 1) not in ("(", "."):
            end = self._statement_end(i, hi)
            Node("import", "", self._start(begin), self._end(end), parent, names=[x for x, k in zip(self.texts[i:end], self.kinds[i:end], strict=True) if k == "name"])
            return end
        if t == "{":
            block = Node("block", "", self._start(i), self._end(self._next(i)), parent)
            self._block(i + 1, self.match.get(i, hi), block)
            return self._next(i)
        if t in ("if", "for", "while", "switch", "with", "catch") and self._t(i + 1) in ("(", "await"):
            return self._controlled(i, hi, parent)
        if t in ("else", "do", "try", "finally") or t == "catch":
            return i + 1
        if t in ("case", "default"):
            return self._find({":"}, i, hi) + 1
        if i + 1 < hi and self.kinds[i] == "name" and self._t(i + 1) == ":" and parent.kind != "class":
            return i + 2
        end = self._statement_end(i, hi)
        kind = "return" if t == "return" else "statement"
        node = Node(kind, "", self._start(begin), self._end(end) + (self._t(end) == ";"), parent)
        self._expression(i + (kind == "return"), end, node)
        return end

    def _controlled(self, i: int, hi: int, parent: Node) -> int:
        at = i + 1 + (self._t(i + 1) == "await")
        lo, close = at + 1, self.match.get(at, hi)
        if self._t(lo) in ("const", "let", "var"):
            for_each = self._find({"of", "in"}, lo + 1, close)
            end = for_each if for_each < close else self._find({";"}, lo + 1, close)
            self._variables(lo, lo + 1, end, parent, self._end(close))
            lo = end + 1
        node = Node("statement", "", self._start(i), self._end(close + 1), parent, condition=True)
        self._expression(lo, close, node)
        return close + 1

    def _type_like(self, begin: int, i: int, hi: int, parent: Node) -> int:
        kind = self._t(i)
        named = self.kinds[i + 1] == "name" and self._t(i + 1) not in ("extends", "implements")
        body = i
        while body < hi and not (self._t(body) == "{" and self._t(body - 1) not in ("<", ",", "=", "&", "|")):
            body = self._next(body)
        end = self._next(body) if body < hi else hi
        node = Node(kind if kind in ("class", "interface", "enum") else "block", self._t(i + 1) if named else "", self._start(begin), self._end(end), parent)
        if kind == "class":
            self._members(body + 1, self.match.get(body, hi), node)
        elif kind in ("namespace", "module"):
            self._block(body + 1, self.match.get(body, hi), node)
        return end

    def _members(self, i: int, hi: int, parent: Node) -> None:
        while i < hi:
            begin = i
            while self._t(i) == "@":  # decorators
                i = self._find({"("}, i, min(i + 3, hi))
                i = self._next(i) if self._t(i) == "(" else i + 2
            while i < hi and self._t(i) in MODIFIERS | {"get", "set", "*"} and self._t(i + 1) not in ("(", "=", ":", ";", "?", "!"):
                i += 1
            if i < hi and (self.kinds[i] in ("name", "text", "number") or self._t(i) in ("#", "[")):
                name, at = (self._t(i + 1), i + 2) if self._t(i) == "#" else (self._t(i), self._next(i))
                at += self._t(at) in ("?", "!")
                if self._t(at) in ("(", "<"):
                    i = max(i + 1, self._function("method", name, begin, at, hi, parent))
                    continue
                end = self._statement_end(i, hi)
                given = self._type_end(at + 1, end, {"="}) if self._t(at) == ":" else at
                node = Node("property", name, self._start(begin), self._end(end), parent, type=self._span(at + 1, given) if self._t(at) == ":" else "", typed=(self._end(at + 1), self._end(given)) if self._t(at) == ":" else None)
                self._expression(given + 1, end, node)
                i = max(i + 1, end)
            else:
                i += 1

    def _span(self, i: int, j: int) -> str:
        return self.source[self._start(i) : self._end(j)] if j > i else ""

    def _function(self, kind: str, name: str, begin: int, i: int, hi: int, parent: Node) -> int:
        if self._t(i) == "<":
            while i < hi and self._t(i) != "(":
                i = self._next(i) if self._t(i) != "(" else i
        if self._t(i) != "(":
            return i + 1
        close = self.match.get(i, hi)
        after = close + 1
        returns, typed = "", None
        if self._t(after) == ":":
            end = self._type_end(after + 1, hi, {"{", ";", "=>"})
            returns, typed = self._span(after + 1, end), (self._end(after + 1), self._end(end))
            after = end
        node = Node(kind, name, self._start(begin), self._start(begin), parent, type=returns, typed=typed, head=self._end(close + 1), body=None, is_async="async" in self.texts[begin:i])
        self._parameters(i + 1, close, node)
        if self._t(after) == "{":
            end = self._next(after)
            node.more["body"] = Node("block", "", self._start(after), self._end(end), node)
            self._block(after + 1, self.match.get(after, hi), node.more["body"])
        else:
            end = after
        node.end = self._end(end)
        return end

    def _parameters(self, i: int, hi: int, owner: Node) -> None:
        while i < hi:
            end = self._find({","}, i, hi)
            at = i
            while self._t(at) in MODIFIERS | {"..."} and at + 1 < end:
                at += 1
            names = [self._t(at)] if self.kinds[at] == "name" else [x for x, k in zip(self.texts[at : self._next(at)], self.kinds[at : self._next(at)], strict=True) if k == "name"] if self._t(at) in OPEN else []
            colon = self._next(at)
            colon += self._t(colon) == "?"
            stop = self._type_end(colon + 1, end, {"="}) if self._t(colon) == ":" else colon
            for n in names or [""]:
                typed = (self._end(colon + 1), self._end(stop)) if self._t(colon) == ":" else None
                node = Node("parameter", n, self._start(i), self._end(end), owner, type=self._span(colon + 1, stop) if typed else "", typed=typed, name_end=self._end(colon))
            self._expression(stop + 1, end, node)
            i = end + 1

    def _variables(self, begin: int, i: int, hi: int, parent: Node, whole_end: int | None = None) -> int:
        """Variables of a statement; `whole` is its text."""
        whole = (self._start(begin), whole_end or self._end(hi))
        while i < hi:
            end = self._find({","}, i, hi)
            names = [self._t(i)] if self.kinds[i] == "name" else [x for x, k in zip(self.texts[i : self._next(i)], self.kinds[i : self._next(i)], strict=True) if k == "name"]
            colon = self._next(i)
            colon += self._t(colon) == "!"
            given = self._type_end(colon + 1, end, {"="}) if self._t(colon) == ":" else colon
            end = self._find({","}, given, hi) if given < hi else hi
            typed = (self._end(colon + 1), self._end(given)) if self._t(colon) == ":" else None
            node = Node("variable", names[0] if self.kinds[i] == "name" else self.source[self._start(i) : self._end(self._next(i))], self._start(i), self._end(end), parent, names=names, type=self._span(colon + 1, given) if typed else "", typed=typed, name_end=self._end(colon), whole=whole, init=self._span(given + 1, end) if self._t(given) == "=" else "")
            if self._t(given) == "=":
                self._expression(given + 1, end, node)
            i = end + 1
        return hi

    # expressions
    def _expression(self, i: int, hi: int, parent: Node) -> None:
        """Functions, arrows, calls and object members inside an expression."""
        while i < hi:
            t = self._t(i)
            if t == "function" and self.kinds[i] == "name":
                at = i + 1 + (self._t(i + 1) == "*")
                named = at < hi and self.kinds[at] == "name"
                i = max(i + 1, self._function("function", self._t(at) if named else "", i, at + named, hi, parent))
                continue
            arrow = self._arrow(i, hi)
            if arrow is not None:
                i = self._arrow_node(i, arrow, hi, parent)
                continue
            if t == "(" and self._called(i):
                first = self._callee(i)
                node = Node("call", self.source[self._start(first) : self._end(self._before_types(i))].strip(), self._start(first), self._end(self._next(i)), parent, new=self._t(first - 1) == "new", arguments=(self._start(i + 1), self._end(self.match.get(i, hi))))
                self._expression(i + 1, min(self.match.get(i, hi), hi), node)
                i = self._next(i)
                continue
            if t == "{":  # an object, or a block that is none
                self._expression(i + 1, min(self.match.get(i, hi), hi), parent)
                i = self._next(i)
                continue
            if t in ("(", "["):
                self._expression(i + 1, min(self.match.get(i, hi), hi), parent)
                i = self._next(i)
                continue
            i += 1

    def _before_types(self, i: int) -> int:
        """Where type arguments that end before i begin; i if there are none."""
        at, depth = i - 1, 0
        while at > 0 and (self.kinds[at] in ("name", "text") or self._t(at) in ("<", ">", ",", ".", "[", "]", "|")):
            depth += (self._t(at) == ">") - (self._t(at) == "<")
            if depth == 0:
                return at if self._t(at) == "<" and self.kinds[at - 1] == "name" else i
            at -= 1
        return i

    def _called(self, i: int) -> bool:
        if self._t(i - 1) == ">":
            return self._before_types(i) < i
        return i > 0 and (self.kinds[i - 1] == "name" and self._t(i - 1) not in NOT_CALLED or self._t(i - 1) in (")", "]"))

    def _callee(self, i: int) -> int:
        """The first token of what a bracket at i calls."""
        at = self._before_types(i) - 1
        while at >= 0:
            if self._t(at) in CLOSE:
                at = self._before_types(self.match.get(at, at))
                if at > 0 and (self.kinds[at - 1] == "name" and self._t(at - 1) not in NOT_CALLED or self._t(at - 1) in (")", "]")):
                    at -= 1
                    continue
            if self._t(at - 1) in (".", "?.", "!"):
                at -= 2
                continue
            return max(at, 0)
        return 0

    def _arrow(self, i: int, hi: int) -> int | None:
        """The place of the => of an arrow function that begins at i."""
        at = i + (self._t(i) == "async")
        if at < hi and self.kinds[at] == "name" and self._t(at + 1) == "=>":
            return at + 1
        if self._t(at) == "(":
            after = self.match.get(at, hi) + 1
            if self._t(after) == "=>":
                return after
            if self._t(after) == ":":
                end = self._type_end(after + 1, hi, {"=>", ",", ";", ")"})
                return end if end < hi and self._t(end) == "=>" else None
        return None

    def _arrow_node(self, i: int, arrow: int, hi: int, parent: Node) -> int:
        at = i + (self._t(i) == "async")
        body = arrow + 1
        end = self._next(body) if self._t(body) == "{" else self._find({",", ";"}, body, hi)
        name = parent.name if parent.kind in ("variable", "property") else ""
        typed = None
        if self._t(at) == "(" and self.match.get(at, hi) + 1 < arrow:
            typed = (self._end(self.match[at] + 2), self._end(arrow))
        node = Node("arrow", name, self._start(i), self._end(end), parent, type=self.source[typed[0] : typed[1]].strip() if typed else "", typed=typed, head=self._end(self.match[at] + 1) if self._t(at) == "(" else None, body=None, is_async=self._t(i) == "async")
        if self._t(at) == "(":
            self._parameters(at + 1, self.match.get(at, hi), node)
        else:
            Node("parameter", self._t(at), self._start(at), self._end(at + 1), node, type="", typed=None, name_end=self._end(at + 1))
        if self._t(body) == "{":
            node.more["body"] = Node("block", "", self._start(body), self._end(end), node)
            self._block(body + 1, self.match.get(body, hi), node.more["body"])
        else:
            self._expression(body, end, node)
        return max(end, i + 1)

    def tokens(self, start: int, end: int) -> range:
        """Numbers of the tokens that begin in a stretch of text."""
        return range(bisect_left(self.starts, start), bisect_left(self.starts, end))

    def uses(self, node: Node, name: str) -> list[int]:
        """Places of a name inside a node, not as a member's name or a key of an object."""
        out = []
        for i in self.tokens(node.start, node.end):
            if self.kinds[i] == "name" and self.texts[i] == name and self._t(i - 1) not in (".", "?."):
                if not (self._t(i + 1) == ":" and self._t(i - 1) in ("{", ",")):
                    out.append(self.starts[i])
        return out

    def names(self, start: int, end: int) -> list[str]:
        """Different names in a stretch of text, members' names left out."""
        return list(dict.fromkeys(self.texts[i] for i in self.tokens(start, end) if self.kinds[i] == "name" and self._t(i - 1) not in (".", "?.")))

    def at(self, place: int) -> Node:
        """The innermost node around a place."""
        node, inner = None, self.root
        while inner is not None:
            node, inner = inner, next((c for c in inner.children if c.start <= place < c.end), None)
        return node
