"""Declarations, calls and initializers of TypeScript texts, found lexically: comments and strings are blanked, brackets matched.

There is no TypeScript parser here; what needs a syntax tree (slicing) is left out.
"""

from __future__ import annotations

import re

NOISE = re.compile(r"//[^\n]*|/\*.*?\*/|'(?:\\.|[^'\\\n])*'|\"(?:\\.|[^\"\\\n])*\"|`(?:\\.|[^`\\])*`", re.S)
HEAD = re.compile(r"\b(?P<kind>class|interface|enum|function|type)\s+(?P<name>[A-Za-z_$][\w$]*)")
ARROW = re.compile(r"\bexport\s+const\s+(?P<name>[A-Za-z_$][\w$]*)\s*(?::[^=]+)?=\s*(?:async\s*)?\([^)]*\)\s*(?::[^=]+)?=>")
CALL = re.compile(r"(?P<new>\bnew\s+)?(?P<name>[A-Za-z_$][\w$]*(?:\.[A-Za-z_$][\w$]*)*)\s*(?:<[\w$,\s.\[\]|]*>)?\(")
NO_CALL = {"if", "for", "while", "switch", "catch", "function", "return", "typeof", "super", "constructor", "await"}


def blanked(source: str) -> str:
    """The text with comments and the insides of strings as blanks, all places unchanged."""
    return NOISE.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), source)


def closing(text: str, at: int) -> int:
    """The end of the bracket that opens at a place; the text's end if it doesn't close."""
    pairs, depth = {"{": "}", "(": ")", "[": "]"}, 0
    for i in range(at, len(text)):
        depth += (text[i] == text[at]) - (text[i] == pairs[text[at]])
        if depth == 0:
            return i + 1
    return len(text)


def declarations(source: str) -> list[dict]:
    """Classes, interfaces, enums, aliases, functions and exported arrow functions, with their texts."""
    plain, out = blanked(source), []
    for m in HEAD.finditer(plain):
        if m["kind"] == "type":
            if not re.match(r"\s*(?:<[^=]*>)?\s*=", plain[m.end() :]):
                continue
            end = m.end()
            while end < len(plain) and plain[end] not in ";\n":
                end = closing(plain, end) if plain[end] in "{([" else end + 1
        else:
            body = plain.find("{", closing(plain, plain.find("(", m.end())) if m["kind"] == "function" and "(" in plain[m.end() :] else m.end())
            end = closing(plain, body) if body >= 0 else len(plain)
        out.append({"name": m["name"], "kind": m["kind"], "line": plain.count("\n", 0, m.start()) + 1, "definition": source[m.start() : end].strip()})
    for m in ARROW.finditer(plain):
        body = re.match(r"\s*\{", plain[m.end() :])
        end = closing(plain, m.end() + body.end() - 1) if body else (plain.find("\n", m.end()) + 1 or len(plain) + 1) - 1
        out.append({"name": m["name"], "kind": "arrow", "line": plain.count("\n", 0, m.start()) + 1, "definition": source[m.start() : end].strip()})
    return sorted(out, key=lambda x: x["line"])


def calls(source: str) -> list[dict]:
    """Calls and constructions with their texts; declarations of functions and methods aren't calls."""
    plain, out = blanked(source), []
    for m in CALL.finditer(plain):
        end = closing(plain, m.end() - 1)
        before = plain[: m.start()].rstrip()
        if m["name"] in NO_CALL or re.search(r"\b(function|interface|class)$", before) or re.match(r"\s*(?::[^;={]*)?\{", plain[end:]):
            continue
        out.append({"name": m["name"], "kind": "new" if m["new"] else "call", "line": plain.count("\n", 0, m.start()) + 1, "code": source[m.start() : end]})
    return out


def initializer_type(text: str) -> str:
    """A guess from the form of an initializer."""
    t = text.strip().rstrip(";").strip()
    if re.fullmatch(r"-?\d[\d_.]*(e[+-]?\d+)?|0[xob][\da-fA-F_]+", t):
        return "number"
    if re.fullmatch(r"'.*'|\".*\"|`.*`", t, re.S):
        return "string"
    if t in ("true", "false"):
        return "boolean"
    if t in ("null", "undefined"):
        return t
    if t.startswith("["):
        return "Array"
    if t.startswith("{"):
        return "object"
    if made := re.match(r"new\s+([A-Za-z_$][\w$.]*)", t):
        return made[1]
    if re.match(r"(?:async\s*)?(?:\([^)]*\)|[A-Za-z_$][\w$]*)\s*=>|(?:async\s+)?function\b", t):
        return "Function"
    return "any"
