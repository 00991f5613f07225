"""Names of class-like declarations in texts, found by scanning words; nothing is parsed."""

from __future__ import annotations

from collections.abc import Iterator

#: Words that may stand before the keyword of a declaration, in this order, the keywords, and marks of a text that looks like a type (fixed values).
MODIFIERS = ("export", "default", "declare", "abstract")
KEYWORDS = ("class", "interface", "type", "enum")
TYPE_MARKS = "_$.<>[], |?"


def _skip_space(text: str, at: int) -> int:
    while at < len(text) and text[at].isspace():
        at += 1
    return at


def _past(text: str, at: int, words: tuple[str, ...]) -> int | None:
    """Where the next word begins if one of the words stands here, in any case."""
    for w in words:
        end = at + len(w)
        if text[at:end].lower() == w and text[end : end + 1].isspace():
            return _skip_space(text, end)
    return None


def _starts_name(c: str) -> bool:
    return c != "" and (c.isascii() and c.isalpha() or c in "_$")


def _name(text: str, at: int) -> str:
    end = at
    while end < len(text) and (text[end].isalnum() or text[end] in "_$."):
        end += 1
    name = text[at:end].rstrip("$.")
    return name if _starts_name(name[:1]) else ""


def heads(text: str, indented: bool = False) -> Iterator[tuple[int, str]]:
    """(start of the line, name) of each declaration that begins a line, with blanks before it only if indented."""
    at = 0
    while at >= 0:
        here = _skip_space(text, at) if indented else at
        for word in MODIFIERS:
            here = _past(text, here, (word,)) or here
        to = _past(text, here, KEYWORDS)
        if to is not None and (name := _name(text, to)):
            yield at, name
            here = to + len(name)
        line = text.find("\n", max(at, here) if to is not None else at)
        at = line + 1 if line >= 0 else -1


def looks_like_type(line: str) -> bool:
    return _starts_name(line[:1]) and all(c.isalnum() or c in TYPE_MARKS for c in line)


def declared(text: str) -> str:
    """The first declared name, else a first line that looks like a type, else empty."""
    for _, name in heads(text, indented=True):
        return name
    first = text.strip().partition("\n")[0].rstrip("\r")
    return first if looks_like_type(first) else ""


def declarations(section: str) -> list[dict]:
    """Each declaration up to the next; without any, each line that is not blank."""
    section = section.strip()
    found = list(heads(section))
    ends = [at for at, _ in found[1:]] + [len(section)]
    if found:
        return [{"name": name, "definition": section[at:end].strip()} for (at, name), end in zip(found, ends, strict=True)]
    lines = (line.strip(" \t,-") for line in section.splitlines())
    return [{"name": declared(line) or line, "definition": line} for line in lines if line]
