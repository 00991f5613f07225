"""Functions that no built-in expresses, over Arrow batches."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import functions as F

from .declarations import declarations, declared
from .names import ratio
from .text import PROMPT_END, PROMPT_STARTS

NAMED = "array<struct<name: string, definition: string>>"
#: Fields of an object that may hold its definition (fixed values).
DEFINITION_FIELDS = ("definition", "code", "signature")


def prompt_section(prompt: str) -> str:
    for mark in PROMPT_STARTS:
        _, found, rest = prompt.partition(mark)
        if found:
            return rest.partition(PROMPT_END)[0]
    return ""


def canonical(name: str) -> str:
    return "".join(name.replace("typing.", "").split()).rpartition(".")[2].casefold()


def _told(raw: str | None) -> list:
    """Texts and objects of a field that holds JSON or a text."""
    try:
        value = json.loads(raw) if raw else []
    except ValueError:
        value = raw
    return value if isinstance(value, list) else [value]


def _records(item) -> list[dict]:
    """(name, definition, qualified_name) of an item of a recommendation field; items of another kind give none."""
    if isinstance(item, str):
        return declarations(item)
    if not isinstance(item, dict):
        return []
    definition = next((str(item[f]) for f in DEFINITION_FIELDS if item.get(f)), "")
    name = str(item.get("name") or declared(definition))
    return [{"name": name, "definition": definition or name, "qualified_name": item.get("qualified_name")}] if name else []


def recommendations(raw: str | None, prompt: str | None) -> list[dict]:
    """A JSON text, list of texts or list of objects, else what the prompt holds; of equal names the first."""
    found = [r for item in _told(raw) for r in _records(item)] or declarations(prompt_section(prompt or ""))
    first: dict[str, dict] = {}
    for r in found:
        qualified = r.get("qualified_name")
        if key := str(qualified or canonical(r["name"])).casefold():
            first.setdefault(key, {"name": r["name"], "definition": r["definition"], "qualified_name": qualified})
    return list(first.values())


def _udf(f, returns: str):
    """A function of columns; the UDF is made when it is first used, for that needs a session."""
    return lambda *columns: F.pandas_udf(f, returns, F.PandasUDFType.SCALAR)(*columns)


split_declarations = _udf(lambda s: pd.Series([declarations(x or "") for x in s]), NAMED)
normalize_recommendations = _udf(lambda raw, prompt: pd.Series([recommendations(x, y) for x, y in zip(raw, prompt, strict=True)]), "array<struct<name: string, definition: string, qualified_name: string>>")
sequence_ratio = _udf(lambda a, b: pd.Series([None if x is None or y is None else ratio(x, y) for x, y in zip(a, b, strict=True)]), "double")


def _surrounding(text, word, n):
    out = []
    for t, w, k in zip(text, word, n, strict=True):
        found, at = [], (t or "").find(w) if w else -1
        while at >= 0:
            found.append({"at": at, "context": t[max(0, at - k) : at + len(w) + k]})
            at = t.find(w, at + 1)
        out.append(found)
    return pd.Series(out)


#: Text around each match; matches may overlap.
surrounding_matches = _udf(_surrounding, "array<struct<at: int, context: string>>")


def _match(f):
    from . import type_algebra

    g = getattr(type_algebra, f)
    return _udf(lambda a, b: pd.Series([None if x is None or y is None else g(x, y) for x, y in zip(a, b, strict=True)], dtype="boolean"), "boolean")


def _canonical():
    from .type_algebra import canonical as g

    return _udf(lambda a: pd.Series([None if x is None else g(x) for x in a], dtype=object), "string")


exact_match, base_match, canonical_type = _match("exact_match"), _match("base_match"), _canonical()


def _of_type(f):
    """Lists of texts that the algebra gives for a type text."""

    def run(a):
        from . import type_algebra as t

        return pd.Series([None if x is None else [str(y) for y in getattr(t, f)(t.alternatives(x))] for x in a], dtype=object)

    return _udf(run, "array<string>")


leaf_types, settled_types = _of_type("leaves"), _of_type("settled")


def _parts(text, by):
    from .type_algebra import split, unwrapped

    return pd.Series([split(unwrapped(t), b) for t, b in zip(text, by, strict=True)], dtype=object)


#: Parts of a type text between separators outside brackets.
split_type = _udf(_parts, "array<string>")
