"""Similarities of names in plain Python, for use inside batches."""

from __future__ import annotations

import difflib


def ratio(a: str, b: str) -> float:
    """Ratcliff-Obershelp similarity of lower-cased texts."""
    return difflib.SequenceMatcher(None, a.lower(), b.lower()).ratio()


def fuzzy(a: str, b: str) -> float:
    """Equal names 1, one within the other 0.8 at least, else the ratio; case doesn't count."""
    x, y = a.lower(), b.lower()
    if x == y:
        return 1.0
    r = ratio(x, y)
    return max(r, 0.8) if x in y or y in x else r
