"""The most similar texts for each of a bounded set of query texts, with few of the similarities worked out.

A similarity of two texts can't be over a bound that their lengths and counts of letters give. Counts of a batch's different texts
are made once; for each query they are gone through by falling bound, until no bound reaches the last of the best so far. A
closer bound, from the longest common subsequence, is then worked out in a few operations on bits; where that one reaches, the
similarity itself is.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable

import numpy as np

#: Letters are counted in so many classes; letters that share one can only raise a bound.
CLASSES = 64
Bound = Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def letter_counts(texts: list[str]) -> np.ndarray:
    """Counts of each class of letters of lower-cased texts, a row for each."""
    out = np.zeros((len(texts), CLASSES), dtype=np.int32)
    for i, t in enumerate(texts):
        out[i] = np.bincount(np.frombuffer(t.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32) % CLASSES, minlength=CLASSES)
    return out


def ratio_bound(common: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """No more letters match than both have; two empty texts are equal."""
    return np.where(a + b > 0, 2 * common / np.maximum(a + b, 1), 1.0)


def fuzzy_bound(common: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """As ratio_bound, but a text whose letters the other has all may stand in it, which counts 0.8."""
    bound = ratio_bound(common, a, b)
    return np.where(common >= np.minimum(a, b), np.maximum(bound, 0.8), bound)


def letter_masks(text: str) -> dict[str, int]:
    """For each letter a number with a bit for each place where it stands."""
    out: dict[str, int] = {}
    for i, letter in enumerate(text):
        out[letter] = out.get(letter, 0) | 1 << i
    return out


def common_subsequence(masks: dict[str, int], size: int, text: str) -> int:
    """Length of the longest common subsequence with a text of that size, a row of the usual table held as bits.

    Blocks that a ratio matches stand in the same order in both texts, so they are no longer than that.
    """
    row = every = (1 << size) - 1
    for letter in text:
        hit = row & masks.get(letter, 0)
        row = ((row + hit) | (row - hit)) & every
    return size - row.bit_count()


class Texts:
    """Texts with their places, equal ones together."""

    def __init__(self, texts: list[str], places: list[int]):
        rows: dict[str, list[int]] = {}
        for t, p in zip(texts, places, strict=True):
            rows.setdefault(t, []).append(p)
        self.texts, self.places = list(rows), [sorted(p) for p in rows.values()]
        self.counts = letter_counts(self.texts)
        self.sizes = self.counts.sum(axis=1)

    def best(self, query: str, counts: np.ndarray, score: Callable[[str, str], float], bound: Bound, above: float, top: int, best: list[tuple[float, int, str]]) -> tuple[list[tuple[float, int, str]], int]:
        """The `top` best (-score, place, text) of these and of `best`, and how many similarities were worked out."""
        size, masks = int(counts.sum()), letter_masks(query.lower())
        most = bound(np.minimum(self.counts, counts).sum(axis=1), size, self.sizes)
        made = 0
        for i in np.argsort(-most, kind="stable").tolist():
            if most[i] <= above or (len(best) == top and most[i] < -best[-1][0]):
                break
            low = self.texts[i].lower()
            nearer = bound(common_subsequence(masks, size, low), size, len(low))
            if nearer <= above or (len(best) == top and nearer < -best[-1][0]):
                continue
            made += 1
            s = score(query, self.texts[i])
            if s > above:
                best = heapq.nsmallest(top, [*best, *((-s, p, self.texts[i]) for p in self.places[i][:top])])
        return best, made
