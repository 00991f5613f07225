"""Similarities of texts, token sets and vectors, as expressions."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

#: BM25 parameters (fixed values).
K1, B = 1.5, 0.75
#: Inverse document frequency of a term that both of two documents hold.
IDF = math.log(1.2)


def tokens(c: Column) -> Column:
    """Words between white space; empty for a blank text."""
    return F.filter(F.split(c, r"\s+"), lambda x: x != "")


def over_words(a: Column, b: Column, term: Callable[[Column, Column], Column]) -> Column:
    """Sum of term(count in a, count in b) over the different words of two arrays, in one pass over both sorted together."""
    each = F.sort_array(F.concat(F.transform(a, lambda w: F.struct(w.alias("w"), F.lit(0).alias("side"))), F.transform(b, lambda w: F.struct(w.alias("w"), F.lit(1).alias("side")))))
    zero = F.lit(0.0)
    start = F.struct(F.lit(None).cast("string").alias("w"), zero.alias("x"), zero.alias("y"), zero.alias("total"))

    def step(held: Column, e: Column) -> Column:
        x, y = (F.when(e["side"] == k, 1.0).otherwise(0.0) for k in (0, 1))
        grown = F.struct(held["w"].alias("w"), (held["x"] + x).alias("x"), (held["y"] + y).alias("y"), held["total"].alias("total"))
        new = F.struct(e["w"].alias("w"), x.alias("x"), y.alias("y"), (held["total"] + term(held["x"], held["y"])).alias("total"))
        return F.when(held["w"] == e["w"], grown).otherwise(new)

    return F.aggregate(each, start, step, lambda held: held["total"] + term(held["x"], held["y"]))


def gain(count: Column, length: Column, other: Column) -> Column:
    """What a word that a document of a length holds `count` times gives a query of another length; the two are the corpus, so idf is a constant."""
    return F.lit(IDF * (K1 + 1)) * count / (count + F.lit(K1) * (F.lit(1 - B) + F.lit(2 * B) * length / (length + other)))


def _common(x: Column, y: Column, value: Column) -> Column:
    return F.when((x > 0) & (y > 0), value).otherwise(0.0)


def normalise_score(raw: Column, method: str = "saturate", c: float = 1.0, average: Column | None = None) -> Column:
    """A score of 0 or more brought into [0, 1): s/(s+c), 1-exp(-s/average), or a sigmoid that is 0 at 0."""
    if method == "exponential":
        return F.when(raw <= 0, 0.0).otherwise(1 - F.exp(-raw / (average if average is not None else F.lit(1.0))))
    if method == "sigmoid":
        return F.when(raw <= 0, 0.0).otherwise(2 / (1 + F.exp(-raw)) - 1)
    return F.when(raw <= 0, 0.0).otherwise(raw / (raw + c))


def bm25_raw(a: Column, b: Column) -> Column:
    """Mean of both directions, from token arrays; a repeated query word counts each time. Two empty arrays score 0."""
    def both(n: Column, m: Column) -> Column:
        return over_words(a, b, lambda x, y: _common(x, y, (x * gain(y, m, n) + y * gain(x, n, m)) / 2))

    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(both(F.size(a), F.size(b)))


def bm25(a: Column, b: Column, method: str = "saturate") -> Column:
    """As bm25_raw, normalised; two empty arrays are equal."""
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(normalise_score(bm25_raw(a, b), method))


def bm25_directed(query: Column, doc: Column) -> Column:
    """One direction, each different query term once, normalised; from lower-cased token arrays."""
    score = over_words(query, doc, lambda x, y: _common(x, y, gain(y, F.size(doc), F.size(query))))
    return F.when((F.size(query) == 0) | (F.size(doc) == 0), 0.0).otherwise(normalise_score(score))


def cleaned_pair(a: Column, b: Column) -> tuple[Column, Column]:
    """Both texts as the directed comparison takes them: marks set apart, and one bracket of each kind taken from one side only."""
    def both(x: Column) -> Column:
        x = F.regexp_replace(F.replace(x, F.lit("?"), F.lit("")), "\r\n", "")
        return F.regexp_replace(F.regexp_replace(x, r"([(<])", "$1 "), r"([)>])", " $1")

    def first_off(x: Column, marks: str) -> Column:
        for m in marks:
            x = F.regexp_replace(x, rf"(?s)^([^\{m}]*)\{m}", "$1")
        return x

    return first_off(both(a), "{("), first_off(both(b), "})")


def bm25_of_texts(a: Column, b: Column) -> Column:
    """Cleaned, directed, and a fifth of it if one text is over five times as long as the other."""
    x, y = cleaned_pair(a, b)
    score = bm25_directed(tokens(F.lower(x)), tokens(F.lower(y)))
    return F.when((F.length(x) > 5 * F.length(y)) | (F.length(y) > 5 * F.length(x)), score / 5).otherwise(score)


def bigrams(c: Column) -> Column:
    return let(F.regexp_replace(F.lower(c), r"\s+", ""), lambda s: F.when(F.length(s) < 2, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.length(s) - 1), lambda i: F.substring(s, i, F.lit(2)))))


def dice(a: Column, b: Column) -> Column:
    """Twice the common letter pairs, repeats counted, over all letter pairs; equal texts score 1."""
    x, y = F.regexp_replace(F.lower(a), r"\s+", ""), F.regexp_replace(F.lower(b), r"\s+", "")

    def common(p: Column, q: Column) -> Column:
        return over_words(p, q, F.least)

    score = let(bigrams(a), lambda p: let(bigrams(b), lambda q: 2.0 * common(p, q) / (F.size(p) + F.size(q))))
    return F.when(x == y, 1.0).when((F.length(x) < 2) | (F.length(y) < 2), 0.0).otherwise(score)


def levenshtein_ratio(a: Column, b: Column) -> Column:
    most = F.greatest(F.length(a), F.length(b))
    return F.when(most == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / most)


def code_tokens(c: Column) -> Column:
    """Identifiers and single marks of lower-cased code without comments."""
    bare = F.regexp_replace(F.lower(c), r"(//[^\n]*|/\*[\s\S]*?\*/)", "")
    return F.regexp_extract_all(bare, F.lit(r"([a-z_$][a-z0-9_$]*|\S)"), F.lit(1))


def jaccard(a: Column, b: Column) -> Column:
    """Of token arrays as sets; 0 for two empty ones."""
    common = F.size(F.array_intersect(a, b))
    return F.coalesce(F.try_divide(common.cast("double"), F.size(F.array_union(a, b))), F.lit(0.0))


def count_cosine(a: Column, b: Column) -> Column:
    """Cosine of word counts brought from [0, 1] to [0.5, 1]."""
    none = F.array().cast("array<string>")
    sizes = F.sqrt(over_words(a, none, lambda x, _: x * x)) * F.sqrt(over_words(none, b, lambda _, y: y * y))
    return (over_words(a, b, lambda x, y: x * y) / F.when(sizes == 0, 1.0).otherwise(sizes) + 1) / 2


def combined(a: Column, b: Column) -> Column:
    """0.4 edit distance, 0.3 token sets, 0.3 word counts."""
    x, y = code_tokens(a), code_tokens(b)
    return 0.4 * levenshtein_ratio(a, b) + 0.3 * jaccard(x, y) + 0.3 * count_cosine(x, y)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda t, x: t + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def masked_mean(vectors: Column, mask: Column) -> Column:
    """Mean over the vectors whose mask is 1; the divisor is at least 1. Array of arrays and array."""
    kept = F.filter(F.zip_with(vectors, mask, lambda v, m: F.when(m == 1, v)), lambda v: v.isNotNull())
    size = F.size(vectors[0])
    return F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.aggregate(kept, F.lit(0.0), lambda t, v: t + F.get(v, i).cast("double")) / F.greatest(F.size(kept), F.lit(1)))


def pad_left(ids: Column, width: Column, pad: Column) -> Column:
    return F.concat(F.array_repeat(pad, F.greatest(F.lit(0), width - F.size(ids))), ids)


def pad_right(values: Column, width: Column, pad: Column) -> Column:
    return F.concat(values, F.array_repeat(pad, F.greatest(F.lit(0), width - F.size(values))))
