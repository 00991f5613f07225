"""The divergence audit against a plain version with Python's whole numbers."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from spindrift.llm import divergence
from spindrift.llm.common import Scratch

from .fixtures import docs


def plain(rows, min_docs=10):
    terms, n, group_n = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    groups = set()
    for _, text, lang, source, *_ in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
        terms[lang].update(set(found))
        n[lang].update(found)
        group_n[lang, source].update(found)
    out = []
    for lang, source in groups:
        kept = [t for t, k in terms[lang].items() if k >= min_docs]

        def shares(counts, kept=kept):
            total = sum(counts[t] for t in kept) + 2 * len(kept)
            return {t: 1 + 10**9 * (counts[t] + 2) // total for t in kept}

        def f(p, q):
            return (p - q) ** 2 // (p + q)

        mine, whole = shares(group_n[lang, source]), shares(n[lang])
        others = {s: shares(group_n[lang, s]) for k, s in groups if k == lang and s != source}
        pairs = sorted((-sum(f(mine[t], q[t]) for t in kept), s.encode(), s) for s, q in others.items())
        out += [(lang, source, "pair", s, -v, i + 1) for i, (v, _, s) in enumerate(pairs)]
        top = sorted((-f(mine[t], whole[t]), t.encode(), t) for t in kept if group_n[lang, source][t] and mine[t] > whole[t])[:10]
        out += [(lang, source, "term", t, -v, i + 1) for i, (v, _, t) in enumerate(top)]
    return sorted(out)


def found(spark, df, tmp_path):
    df.write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    return sorted((r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in divergence.query(spark, str(tmp_path)).collect())


def many(seed=1):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdeÉéß中\U0001f600") for _ in range(r.randint(1, 4))) for _ in range(60)]
    out = []
    for i in range(400):
        source = r.choice(["s0", "s0", "s0", "s1", "s2", "ſ3", None, ""])
        text = " ".join(r.choice(vocabulary[: 20 + 10 * (len(source or "") + (i % 3))]) + r.choice(["", "!", "\n", "\x00", "A", "_b"]) for _ in range(r.randint(0, 40)))
        out.append((i % 350 if i % 7 else None, None if i % 50 == 0 else text, r.choice(["en", "en", "de", None, "xx" if i % 40 == 0 else "en"]), source, 1))
    return out


@pytest.mark.parametrize("chunk", [1, 7, 1024])
def test_against_plain_version(spark, tmp_path, monkeypatch, chunk):
    monkeypatch.setattr(divergence, "CHUNK", chunk)
    monkeypatch.setattr(divergence, "BLOCK", 2)
    monkeypatch.setattr(divergence, "HELD", 30)
    monkeypatch.setattr(divergence, "PIECE", 5)
    rows = many()
    assert found(spark, docs(spark, rows), tmp_path) == plain(rows)


def test_nothing_kept_and_no_rows(spark, tmp_path):
    rows = [(1, "one two", "en", "a", 1), (2, None, "en", "b", 1), (2, None, "en", "b", 1), (3, "", None, None, 0)]
    assert found(spark, docs(spark, rows), tmp_path) == plain(rows) == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]
    assert found(spark, docs(spark, rows[:0]).limit(0), tmp_path) == []


def test_fixture_rows_one_document_each(spark):
    pairs, terms = divergence.audit(docs(spark), Scratch(spark), min_docs=1)
    groups = {(r[2] or "", r[3] or "") for r in docs(spark).select("doc_id", "text", "lang", "source").collect()}
    assert pairs.count() == sum(1 for a in groups for b in groups if a[0] == b[0] and a != b)
    assert {(r.lang, r.source) for r in terms.collect()} <= groups


def test_shares_are_exact():
    r = random.Random(4)
    for _ in range(2000):
        terms, total = r.randint(1, 10**6), r.randint(0, 9 * 10**15 - 10**7)
        count = r.randint(0, total)
        assert divergence._shares(np.array([count]), total, terms)[0] == 1 + 10**9 * (count + 2) // (total + 2 * terms)
    ids, n = np.array([0, 2, 2]), np.array([2**53 + 1, 2**60, 3])
    assert divergence._bincount(ids, n, 4).tolist() == [2**53 + 1, 0, 2**60 + 3, 0]


def test_a_pair_is_one_whichever_way_round_its_chunks_have_it(spark):
    rows = spark.createDataFrame([("x", "a", "b", 3), ("x", "b", "a", 4), ("x", "b", "c", 1), ("y", "a", "b", 9), ("x", "", "a", 2)], "lang string, source string, other string, value long")
    assert sorted(map(tuple, divergence.pair_sums(rows).collect())) == [("x", "", "a", 2), ("x", "a", "b", 7), ("x", "b", "c", 1), ("y", "a", "b", 9)]
