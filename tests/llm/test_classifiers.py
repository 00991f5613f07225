import random
import zlib

import numpy as np
import pytest

from spindrift.llm import language_id as L
from spindrift.llm import quality as Q

from .fixtures import docs, rows

SYLLABLES = {"en": ["the", "ing", "tion", "wh"], "de": ["ung", "sch", "ein", "über"], "ru": ["ство", "ние", "при", "ать"]}


def sentence(lang, n, r):
    return " ".join("".join(r.choice(SYLLABLES[lang]) for _ in range(r.randint(1, 3))) for _ in range(n))


def corpus():
    r = random.Random(4)
    return [(i, sentence(lang := r.choice(list(SYLLABLES)), r.randint(3, 60), r), lang, "s", 1) for i in range(400)]


@pytest.fixture(scope="module")
def model(spark):
    return L.fit(docs(spark, corpus()))


def test_held_out_accuracy(spark, model):
    truth = {r[0]: r[2] for r in corpus()}
    got = L.identify(docs(spark, corpus()), model).collect()
    assert sum(r.lang_pred == truth[r.doc_id] for r in got) >= 0.98 * len(got) and all(0 <= r.score <= 1 for r in got)


def test_spans_of_mixed_text(spark, model):
    r = random.Random(9)
    text = sentence("en", 20, r) + " " + sentence("de", 30, r) + " " + sentence("ru", 10, r)
    got = L.identify(docs(spark, [(1, text, None, None, None)]), model).first()
    assert [s.lang for s in got.spans] == ["en", "de", "ru"] and got.lang_pred == "de"
    assert abs(got.spans[0].end - 20) <= 1 and got.spans[-1].end == 60


def test_odd_texts(spark, model):
    data = [(1, None, "en", "s", 1), (2, "", "en", "s", 1), (3, "123 !!", "en", "s", 1), (4, "中文字", "en", "s", 1), (5, "the " * 9000, "en", "s", 1), (6, "thingtionthe" * 4000, "en", "s", 1), (6, "x", "en", "s", 1)]
    got = {(r.doc_id, r.lang_pred): r for r in L.identify(docs(spark, data), model).collect()}
    assert {(1, "und"), (2, "und"), (3, "und"), (5, "en"), (6, "en")} <= set(got)
    four = next(r for k, r in got.items() if k[0] == 4)
    assert four.lang_pred in SYLLABLES and four.score == 0
    assert L.identify(docs(spark, data).limit(0), model).count() == 0


def test_single_label_is_viterbis(model):
    r = random.Random(1)
    labeller = L.Labeller(model)
    for _ in range(200):
        words = sentence(r.choice(list(SYLLABLES)), r.randint(1, 12), r).split() + ["a1", "!!"] + (sentence("en", r.randint(0, 6), r).split())
        rows_ = labeller.numbers([words])[0]
        k = labeller.single(rows_)
        if k is not None:
            path = labeller.viterbi([rows_])[0]
            s = labeller.scores[rows_]
            cost = lambda p: s[np.arange(len(p)), p].sum() - L.SWITCH * (np.diff(p) != 0).sum()
            assert cost(np.full(len(path), k)) >= cost(path) - 1e-3


def test_viterbi_against_all_paths(model):
    import itertools

    labeller = L.Labeller(model)
    r = random.Random(2)
    for _ in range(20):
        words = sentence("en", 3, r).split() + sentence("de", 3, r).split()
        rows_ = labeller.numbers([words])[0]
        s = labeller.scores[rows_]
        cost = lambda p: s[np.arange(len(p)), list(p)].sum() - L.SWITCH * (np.diff(p) != 0).sum()
        best = max(cost(p) for p in itertools.product(range(len(model.languages)), repeat=len(words)))
        assert cost(labeller.viterbi([rows_])[0]) == pytest.approx(best, abs=1e-3)


def test_small_cache(monkeypatch, model):
    texts = [r[1] for r in corpus()[:50]]
    want = L.Labeller(model).label(texts)
    monkeypatch.setattr(L, "CACHED", 3000)
    labeller = L.Labeller(model)
    assert labeller.most < 20
    assert [x for t in texts for x in labeller.label([t])] == want


def brute_language(model, text):
    """(language, score) by the rules alone, word by word, in plain Python."""
    whole = (1 << 64) - 1

    def mixed(h):
        h ^= h >> 33
        h = h * 0xFF51AFD7ED558CCD & whole
        h ^= h >> 33
        h = h * 0xC4CEB9FE1A85EC53 & whole
        return h ^ (h >> 33)

    words = [w[i : i + 64] for w in (text or "").split() for i in range(0, len(w), 64)]
    names, rows, sizes = model.languages, [], []
    for w in words:
        letters = "".join(c for c in w if c.isalpha()).lower()
        script = L.script_of(letters) if letters else None
        may = [script in s for s in model.scripts]
        codes = [ord(c) for c in f" {letters} "]
        grams = [mixed(sum(codes[i] * mixed(i + 7) for i in range(len(codes))) & whole)]
        for k in (1, 2, 3):
            for i in range(len(codes) - k + 1):
                h = 0
                for j in range(k):
                    h = (h * L.BASE + codes[i + j] + j + 1) & whole
                grams.append(mixed(h))
        made = [sum(float(p[g % L.BUCKETS]) for g in grams) if u else -np.inf for p, u in zip(model.log_p, may)]
        rows.append([max(x - max(made), -L.AGAINST) for x in made] if any(may) else [0.0] * len(names))
        sizes.append((len(letters), any(may)))
    total = sum(n for n, _ in sizes)
    if not total:
        return "und", 0.0
    best, back = list(rows[0]), []
    for r in rows[1:]:
        top = max(range(len(names)), key=lambda k: best[k])
        back.append([k if best[k] >= best[top] - L.SWITCH else top for k in range(len(names))])
        best = [max(best[k], best[top] - L.SWITCH) + r[k] for k in range(len(names))]
    path = [max(range(len(names)), key=lambda k: best[k])]
    for b in reversed(back):
        path.append(b[path[-1]])
    held = [0] * len(names)
    for k, (n, known) in zip(reversed(path), sizes):
        held[k] += n * known
    k = max(range(len(names)), key=lambda k: held[k]) if any(held) else model.common
    return names[k], held[k] / total


def test_predictions_against_brute_force(spark, model):
    r = random.Random(12)
    texts = [sentence(r.choice(list(SYLLABLES)), r.randint(1, 25), r) for _ in range(60)]
    texts += [sentence("en", r.randint(1, 9), r) + " 12 " + sentence("ru", r.randint(1, 9), r) + " !! " + sentence("de", r.randint(0, 9), r) for _ in range(60)]
    texts += [None, "", "12 !", "中文", "the" * 50, "sch中文ung the"]
    got = {x.doc_id: x for x in L.identify(docs(spark, [(i, t, None, None, None) for i, t in enumerate(texts)]), model).collect()}
    for i, t in enumerate(texts):
        lang, score = brute_language(model, t)
        assert got[i].lang_pred == lang and got[i].score == pytest.approx(score, abs=1e-9), t


def test_ties_go_to_the_first_language(spark):
    texts = ["alpha beta gamma", "delta epsilon"]
    ids = iter(i for i in range(100) if zlib.crc32(str(i).encode()) % 4 != 2)
    data = [(next(ids), texts[0], lang, "s", 1) for _ in range(10) for lang in ("zz", "aa", "mm")]
    model = L.fit(docs(spark, data))
    assert {r.lang_pred for r in L.identify(docs(spark, [(1, "alpha beta", None, None, None), (2, texts[1], None, None, None)]), model).collect()} == {"aa"}


def test_many_languages(spark):
    data = [(4 * i + k, f"{chr(97 + i % 26)}{chr(97 + i // 26)}x " * 9, f"l{i:03}", "s", 1) for i in range(300) for k in range(4)]
    model = L.fit(docs(spark, data))
    assert len(model.languages) == 300
    got = L.identify(docs(spark, data), model).collect()
    truth = {r[0]: r[2] for r in data}
    assert sum(r.lang_pred == truth[r.doc_id] for r in got) >= 0.97 * len(got)
    with pytest.raises(ValueError):
        L.fit(docs(spark, data), languages=299)


def test_accepted(spark):
    d = docs(spark)
    kept = L.accepted(d)
    ids = [r.doc_id for r in kept.collect()]
    assert kept.columns == d.columns and 1 in ids and not {4, 5, 11} & set(ids) and len(ids) == len(rows()) - 3
    nothing = docs(spark, [(1, "abc", None, "s", 1), (2, None, None, "s", 1), (3, "12", None, "s", 1)])
    assert [r.doc_id for r in L.accepted(nothing).collect()] == [1]
    assert {r.lang_pred for r in L.identify(nothing, L.fit(nothing)).collect()} == {"und"}
    assert L.accepted(d.limit(0)).count() == 0


def quality_corpus():
    r = random.Random(8)
    out, labels = [], []
    for i in range(600):
        good = r.random() < 0.7
        text = sentence("en", 30, r).capitalize() + "." if good else sentence("en", 30, r).upper().replace(" ", "!! ")
        out.append((i, text, "en", "good.org" if good or r.random() < 0.1 else "bad.org", len(text)))
        if i % 3 == 0:
            labels.append((i, int(good), 0))
    return out, labels, {i: t[0] == t[0].upper() and "!!" not in t for i, t, *_ in out}


def test_cotraining_held_out(spark):
    data, labels, good = quality_corpus()
    lb = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = Q.score(docs(spark, data), Q.fit(docs(spark, data), lb)).collect()
    free = [r for r in got if r.doc_id % 3]
    assert sum(r.kept == good[r.doc_id] for r in free) >= 0.97 * len(free)
    assert sum((r.meta_score >= 0.5) == good[r.doc_id] for r in free) >= 0.85 * len(free)


def brute_odds(model, texts, metas):
    """Both views' log odds from dense rows, word by word in plain Python."""
    text, meta = np.zeros((len(texts), Q.FEATURES)), np.zeros((len(texts), Q.META))
    for i, (t, m) in enumerate(zip(texts, metas)):
        words = Q.words_in(t)
        for k, w in enumerate(words):
            for f in Q.features(w):
                text[i, f] += Q.SCALE / len(words)
            text[i, Q.REPEATS] += Q.SCALE / len(words) * (k > 0 and words[k - 1] == w)
        meta[i, Q.meta_features(m)] = 1
    return np.where([bool(Q.words_in(t)) for t in texts], model.text.odds(text), model.prior), model.meta.odds(meta)


def test_scores_against_brute_force(spark):
    data, labels, _ = quality_corpus()
    data += [(1000, None, None, None, None), (1001, "", "en", "s", 0), (1002, "the the the 文" * 3, "en", "bad.org", 7), (1003, "x" * 300, "en", "s", 1)]
    model = Q.fit(docs(spark, data), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    text, meta = brute_odds(model, [r[1] for r in data], [[r[3], r[2], r[4]] for r in data])
    got = {r.doc_id: r for r in Q.score(docs(spark, data).repartition(3), model).collect()}
    for r, t, m in zip(data, text, meta):
        x = got[r[0]]
        assert (x.text_score, x.meta_score, x.score) == pytest.approx((Q.Logistic.prob(t), Q.Logistic.prob(m), Q.Logistic.prob(t + m - model.prior)), abs=1e-5)
        assert x.kept == (x.score >= 0.5)


def test_pseudo_labels_come_from_all_rows(spark):
    data, labels, _ = quality_corpus()
    rows = Q.featured(docs(spark, data), "doc_id", "text", Q.META_COLS)
    model = Q.fit(docs(spark, data), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    text, meta = brute_odds(model, [r[1] for r in data], [[r[3], r[2], r[4]] for r in data])
    for n in (1, 6):
        for (x, y, w), odds in zip(Q.pseudo_labelled(rows.repartition(n), model), (meta, text)):  # a view learns from the other
            p = Q.Logistic.prob(odds)
            for label, sure in ((1, p >= Q.SURE), (0, 1 - p >= Q.SURE)):
                assert w[y == label].sum() == sure.sum() and len(x) <= 2 * Q.CELLS


def test_repeated_rows_train_once(spark):
    data, labels, _ = quality_corpus()
    lb = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    once, often = (Q.train(Q.featured(docs(spark, d), "doc_id", "text", Q.META_COLS), lb, rounds=0) for d in (data, data + [data[3]] * 500))
    assert np.allclose(once.text.w, often.text.w, atol=1e-6) and np.allclose(once.meta.w, often.meta.w, atol=1e-6)


def test_quality_odd_tables(spark):
    data, labels, _ = quality_corpus()
    schema = "doc_id long, quality int, toxic int"
    d, lb = docs(spark, data), spark.createDataFrame(labels + [(None, 1, 0), (3, None, 0), (9, 5, 0)], schema)
    odd = docs(spark)
    got = Q.score(odd, Q.fit(d, lb)).collect()
    assert len(got) == len(rows()) and all(0 <= r.score <= 1 for r in got)
    assert Q.score(odd.limit(0), Q.fit(d, lb)).count() == 0
    assert {r.score for r in Q.score(odd, Q.fit(d, lb.limit(0))).collect()} == {0.5}
    assert {r.score for r in Q.score(odd, Q.fit(d, lb.where("quality = 1"))).collect()} == {1.0}


def test_quality_of_texts_without_spaces(spark):
    """All begin with the same 81 characters; what makes the difference stands behind them."""
    r = random.Random(3)
    good, bad = ([chr(0x4E00 + k + i) for i in range(40)] for k in (0, 40))
    data = [(i, "文" * 81 + "".join(r.choice(good if i % 2 else bad) for _ in range(201)), "zh", "s", 1) for i in range(600)]
    d = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)], "doc_id long, quality int")
    got = Q.score(d, Q.fit(d, labels)).where("doc_id >= 300").collect()
    assert sum((x.text_score >= 0.5) == bool(x.doc_id % 2) for x in got) >= 0.95 * len(got)
