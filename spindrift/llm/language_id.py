"""Language identification with spans of mixed-language text.

Script ranges narrow the candidates of a word to the languages that use its script; a naive Bayes model over hashed
character n-grams scores the candidates; Viterbi with a penalty on each change of language labels the words of a text, and
runs of one label are spans. A text's language is the one with the most letters in its spans, its score that share of all
letters.

The model is fitted on at most `SAMPLE` labelled texts of each language (smallest hashes of doc_id); it holds languages x
`BUCKETS` numbers whatever the corpus, and over `LANGUAGES` languages are refused with an error. Every whole text is labelled,
over Arrow batches, without a shuffle; Viterbi runs over many texts at once, and only over those that no single label is sure
to fit best. What a worker keeps of words is bounded in bytes.

Defined cases: null texts and texts without a letter are `und` with score 0; with letters of unknown scripts only, a text
gets the commonest learned language and score 0; with nothing to learn from, all are `und`. Ties go to the language first in
order. Repeated rows are labelled one by one; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import bisect
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BASE, documents, fresh, frugal, latest_in_worker, mix, parts, share

#: Most texts of a language that the model is fitted on, and most languages that it can hold.
SAMPLE = 1000
LANGUAGES = 1024
BUCKETS = 1 << 15
#: Longer runs without white space are cut to pieces of this length.
WORD = 64
#: Cost of a change of language between two words, and the most by which one word can speak against a language.
SWITCH = 10.0
AGAINST = 6.0
#: Bytes of kept words with their scores, of a word without them, and of scores that are made at once.
CACHED = 48 << 20
WORD_BYTES = 250
MADE = 1 << 22
#: Words whose n-grams, and texts whose words, are held at once.
LEARN = 8192
TEXTS = 1024
#: A language uses a script if this share of its letters is of it.
USES = 0.01
#: Cells (words x texts x languages) of a Viterbi table.
CELLS = 1 << 22

#: First code points of blocks and the scripts they belong to (fixed values of the Unicode standard).
SCRIPTS = [
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"), (0x0600, "Arabic"),
    (0x0700, "Syriac"), (0x0750, "Arabic"), (0x0780, "Thaana"), (0x07C0, "Other"), (0x08A0, "Arabic"), (0x0900, "Devanagari"),
    (0x0980, "Bengali"), (0x0A00, "Gurmukhi"), (0x0A80, "Gujarati"), (0x0B00, "Oriya"), (0x0B80, "Tamil"), (0x0C00, "Telugu"),
    (0x0C80, "Kannada"), (0x0D00, "Malayalam"), (0x0D80, "Sinhala"), (0x0E00, "Thai"), (0x0E80, "Lao"), (0x0F00, "Tibetan"),
    (0x1000, "Myanmar"), (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Ethiopic"), (0x13A0, "Other"), (0x1780, "Khmer"),
    (0x1800, "Mongolian"), (0x18B0, "Other"), (0x1C80, "Cyrillic"), (0x1C90, "Georgian"), (0x1CC0, "Other"), (0x1D00, "Latin"),
    (0x1F00, "Greek"), (0x2000, "Latin"), (0x2C60, "Latin"), (0x2C80, "Other"), (0x2DE0, "Cyrillic"), (0x2E00, "Other"),
    (0x2E80, "Han"), (0x3040, "Kana"), (0x3100, "Han"), (0x3130, "Hangul"), (0x3190, "Han"), (0x31F0, "Kana"), (0x3200, "Han"),
    (0xA000, "Other"), (0xA640, "Cyrillic"), (0xA6A0, "Other"), (0xA720, "Latin"), (0xA800, "Other"), (0xAC00, "Hangul"),
    (0xD800, "Other"), (0xF900, "Han"), (0xFB00, "Latin"), (0xFB13, "Armenian"), (0xFB1D, "Hebrew"), (0xFB50, "Arabic"),
    (0xFE00, "Other"), (0xFE70, "Arabic"), (0xFF00, "Latin"), (0xFF66, "Kana"), (0xFFA0, "Hangul"), (0x10000, "Other"),
    (0x20000, "Han"), (0x33480, "Other"),
]
STARTS = [x for x, _ in SCRIPTS]


def script_of(letters: str) -> str:
    """The script of most letters, of ties the first."""
    if letters.isascii():
        return "Latin"
    return Counter(SCRIPTS[bisect.bisect(STARTS, ord(c)) - 1][1] for c in letters).most_common(1)[0][0]


def words_in(text: str) -> list[str]:
    words = text.split()
    if any(len(x) > WORD for x in words):
        words = [x[i : i + WORD] for x in words for i in range(0, len(x), WORD)]
    return words


def letters_of(word: str) -> str:
    return word.lower() if word.isalpha() else "".join(filter(str.isalpha, word)).lower()


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(number of the word, bucket) of each character n-gram of one to three, a blank before and after the word, and of the word itself."""
    codes = np.frombuffer("".join([f" {x} " for x in words]).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    sizes = np.array([len(x) + 2 for x in words])
    word, start = np.repeat(np.arange(len(words)), sizes), np.concatenate(([0], np.cumsum(sizes)[:-1]))
    numbers, hashes = [], []
    h = np.zeros(len(codes), dtype=np.uint64)
    for k in range(3):
        n = len(codes) - k
        h = h[:n] * np.uint64(BASE) + codes[k:] + np.uint64(k + 1)
        inside = word[:n] == word[k:]
        numbers.append(word[:n][inside])
        hashes.append(h[inside])
    place = np.arange(len(codes)) - start[word]
    whole = np.add.reduceat(codes * mix(place.astype(np.uint64) + np.uint64(7)), start) if len(words) else np.zeros(0, dtype=np.uint64)
    numbers.append(np.arange(len(words)))
    hashes.append(whole)
    return np.concatenate(numbers), (mix(np.concatenate(hashes)) & np.uint64(BUCKETS - 1)).astype(np.int64)


class Model:
    """languages in order; log_p: languages x BUCKETS; scripts: of each language; common: number of the commonest language."""

    def __init__(self, languages: list[str], log_p: np.ndarray, scripts: list[set[str]], common: int):
        self.languages, self.log_p, self.scripts, self.common, self.version = languages, log_p, scripts, common, uuid.uuid4().hex


class Labeller:
    def __init__(self, model: Model):
        self.model, self.rows = model, {}
        n = len(model.languages)
        self.scores, self.letters, self.known = np.zeros((1024, n), dtype=np.float32), np.zeros(1024, dtype=np.int64), np.zeros(1024, dtype=bool)
        self.uses: dict[str, np.ndarray] = {}
        self.most = max(1, CACHED // (WORD_BYTES + 4 * n))
        self.at_once = max(64, min(LEARN, MADE // (8 * max(1, n))))

    def learn(self, words: list[str]) -> None:
        """Rows of scores of words not seen yet, so many at a time that their n-grams stay small."""
        for i in range(0, len(words), self.at_once):
            self._learn(words[i : i + self.at_once])

    def _learn(self, words: list[str]) -> None:
        at, n = len(self.rows), len(words)
        if at + n > len(self.scores):
            size = max(min(2 * len(self.scores), at + n + self.most // 4), at + n)
            for name in ("scores", "letters", "known"):
                old = getattr(self, name)
                new = np.zeros((size, *old.shape[1:]), dtype=old.dtype)
                new[:at] = old[:at]
                setattr(self, name, new)
        self.rows.update(zip(words, range(at, at + n), strict=True))
        letters = [letters_of(x) for x in words]
        self.letters[at : at + n] = [len(x) for x in letters]
        uses = np.array([self.users(x) for x in letters])
        number, bucket = features(letters)
        made = np.column_stack([np.bincount(number, weights=p[bucket], minlength=n) for p in self.model.log_p])
        made[~uses] = -np.inf
        some = uses.any(axis=1)
        self.known[at : at + n] = some
        self.scores[at : at + n] = 0
        self.scores[at : at + n][some] = np.maximum(made[some] - made[some].max(axis=1, keepdims=True), -AGAINST)

    def users(self, letters: str) -> np.ndarray:
        """Which languages use the script of a word; none does without letters."""
        script = script_of(letters) if letters else ""
        if (uses := self.uses.get(script)) is None:
            uses = self.uses[script] = np.array([script in s for s in self.model.scripts], dtype=bool)
        return uses

    def numbers(self, texts: list[list[str]]) -> list[np.ndarray]:
        """Row numbers of words. What was kept goes before it grows over its bound; the texts of one call stay together."""
        rows = self.rows
        new = {x: None for words in texts for x in words if x not in rows}
        if len(rows) + len(new) > self.most and rows:
            rows.clear()
            self.scores, self.letters, self.known = self.scores[:1024].copy(), self.letters[:1024].copy(), self.known[:1024].copy()
            new = {x: None for words in texts for x in words}
        self.learn(list(new))
        return [np.fromiter(map(rows.__getitem__, words), dtype=np.int64, count=len(words)) for words in texts]

    def single(self, rows: np.ndarray) -> int | None:
        """The language of all words if one label is sure to be Viterbi's: no stretch speaks for another language by over half a change.

        A path of k stretches in other languages changes k - 1 times at least, k times if it also has stretches in this one,
        and k halves of a change never exceed that for k of two or more; for one, this language has the best sum.
        """
        s = self.scores[rows].astype(np.float64)
        best = int(s.sum(axis=0).argmax())
        run = np.zeros((len(s) + 1, s.shape[1]))
        np.cumsum(s - s[:, best : best + 1], axis=0, out=run[1:])
        return best if (run - np.minimum.accumulate(run, axis=0)).max() <= SWITCH / 2 else None

    def viterbi(self, texts: list[np.ndarray]) -> list[np.ndarray]:
        """The label of each word of each text; texts come longest first."""
        n, size = len(texts), len(self.model.languages)
        lengths = np.array([len(x) for x in texts])
        most = int(lengths[0])
        word = np.zeros((most, n), dtype=np.int64)
        for i, x in enumerate(texts):
            word[: len(x), i] = x
        active = np.searchsorted(-lengths, -np.arange(most), side="left")  # texts longer than t
        stay, came = np.zeros((most, n, size), dtype=bool), np.zeros((most, n), dtype=np.int16)
        best = self.scores[word[0]].astype(np.float64)
        each = np.arange(n)
        for t in range(1, most):
            k = active[t]
            now = best[:k]
            top = now.argmax(axis=1)
            change = now[each[:k], top][:, None] - SWITCH
            stay[t, :k] = now >= change
            came[t, :k] = top
            best[:k] = np.maximum(now, change) + self.scores[word[t, :k]]
        label = np.zeros((most, n), dtype=np.int16)
        at = best.argmax(axis=1)
        for t in range(most - 1, -1, -1):
            k = active[t]
            label[t, :k] = at[:k]
            at[:k] = np.where(stay[t, each[:k], at[:k]], at[:k], came[t, :k]) if t else at[:k]
        return [label[: len(x), i] for i, x in enumerate(texts)]

    def label(self, texts: list[str | None]) -> list[tuple[str, float, float, list[tuple[str, int, int]]]]:
        """(language, score, share of letters of known scripts, spans as (language, first word, end word)) of each text."""
        names = self.model.languages
        if not names:
            return [("und", 0.0, 0.0, []) for _ in texts]
        out: list = [("und", 0.0, 0.0, [])] * len(texts)
        order, at = sorted(range(len(texts)), key=lambda i: -len(texts[i] or "")), 0
        while at < len(order):
            some: list[int] = []
            words: list[list[str]] = []
            while at < len(order):
                w = words_in(texts[order[at]] or "")
                if words and (len(words) + 1) * max(len(words[0]), len(w)) * len(names) > CELLS:
                    break
                some.append(order[at])
                words.append(w)
                at += 1
            numbers = self.numbers(words)
            pairs = sorted((p for p in zip(some, numbers, strict=True) if len(p[1])), key=lambda p: -len(p[1]))
            if not pairs:
                continue
            sure = [self.single(r) for _, r in pairs]
            rest = [r for (_, r), k in zip(pairs, sure, strict=True) if k is None]
            found = iter(self.viterbi(rest) if rest else ())
            for (i, rows), k in zip(pairs, sure, strict=True):
                labels = next(found) if k is None else np.full(len(rows), k)
                letters = self.letters[rows]
                total = int(letters.sum())
                if not total:
                    continue
                known = letters * self.known[rows]
                held = np.bincount(labels, weights=known, minlength=len(names))
                cuts = np.flatnonzero(np.diff(labels)) + 1
                spans = [(names[labels[a]], int(a), int(b)) for a, b in zip([0, *cuts], [*cuts, len(labels)], strict=True)]
                share_known = float(known.sum()) / total
                best = int(held.argmax()) if share_known else self.model.common
                out[i] = (names[best], float(held[best]) / total, share_known, spans)
        return out


def held_out(id_column: Column) -> Column:
    """Rows that nothing is learned from."""
    return F.pmod(F.crc32(F.coalesce(id_column.cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE, languages: int = LANGUAGES) -> Model:
    """Learn from rows with a text and a language that are not held out. Raises if there are more languages than `languages`."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    counts = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(languages + 1).collect()
    if len(counts) > languages:
        raise ValueError(f"over {languages} languages; merge rare values of {lang_col} or raise the bound")
    names = sorted(r["lang"] for r in counts)
    if not names:
        return Model([], np.zeros((0, BUCKETS), dtype=np.float32), [], 0)
    first = Window.partitionBy("lang").orderBy("h", "doc_id")
    # hashes up to here are enough for the sample, so only as many rows meet in the window
    low = docs.sparkSession.createDataFrame([(r["lang"], 2.0**32 * min(1.0, (2 * sample + 100) / r["n"])) for r in counts], "lang string, low double")
    chosen = rows.select("lang", "doc_id", share(F.col("doc_id")).alias("h")).join(F.broadcast(low), "lang").where(F.col("h") <= F.col("low")).withColumn("k", F.row_number().over(first)).where(F.col("k") <= sample)
    chosen = F.broadcast(chosen.select("doc_id", F.col("lang").alias("chosen_lang")).distinct())  # at most sample x languages ids
    texts = rows.join(chosen, rows["doc_id"].eqNullSafe(chosen["doc_id"]) & (rows["lang"] == chosen["chosen_lang"])).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, Counter] = {}
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                seen.setdefault(lang, Counter()).update(words_in(text))
        for lang, words in seen.items():
            scripts: Counter = Counter()
            letters: Counter = Counter()
            for word, n in words.items():
                if x := letters_of(word):
                    letters[x] += n
                    scripts[script_of(x)] += n * len(x)
            grams, names, times = np.zeros(BUCKETS), list(letters), np.fromiter(letters.values(), dtype=np.float64, count=len(letters))
            for i in range(0, len(names), LEARN):
                number, bucket = features(names[i : i + LEARN])
                grams += np.bincount(bucket, weights=times[i:][number], minlength=BUCKETS)
            grams = grams.astype(np.int64)
            used = np.flatnonzero(grams)
            keys, values = [*used.tolist(), *(f"{x}" for x in scripts)], [*grams[used].tolist(), *scripts.values()]
            yield pa.RecordBatch.from_pydict({"lang": [lang] * len(keys), "gram": [str(x) for x in keys], "n": pa.array(values, pa.int64())})

    sums = texts.mapInArrow(frugal(count), "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # a row a language, of at most BUCKETS counts and those of its scripts; one is on the driver at a time
    found = sums.groupBy("lang").agg(F.collect_list("gram").alias("grams"), F.collect_list("n").alias("times"))
    log_p = np.full((len(names), BUCKETS), -np.log(BUCKETS), dtype=np.float32)
    scripts = [Counter() for _ in names]
    at = {x: i for i, x in enumerate(names)}
    for lang, grams, times in found.toLocalIterator():
        table = np.zeros(BUCKETS)
        for gram, n in zip(grams, times, strict=True):
            if gram.isdigit():
                table[int(gram)] = n
            else:
                scripts[at[lang]][gram] = n
        log_p[at[lang]] = np.log((table + 0.5) / (table.sum() + 0.5 * BUCKETS))
    uses = [{s for s, n in c.items() if n >= USES * sum(c.values())} for c in scripts]
    common = at[counts[0]["lang"]]
    return Model(names, log_p, uses, common)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, known, spans), a row for each row of docs; spans count words between white space."""
    chosen = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    held = docs.sparkSession.sparkContext.broadcast(model)
    version = model.version

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = latest_in_worker("language", version, lambda: Labeller(held.value))
        kind = pa.list_(pa.struct([("lang", pa.string()), ("first", pa.int32()), ("end", pa.int32())]))
        for b in parts(batches, 1, 1 << 20, TEXTS):
            found = labeller.label(b.column(1).to_pylist())
            spans = pa.array([[{"lang": x, "first": i, "end": j} for x, i, j in r[3]] for r in found], kind)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([r[0] for r in found], pa.string()), pa.array([r[1] for r in found], pa.float64()), pa.array([r[2] for r in found], pa.float64()), spans],
                ["doc_id", "lang_pred", "score", "known", "spans"],
            )

    kind = chosen.schema["doc_id"].dataType.simpleString()
    return chosen.mapInArrow(frugal(run), f"doc_id {kind}, lang_pred string, score double, known double, spans array<struct<lang: string, first: int, end: int>>")


def accepted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Rows of docs in a known language, all columns kept: the text has letters, and at least half are of scripts that some learned language uses."""
    model = fit(docs, id_col, text_col, lang_col)
    p = fresh(docs, "row")
    held = docs.sparkSession.sparkContext.broadcast(model)
    version, at = model.version, docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = latest_in_worker("language", version, lambda: Labeller(held.value))
        for b in parts(batches, at, 1 << 20, TEXTS):
            found = labeller.label(b.column(at).to_pylist())
            yield b.filter(pa.array([x[0] != "und" and x[2] >= 0.5 for x in found], pa.bool_()))

    named = docs.toDF(*[f"{p}{i}" for i in range(len(docs.columns))])  # names may clash
    if not model.languages:  # nothing to learn from: only texts without a letter go
        return docs.where(F.coalesce(F.col(text_col), F.lit("")).rlike(r"\p{L}"))
    return named.mapInArrow(frugal(run), named.schema).toDF(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = identify(docs, fit(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", F.size("spans").alias("n_spans"))
