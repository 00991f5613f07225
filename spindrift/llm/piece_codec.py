"""Encoding and decoding with merge-type SentencePiece vocabularies.

The encoder keeps an agenda of adjacent symbol pairs whose join is a piece, ordered by the piece's score, then position: a heap,
or for short segments a list of scores. The best pair is joined, pairs that lost a side are skipped when they come up, and the
two new neighbours are put on the agenda. Symbols that are no piece at the end become their bytes' pieces.

No piece of such a vocabulary has a space mark after another character (checked when the model is loaded), so nothing joins
across the gap before a run of space marks. A text is cut there, and each different segment goes through the agenda once in
a worker (bounded cache). The new segments of an Arrow batch are checked against the sentencepiece library in that batch,
and a difference raises an error. No shuffle; memory is bounded by the batch, the cache and the longest text.

Defined cases: a null text is empty and has the begin and end ids alone; repeated rows are encoded one by one; an empty
table gives no rows; extra columns are not read; ties of score go to the left pair.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import BoundedCache, documents, frugal, per_worker

SPACE = "▁"
CACHED = 800_000
SEGMENT = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
#: A segment longer than this is not kept.
LONG = 200
#: Characters up to which all pairs are looked through for the next one, and the score of a pair that is no piece.
SHORT = 32
NONE = float("-inf")


class PieceCodec:
    def __init__(self, model: bytes, limit: int = CACHED):
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor()
        sp.LoadFromSerializedProto(model)
        size = sp.get_piece_size()
        self.score = {sp.id_to_piece(i): sp.get_score(i) for i in range(size) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))}
        self.ids = {p: sp.piece_to_id(p) for p in self.score}
        self.byte = [sp.piece_to_id(f"<0x{i:02X}>") for i in range(256)]
        if any(SPACE in p.lstrip(SPACE) for p in self.score):
            raise ValueError("a piece of this vocabulary holds a space mark after another character")
        if sp.piece_to_id("<0x00>") == sp.unk_id():
            raise ValueError("this vocabulary has no byte pieces")
        self.bos, self.eos = sp.bos_id(), sp.eos_id()
        self.cache = BoundedCache(limit)
        self.inside = {p[i : i + 2] for p in self.score for i in range(len(p) - 1)}

    def pieces_of(self, segment: str, parts: dict[str, list[int]]) -> list[int]:
        """Ids of a segment; it is cut between characters that stand together in no piece. parts: what such cuts gave before."""
        out: list[int] = []
        start, inside = 0, self.inside
        for i in range(1, len(segment) + 1):
            if i == len(segment) or segment[i - 1 : i + 1] not in inside:
                if (ids := parts.get(part := segment[start:i])) is None:
                    ids = parts[part] = self.agenda(part)
                out += ids
                start = i
        return out

    def agenda(self, segment: str) -> list[int]:
        """Ids of a segment that the library's normaliser has been through."""
        part = list(segment)
        return self.ids_of(self.joined_short(part) if len(part) <= SHORT else self.joined_long(part))

    def joined_short(self, part: list[str]) -> list[str]:
        """Symbols of a few characters: the agenda is the list of all adjacent pairs' scores."""
        get = self.score.get
        scores = [get(a + b, NONE) for a, b in zip(part, part[1:])]
        while scores and (best := max(scores)) != NONE:
            i = scores.index(best)
            part[i : i + 2] = [joined := part[i] + part[i + 1]]
            del scores[i]
            if i:
                scores[i - 1] = get(part[i - 1] + joined, NONE)
            if i < len(scores):
                scores[i] = get(joined + part[i + 1], NONE)
        return part

    def joined_long(self, part: list[str]) -> list[str]:
        """Symbols of any number of characters: the agenda is a heap."""
        n, score = len(part), self.score
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(-s, i, part[i] + part[i + 1]) for i in range(n - 1) if (s := score.get(part[i] + part[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, joined = heapq.heappop(heap)
            j = after[i]
            if not part[i] or j >= n or part[i] + part[j] != joined:
                continue
            part[i], part[j] = joined, ""
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (s := score.get(joined + part[k])) is not None:
                    heapq.heappush(heap, (-s, i, joined + part[k]))
            if (h := before[i]) >= 0 and (s := score.get(part[h] + joined)) is not None:
                heapq.heappush(heap, (-s, h, part[h] + joined))
        return part

    def ids_of(self, part: list[str]) -> list[int]:
        """Ids of symbols; those that are no piece become their bytes' pieces."""
        out: list[int] = []
        for p in part:
            if p:
                if (i := self.ids.get(p)) is not None:
                    out.append(i)
                else:
                    out += [self.byte[x] for x in p.encode()]
        return out

    def segments(self, text: str) -> list[str]:
        if not text:
            return []
        marked = SPACE + text.replace(" ", SPACE)
        if SPACE + SPACE in marked or marked.endswith(SPACE):
            return SEGMENT.findall(marked)
        return [SPACE + x for x in marked[1:].split(SPACE)]

    def encode_batch(self, texts: list[str], check: bool = True) -> list[bytes]:
        """Ids of each text, begin and end included, as little-endian 32-bit bytes."""
        begin, end = (np.array([x], dtype="<u4").tobytes() for x in (self.bos, self.eos))
        cut = [self.segments(self.library.normalize(x)[1:] if self.odd(x) else x) for x in texts]
        cache, out, at = self.cache, [], 0
        while at < len(cut):  # as many texts at a time as the cache has room for
            new: dict[str, None] = {}
            to = at
            while to < len(cut) and (to == at or len(new) + len(cut[to]) <= cache.limit):
                new.update((x, None) for x in cut[to] if x not in cache)
                to += 1
            if len(cache) + len(new) > cache.limit:
                cache.clear()
                new = dict.fromkeys(x for y in cut[at:to] for x in y)
            parts: dict[str, list[int]] = {}
            made = {x: self.pieces_of(x, parts) for x in new}
            asked = [x for x in made if x != SPACE] if check else []  # a lone mark can't be asked for: the library adds one to every text
            if asked:
                for x, other in zip(asked, self.library.encode([x.removeprefix(SPACE) for x in asked], num_threads=1), strict=True):
                    ids = made[x]
                    if ids != other:
                        raise ValueError(f"the sentencepiece library encodes {x[:LONG]!r} as {other[:20]}, the agenda as {ids[:20]}")
            fresh = {x: np.array(ids, dtype="<u4").tobytes() for x, ids in made.items()}
            cache.update((x, ids) for x, ids in fresh.items() if len(x) <= LONG)
            if any(len(x) > LONG for x in fresh):
                look = lambda x: fresh[x] if x in fresh else cache[x]
            else:
                look = cache.__getitem__
            out += [b"".join([begin, *map(look, y), end]) for y in cut[at:to]]
            at = to
        return out

    def odd(self, text: str) -> bool:
        """Whether the library's normaliser may change more than spaces: it drops no character of other texts."""
        return "\0" in text

    def decode(self, ids: bytes) -> str:
        return self.library.decode(np.frombuffer(ids, dtype="<u4").tolist())


def encode_documents(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids and decoded), a row for each row of docs.

    The model file is read on the driver and broadcast.
    """
    with open(model_path, "rb") as f:
        model = docs.sparkSession.sparkContext.broadcast(f.read())
    chosen = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    shape = f"doc_id {chosen.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    shape += ", ids array<int>, decoded string" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = per_worker(("pieces", model_path), lambda: PieceCodec(model.value), large=True)
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                found = codec.encode_batch([x or "" for x in b.column(1).to_pylist()])
                decoded = [codec.decode(x) for x in found]
                columns = [
                    b.column(0),
                    pa.array([len(x) // 4 for x in found], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in found], pa.string()),
                    pa.array([hashlib.sha256(x.encode()).hexdigest() for x in decoded], pa.string()),
                ]
                if with_ids:
                    columns += [pa.array([np.frombuffer(x, dtype="<i4") for x in found], pa.list_(pa.int32())), pa.array(decoded, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in shape.split(", ")])

    return chosen.mapInArrow(frugal(run), shape)


def decode_documents(encoded: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text) from arrays of ids; begin and end ids leave no text, null ids give null."""
    with open(model_path, "rb") as f:
        model = encoded.sparkSession.sparkContext.broadcast(f.read())
    chosen = encoded.select(encoded[id_col].alias("doc_id"), encoded[ids_col].cast("array<int>").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = per_worker(("pieces", model_path), lambda: PieceCodec(model.value), large=True)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([None if x is None else codec.library.decode(x) for x in b.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    return chosen.mapInArrow(frugal(run), f"doc_id {chosen.schema['doc_id'].dataType.simpleString()}, text string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_documents(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"), with_ids=False)
