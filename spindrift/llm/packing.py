"""Packing of examples into training sequences by vector bin packing with the dot-product heuristic.

Every piece has a demand (tokens, one segment, loss-bearing tokens) and a sequence has limits on all three. A piece that is
put into the open sequence is the one with the largest dot product of its demand and what the sequence has left, both in
units of the limits, among the pieces that fit in every dimension. Where none fits and more than `waste` tokens are free,
the piece with the largest product is cut to what fits; the rest of it stays to be placed. Documents of more tokens than a
sequence are cut into whole sequences first.

Each task packs the rows it reads, in blocks of `block` examples: no shuffle, memory bounded by the block and the longest
text, work in proportion to the rows. Only the last sequence of a block can stay part empty. Sequence ids hold the
partition number, so they are unique, and a task that runs again gives the same rows.

Defined cases: a null text is empty (its one id is the end id); repeated rows are packed one by one; ties go to the piece
that comes first; an empty table gives no rows; extra columns are not read; an example without any id gives no piece.
"""

from __future__ import annotations

import json
import os
import re
import sys
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from .common import documents, frugal, per_worker

TOKENS = 2048
SEGMENTS = 64
#: Tokens that may stay free at a sequence's end before a piece is cut to fill it.
WASTE = 8
BLOCK = 4096
END_ID = 1
LITTLE = sys.byteorder == "little" and array("I").itemsize == 4

SHAPE = "doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long"


def pack_block(tokens: np.ndarray, loss: np.ndarray, limits: tuple[int, int, int], waste: int) -> Iterator[list[tuple[int, int, int]]]:
    """Sequences as lists of (example, first token, tokens). loss: (first loss-bearing token, end) of each example, a row each."""
    most, segments, most_loss = limits
    start = np.zeros(len(tokens), dtype=np.int64)
    left = tokens.astype(np.int64).copy()

    def bearing(i, a, b):
        return np.clip(np.minimum(loss[i, 1], b) - np.maximum(loss[i, 0], a), 0, None)

    def longest(i: int, room: int, room_loss: int) -> int:
        """The most tokens of example i, from its start on, within both rooms."""
        n, a = min(int(left[i]), room), int(start[i])
        free = max(0, int(loss[i, 0]) - a)
        return n if bearing(i, a, a + n) <= room_loss or a >= loss[i, 1] else min(n, free + room_loss)

    alive = left > 0
    need = bearing(np.arange(len(left)), start, start + left) if len(left) else np.zeros(0, dtype=np.int64)
    while alive.any():
        room, room_segments, room_loss, out = most, segments, most_loss, []
        while room > 0 and room_segments > 0:
            product = left / most * (room / most) + (1 / segments) * (room_segments / segments) + need / most_loss * (room_loss / most_loss)
            fits = alive & (left <= room) & (need <= room_loss)
            if fits.any():
                i = int(np.where(fits, product, -1.0).argmax())
                n = int(left[i])
            else:
                if room <= waste or not alive.any():
                    break
                i = int(np.where(alive, product, -1.0).argmax())
                n = longest(i, room, room_loss)
                if n <= 0:
                    break
            used = int(bearing(i, start[i], start[i] + n))
            out.append((i, int(start[i]), n))
            room, room_segments, room_loss = room - n, room_segments - 1, room_loss - used
            start[i] += n
            left[i] -= n
            need[i] -= used
            alive[i] = left[i] > 0
        yield out


def pack(examples: DataFrame, ids_of: Callable[[], Callable[[pa.RecordBatch], Iterator[tuple[bytes, int, int]]]], id_col: str, limits: tuple[int, int, int] = (TOKENS, SEGMENTS, TOKENS), waste: int = WASTE, block: int = BLOCK) -> DataFrame:
    """A row for each piece. ids_of() gives, in a worker, a function from a batch to (ids as little-endian 32-bit bytes, first loss-bearing token, end) of each row; id_col is the batch's first column."""
    if min(limits) < 1:
        raise ValueError("limits must be positive")
    most, _, most_loss = limits

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = ids_of()
        context = TaskContext.get()
        sequence = (context.partitionId() if context else 0) << 40
        names = [x.split()[0] for x in SHAPE.split(", ")]
        held: list[tuple[object, bytes, int, int, int, int]] = []  # id, ids not placed yet, start, loss span, tokens of the example

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(columns[0], kind), *(pa.array(x, pa.int64()) for x in columns[1:])], names)

        def flush(some) -> list[tuple]:
            nonlocal sequence
            rows = []
            span = np.array([(x[3] - x[2], x[4] - x[2]) for x in some], dtype=np.int64).reshape(-1, 2)
            for made in pack_block(np.array([len(x[1]) // 4 for x in some]), span, limits, waste):
                offset = 0
                for i, a, n in made:
                    doc, ids, start, low, high, total = some[i]
                    borne = max(0, min(high, start + a + n) - max(low, start + a))
                    rows.append((doc, start + a, n, zlib.crc32(ids[4 * a : 4 * (a + n)]), total, sequence, offset, borne))
                    offset += n
                sequence += 1
            return rows

        kind, out = None, []
        for b in batches:
            kind = b.schema.field(0).type
            for doc, (ids, low, high) in zip(b.column(0).to_pylist(), encode(b), strict=True):
                total, start = len(ids) // 4, 0
                while total - start >= most:
                    borne = max(0, min(high, start + most) - max(low, start))
                    if borne > most_loss:
                        break
                    out.append((doc, start, most, zlib.crc32(ids[4 * start : 4 * (start + most)]), total, sequence, 0, borne))
                    sequence, start = sequence + 1, start + most
                if start < total:
                    held.append((doc, ids[4 * start :], start, low, high, total))
                if len(held) >= block:
                    out += flush(held)
                    held = []
                if len(out) >= 8192:
                    yield batch(out)
                    out = []
        if held:
            out += flush(held)
        if out:
            yield batch(out)

    return examples.mapInArrow(frugal(pieces), SHAPE.format(kind=examples.schema[id_col].dataType.simpleString()))


#: Only texts of these code points take the quick way; the tests hold each of them against the tokenizers library.
QUICK = re.compile("[^\\x00-\u024f]")
#: The pattern of byte-level pre-tokenizers (a fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Ids:
    """Ids of whole texts by a byte-level BPE file of the tokenizers library, no special tokens added.

    If each merge of the file makes the token of the next id, which is checked, tiktoken over the same tokens gives the same
    ids and takes a quarter of the time. Texts with other code points than `QUICK` tells, or with the text of an added
    token, go to the tokenizers library itself, as do all texts of another kind of file.
    """

    def __init__(self, model: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(model)
        self.added = [x.content for x in self.library.get_added_tokens_decoder().values()]
        self.quick = self._ranks(json.loads(model))

    def _ranks(self, told: dict):
        kind, before = told["model"], told["pre_tokenizer"] or {}
        plain = kind["type"] == "BPE" and not any(kind.get(x) for x in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges"))
        if not plain or told["normalizer"] or told["truncation"] or told["padding"] or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True):
            return None
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves, then the others from 256 on
        chars = {chr(x): x for x in shown} | {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in set(shown))}
        vocabulary, merges = kind["vocab"], [x if isinstance(x, list) else x.split(" ") for x in kind["merges"]]
        first = len(vocabulary) - len(merges)
        if first != 256 or any(vocabulary.get(a + b) != first + i for i, (a, b) in enumerate(merges)):
            return None
        import tiktoken

        return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks={bytes(chars[c] for c in x): i for x, i in vocabulary.items()}, special_tokens={})

    def __call__(self, text: str) -> bytes:
        if self.quick and not QUICK.search(text) and not any(x in text for x in self.added):
            ids = self.quick.encode_ordinary(text)
        else:
            ids = self.library.encode(text, add_special_tokens=False).ids
        return array("I", ids).tobytes() if LITTLE else np.array(ids, dtype="<u4").tobytes()


def pack_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, limits: tuple[int, int, int] = (TOKENS, SEGMENTS, TOKENS), waste: int = WASTE, block: int = BLOCK) -> DataFrame:
    """Plain documents: every token bears loss. The tokenizer file is read on the driver and broadcast."""
    with open(tokenizer_path, encoding="utf-8") as f:
        model = docs.sparkSession.sparkContext.broadcast(f.read())
    end = np.array([end_id], dtype="<u4").tobytes()

    def ids_of():
        words = per_worker(("ids", tokenizer_path), lambda: Ids(model.value), large=True)

        def encode(b: pa.RecordBatch):
            for text in b.column(1):
                ids = words(text.as_py() or "") + end
                yield ids, 0, len(ids) // 4

        return encode

    return pack(docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")), ids_of, "doc_id", limits, waste, block)


def pack_conversations(turns: DataFrame, tokenizer_path: str, end_id: int = END_ID, limits: tuple[int, int, int] = (TOKENS, SEGMENTS, TOKENS), waste: int = WASTE, block: int = BLOCK) -> DataFrame:
    """Instruction data: an example is one assistant turn after the turn before it, and only the answer bears loss."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    with open(tokenizer_path, encoding="utf-8") as f:
        model = turns.sparkSession.sparkContext.broadcast(f.read())
    end = np.array([end_id], dtype="<u4").tobytes()

    def ids_of():
        words = per_worker(("ids", tokenizer_path), lambda: Ids(model.value), large=True)

        def encode(b: pa.RecordBatch):
            for prompt, answer in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                head, tail = words(prompt or "") + end, words(answer or "") + end
                yield head + tail, len(head) // 4, (len(head) + len(tail)) // 4

        return encode

    prompt = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    pairs = turns.select("conv_id", "turn", "role", "text", prompt.alias("prompt")).where("role = 'assistant'")
    examples = pairs.select(F.concat_ws(":", "conv_id", "turn").alias("doc_id"), "prompt", F.col("text").alias("answer"))
    return pack(examples, ids_of, "doc_id", limits, waste, block)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
