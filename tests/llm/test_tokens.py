import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from spindrift.llm import packing as P
from spindrift.llm import piece_codec as C

from .fixtures import docs, rows

BYTE, PIECE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def encoded(text):
    return [*Tokenizer.from_file(BYTE).encode(text or "", add_special_tokens=False).ids, 1]


def check_pieces(got, want):
    """Every id in one piece, sequences gapless from 0 and within the limit."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert set(by_doc) == set(want)
    for k, members in by_doc.items():
        copies = want[k]
        at = defaultdict(int)
        for r in members:
            ids = np.array(copies[0][r.start : r.start + r.length], dtype="<u4").tobytes()
            assert r.doc_tokens == len(copies[0]) and r.ids_crc32 == zlib.crc32(ids) and len(ids) == 4 * r.length
            for i in range(r.start, r.start + r.length):
                at[i] += 1
        assert at == {i: len(copies) for i in range(len(copies[0]))}
    for members in by_sequence.values():
        at = 0
        for r in sorted(members, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    return len(by_sequence)


def test_pack_documents(spark):
    want = defaultdict(list)
    for r in rows():
        want[r[0]].append(encoded(r[1]))
    got = P.pack_documents(docs(spark).coalesce(1), BYTE).collect()
    n = check_pieces(got, want)
    total = sum(len(x) for v in want.values() for x in v)
    assert n <= -(-total // 2048) + 1
    assert P.pack_documents(docs(spark).limit(0), BYTE).count() == 0


def test_pack_block_keeps_all_limits():
    r = random.Random(3)
    tokens = np.array([r.randint(1, 3000) for _ in range(300)])
    low = np.array([r.randint(0, t) for t in tokens])
    loss = np.stack([low, tokens], 1)
    seen = defaultdict(list)
    for sequence in P.pack_block(tokens, loss, (1000, 4, 600), 8):
        assert sequence and sum(n for _, _, n in sequence) <= 1000 and len(sequence) <= 4
        assert sum(max(0, min(tokens[i], a + n) - max(low[i], a)) for i, a, n in sequence) <= 600
        for i, a, n in sequence:
            seen[i].append((a, n))
    for i, t in enumerate(tokens):
        at = 0
        for a, n in sorted(seen[i]):
            assert a == at
            at += n
        assert at == t


def test_pack_conversations_counts_loss_of_answers(spark):
    turns = spark.createDataFrame([(1, 0, "user", "a question"), (1, 1, "assistant", "an answer"), (2, 0, "assistant", "alone"), (3, 0, "user", "no answer")], "conv_id long, turn long, role string, text string")
    got = P.pack_conversations(turns, BYTE).collect()
    assert {r.doc_id for r in got} == {"1:1", "2:0"}
    assert sum(r.loss_tokens for r in got if r.doc_id == "1:1") == len(encoded("an answer"))


def test_quick_ids_equal_the_library_for_every_quick_code_point():
    with open(BYTE, encoding="utf-8") as f:
        ids = P.Ids(f.read())
    assert ids.quick is not None
    library = Tokenizer.from_file(BYTE)
    for c in map(chr, range(0x250)):
        for t in (c, f"a{c}b", f" {c} {c}{c} ", f"1{c}2", f"\n{c}\n {c}", f"'{c} don't{c}"):
            assert np.frombuffer(ids(t), "<u4").tolist() == library.encode(t, add_special_tokens=False).ids, repr(t)
    for t in ("<|endoftext|> a", "中文 text", "😀"):
        assert np.frombuffer(ids(t), "<u4").tolist() == library.encode(t, add_special_tokens=False).ids


@pytest.fixture(scope="module")
def codec():
    with open(PIECE, "rb") as f:
        return C.PieceCodec(f.read())


def test_agenda_equals_library(codec):
    r = random.Random(1)
    parts = [" ", "  ", "\n", "\t", "a", "the", "▁", "é", "ﬁ", "①", "\u3000", "中", "😀", "<s>", "</s>", "<unk>", "<0x41>", "\r", "'s", "12", "!!", ".", "\0", "\u200b", "e\u0301", "ation"]
    for _ in range(4000):
        t = "".join(r.choice(parts) for _ in range(r.randint(0, 12)))
        want = [codec.bos, *codec.library.encode(t), codec.eos]
        assert np.frombuffer(codec.encode_batch([t])[0], "<u4").tolist() == want, repr(t)


def test_both_agendas_agree(codec):
    r = random.Random(5)
    letters = "▁abcdefgehinorstu.é中😀"
    for _ in range(3000):
        t = [r.choice(letters) for _ in range(r.randint(0, 40))]
        assert [x for x in codec.joined_long(list(t)) if x] == codec.joined_short(list(t)), t
    long = "▁" + "".join(r.choice("abcdenrst") for _ in range(3000))
    assert codec.agenda(long) == codec.library.encode(long[1:])


def test_small_cache_changes_nothing():
    with open(PIECE, "rb") as f:
        small = C.PieceCodec(f.read(), limit=3)
    texts = ["a b c d e f", "g h", "a b c", "x" * 500 + " y"] * 3
    assert [np.frombuffer(x, "<u4").tolist()[1:-1] for x in small.encode_batch(texts)] == small.library.encode(texts)


def test_check_finds_a_wrong_agenda(codec, monkeypatch):
    monkeypatch.setattr(codec, "agenda", lambda part: [7])
    with pytest.raises(ValueError, match="agenda"):
        codec.encode_batch(["unseen words zzyzx"])


def test_encode_and_decode_documents(spark, codec):
    got = C.encode_documents(docs(spark), PIECE)
    rows_ = got.collect()
    assert len(rows_) == len(rows())
    text = {r[0]: r[1] or "" for r in rows()}
    for r in rows_:
        want = [codec.bos, *codec.library.encode(text[r.doc_id]), codec.eos]
        assert r.ids == want and r.n_tokens == len(want) and r.decoded == codec.library.decode(want)
        assert r.ids_sha256 == hashlib.sha256(np.array(want, dtype="<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(r.decoded.encode()).hexdigest()
    back = {r.doc_id: r.text for r in C.decode_documents(got, PIECE).collect()}
    assert back == {r.doc_id: r.decoded for r in rows_}
    assert C.encode_documents(docs(spark).limit(0), PIECE).count() == 0


def test_whole_documents_against_the_library(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = {r.doc_id: [encoded(r.text)] for r in d.collect()}
    got = P.pack_documents(d, BYTE).collect()
    n = check_pieces(got, want)
    total = sum(len(x) for v in want.values() for x in v)
    parts = d.rdd.getNumPartitions()
    assert n <= -(-total // 2048) + parts + total // 2048 // 50  # little padding: a part-empty sequence a task, and 2 % at most


def test_conversations_of_all_kinds(spark):
    data = [
        (1, 0, "user", "a question"), (1, 1, "assistant", "an answer"), (1, 2, "assistant", "a second one"), (2, 0, "assistant", None), (3, 0, "user", None), (3, 1, "assistant", "x"), (None, 0, "user", "q"), (None, 1, "assistant", "a"),
        (4, 0, "user", "same"), (4, 1, "assistant", "same"), (4, 1, "assistant", "same"), (5, 0, None, "nobody"), (5, 1, "assistant", "long " * 5000), (6, 0, "user", "no answer"), (7, None, "assistant", "no turn"),
    ]
    turns = spark.createDataFrame([(*x, 1, "c") for x in data], "conv_id long, turn long, role string, text string, doc_id int, prompt string")
    got = P.pack_conversations(turns, BYTE).collect()
    by = defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
    assert sum(x[2] == "assistant" for x in data) == sum(r.start == 0 for r in got)
    before = {"1:1": "a question", "1:2": "an answer", "2:0": None, "3:1": None, "1": "q", "5:1": "nobody", "7": None}
    for key, answer in (("1:1", "an answer"), ("1:2", "a second one"), ("2:0", None), ("3:1", "x"), ("1", "a"), ("5:1", "long " * 5000), ("7", "no turn")):
        ids = encoded(before[key]) + encoded(answer)
        mine = sorted(by[key], key=lambda r: r.start)
        assert sum(r.length for r in mine) == len(ids) == mine[0].doc_tokens and sum(r.loss_tokens for r in mine) == len(encoded(answer)), key
        assert all(r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], dtype="<u4").tobytes()) for r in mine)
    assert len(by["4:1"]) == 2 and P.pack_conversations(turns.limit(0), BYTE).count() == 0
