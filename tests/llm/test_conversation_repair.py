"""Repaired conversations against a plain version, and the layers against costs worked out one by one."""

import hashlib
import random
import re
import zlib
from functools import lru_cache

import pytest
from pyspark.sql import functions as F

from spindrift.llm import conversation_repair as repair
from spindrift.llm.common import Scratch

SHAPE = "conv_id long, turn long, role string, text string"
BLANK = re.compile(r"[\x20\x09-\x0D]")


def least(rows):
    """(cost, letters) of rows (initial, must go, truncated): the least of all ways."""
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}

    @lru_cache(None)
    def best(i, state, inserts):
        ways = []
        if i == len(rows):
            if state in ("", "a"):
                ways.append((0, ""))
        else:
            initial, must, cut = rows[i]
            moves = [("D", 2, state)]
            if not must:
                more = 5 if cut else 0
                if (state, initial) in step:
                    moves.append(("K", more, step[state, initial]))
                moves += [("R", 1 + more, x) for x in "ua" if (state, x) in step]
            ways += [(c + x[0], letter + x[1]) for letter, c, to in moves for x in [best(i + 1, to, 0)]]
        if inserts < 3:
            ways += [(5 + x[0], "I" + x[1]) for to in "ua" if (state, to) in step for x in [best(i, step[state, to], inserts + 1)]]
        return min(ways, default=(10**9, ""))

    return best(0, "", 0)


def plain(rows, damage=True):
    convs = {}
    for conv, turn, role, text in rows:
        mine = convs.setdefault(conv, [])
        role, text = (" " if x is None else x for x in (role, text))
        fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20 if damage else 9
        if fate == 0:
            continue
        text = "" if fate == 1 else re.sub(r"[.!?]", "", text) if fate == 2 else text
        role = "user" if fate == 4 else role
        mine += [(turn, role, text)] * (2 if fate == 3 else 1)
    out = []
    for conv, mine in convs.items():
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0))
        faults, seen = [], set()
        for _, role, text in mine:
            shown = BLANK.sub("", text)
            faults.append("blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else "")
            seen.add((role, text))
        cost, audit = least(tuple((r[1][:1], f in ("blank", "duplicate"), f == "truncated") for r, f in zip(mine, faults, strict=True)))
        said, at, after = [], 0, ""
        for letter in audit:
            wanted = "assistant" if after == "u" else "user"
            if letter == "I":
                said.append(f"{wanted}:")
            else:
                _, role, text = mine[at]
                at += 1
                if letter != "D":
                    said.append(f"{role if letter == 'K' else wanted}:{text}")
            after = said[-1][:1] if said and letter != "D" else after
        turns = [r[0] for r in mine if r[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum((a[1][:1] + b[1][:1]) not in ("su", "ua", "au") for a, b in zip(mine[:-1], mine[1:], strict=True))
        out.append((conv, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest()))
    return sorted(out, key=str)


NAMES = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def found(spark, rows, tmp_path):
    df = spark.createDataFrame(rows, SHAPE).withColumn("pos", F.lit(1)).withColumn("digest", F.lit("x"))
    df.write.mode("overwrite").parquet(f"{tmp_path}/conversations.parquet")
    return sorted([tuple(r[n] for n in NAMES) for r in repair.query(spark, str(tmp_path)).collect()], key=str)


def made(n, seed, most=9):
    r = random.Random(seed)
    texts = ["Yes.", "No!", "cut", " ", "", "why? ", "x.\n", "one two", "ü?\t"]
    return [(i, t, r.choice(["user", "assistant", "assistant", "user", "system", None, "", "tool", "u"]), r.choice([*texts, None, f"t{i} {t}."])) for i in range(n) for t in range(r.randint(1, most))]


def test_layers_give_the_least(spark):
    r = random.Random(1)
    for _ in range(1500):
        rows = tuple((r.choice("sua "), r.random() < 0.15, r.random() < 0.2) for _ in range(r.randint(0, 12)))
        codes = bytes({"s": 0, "u": 1, "a": 2, " ": 3}[i] + 4 * cut + 8 * must for i, must, cut in rows)
        ends = repair.end_costs()
        cost = repair._costs(*repair.Layers.run(repair._layers(ends), codes)[0])[0]
        assert (cost, repair.trace(codes, ends, 0, True)[0]) == least(rows)


@pytest.mark.parametrize("segment", [1, 3, 4096])
def test_against_plain_version(spark, tmp_path, monkeypatch, segment):
    monkeypatch.setattr(repair, "SEGMENT", segment)
    rows = made(150, 2)
    assert found(spark, rows, tmp_path) == plain(rows)


def test_defined_cases(spark, tmp_path):
    rows = [(None, 0, "user", "Hi."), (None, None, "assistant", "Yes."), (None, 1, "assistant", "Yes."), (7, None, None, None), (8, 5, "user", "Long. " * 50_000), (8, 9, "assistant", "ok."), (9, 3, "system", "S.")]
    assert found(spark, rows, tmp_path) == plain(rows)
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    assert found(spark, [(gone, 0, "user", "Hi.")], tmp_path) == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert found(spark, [], tmp_path) == []


def test_repeated_rows_and_a_long_conversation(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(repair, "SEGMENT", 50)
    r = random.Random(5)
    rows = [(1, t, r.choice(["user", "assistant"]), r.choice(["Same.", f"n{t}.", "cut"])) for t in range(300)]
    once = found(spark, rows, tmp_path)
    assert once == plain(rows)
    twice = found(spark, rows + rows, tmp_path)
    assert [x[7].replace("D", "") for x in twice] == [x[7].replace("D", "") for x in once]
    assert [x[8] for x in twice] == [x[8] for x in once]


def test_turns_follow_the_grammar(spark):
    turns, report = repair.repair(spark.createDataFrame(made(60, 9), SHAPE), Scratch(spark))
    by = {}
    for row in sorted(turns.collect(), key=lambda x: (x.pos, x.nth)):
        by.setdefault(row.conv_id, []).append(row)
    assert all(re.fullmatch(r"(s?(ua)+)?", "".join(x.role[:1] for x in rows)) for rows in by.values())
    assert {r.conv_id for r in report.collect()} == set(range(60))
