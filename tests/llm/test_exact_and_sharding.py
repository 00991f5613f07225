import re
import zlib
from collections import Counter, defaultdict
from hashlib import sha256

from pyspark.sql import functions as F

from spindrift.llm import exact_dedup as E
from spindrift.llm import sharding as H
from spindrift.llm.common import Scratch

from .fixtures import docs, rows


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]", "", t or "")


def test_exact_dedup_against_brute_force(spark):
    for heavy in (1, 3, 1024):
        got = E.classes(docs(spark), Scratch(spark), heavy=heavy).collect()
        groups = defaultdict(list)
        for r in rows():
            groups[norm(r[1])].append(r)
        want = Counter()
        for text, members in groups.items():
            best = min(members, key=lambda r: (-len(r[1] or ""), r[0] is None, r[0] or 0))
            for r in members:
                want[(r[0], sha256(text.encode()).hexdigest(), best[0], len(members))] += 1
        assert Counter((r.doc_id, r.digest.hex(), r.keep_id, r.group_size) for r in got) == want


def test_exact_dedup_keeps_columns_and_first(spark):
    d = docs(spark)
    kept = E.exact_dedup(d)
    assert kept.columns == d.columns
    ids = sorted(r.doc_id for r in kept.collect() if r.doc_id is not None)
    assert 1 in ids and 2 not in ids and 6 in ids and 7 not in ids and 4 in ids and 5 not in ids
    assert E.exact_dedup(d.limit(0)).count() == 0


def test_exact_dedup_loses_no_text_of_null_or_repeated_ids(spark):
    data = [(1, "A a"), (None, "A a"), (None, "B"), (5, "Aa"), (5, "C"), (5, "A  a"), (None, None), (7, "")]
    for kind in ("long", "string"):
        kept = E.exact_dedup(docs(spark, [(*x, "en", "s", 1) for x in data]).withColumn("doc_id", F.col("doc_id").cast(kind))).collect()
        assert sorted((str(r.doc_id), r.text) for r in kept) == [("5", "A  a"), ("5", "C"), ("7", ""), ("None", "B")]


def test_misra_gries_has_every_heavy_value(spark):
    values = [b"a"] * 500 + [b"b"] * 300 + [bytes([i % 250, i // 250]) for i in range(900)]
    df = spark.createDataFrame([(bytearray(v),) for v in values], "digest binary").repartition(7)
    held = {bytes(r.digest) for r in E.misra_gries(df, "digest", 5).collect()}
    assert {b"a", b"b"} <= held and len(held) <= 5


def test_sharding_law_slots_and_mixture(spark):
    data = [(i, "t" * (i % 7) if i % 5 else None, "en", f"s{min(i % 9, 3)}" if i % 11 else None, 1) for i in range(1003)]
    got = H.shard(docs(spark, data), shards=40).collect()
    assert len(got) == len(data)
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r)
    sizes = [len(by[k]) for k in range(40)]
    assert max(sizes) - min(sizes) <= 1
    text = {r[0]: (r[1] or "").encode() for r in data}
    share = Counter(r[3] for r in data)
    for k, members in by.items():
        assert sorted(r.slot for r in members) == list(range(len(members)))
        for source, n in Counter(r.stratum for r in members).items():
            want = share[None if source == "-" else source[1:]] * len(members) / len(data)
            assert abs(n - want) <= 2.5
    for r in got:
        assert r.size == len(text[r.doc_id]) + 16 and r.text_crc32 == zlib.crc32(text[r.doc_id])


def test_sharding_odd_tables(spark):
    assert H.shard(docs(spark).limit(0)).count() == 0
    assert H.shard(docs(spark)).count() == len(rows())
    again = [tuple(r) for r in H.shard(docs(spark).repartition(5)).orderBy("shard", "slot").collect()]
    assert again == [tuple(r) for r in H.shard(docs(spark)).orderBy("shard", "slot").collect()]


def test_sharding_plan_is_native(spark):
    plan = H.shard(docs(spark))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_write_shards(spark, tmp_path):
    d = spark.createDataFrame([(i, f"t{i}", f"s{i % 3}") for i in range(30)], "doc_id long, text string, source string")
    H.write_shards(d, str(tmp_path / "out"), shards=4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 30 and back.select(F.countDistinct("shard_number")).first()[0] == 4


def test_sharding_against_brute_force(spark):
    from hashlib import md5

    data = [(i if i % 17 else None, "t" * (i % 7) if i % 5 else None, "en", f"s{min(i % 9, 3)}" if i % 11 else None, 1) for i in range(777)] + [(3, "x", "en", "s1", 1)] * 5
    each = []
    for i, text, _, source, _ in data:
        raw = (text or "").encode()
        each.append((md5(f"{H.SEED}:{'' if i is None else i}".encode()).hexdigest(), i is not None, i or 0, len(raw) + 16, zlib.crc32(raw), "-" if source is None else "+" + source))
    strata = defaultdict(list)
    for x in sorted(each):
        strata[x[5]].append(x)
    spread = sorted(((k + 0.5) / len(v), *x) for v in strata.values() for k, x in enumerate(v))
    n, want = len(data), Counter()
    for place, (_, _, known, i, size, crc, stratum) in enumerate(spread):
        shard = (40 * (place + 1) - 1) // n
        want[i if known else None, size, crc, stratum, shard, place - shard * n // 40] += 1
    got = H.shard(docs(spark, data).repartition(5)).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32, r.stratum, r.shard, r.slot) for r in got) == want


def test_write_shards_writes_every_row(spark, tmp_path):
    import pytest

    data = [(i % 50 if i % 3 else None, f"t{i % 20}", "en", f"s{i % 4}", i) for i in range(300)]
    H.write_shards(docs(spark, data), str(tmp_path / "out"), shards=7)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(r.n_chars for r in got.collect()) == list(range(300)) and set(got.columns) == {*docs(spark, data).columns, "shard_number"}
    sizes = [r["count"] for r in got.groupBy("shard_number").count().collect()]
    assert len(sizes) == 7 and max(sizes) - min(sizes) <= 1
    with pytest.raises(ValueError):
        H.write_shards(docs(spark, data).withColumn("Shard_Number", F.lit(1)), str(tmp_path / "no"))
