import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spindrift.llm import embedding_dedup as D
from spindrift.llm import ngram_join as N
from spindrift.llm import substring_dedup as S
from spindrift.llm.common import Scratch, connected_components, shingles_of, words_of

from .fixtures import docs, rows, words


def components(nodes, edges):
    up = {n: n for n in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    return {n: root(n) for n in nodes}


def test_connected_components(spark):
    r = random.Random(2)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(160)] + [(i, i + 1) for i in range(400, 460)] + [(7, 7)]
    got = {x.node: x.root for x in connected_components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark), "t").collect()}
    real = [(a, b) for a, b in edges if a != b]
    want = components({x for e in real for x in e}, real)
    assert got == want
    assert connected_components(spark.createDataFrame([], "a long, b long"), Scratch(spark), "t").count() == 0


def near_rows():
    r = random.Random(5)
    out, k = list(rows()), 100
    for g in range(12):
        base = words(r.randint(30, 200), 50 + g).split()
        for _ in range(r.randint(2, 9)):
            copy = list(base)
            for _ in range(r.randint(0, 6)):
                copy[r.randrange(len(copy))] = f"w{r.randrange(1000)}"
            out.append((k, " ".join(copy), "en", "s", 1))
            k += 1
    return out


@pytest.mark.parametrize("chunk", [1024, 3])
def test_ngram_join_against_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr("spindrift.llm.blocks.CHUNK", chunk)
    data = near_rows()
    got = N.similarity_groups(docs(spark, data), Scratch(spark)).collect()
    assert len(got) == len(data)
    sets = [set(x.tolist()) for x in N.shingle_sets(pa.array([r[1] for r in data]), 5)]
    near = [[j for j in range(len(data)) if j != i and sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9] for i in range(len(data))]
    edges = [(i, j) for i, x in enumerate(near) for j in x]
    root = components(range(len(data)), edges)
    groups = defaultdict(list)
    for i, r in root.items():
        groups[r].append(data[i][0])
    want = sorted((str(data[i][0]), len(near[i]), min((x for x in groups[root[i]] if x is not None), default=None)) for i in range(len(data)))
    assert sorted((str(r.doc_id), r.n_links, r.component_id) for r in got) == want


def missed(crowds, kept, threshold=0.8):
    return float(np.prod([1 - threshold ** int(d) for d in kept]))


def test_prefixes_are_shortened_to_the_recall():
    few = N.depths(np.array([[2, 1], [5, 2], [64, 64]]), 7)
    assert few.tolist() == [4, 4, 4]  # whoever meets few is shortened wherever it meets anyone
    crowd = np.array([[1000 * (t + 1), 100 * (t + 1)] for t in range(16)])
    kept = N.depths(crowd, 7)
    assert missed(crowd, kept) <= 0.002 < missed(crowd, np.maximum(kept, 5)) and set(kept) == {4, 5, 6} and kept[0] == 4 and kept[-1] == 6
    assert (N.depths(crowd[:5], 7) == 4).all()  # too few trees to reach the recall: all of them
    sizes = np.full((16, 2), 3000)
    assert N.depths(sizes, 1).tolist() != N.depths(sizes, 2).tolist()  # equal crowds in an order of chance
    assert N.trees_for(0.8) == 16 and N.trees_for(0.7) > 16
    with pytest.raises(ValueError):
        N.trees_for(0.3)


def test_each_node_is_shortened_where_it_meets_fewest(spark):
    r = np.random.default_rng(3)
    base = r.integers(0, 2**16, size=(16, 6)).astype(np.uint16)
    crowd = []
    for k in range(200):  # all share short prefixes in trees 0 to 9, pairs of two in trees 10 to 15
        s = base.copy()
        s[:10, 4:] = r.integers(0, 2**16, size=(10, 2))
        s[10:] = (base[10:].astype(int) + 1 + k // 2) % 2**16
        crowd.append((bytes([k]), s.tobytes()))
    alone = [(bytes([k, 1]), r.integers(0, 2**16, size=96).astype(np.uint16).tobytes()) for k in range(5)]
    nodes = spark.createDataFrame(crowd + alone, "node binary, signature binary")
    shortened, placed = N.trie_nodes(nodes, Scratch(spark), 0.8, 0.998, 16)
    bits = {bytes(x.node): {t for t in range(16) if x.to_4 >> t & 1} for x in shortened.collect()}
    assert set(bits) == {c[0] for c in crowd} and all(b >= set(range(10, 16)) and len(b) < 9 for b in bits.values())
    groups = defaultdict(set)
    for x in placed.collect():
        groups[x.tree, x.trie].add(bytes(x.node))
        assert x.n > 1
    assert sum(t >= 10 for t, _ in groups) == 6 * 100 and all(len(g) == 2 for (t, _), g in groups.items() if t >= 10)


def test_lone_pairs_at_the_threshold_are_found(spark):
    """Pairs that meet nobody else, at a similarity of 178 / 222: 0.802. The model misses 0.2 in a thousand."""
    n, data = 1500, []
    for k in range(n):
        common = [f"w{k}x{i}" for i in range(182)]
        data += [(2 * k, " ".join(common + [f"a{k}x{i}" for i in range(22)])), (2 * k + 1, " ".join(common + [f"b{k}x{i}" for i in range(22)]))]
    got = {x.doc_id: x for x in N.similarity_groups(docs(spark, [(*x, "en", "s", 1) for x in data]), Scratch(spark)).where("n_links > 0").collect()}
    assert all(x.n_links == 1 and x.component_id == i // 2 * 2 for i, x in got.items()) and len(got) >= 2 * (n - 2)


def test_pairs_within_a_crowd_are_found(spark):
    """Pairs at 0.802 whose texts all hold one long passage, so that nodes meet hundreds at short prefixes."""
    n, data = 300, []
    passage = [f"p{i}" for i in range(90)]
    for k in range(n):
        own = passage + [f"w{k}x{i}" for i in range(92)]
        data += [(2 * k, " ".join(own + [f"a{k}x{i}" for i in range(22)])), (2 * k + 1, " ".join(own + [f"b{k}x{i}" for i in range(22)]))]
    got = {x.doc_id: x for x in N.similarity_groups(docs(spark, [(*x, "en", "s", 1) for x in data]), Scratch(spark)).where("n_links > 0").collect()}
    assert all(x.n_links == 1 and x.component_id == i // 2 * 2 for i, x in got.items()) and len(got) >= 2 * (n - 3)


def test_a_table_loaded_twice_is_thinned_to_one(spark):
    a, b, c = words(80, 1), words(90, 2), words(100, 3)
    near = " ".join([*a.split()[:-1], "changed"])
    data = [(1, a), (None, b), (None, b + " "), (5, c), (5, near), (9, None), (None, None), (1, near), (None, c)]
    once = docs(spark, [(*x, "en", "s", 1) for x in data])
    rows = [sorted(map(str, N.near_dedup(d).collect())) for d in (once, once.unionByName(once))]
    assert rows[0] == rows[1] and len(rows[0]) == 5
    from spindrift.llm import exact_dedup as E

    rows = [sorted(map(str, E.exact_dedup(d).collect())) for d in (once, once.unionByName(once))]
    assert rows[0] == rows[1] and len(rows[0]) == 5
    vectors = spark.createDataFrame([(1, [1.0, 2.0]), (None, [2.0, 1.0]), (None, [2.0, 1.001]), (3, [2.0, 4.0]), (4, None)], "vec_id long, embedding array<double>")
    rows = [sorted(map(str, D.near_dedup(d).collect())) for d in (vectors, vectors.unionByName(vectors))]
    assert rows[0] == rows[1] and len(rows[0]) == 3


def test_links_near_the_threshold_do_not_depend_on_their_block():
    r = np.random.default_rng(2)
    unit = r.normal(size=(40, 64))
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    i, j = np.triu_indices(40, 1)
    for at in (unit @ unit.T)[i, j][::50]:
        every = D.linked_pairs(unit, i, j, float(at))
        assert every.tolist() == [bool(D.linked_pairs(unit[[a, b]], np.array([0]), np.array([1]), float(at))[0]) for a, b in zip(i, j)]


def test_components_that_do_not_converge_raise(spark, monkeypatch):
    from spindrift.llm import common

    path = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")
    with monkeypatch.context() as m:
        m.setattr(common, "ROUNDS", 2)
        with pytest.raises(RuntimeError):
            common.connected_components(path, Scratch(spark), "links")
    assert {x.root for x in common.connected_components(path, Scratch(spark), "links").collect()} == {0}


def test_recall_on_documents(spark):
    """All links of the test data by brute force over shared shingles."""
    from spindrift.llm.common import documents

    d = documents(spark, "/root/testdata/sf0.01")
    data = [(x.doc_id, x.text) for x in d.select("doc_id", "text").collect()]
    sets = N.shingle_sets(pa.array([x[1] for x in data]), 5)
    holders, both = defaultdict(list), defaultdict(int)
    for i, s in enumerate(sets):
        for x in s.tolist():
            holders[x].append(i)
    for h in holders.values():
        for a in range(len(h)):
            for b in range(a):
                both[h[b], h[a]] += 1
    want = defaultdict(int)
    for (a, b), n in both.items():
        if n >= 0.8 * (len(sets[a]) + len(sets[b]) - n) - 1e-9:
            want[data[a][0]] += 1
            want[data[b][0]] += 1
    got = {x.doc_id: x.n_links for x in N.similarity_groups(d, Scratch(spark)).where("n_links > 0").collect()}
    assert all(n <= want[i] for i, n in got.items()) and sum(got.values()) >= 0.99 * sum(want.values()) > 100


def test_near_dedup_keeps_the_first(spark):
    d = docs(spark)
    kept = N.near_dedup(d)
    ids = [r.doc_id for r in kept.collect()]
    assert kept.columns == d.columns and 1 in ids and 2 not in ids and 3 not in ids and 4 in ids and 5 in ids and ids.count(8) == 1
    assert N.near_dedup(d.limit(0)).count() == 0


def test_near_dedup_loses_no_text_of_null_or_repeated_ids(spark):
    a, b, c = words(80, 1), words(90, 2), words(100, 3)
    data = [(1, a), (None, a), (None, b), (5, a), (5, c), (None, None), (6, "")]
    kept = N.near_dedup(docs(spark, [(*x, "en", "s", 1) for x in data])).collect()
    assert sorted((str(r.doc_id), r.text or "") for r in kept) == sorted([("1", a), ("None", b), ("5", c), ("None", ""), ("6", "")])


def vectors():
    r = np.random.default_rng(1)
    out = []
    for g in range(40):
        c = r.normal(size=24)
        for k in range(1 + g % 5):
            out.append((len(out), (c + r.normal(size=24) * 0.08).tolist(), 1))
    big = r.normal(size=24)
    for _ in range(60):
        out.append((len(out), (big + r.normal(size=24) * 0.05).tolist(), 2))
    same = r.normal(size=24).tolist()
    out += [(len(out) + i, same, 3) for i in range(3)]
    out += [(900, None, 0), (901, [0.0] * 24, 0), (902, [float("nan")] + [1.0] * 23, 0), (903, [float("inf")] + [1.0] * 23, 0), (904, [None] + [1.0] * 23, 0), (905, [], 0), (906, [1.0] * 8, 0), (907, [2.0] * 8, 0), (908, [1e200] * 24, 0), (909, [1e-200] * 24, 0)]
    return out


@pytest.mark.parametrize("chunk", [1024, 5])
def test_lattice_dedup_against_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr("spindrift.llm.blocks.CHUNK", chunk)
    data = vectors()
    df = spark.createDataFrame([(*x, "c", 1) for x in data], "vec_id long, embedding array<double>, label int, node string, cell int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in D.similar_vectors(df, Scratch(spark)).collect()}
    unit = {}
    for i, v, _ in data:
        if v and None not in v and np.isfinite(v).all() and any(v):
            x = np.array(v) / np.abs(v).max()
            unit[i] = x / np.linalg.norm(x)
    links = {(a, b) for a in unit for b in unit if a != b and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.95}
    root = components([i for i, *_ in data], links)
    want = {i: (sum(a == i for a, _ in links), root[i]) for i, *_ in data}
    found, all_ = sum(n for n, _ in got.values()), len(links)
    assert found <= all_ and found >= 0.98 * all_ and set(got) == set(want)
    if found == all_:
        assert got == want
    assert D.similar_vectors(df.limit(0), Scratch(spark)).count() == 0


def test_near_dedup_of_vectors_keeps_rows_of_null_and_repeated_ids(spark):
    r = np.random.default_rng(7)
    a, b, c = (r.normal(size=16).tolist() for _ in range(3))
    data = [(1, a), (None, a), (None, b), (5, a), (5, c), (None, None), (6, [0.0] * 16)]
    df = spark.createDataFrame([(*x, 1, 2) for x in data], "vec_id long, embedding array<double>, digest int, _id int")
    kept = D.near_dedup(df)
    assert kept.columns == df.columns and sorted(str((x.vec_id, x.embedding)) for x in kept.collect()) == sorted(str(x) for x in [(1, a), (None, b), (5, c), (None, None), (6, [0.0] * 16)])
    assert D.near_dedup(df.limit(0)).count() == 0


def test_recall_of_links_among_many_vectors(spark):
    """10000 vectors of which 3000 are within a cosine of 0.95 to 0.96 of another."""
    r = np.random.default_rng(9)
    x = r.normal(size=(10000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for k in range(3000):
        side = r.normal(size=64)
        side -= side @ x[k] * x[k]
        cos = r.uniform(0.9501, 0.96)
        x[7000 + k] = cos * x[k] + np.sqrt(1 - cos * cos) * side / np.linalg.norm(side)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {i.vec_id: i for i in D.similar_vectors(df.repartition(5), Scratch(spark)).where("n_links > 0").collect()}
    want = {i for k in range(3000) for i in (k, 7000 + k)}
    assert set(got) <= want and len(got) >= 0.99 * len(want) and all(i.component_id == k % 7000 and i.n_links == 1 for k, i in got.items())


def test_nearest_lattice_points():
    r = np.random.default_rng(0)
    short = D._shortest()
    assert len(short) == 240 and np.allclose((short**2).sum(1), 2)
    x = r.normal(size=(200, 8)) * 2
    p = D.nearest_e8(x)
    assert np.allclose(p.sum(1) % 2, 0) and np.all((np.allclose(row % 1, 0) or np.allclose(row % 1, 0.5)) for row in p)
    mine = ((x - p) ** 2).sum(1)
    assert (mine[:, None] <= ((x[:, None] - p[:, None] - short[None]) ** 2).sum(2) + 1e-9).all() and mine.max() <= 1 + 1e-9


def test_compact_windows_against_all_passages():
    r, by, t = np.random.default_rng(0), np.uint64(0x9E3779B97F4A7C15), 8
    texts = [r.integers(0, 12 if n == 60 else 2**60, size=n).astype(np.uint64) for n in (30, 60, 8, 7, 0, 50, 1)]
    at = np.concatenate(([0], np.cumsum([len(x) for x in texts])))
    of, left, mid, right = S.compact_windows(np.concatenate(texts), at, t, by)
    for k, s in enumerate(texts):
        n = len(s)
        l, c, rr = (x[of == k] for x in (left, mid, right))
        bits = np.uint64(max(1, n.bit_length()))
        h = ((s * by) >> bits << bits) | np.arange(n, dtype=np.uint64)
        held = {(i, j): int(x) for a, x, b in zip(l, c, rr, strict=True) for i in range(a, x + 1) for j in range(x, b + 1)}
        for i in range(n):
            for j in range(i + t - 1, n):
                assert held[i, j] == i + int(h[i : j + 1].argmin())
        assert all(0 <= a <= x <= b < n and b - a + 1 >= t for a, x, b in zip(l, c, rr, strict=True))


def test_packs_hold_what_was_packed():
    r = np.random.default_rng(2)
    for top in (1, 255, 256, 2**31, 2**62):
        x, y = r.integers(-top, top, size=50), r.integers(0, top, size=50)
        assert [v.tolist() for v in S.unpack(S.pack(x, y))] == [x.tolist(), y.tolist()]
    c, l, rr = np.array([500, 3]), np.array([470, 0]), np.array([520, 900])
    assert [x.tolist() for x in S.unpacked(S.packed(c, l, rr, np.array([1, 0]), 46), 46)] == [[500, 3], [470, 0], [520, 48], [1, 0]]


def test_word_hashes_ignore_ascii_case_and_place():
    h, start, end = words_of(b"  Ab\ncd ab\t\x0bCD ")
    assert h[0] == h[2] and h[1] == h[3] and h[0] != h[1] and [(int(a), int(b)) for a, b in zip(start, end)] == [(2, 4), (5, 7), (8, 10), (12, 14)]
    assert len(shingles_of(h, 5)) == 1 and len(shingles_of(h[:0], 5)) == 0


def test_passages(spark):
    d = docs(spark)
    got = [r for r in S.passages(d).collect() if r.doc_id == 10]
    assert got and got[0].of_doc_id == 9 and got[0].first_word <= 20 and got[0].end_word >= 80
    found = {r.doc_id for r in S.passages(d).collect()}
    assert {2, 3, 7, 10} <= found and not found & {1, 6, 9, 8, 4, 5}
    cut = {r.doc_id: r for r in S.without_passages(d, length_col="n_chars").collect() if r.doc_id is not None}
    assert S.without_passages(d).columns == d.columns and S.without_passages(d).count() == len(rows())
    assert cut[2].text == "" and cut[2].n_chars == 0 and cut[9].text == [r for r in rows() if r[0] == 9][0][1]
    whole = [r for r in rows() if r[0] == 10][0][1].split()
    assert cut[10].text.split() == whole[:20] + whole[80:] and cut[10].n_chars == len(cut[10].text)
    assert cut[4].text is None and cut[14].text == [r for r in rows() if r[0] == 14][0][1]
    assert S.passages(d.limit(0)).count() == 0 and S.without_passages(d.limit(0)).count() == 0


def test_passages_of_null_and_repeated_ids(spark):
    a, b, c = words(80, 1), words(90, 2), words(100, 3)
    data = [(1, a), (5, a), (5, c), (5, c), (None, b), (None, f"{words(10, 4)} {b}"), (None, None), (9, f"{words(20, 5)} {c}")]
    for kind in ("long", "string"):
        d = docs(spark, [(*x, "en", "s", 1) for x in data]).withColumn("doc_id", F.col("doc_id").cast(kind))
        left = sorted((str(r.doc_id), len((r.text or "").split())) for r in S.without_passages(d).collect())
        assert sorted(n for i, n in left if i == "5") == [0, 100, 100] and ("1", 80) in left and ("9", 20) in left
        assert sorted(n for i, n in left if i == "None") in ([0, 0, 100], [0, 10, 90]) and len(left) == len(data)


def test_partitions_change_nothing(spark, monkeypatch):
    from spindrift.llm.common import documents

    d = documents(spark, "/root/testdata/sf0.01")
    got = {tuple(sorted(map(tuple, S.passages(d.repartition(n)).collect()))) for n in (1, 7, 64)}
    monkeypatch.setattr(S, "PACKED", 5000)
    monkeypatch.setattr(S, "RANGE_BYTES", 1 << 16)
    monkeypatch.setattr(S, "ROWS", 7)
    got.add(tuple(sorted(map(tuple, S.passages(d.repartition(3)).collect()))))
    assert len(got) == 1 and len(got.pop()) > 100


def test_every_repeat_on_documents(spark):
    from spindrift.llm.common import documents

    d = documents(spark, "/root/testdata/sf0.01")
    data = [(r.doc_id, (r.text or "").lower()) for r in d.collect()]
    want = repeated_stretches(data)
    covered = defaultdict(set)
    for r in S.passages(d).collect():
        covered[r.doc_id].update(range(r.first_word, r.end_word))
    missed = [x for x in want if not covered[x[0]].issuperset(range(x[1], x[1] + 50))]
    assert len(want) > 10000 and not missed, (len(missed), len(want))


def test_many_copies_and_near_passages(spark):
    passage = words(70, 9).split()
    data = []
    for i in range(60):
        p = list(passage)
        if i % 3 == 1:
            p[35] = f"x{i}"
        data.append((i, words(15 + i, 1000 + i) + " " + " ".join(p) + " " + words(30, 2000 + i), "en", "s", 1))
    data += [(100 + i, words(200, 3000 + i), "en", "s", 1) for i in range(20)]
    got = S.passages(docs(spark, data)).collect()
    assert {r.doc_id for r in got} >= set(range(1, 60)) - {i for i in range(60) if i % 3 == 1}
    assert len({r.doc_id for r in got} & {i for i in range(60) if i % 3 == 1}) >= 16
    assert all(r.doc_id < 100 and r.of_doc_id < r.doc_id for r in got)


def repeated_stretches(data, t=50):
    """By brute force: for each document the first words of its stretches of t words that a document of smaller id holds."""
    least, out = {}, set()
    for i, text, *_ in data:
        w = text.split()
        for k in range(len(w) - t + 1):
            s = tuple(w[k : k + t])
            least[s] = min(i, least.get(s, i))
    for i, text, *_ in data:
        w = text.split()
        out |= {(i, k) for k in range(len(w) - t + 1) if least[tuple(w[k : k + t])] < i}
    return out


def test_every_repeat_beside_a_hot_heading(spark):
    heading, tail = words(42, 1).split(), words(30, 2).split()
    data = []
    for i in range(400):  # the heading is under 50 words, so only what two documents hold beside it makes a passage
        head = list(heading)
        if i % 5 == 4:
            head[20] = f"v{i % 7}"
        before, after = words(10, 5000 + i % 90), words(9 + i % 6, 9000 + i % 110)
        data.append((i, f"{words(12 + i % 9, 100 + i)} {before} {' '.join(head)} {after} {words(25, 20000 + i)} {' '.join(tail)} {words(40, 30000 + i % 150)}", "en", "s", 1))
    random.Random(4).shuffle(data)
    want = repeated_stretches(data)
    covered = defaultdict(set)
    for r in S.passages(docs(spark, data).repartition(6)).collect():
        assert r.of_doc_id < r.doc_id
        covered[r.doc_id].update(range(r.first_word, r.end_word))
    missed = [x for x in want if not covered[x[0]].issuperset(range(x[1], x[1] + 50))]
    assert len(want) > 3000 and not missed, (len(missed), len(want))


def test_recall_of_passages_at_the_threshold(spark):
    """Passages of 50 to 54 words with one changed, at a Jaccard similarity of 0.8 to 0.82; earlier documents hold a part of them."""
    r, data, pairs = random.Random(11), [], 400
    for g in range(pairs):
        n = r.randint(50, 54)
        a = words(n, 40000 + g).split()
        b = list(a)
        b[r.randrange(6, n - 6)] = f"z{g}"
        x, y = ({tuple(p[k : k + 5]) for k in range(n - 4)} for p in (a, b))
        assert 0.8 <= len(x & y) / len(x | y) <= 0.83
        for k, p in enumerate((a[: n // 2], a[n // 3 : -8], a[n // 2 :], a, b)):
            data.append((5 * g + k, f"{words(40 + k, 60000 + 5 * g + k)} {' '.join(p)} {words(40, 80000 + 5 * g + k)}", "en", "s", 1))
    found = {(x.of_doc_id, x.doc_id) for x in S.passages(docs(spark, data).repartition(5)).collect()}
    met = sum((5 * g + 3, 5 * g + 4) in found for g in range(pairs))
    assert met >= 0.995 * pairs, met


@pytest.mark.parametrize("rows_", [3, 1 << 16])
def test_links_of_values_against_brute_force(monkeypatch, rows_):
    monkeypatch.setattr(S, "ROWS", rows_)
    r = np.random.default_rng(6)
    n = 400
    key, doc, at = r.integers(0, 60, n), r.integers(0, 50, n), r.permutation(n)
    key[:80] = 1000  # a hot value
    mark = (np.arange(n) % 97 == 5).astype(np.int64)
    before, after = r.integers(0, 2, n), r.integers(0, 2, n)
    made = defaultdict(set)
    for b in S.linked_in([key, doc, at, before, after, mark], 16):
        assert b.num_rows <= max(rows_, 16 * 15) and b.num_rows
        for x in b.to_pylist():
            made[x["kind"]].add((x["doc"], x["at"], x["o_doc"], x["o_at"]) if x["kind"] == S.LINK else (x["key"], x["doc"], x["at"]))
    want = defaultdict(set)
    for k in set(key.tolist()):
        group = sorted((int(d), int(a), int(m), int(b), int(f)) for kk, d, a, m, b, f in zip(key, doc, at, mark, before, after) if kk == k)
        marked = any(x[2] for x in group)
        if marked or len(group) > 16:
            want[S.LINK] |= {(*x[:2], *group[0][:2]) for x in group if not x[2] and x[0] > group[0][0]}
            want[S.HOT] |= {(k, *x[:2]) for x in group if not x[2] and (x[3] or x[4])}
            if marked:
                want[S.FIRST].add((k, *group[0][:2]))
        else:
            want[S.LINK] |= {(*x[:2], *y[:2]) for x in group for y in group if x[0] > y[0]}
    assert made == {k: v for k, v in want.items() if v}


def test_covered_places():
    r = np.random.default_rng(8)
    for _ in range(50):
        owner, first = r.integers(0, 4, 12), r.integers(0, 40, 12)
        last = first + r.integers(-2, 9, 12)
        of, start = r.integers(0, 4, 30), r.integers(0, 45, 30)
        got = S.covered_until(owner, first, last, of, start)
        for o, s, g in zip(of, start, got):
            held = {p for w, a, b in zip(owner, first, last) if w == o for p in range(a, b + 1)}
            end = s - 1
            while end + 1 in held:
                end += 1
            assert g == end


def test_scratch_leaves_the_session_as_it_was(spark):
    from spindrift.llm.common import BATCH_KEY

    was = spark.conf.get(BATCH_KEY)
    scratch = Scratch(spark)
    a, b = (scratch.save(spark.range(3), n) for n in "ab")
    assert spark.conf.get(BATCH_KEY) == was
    scratch.keep_only("a")
    assert a.count() == 3 and scratch.names == {"a"}
    other = scratch.own()
    other.save(spark.range(5), "a")
    assert other.root != scratch.root and a.count() == 3
    with pytest.raises(Exception):
        scratch.save(spark.range(1).select(F.raise_error(F.lit("no"))), "c")
    assert spark.conf.get(BATCH_KEY) == was


def test_near_passages_of_hot_values_are_met(spark):
    """Two documents hold one passage but for a word in its middle; either half of it is in sixty others, so all that they share is hot."""
    data, bases = [], 5
    for g in range(bases):
        a = words(54, 900 + g).split()
        for i in range(120):
            data.append((1000 * g + i, f"{words(40, 10000 + 200 * g + i)} {' '.join(a[:30] if i % 2 else a[24:])} {words(40, 20000 + 200 * g + i)}", "en", "s", 1))
        for k, p in enumerate((a, [*a[:26], f"z{g}", *a[27:]])):
            data.append((1000 * g + 500 + k, f"{words(40, 30000 + 2 * g + k)} {' '.join(p)} {words(40, 40000 + 2 * g + k)}", "en", "s", 1))
    found = defaultdict(set)
    for x in S.passages(docs(spark, data).repartition(5)).collect():
        found[x.of_doc_id, x.doc_id].update(range(x.first_word, x.end_word))
    assert all(found[1000 * g + 500, 1000 * g + 501] >= set(range(40, 94)) for g in range(bases)), found


@pytest.mark.parametrize("seed", range(3))
def test_matched_values_against_brute_force(monkeypatch, seed):
    monkeypatch.setattr(S, "STRIP", 3)
    r = np.random.default_rng(seed)
    values, owner = r.integers(0, 20, 60), np.sort(r.integers(0, 7, 60))
    held, got = [values[owner == k].tolist() for k in range(7)], S.matched(values, owner, 7)
    assert all(got[a, b] == sum(v in held[b] for v in held[a]) for a in range(7) for b in range(7) if a != b)


def test_windows_are_the_same_only_with_the_same_shingles():
    r = np.random.default_rng(4)
    shingles = r.integers(0, 3, 400).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    l = r.integers(0, 390, 3000)
    c, reach = l + r.integers(0, 3, 3000), r.integers(3, 6, 3000)
    made = S._same_shingles(shingles, l, c, l + reach)
    held = [(shingles[a : a + n + 1].tobytes(), int(b - a)) for a, b, n in zip(l, c, reach)]
    assert len(set(made.tolist())) == len(set(held)) == len(set(zip(made.tolist(), held)))


def test_windows_at_the_edges_of_copies_are_not_linked_to_all_copies(spark, monkeypatch):
    """What stands in all copies of a hot passage is covered by one of them, so the others bring nothing to windows that reach beyond its ends."""
    counts, save = {}, S.Scratch.save

    def counted(self, df, name):
        saved = save(self, df, name)
        counts[name] = saved.count()
        return saved

    monkeypatch.setattr(S.Scratch, "save", counted)
    passage = words(70, 9)
    data = [(i, f"{words(15 + i % 9, 1000 + i)} {passage} {words(30, 2000 + i)}", "en", "s", 1) for i in range(80)]
    covered = defaultdict(set)
    for r in S.passages(docs(spark, data)).collect():
        covered[r.doc_id].update(range(r.first_word, r.end_word))
    short = {i: sorted(set(range(15 + i % 9, 85 + i % 9)) - covered[i]) for i in range(1, 80)}
    assert not any(short.values()), short
    assert counts["near-every"] < 80, counts


def test_shingles_that_nothing_covers():
    # the spans of document 0 leave its words 60 to 69 and those from 90 on, document 1 has none
    of, l, r = np.array([0, 0, 1]), np.array([0, 50, 3]), np.array([99, 85, 5])
    low, high = S.bare_bits(of, l, r, np.array([0, 0]), np.array([0, 70]), np.array([60, 90]), 2, 5)
    bits = [[int(x) >> i & 1 for x in (low[k], high[k]) for i in range(64)] for k in range(3)]
    assert [i for i, b in enumerate(bits[0]) if b] == [*range(56, 70), *range(86, 100)]
    assert [50 + i for i, b in enumerate(bits[1]) if b] == list(range(56, 70)) and [i for i, b in enumerate(bits[2]) if b] == [0, 1, 2]
    n = np.array([100, 36, 3])
    weights = S.new_weights(n, S._expanded(n, low, high))
    for window, places, adds in ((0, [0, 20, 55], False), (0, [20, 57], True), (0, [20, 80], True), (0, [70, 85], False), (1, [0, 5], False), (1, [0, 25], True), (2, [1], True)):
        start = int(n[:window].sum())
        assert bool(S.adds_words(np.array([weights[[start + p for p in places]].sum()]))[0]) == adds, (window, places)
