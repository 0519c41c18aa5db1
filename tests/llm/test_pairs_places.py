import itertools
import random
from datetime import datetime, timedelta

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from placeloom.llm import bktree, canonical, neardup, vptree


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_bk_trees_match_brute_force():
    rng = random.Random(2)
    keys = ["".join(rng.choice("abcd") for _ in range(rng.randint(1, 9))) for _ in range(300)]
    asked = ["".join(rng.choice("abcde") for _ in range(rng.randint(0, 10))) for _ in range(40)] + ["x" * 200]
    tree, forest = bktree.BKTree(keys), bktree.BKForest(keys)
    for r in (0, 1, 2):
        want = sorted((i, k, edits(s, k)) for i, s in enumerate(asked) if s for k in tree.keys if edits(s, k) <= r)
        assert sorted((int(i), tree.keys[k], int(d)) for i, k, d in zip(*tree.search(asked, r))) == want
        assert sorted(forest.search(asked, r)) == [w for w in want if asked[w[0]]]
    assert bktree.BKForest([]).nearest(["a"], 2) == []


def test_vp_tree_loses_no_pair():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, size=(40, 2)).astype(np.uint64)
    prints = np.repeat(base, 10, axis=0) ^ (np.uint64(1) << rng.integers(0, 64, size=(400, 2)).astype(np.uint64))
    radius = rng.integers(0, 9, 400)
    d = np.bitwise_count(prints[:, None] ^ prints[None]).sum(axis=2)
    want = set(zip(*np.nonzero(d <= radius[:, None])))
    got = [p for i, j in vptree.pairs_within(prints, prints, radius, leaf=8) for p in zip(i.tolist(), j.tolist())]
    assert set(got) == want and len(got) == len(want)


def test_vp_tree_asks_each_query_of_its_own_stretch():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**63, size=(30, 2)).astype(np.uint64)
    prints = base[rng.integers(0, 30, 900)] ^ (np.uint64(1) << rng.integers(0, 64, size=(900, 2)).astype(np.uint64))
    radius, since, until = rng.integers(0, 9, 600), np.sort(rng.integers(0, 400, 600)), np.arange(300, 900)
    d = np.bitwise_count(prints[300:, None] ^ prints[None]).sum(axis=2)
    at = np.arange(900)
    want = set(zip(*np.nonzero((d <= radius[:, None]) & (at >= since[:, None]) & (at < until[:, None]))))
    assert len(want) > 1000
    for leaf in (8, 10**6):
        got = [p for i, j in vptree.pairs_within(prints, prints[300:], radius, leaf, since, until) for p in zip(i.tolist(), j.tolist())]
        assert set(got) == want and len(got) == len(want)


def test_rows_of_a_shard_meet_once(monkeypatch):
    rng, day, least = np.random.default_rng(6), 86_400 * 10**6, neardup.Threshold(7, 10)
    kinds = rng.integers(-(2**63), 2**63 - 1, size=(25, 2))
    n, sizes = 1500, rng.integers(6, 30, 1500)
    shard, first = np.repeat([7, 9, 11], [1200, 20, 280]), np.sort(rng.integers(0, 4 * day, n))
    first[1200:1220], first[1220:] = np.sort(first[1200:1220]), np.sort(rng.integers(0, day, 280))
    span = np.where(rng.random(n) < 0.2, rng.integers(0, day // 2, n), 0)
    bits = kinds[rng.integers(0, 25, n)] ^ (1 << rng.integers(0, 62, size=(n, 2)))
    cols = [shard, first, np.arange(n) + 100, bits[:, 0], bits[:, 1], (sizes << 40) | span]
    last, d = first + span, np.bitwise_count((bits[:, None] ^ bits[None]).view(np.uint64)).sum(axis=2)
    near = (shard[:, None] == shard) & (first[:, None] - last <= day) & (first - last[:, None] <= day)
    alike = near & (d <= least.apart(sizes[:, None], sizes)) & least.sizes(sizes[:, None], sizes)
    want = {(a + 100, b + 100) for a, b in zip(*np.nonzero(alike)) if a < b}
    assert len(want) > 1000
    found, search = [], neardup.pairs_within
    monkeypatch.setattr(neardup, "pairs_within", lambda *args: (p for p in search(*args) if not found.append(len(p[0]))))
    for at_once, told in ((1, 1), (500, 300), (10**6, 10**6)):
        monkeypatch.setattr(neardup, "MET_AT_ONCE", at_once)
        monkeypatch.setattr(neardup, "TOLD_AT_ONCE", told)
        batches = [pa.RecordBatch.from_arrays([pa.array(c[lo : lo + 100]) for c in cols], list("abcdef")) for lo in range(0, n, 100)]
        found.clear()
        got = [p for b in neardup.meeting(86_400, least)(iter([batches[0][:0], *batches])) for p in zip(*(c.to_pylist() for c in b.columns))]
        assert set(got) == want and len(got) == len(want)
        # No pair comes out of the trees twice, nor a row with itself.
        assert sum(found) <= ((d <= least.radius(sizes)[:, None]) & (shard[:, None] == shard) & np.tri(n, k=-1, dtype=bool)).sum()


def posts(n, seed):
    rng, start = random.Random(seed), datetime(2016, 1, 4)
    vocab = [f"word{i}" for i in range(60)]
    out = []
    for i in range(n):
        if out and rng.random() < 0.5:
            words = out[rng.randrange(len(out))][2].split()
            for _ in range(rng.randint(0, 3)):
                words[rng.randrange(len(words))] = rng.choice(vocab)
        else:
            words = rng.sample(vocab, rng.randint(5, 14))
        out.append((f"{1000 + i}", start + timedelta(hours=rng.uniform(0, 90)), " ".join(words)))
    return out


def brute_groups(rows):
    docs = [(k, t, frozenset(x.split())) for k, t, x in rows if k and t and x and len(set(x.split())) >= 6]
    up = {k: k for k, *_ in docs}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for (a, s, v), (b, t, w) in itertools.combinations(docs, 2):
        if abs(s - t) <= timedelta(hours=24) and 10 * len(v & w) >= 7 * len(v | w):
            up[max(top(a), top(b))] = min(top(a), top(b))
    groups = {}
    for k, *_ in docs:
        groups.setdefault(top(k), set()).add(k)
    return {(g, k) for g, ks in groups.items() if len(ks) > 1 for k in ks}


def test_near_duplicates_match_brute_force(spark):
    rows = posts(260, 5)
    copy = [(f"c{i:03}", datetime(2016, 1, 4, 3) + timedelta(minutes=i), "one two three four five six seven") for i in range(120)]
    odd = [("n1", None, rows[0][2]), ("n2", rows[0][1], None), ("n3", rows[0][1], ""), (None, rows[0][1], rows[0][2]), ("l1", rows[0][1], "a b c d e f " + "long " * 30_000)]
    whole = rows + copy
    df = spark.createDataFrame(whole + odd + rows[:5], "id string, at timestamp, text string").withColumn("node", F.lit(1)).withColumn("group_id", F.lit("x"))
    want = brute_groups(whole)
    assert len(want) > 150
    for hot in (neardup.HOT_WORD, 10, 0):  # shards of one word, and of up to three
        got = [tuple(r) for r in neardup.near_duplicates(df, "id", "at", "text", hot=hot).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert neardup.near_duplicates(df.limit(0), "id", "at", "text").count() == 0


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 50)] + [(5, 5)]
    got = dict(map(tuple, neardup.components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert all(got[i] == 0 for i in range(61)) and all(got[1000 + i] == 1000 for i in range(50)) and len(got) == 111


ENTRIES = [
    ("Oberankirch", 1, False, 5000, [1, 90], 0), ("Giaorno", 2, False, 900, [2, 91], 0), ("Giaorno", 3, False, 100, [3, 90], 0), ("Veldora", 90, True, 10**6, [90], 0),
    ("Belina", 91, True, 10**6, [91], 0), ("VQD", 90, True, 0, [90], 2), ("BLN", 91, True, 10**6, [91], 1), ("Kızıltaş Köyü", 4, False, 10, [4, 91], 0), ("Хитград", 5, False, 10, [5], 0), (None, 6, False, 1, [6], 0),
]
WANT = {
    "Oberankirch": {1}, "  oberANKIRCH ✌": {1}, "living in Oberankirch": {1}, "Oberankrch": {1}, "Obrankirck": {1}, "Obernkrch!": {1}, "Oberankirch/Giaorno": {1, 2}, "Oberankirch and Giaorno": {1, 2},
    "Giaorno": {2}, "Giaorno, Veldora": {3}, "giaorno (BLN)": {2}, "Giaorno, VQD": {3}, "BLN": {91}, "BLM": {None}, "ex-Giaorno": {2}, "kiziltaskoyu": {4}, "Ｇｉａｏｒｎｏ": {2}, "Gіaorno": {2}, "хитград": {5}, "ask my mum": {None}, "Wobpruyit, Veldora": {None},
    "24/7 online": {None}, "x" * 5000: {None},
}


def test_map_values(spark):
    entries = spark.createDataFrame(ENTRIES, "label string, id int, is_area boolean, population long, inside array<int>, kind int")
    values = spark.createDataFrame([(v,) for v in [*WANT, None, "", "   ", "Giaorno"]], "v string").withColumn("name", F.lit("x"))
    got = {}
    for r in canonical.map_values(values, "v", entries).collect():
        got.setdefault(r["value"], set()).add(r["id"])
    assert got == WANT
    assert canonical.map_values(values.limit(0), "v", entries).count() == 0


def test_sharded_names_give_the_same(spark):
    names = [f"name{i:03}x{i % 7}" for i in range(60)]
    keys = spark.createDataFrame([(n[:-1],) for n in names] + [("zzzzzz",)], "key string")
    df = spark.createDataFrame([(n,) for n in names], "name string")
    whole = sorted(map(tuple, canonical.nearest_names(keys, df).collect()))
    assert whole and whole == sorted(map(tuple, canonical.nearest_names(keys, df, names_per_shard=11).collect()))


def test_names_of_any_length(spark):
    long_name = "Llanfair" + "pwll" * 16
    many_words = "Saint Mary By The Old Mill Near The Bend Of River"
    entries = spark.createDataFrame([(long_name, 1, False, 5, [1], 0), (many_words, 2, False, 5, [2], 0), ("Oakport", 3, False, 9, [3], 0), ("OKP", 4, False, 1, [4], 1)], "label string, id int, is_area boolean, population long, inside array<int>, kind int")
    told = {long_name: 1, long_name[:40] + "x" + long_name[40:]: 1, "x " + long_name[:-2]: 1, f"living in {many_words} today": 2, many_words.replace("Mill", "Mil"): 2, "okp": 4, "oakprt": 3, "okq": None, "word " * 5_000 + "Oakport": 3}
    values = spark.createDataFrame([(v,) for v in told], "v string")
    assert {r["value"]: r["id"] for r in canonical.map_values(values, "v", entries).collect()} == told
    assert {r["value"]: r["id"] for r in canonical.map_values(values, "v", entries, names_per_shard=1).collect()} == told


def test_long_patterns_have_the_true_distance():
    rng = random.Random(3)
    keys = ["".join(rng.choice("ab") for _ in range(rng.randint(60, 90))) for _ in range(60)]
    keys += [k[:30] + k[31:] for k in keys[:20]]
    want = sorted((i, k, d) for i, q in enumerate(keys) for k in set(keys) if (d := edits(q, k)) <= 2)
    assert sorted(bktree.BKForest(keys).search(keys, 2)) == want
