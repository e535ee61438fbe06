import random
import re
import zlib

import numpy as np
import pytest

from gridmap.llm import near_dup as N
from gridmap.llm.common import word_hashes


def brute(rows, k, similarity):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    comp = {i: i for i, _ in rows}

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b]):
                x, y = sorted((find(rows[a][0]), find(rows[b][0])))
                comp[y] = x
    return sorted((i, len(s), find(i), find(i) == i) for (i, _), s in zip(rows, sets))


def edited(rnd, words, n):
    words = list(words)
    for _ in range(n):
        words[rnd.randrange(len(words))] = f"new{rnd.random()}"
    return words


@pytest.mark.parametrize("k", [2, 5])
def test_components_equal_brute_force(spark, k):
    rnd = random.Random(k)
    rows, vocabulary = [], [f"w{i}" for i in range(400)]
    for g in range(12):  # near copies at all distances from their original, and chains of copies of copies
        words = [rnd.choice(vocabulary) for _ in range(rnd.choice([12, 60, 150]))]
        for c in range(14):
            text = edited(rnd, words, rnd.randrange(0, 8))
            rows.append(" ".join(text))
            if c % 3 == 0:
                words = text
    rows += [None, "", " \n", "One", "one", "one two", "ONE\ttwo\n", "é", "É", rows[0].upper(), rows[0], "x " * 500, "x x x", "long " + "w " * 9000]
    rnd.shuffle(rows)
    rows = list(enumerate(rows))
    docs = spark.createDataFrame([(i, t, 1, "k") for i, t in rows], "doc_id long, text string, node int, kept string").repartition(4)
    out = N.near_duplicates(docs, k=k).collect()
    assert sorted(tuple(r) for r in out) == brute(rows, k, 80)
    kept = {r["doc_id"] for r in N.drop_near_duplicates(docs, k=k).collect()}
    assert kept == {r["doc_id"] for r in out if r["kept"]}


def test_a_cloud_of_half_similar_texts(spark, monkeypatch):
    """One bucket holds many texts that are 0.65 to 0.85 similar to each other: only exact counts settle which are linked."""
    monkeypatch.setattr(N, "TILE_ITEMS", 3000)  # several tiles
    rnd = random.Random(8)
    base = [f"b{i}" for i in range(100)]
    rows = list(enumerate(" ".join(edited(rnd, base, rnd.randrange(4, 14))) for _ in range(160)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    assert sorted(tuple(r) for r in N.near_duplicates(docs, k=2).collect()) == brute(rows, 2, 80)
    assert sorted(tuple(r) for r in N.near_duplicates(docs, k=2, bands=40, rows=2).collect()) == brute(rows, 2, 80)


def test_links_of_a_group_equal_all_pairs():
    import pyarrow as pa

    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 30, 30)) for _ in range(60)]
    comp, probe = rng.integers(0, 12, 60), np.arange(60) % 3 == 0
    order = list(range(60)) + np.flatnonzero(probe).tolist()  # a probe is a member too
    group = pa.RecordBatch.from_arrays([pa.array([False] * 60 + [True] * int(probe.sum())), pa.array(comp[order]), pa.array(np.array(order)),
                                        pa.array([sets[i].tolist() for i in order], pa.list_(pa.int64()))], names=["probe", "comp", "node", "items"])
    want = {(p, int(comp[m])) for p in np.flatnonzero(probe) for m in range(60) if comp[m] != comp[p]
            and 100 * len(np.intersect1d(sets[p], sets[m])) >= 60 * len(np.union1d(sets[p], sets[m]))}
    got = list(N._linked(group, 60))
    assert {(u, int(comp[v])) for u, v in got} == want and len(got) == len(want) > 10


def test_rows_that_share_an_id_go_by_their_text(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (2, "A b c d e f"), (2, "another text of its own here"), (None, "a b c d e f")], "doc_id long, text string")
    left = sorted((r.doc_id or 0, r.text) for r in N.drop_near_duplicates(docs).collect())
    assert left == [(0, "a b c d e f"), (1, "a b c d e f"), (2, "another text of its own here")]


def test_null_ids_repeated_rows_and_empty(spark):
    docs = spark.createDataFrame([(None, "a b c"), (3, "a b c"), (3, "a b c"), (1, "a B c"), (None, None)], "doc_id long, text string")
    out = sorted((str(r[0]), r[1], str(r[2]), r[3]) for r in N.near_duplicates(docs, k=2).collect())
    assert out == [("1", 2, "1", True), ("3", 2, "1", False), ("3", 2, "1", False), ("None", 0, "None", True), ("None", 2, "None", True)]
    assert N.drop_near_duplicates(docs).count() == 3
    assert N.near_duplicates(docs.limit(0)).count() == 0


def test_signature_estimates_similarity():
    rng = np.random.default_rng(1)
    a = np.unique(rng.integers(0, 1 << 62, 4000, dtype=np.uint64))
    b = np.unique(np.concatenate([a[:3000], rng.integers(0, 1 << 62, 1000, dtype=np.uint64)]))
    sig = N.signatures(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]), 640)
    assert abs((sig[0] == sig[1]).mean() - 0.6) < 0.08


def test_components_of_chains_and_stars(spark):
    rnd = random.Random(9)
    names = rnd.sample(range(10_000), 300)
    links = [(names[i], names[i + 1]) for i in range(120)] + [(names[150], names[j]) for j in range(151, 250)]
    got = {r["node"]: r["comp"] for r in N.components(spark.createDataFrame(links, "u long, v long")).collect()}
    chain, star = names[:121], names[150:250]
    assert got == {**{n: min(chain) for n in chain}, **{n: min(star) for n in star}}


def test_word_hashes_of_long_and_odd_texts(monkeypatch):
    texts = ["A b", None, "", "a\tB", "x" * 50_000 + " y", "x" * 50_000, "é É"]
    words, edges = word_hashes(texts)
    split = [words[s:e].tolist() for s, e in zip(edges, edges[1:])]
    assert [len(s) for s in split] == [2, 0, 0, 2, 2, 1, 2]
    assert split[0] == split[3] and split[4][0] == split[5][0] and len(set(split[6])) == 2
    many = [str(zlib.crc32(str(i).encode())) for i in range(20_000)]
    assert len(np.unique(word_hashes([" ".join(many)])[0])) == len(set(many))
