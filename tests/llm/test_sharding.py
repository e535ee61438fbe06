import random
import zlib
from collections import defaultdict

import pytest

from gridmap.llm import sharding
from gridmap.llm.sharding import minimax_shards


def brute_capacity(sizes, shards):
    def ok(c):
        n = at = 0
        for s in sizes:
            if s > c:
                return False
            if n == 0 or at + s > c:
                n, at = n + 1, 0
            at += s
        return n <= shards
    c = max(max(sizes), -(-sum(sizes) // shards))
    while not ok(c):
        c += 1
    return c


@pytest.mark.parametrize("cells", [1, 50_000])
def test_smallest_capacity_is_exact(spark, cells):
    rnd = random.Random(5)
    for shards in (2, 7):
        sizes = [rnd.choice([1, 3, 17, 40]) + rnd.randrange(30) for _ in range(120)]
        at, rows = 0, []
        for s in sizes:
            at += s
            rows.append((at, s))
        prefix = spark.createDataFrame(rows, "upto long, gsize long")
        cap, total, bounds = sharding.smallest_capacity(prefix, shards, cells)
        assert (cap, total) == (brute_capacity(sizes, shards), sum(sizes))
        cuts = [0, *sharding.balanced_cuts(bounds, shards, cap, total), total]
        assert all(b - a <= cap for a, b in zip(cuts, cuts[1:])) and sorted(cuts) == cuts
        assert set(cuts) <= {0, *(r[0] for r in rows)}


def test_whole_table(spark):
    rnd = random.Random(1)
    texts = ["x" * rnd.randrange(200) for _ in range(150)] + ["same"] * 60 + [None, "", "é" * 50]
    rows = [(i, t, "extra") for i, t in enumerate(texts)] + [(None, "no id", "extra"), (3, texts[3], "extra")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard string")
    out = minimax_shards(docs, shards=5).collect()
    assert len(out) == len(rows)
    text = dict((r[0], r[1] or "") for r in rows)
    where, load, slots = defaultdict(set), defaultdict(int), defaultdict(list)
    for r in out:
        t = text[r["doc_id"]]
        assert r["size"] == len(t.encode()) + 16 and r["text_crc32"] == zlib.crc32(t.encode())
        where[t].add(r["shard"])
        load[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert all(len(s) == 1 for s in where.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    groups = {}
    for r in sorted(out, key=lambda r: (r["doc_id"] is not None, r["doc_id"])):
        t = text[r["doc_id"]]
        groups[t] = groups.get(t, 0) + r["size"]
    first = {}
    for r in out:
        t = text[r["doc_id"]]
        k = (r["doc_id"] is not None, r["doc_id"] or 0)
        first[t] = min(first.get(t, (True, 1 << 60)), k if k[0] else (True, 1 << 60)) if r["doc_id"] is not None else first.get(t, (True, 1 << 60))
    order = sorted(groups, key=lambda t: (first[t][1] != 1 << 60, first[t][1]))
    assert max(load.values()) == brute_capacity([groups[t] for t in order], 5)


def test_empty(spark):
    assert minimax_shards(spark.createDataFrame([], "doc_id long, text string")).count() == 0
