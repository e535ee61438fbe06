import math
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from gridmap.llm import quality_rules as Q
from gridmap.llm.queries import QUERIES


def plain_statistics(text):
    words, lines = text.split(), [line for line in text.split("\n") if line]
    lower = ["".join(c.lower() if c.isascii() else c for c in w) for w in words]
    n, m, k = len(text), max(len(words), 1), max(len(lines), 1)
    size = [len(w.encode()) for w in words]
    up, low = sum("A" <= c <= "Z" for c in text), sum("a" <= c <= "z" for c in text)
    other = sum(ord(c) >= 128 for c in text)
    count = lambda chars: sum(c in chars for c in text) / max(n, 1)
    symbols = sum(ord(c) < 128 and not c.isalnum() and c not in " \t\n\x0b\x0c\r,;:'\"()-.?!|" for c in text) / max(n, 1)
    return [math.log1p(n), math.log1p(len(words)), math.log1p(len(lines)), sum(size) / m, max(size, default=0), math.log1p(n / k),
            len(set(lower)) / m, len(set(lines)) / k if lines else 0, max(Counter(lower).values(), default=0) / m,
            sum(a == b for a, b in zip(lower, lower[1:])) / m, sum(w[-1] in ".!?" for w in words) / m, up / max(up + low, 1),
            (up + low + other) / max(n, 1), count("0123456789"), count(" \t\n\x0b\x0c\r"), count(",;:'\"()-"), count(".?"), count("!"), count("|"), symbols]


def rows(n, seed):
    """Good prose, and four kinds of bad texts."""
    rnd, out = random.Random(seed), []
    for i in range(n):
        words = [f"{rnd.choice('abcdefgh')}{rnd.choice('xyz')}{rnd.randrange(400)}".translate(str.maketrans("0123456789", "klmnopqrst")) for _ in range(rnd.randrange(8, 90))]
        kind = rnd.choice([0, 0, 0, 0, 0, 1, 2, 3, 4])
        if kind == 1:
            words = [w for w in words[:10] for _ in range(9)]
        if kind == 2:
            words = [w.upper() + "!!" for w in words]
        if kind == 3:
            words = [w + "###" for w in words]
        text = (" | " if kind == 4 else " ").join(words).capitalize() + "." if kind != 2 else " ".join(words)
        out.append((i, text, int(kind == 0)))
    return out


def test_statistics_equal_plain_counts():
    texts = [t for _, t, _ in rows(200, 1)] + ["", " \n ", "é", "a\n\na\nb\tb B", "x" * 3000, "ÀÉ 12,5 % | | !? «ok»\n", "a b\n\x0c\n"]
    got = Q.statistics_of([t.encode() for t in texts])
    assert np.allclose(got, [plain_statistics(t) for t in texts])


def test_held_out_quality_and_column(spark):
    data = rows(2400, 3)
    docs = spark.createDataFrame([(i, t, 0.5) for i, t, _ in data], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, y) for i, _, y in data] + [(0, None), (None, 1)], "doc_id long, quality int")
    ensemble = Q.train(docs, labels, F.col("id") % 3 != 1)
    assert 2 <= len(ensemble.rules) < 100 and len(ensemble.describe()) == len(ensemble.rules)
    out = {r["doc_id"]: r for r in Q.score(docs, ensemble).collect()}
    assert np.mean([out[i]["predicted"] == y for i, _, y in data if i % 3 == 1]) > 0.98
    margin = ensemble.margin(Q.statistics_of([t.encode() for _, t, _ in data]))
    assert np.allclose([out[i]["score"] for i, _, _ in data], 1 / (1 + np.exp(-np.clip(margin, -40, 40))))
    assert all(r["predicted"] == int(r["score"] >= 0.5) for r in out.values())
    odd = spark.createDataFrame([(1, None), (None, ""), (2, "x" * 300_000), (2, "Fine prose, as it is.")], "doc_id long, text string")
    got = Q.score(odd, ensemble).collect()
    assert len(got) == 4 and all(0 <= r["score"] <= 1 for r in got)
    assert Q.score(docs.limit(0), ensemble).count() == 0


def test_paths_are_conjunctions_of_their_bounds():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(600, 4))
    y = ((x[:, 0] > 0.3) & (x[:, 1] < 0.5)).astype(int)
    rules = Q.grow_rules(x, y, trees=5)
    assert all(1 <= len(r) <= Q.DEPTH for r in rules) and len(set(rules)) == len(rules)
    assert max(np.mean(Q.holds(r, x) == y) for r in rules) > 0.95
    assert np.mean((Q.fit(x, y).margin(x) > 0) == y) > 0.97


def test_without_labels_of_both_classes(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r["predicted"] for r in Q.score(docs, Q.train(docs, none)).collect()} == {0}
    one = spark.createDataFrame([(1, 1), (1, 1), (2, 1)], "doc_id long, quality int")
    assert {r["predicted"] for r in Q.score(docs, Q.train(docs, one)).collect()} == {1}


def test_query_rows_and_types(spark, tmp_path):
    data = rows(600, 7)
    spark.createDataFrame([(i, t) for i, t, _ in data] + [(None, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, y) for i, _, y in data], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    out = QUERIES["op12_quality_rules"](spark, str(tmp_path))
    assert dict(out.dtypes) == {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"}
    got = out.collect()
    assert len(got) == 601 and all(r["held_out"] is not None and 0 <= r["score"] <= 1 for r in got)
    held = {r["doc_id"]: r["predicted"] for r in got if r["held_out"]}
    assert np.mean([held[i] == y for i, _, y in data if i in held]) > 0.95
