import hashlib

import pytest

from gridmap.llm import exact_dedup as D

ROWS = [(1, "Aa b"), (2, "aA B"), (3, None), (4, ""), (5, "É"), (6, "é"), (7, "x" * 100_000), (8, "X" * 100_000),
        (9, "x" * 99_999 + "y"), (10, "p" * 70 + "1"), (11, "p" * 70 + "2"), (1, "Aa b"), (None, "lone"), (None, "aa b")]


def brute(rows):
    norm = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "") for _, t in rows]
    out = []
    for (i, _), n in zip(rows, norm):
        ids = [j for (j, _), m in zip(rows, norm) if m == n]
        known = [j for j in ids if j is not None]
        keep = max(known) if known else None
        out.append((str(i), str(keep), len(ids), i == keep, hashlib.sha256(n.encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("rows", [0, 200_000])
def test_groups(spark, rows, monkeypatch):
    monkeypatch.setattr(D.duplicate_groups, "__defaults__", ("doc_id", "text", 64, rows))
    docs = spark.createDataFrame([(i, t, "old", 1) for i, t in ROWS], "doc_id long, text string, kept string, keep_ID int")
    out = D.exact_dedup(docs, sha_col="sha").select("doc_id", "keep_id", "group_size", "kept", "sha").collect()
    assert sorted((str(r[0]), str(r[1]), r[2], r[3], r[4]) for r in out) == brute(ROWS)


def test_drop_duplicates_and_empty(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    kept = D.drop_duplicates(docs)
    assert kept.columns == ["doc_id", "text"]
    assert sorted(str(r[0]) for r in kept.collect()) == sorted(map(str, [2, 4, 5, 6, 8, 9, 10, 11, None]))
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert D.exact_dedup(empty).count() == 0


def test_columns_named_like_helpers(spark):
    rows = [(1, "Same", "p", "q", 7, "k"), (2, "same", "p", "q", 8, "k"), (3, "other", "p", "q", 9, "k"), (None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __sha string, __key string, keep_id int, __Slot string")
    out = D.drop_duplicates(docs)
    assert out.columns == docs.columns
    assert sorted(map(tuple, out.collect()), key=str) == sorted([rows[1], rows[2], rows[3]], key=str)
    assert {r["doc_id"]: r["kept"] for r in D.exact_dedup(docs).collect()} == {1: False, 2: True, 3: True, None: True}


def test_texts_outside_the_filter_are_not_hashed(spark):
    docs = spark.createDataFrame([(i, f"text {i}" if i < 90 else "the same text") for i in range(100)], "doc_id long, text string")
    found = D._filter(docs, "text", 64)
    hashed = {r["doc_id"] for r in D._marked(docs, found, "text", 64, "sha").where("sha is not null").collect()}
    assert hashed == set(range(90, 100))
    assert {r["doc_id"] for r in D.drop_duplicates(docs).collect()} == {*range(90), 99}
    long = spark.createDataFrame([(i, "p" * 64 + str(i // 2) * 5) for i in range(20)], "doc_id long, text string")  # prefixes and lengths say nothing
    assert {r["doc_id"] for r in D.drop_duplicates(long).collect()} == {1, 3, 5, 7, 9, 11, 13, 15, 17, 19}
