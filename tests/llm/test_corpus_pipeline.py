import random

import pytest

import __spark_entry__ as E
import corpus_pipeline as P
from gridmap.llm.queries import ORACLE, QUERIES


def fixture_rows():
    """Documents with toxic rows, exact and near copies and benchmark passages; expected ids after each stage."""
    rnd = random.Random(6)
    vocabulary = [f"w{''.join(rnd.choice('aeioustrn') for _ in range(7))}" for _ in range(900)]
    text = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    docs, labels = [(i, text(rnd.randrange(20, 120))) for i in range(600)], []
    toxic = set()
    for i in range(0, 600, 6):  # insults
        docs[i] = (i, docs[i][1] + " vilescum " + text(3))
        toxic.add(i)
    labels = [(i, 1, int(i in toxic)) for i in range(0, 560)]
    exact, near, leaks = {}, {}, set()
    for k in range(20):
        a, b, c = 6 * k + 1, 6 * k + 2, 6 * k + 3
        docs[b] = (b, docs[a][1].upper())  # the larger doc_id stays
        exact[a] = b
        if k < 10:
            words = text(120).split()
            docs[b], docs[a] = (b, " ".join(words)), (a, " ".join(words).title())
            words[60] = "changed"
            docs[c] = (c, " ".join(words))
            near[c] = b
    items = [(i, text(25)) for i in range(8)]
    for k in range(8):
        i = 6 * (k + 30) + 5
        docs[i] = (i, text(30) + " " + items[k][1] + " " + text(30))
        leaks.add(i)
    alive = {i for i, _ in docs} - toxic
    steps = [alive, alive - set(exact)]
    steps.append(steps[-1] - set(near))
    steps.append(steps[-1] - leaks)
    return docs, labels, items, steps


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    docs, labels, items, steps = fixture_rows()
    d = str(tmp_path_factory.mktemp("corpus"))
    rows = [(i, t, "en", "s", len(t)) for i, t in docs]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int").repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d, dict(docs), steps


def test_each_stage_against_what_was_planted(spark, folder):
    d, texts, steps = folder
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns = docs.columns
    for k, (_, stage) in enumerate(P.STAGES):
        out = P.written(stage(spark, docs, d), f"test-{k}")
        if k < 4:
            assert out.columns == columns
            rows = out.collect()
            assert {r["doc_id"] for r in rows} == steps[k] and len(rows) == len(steps[k])
            assert all(r["text"] == texts[r["doc_id"]] for r in rows)
        docs = out
    assert {r["doc_id"] for r in docs.collect()} == steps[3]
    sizes = [r["n"] for r in docs.groupBy("sequence_id").agg({"length": "sum"}).withColumnRenamed("sum(length)", "n").collect()]
    assert max(sizes) <= 2048


def test_run_equals_the_stages_and_odd_rows_pass(spark, folder, tmp_path):
    d, _, steps = folder
    assert {r["doc_id"] for r in P.run(spark, d).select("doc_id").collect()} == steps[3]
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "s", 0), (2, None, None, None, None), (3, "x " * 50_000, "en", "s", 9),
                                 (3, "x " * 50_000, "en", "s", 9)], "doc_id long, text string, lang string, source string, n_chars int")
    for name, rows in (("odd", odd), ("none", odd.limit(0))):
        e = str(tmp_path / name)
        rows.write.parquet(f"{e}/documents.parquet")
        spark.read.parquet(f"{d}/labels.parquet").limit(0).write.parquet(f"{e}/labels.parquet")
        spark.read.parquet(f"{d}/benchmark.parquet").limit(0).write.parquet(f"{e}/benchmark.parquet")
        out = P.run(spark, e).collect()
        assert {r["doc_id"] for r in out} == ({2, 3} if name == "odd" else set())


def test_queries_are_registered():
    names = E.queries()
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10
    assert "pipeline" in names and set(ORACLE) <= set(QUERIES) <= set(names)
    assert [n for n, _ in P.STAGES] == ["toxicity", "exact_dedup", "minhash_near_dedup", "benchmark_decontamination", "best_fit_packing"]


def test_later_operators_are_registered():
    names = E.queries()
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in (11, 12, 13)] == [1] * 3
