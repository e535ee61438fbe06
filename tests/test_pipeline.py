import datetime as dt

import pandas as pd
from pyspark.sql import functions as F

from gridmap.operators.scorer import score
from gridmap.plans import corpus as K
from gridmap.plans import pipeline as P
from gridmap.streaming.ingest import ingest_folder


def small_corpus(spark):
    orders = spark.createDataFrame([(k, dt.datetime(2024, 1, 1 + k)) for k in range(1, 9)],
                                   "o_orderkey long, o_orderdate timestamp")
    li = spark.createDataFrame(
        [(k, 100 + n, 7, n, 1000.0 + n, "O" if n % 2 else "F", dt.datetime(2024, 2, n))
         for k in range(1, 8) for n in range(1, 4)],
        "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_extendedprice double, "
        "l_linestatus string, l_shipdate timestamp")
    return K.corpus_cells(orders, li), K.corpus_docs(orders), orders


def test_mapping_job_finds_true_headers(spark):
    cells, docs, orders = small_corpus(spark)
    res = P.map_documents(cells, docs)
    m = res.mapping.where(F.col("header").isNotNull()).select("doc_id", "section", "field", "header")
    truth = K.corpus_truth(orders).select("doc_id", "section", "field", "header")
    hit = m.join(truth, ["doc_id", "section", "field", "header"]).count()
    assert hit >= 7 * 4                            # code, name, price and date are found for every document
    # order 8 has no line items: its header has no content row -> quarantined, job goes on
    errs = res.errors.collect()
    assert [(e.doc_id, e.code) for e in errs] == [(8, "HEADER_VALIDATION_LOW_CONFIDENCE")]
    # one winner per claimed header
    assert all(r["count"] == 1 for r in m.groupBy("doc_id", "header").count().collect())


def test_scorer_hook_records_failures(spark):
    prompts = spark.createDataFrame([(1, "a fund"), (2, "stock list")], "doc_id long, prompt string")

    def ok(pdf):
        return pd.Series(["<class>X</class>"] * len(pdf))

    def broken(pdf):
        raise RuntimeError("model down")

    assert {r.answer for r in score(prompts, ok).collect()} == {"<class>X</class>"}
    bad = score(prompts, broken, retries=1, backoff_s=0).collect()
    assert all(r.answer is None and "model down" in r.error for r in bad)


def test_stream_ingest_exactly_once(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.csv").write_text("x,y\n1,2\n")
    (src / "b.xlsx").write_bytes(b"PK")
    out, ck = str(tmp_path / "out"), str(tmp_path / "ck")
    ingest_folder(spark, str(src), out, ck)
    ingest_folder(spark, str(src), out, ck)        # nothing new: nothing appended
    got = spark.read.parquet(out)
    assert sorted(r.base for r in got.collect()) == ["a.csv", "b.xlsx"]
    assert {r.file_type for r in got.collect()} == {"csv", "xlsx"}


def test_stream_maps_arriving_csv_files(spark, tmp_path):
    from gridmap.streaming.ingest import map_arrivals
    src = tmp_path / "in"
    src.mkdir()
    (src / "funds_a.csv").write_text("Price list\nISIN Code;Fund Name;NAV;Devise\nLU01;Alpha;10.5;EUR\nLU02;Beta;11.0;USD\n")
    (src / "funds_b.csv").write_text("Code ISIN,FONDS,VL\nFR01,Gamma,99.1\n", encoding="latin-1")
    out = str(tmp_path / "out")
    ingest_folder(spark, str(src), out, str(tmp_path / "ck"), batch_fn=map_arrivals)
    got = {(r.doc_name, r.section, r.field): r.header
           for r in spark.read.parquet(out).where("header IS NOT NULL").collect()}
    assert got[("funds_a", "Identifier", "Code")] == "ISIN Code"
    assert got[("funds_a", "Valorisation", "Nav")] == "NAV"
    assert got[("funds_b", "Denomination", "InstrumentName")] == "FONDS"
