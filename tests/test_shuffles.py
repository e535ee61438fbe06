"""What the jobs send between tasks: cells once as narrow rows, empty slots never."""

from pyspark.sql import functions as F

from gridmap.operators import grid as G
from gridmap.operators import headers as H
from gridmap.operators import sections as S
from gridmap.plans import dims
from gridmap.plans import pipeline as P
from test_pipeline import small_corpus


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_grid_rows_are_gathered_without_sending_cells(spark):
    cells, _, _ = small_corpus(spark)
    above, below = plan(G.rows_to_lines(cells)).split("Union", 1)
    assert "Exchange" not in above and "Exchange" in below


def test_empty_slots_are_neither_sent_nor_sorted(spark):
    cells, docs, _ = small_corpus(spark)
    res = P.map_documents(cells, docs)
    for df in (res.mapping, res.extracted, res.validated):
        above, below = plan(df).split("BroadcastHashJoin [doc_class", 1)  # the fan-out
        assert "Exchange" not in above and "Sort" not in above and "Join" not in above and "Exchange" in below


def test_fanned_out_slots_are_those_of_the_join(spark):
    fd = dims.field_defs(spark)
    docs = spark.createDataFrame([(1, "Mutual Funds"), (2, "Mutual Funds"), (3, "no such class")], "doc_id long, doc_class string")
    found = spark.createDataFrame([(1, "Identifier", "Code", "ISIN"), (1, "Valorisation", "Nav", None), (9, "Identifier", "Code", "x")],
                                  "doc_id long, section string, field string, header string")
    got = S.slot_rows(docs, fd, found, ["header"], "s.found.header", F.size("s.in_section").alias("n"))
    keys = ["doc_id", "section", "field"]
    want = S.section_fanout(docs, fd).join(found, keys, "left").select(*keys, "section_ord", "field_ord", "header")
    assert sorted(got.select(*keys, "section_ord", "field_ord", "header").collect(), key=str) == sorted(want.collect(), key=str)
    arrays = S.fanned_out(docs, fd, found, ["header"]).select("doc_id", F.explode("slots").alias("s")).select("doc_id", "s.section", "s.field", "s.found.header")
    assert sorted(arrays.collect(), key=str) == sorted(want.select(*keys, "header").collect(), key=str)
    n = {(r.doc_id, r.section): r.n for r in got.collect()}
    assert n[1, "Identifier"] == 1 and n[1, "Valorisation"] == 1 and not n[2, "Identifier"]


def test_header_blocks_need_rows_that_follow_each_other(spark):
    rows = [(1, r, c, v) for r, cs in {0: ["Fund", "Code"], 1: ["Name", "ISIN"], 2: ["Name", "Code"], 4: ["Fund", "Name"]}.items() for c, v in enumerate(cs)]
    cells = spark.createDataFrame(rows + [(2, 0, 0, "Fund"), (2, 2, 0, "Name")], "doc_id long, row_idx int, col_idx int, value string")
    vocab = ["Fund Name", "Code ISIN", "Code"]
    got = {(r.doc_id, r.header_start, r.header_end, r.n_alias, r.n_texts) for r in H.header_blocks(H.row_summary(cells, vocab), vocab).collect()}
    assert got == {(1, 0, 1, 2, 2)}


def test_numeric_rows_are_no_possible_header_rows(spark):
    cells = spark.createDataFrame([(1, 0, 0, "Code"), (1, 1, 0, "12"), (1, 2, 0, " "), (1, 3, 0, "A 1")], "doc_id long, row_idx int, col_idx int, value string")
    rows = H.row_summary(cells, ["Code"])
    assert {r.row_idx for r in H.possible_header_rows(rows).collect()} == {0, 3}
    assert {r.row_idx for r in H.possible_header_rows(rows, 0.5).collect()} == {0, 1, 3}  # such a gate lets a numeric header through


def test_small_files_share_a_micro_batch(spark, tmp_path):
    from gridmap.streaming.ingest import ingest_folder
    src = tmp_path / "in"
    src.mkdir()
    for i in range(70):
        (src / f"f{i}.csv").write_text(f"Code;NAV\nX{i};1\n")
    out = ingest_folder(spark, str(src), str(tmp_path / "out"), str(tmp_path / "ck"))
    assert spark.read.parquet(out).count() == 70
    assert len(list((tmp_path / "out").glob("epoch=*"))) == 1
    few = ingest_folder(spark, str(src), str(tmp_path / "out2"), str(tmp_path / "ck2"), files_per_batch=40)
    assert spark.read.parquet(few).count() == 70 and len(list((tmp_path / "out2").glob("epoch=*"))) == 2


def test_completeness_sends_no_slots(spark, tmp_path):
    import datetime as dt

    from gridmap.plans import queries_misc as M
    spark.createDataFrame([(k, dt.datetime(2024, 1, k)) for k in range(1, 5)], "o_orderkey long, o_orderdate timestamp").write.parquet(str(tmp_path / "orders.parquet"))
    df = M.q_completeness(spark, str(tmp_path))
    assert "Exchange" not in plan(df).split("BroadcastHashJoin [doc_class", 1)[0]
    found = {r.section: (r.n_fields, r.n_blank) for r in df.where("doc_id = 1").collect()}
    assert found["Valorisation"] == (2, 0) and found["MarketCap"][0] == found["MarketCap"][1]
