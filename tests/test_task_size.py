"""Tasks hold a bounded number of rows, and cells stream by what a document has few of."""

import pytest
from pyspark.sql import functions as F

from gridmap.operators import grid as G
from gridmap.operators import headers as H
from gridmap.plans import corpus as K
from gridmap.plans import registry as R
from test_pipeline import small_corpus


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_partitions_of_the_corpus_grow_with_its_rows(spark, monkeypatch):
    for per_task, tasks in ((3, 7), (2, 11)):  # 21 line items
        monkeypatch.setattr(K, "LINES_PER_TASK", per_task)
        cells, _, _ = small_corpus(spark)
        assert G.rows_to_lines(cells).rdd.getNumPartitions() == tasks


@pytest.mark.parametrize("name", ["project", "columns", "flat", "slice", "focus", "empty", "format"])
def test_cells_are_not_sorted_to_meet_their_documents(spark, name):
    cells, docs, orders = small_corpus(spark)
    ctx, lines = R.corpus_context(orders), G.rows_to_lines(cells)
    columns = orders.select(F.col("o_orderkey").alias("doc_id"), F.lit("s").alias("section"), F.lit("f").alias("field"), F.lit(1).alias("col_idx"))
    df = {"project": lambda: G.project_mapped(cells, ctx, columns), "columns": lambda: G.map_to_columns(cells, ctx, K.corpus_truth(orders)),
          "flat": lambda: G.flatten_headers(cells, ctx), "slice": lambda: G.header_slice(lines, ctx), "focus": lambda: H.focus_content(lines, ctx),
          "empty": lambda: G.drop_empty_cols(cells), "format": lambda: G.format_profile(cells, ctx.select("doc_id", F.col("content_start").alias("probe_row")))}[name]()
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "ShuffledHashJoin [" in plan(df)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_rows_gathered_with_gaps_and_repeated_columns_keep_their_order(spark):
    cells = spark.createDataFrame([(1, 0, 3, "d"), (1, 0, 0, "a"), (1, 1, 1, None), (1, 1, 0, "x"), (1, 2, 0, "b"), (1, 2, 0, "a")],
                                  "doc_id long, row_idx int, col_idx int, value string")
    got = {r.line_no: r.line for r in G.rows_to_lines(cells).collect()}
    assert got[0] == "| a |  |  | d |" and got[1] == "| x |  |"


@pytest.mark.parametrize("threshold", ["-1", "1g"])
def test_the_truth_meets_the_cells_unsent(spark, tmp_path, threshold):
    import datetime as dt

    from gridmap.plans import queries_cells as C
    spark.createDataFrame([(k, dt.datetime(2024, 1, k)) for k in range(1, 9)], "o_orderkey long, o_orderdate timestamp").write.parquet(str(tmp_path / "orders.parquet"))
    spark.createDataFrame([(k, 100, 7, 1, 9.5, "O", dt.datetime(2024, 2, 1)) for k in range(1, 8)],
                          "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_extendedprice double, l_linestatus string, "
                          "l_shipdate timestamp").write.parquet(str(tmp_path / "lineitem.parquet"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        for query in (C.q_map_to_columns, C.q_project_mapped):
            text = plan(query(spark, str(tmp_path)))
            assert "BroadcastHashJoin" not in text and "SortMergeJoin" not in text
            sent = [line for line in text.splitlines() if "Exchange hashpartitioning" in line]
            assert sent and all("hashpartitioning(o_orderkey" in x or "hashpartitioning(l_orderkey" in x for x in sent)  # keys, before the truth's texts
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
