"""The lines of the corpus are built once for all who read them in one query."""

import datetime as dt
import re

import pytest

from gridmap.operators import grid as G
from gridmap.operators import headers as H
from gridmap.plans import corpus as K
from gridmap.plans import queries_cells as C
from gridmap.plans import registry as R


@pytest.mark.parametrize("per_task", [1, 4])  # 9 partitions of the corpus, and 4
def test_the_slice_and_the_fallback_rule_share_the_lines(spark, tmp_path, monkeypatch, per_task):
    monkeypatch.setattr(K, "LINES_PER_TASK", per_task)
    spark.createDataFrame([(k, dt.datetime(2024, 1, k)) for k in range(1, 9)], "o_orderkey long, o_orderdate timestamp").write.parquet(str(tmp_path / "orders.parquet"))
    spark.createDataFrame([(k, 100, 7, 1, 9.5, "O", dt.datetime(2024, 2, 1)) for k in (1, 1, 2, 3, 4, 5, 6, 7, 7)],
                          "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_extendedprice double, l_linestatus string, "
                          "l_shipdate timestamp").write.parquet(str(tmp_path / "lineitem.parquet"))
    lines = G.rows_to_lines(R.corpus(spark, str(tmp_path))[0])
    want = G.header_slice(lines, H.fallback_header(lines), 5).collect()
    df = C.q_header_slice(spark, str(tmp_path))
    assert sorted(df.collect(), key=str) == sorted(want, key=str) and want
    text = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    sent = re.findall(r"Exchange hashpartitioning\(doc_id#\w+, (\d+)\), REPARTITION_BY_NUM, \[plan_id=(\d+)\]", text)
    assert len(set(sent)) == 1 and len(sent) >= 3 and sent[0][0] == {1: "18", 4: "2"}[per_task]
    assert len(re.findall("ReusedExchange .*REPARTITION_BY_NUM", text)) == 2
