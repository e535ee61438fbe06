import pandas as pd
from pyspark.sql import functions as F

from gridmap.operators import evaluate as EV
from gridmap.operators import prompts as PR
from gridmap.operators import vocab as VO
from gridmap.plans import corpus as K
from gridmap.plans import pipeline as P

TURNS = [(1, 0, "system", "Be brief."), (1, 1, "user", "u1"), (1, 2, "assistant", "a1"), (1, 3, "user", "u2"),
         (1, 4, "assistant", "a2"), (1, 5, "user", "u3"), (1, 6, "assistant", "a3"), (1, 7, "user", "last"),
         (2, 0, "user", "q"), (2, 1, "assistant", "r")]
SCHEMA = "conv_id long, turn long, role string, text string"


def msgs(df):
    return [(r.conv_id, r.msg_idx, r.role, r.content) for r in df.orderBy("conv_id", "msg_idx").collect()]


def test_few_shot_keeps_first_two_pairs_and_system(spark):
    out = msgs(PR.few_shot_messages(spark.createDataFrame(TURNS, SCHEMA), 2))
    assert out[:5] == [(1, 0, "system", "Be brief."), (1, 1, "user", "# Example 1\nu1"), (1, 2, "assistant", "a1"),
                       (1, 3, "user", "# Example 2\nu2"), (1, 4, "assistant", "a2")]
    assert (2, 0, "system", "You are a helpful assistant.") in out


def test_chat_assembly_ends_with_last_user_turn(spark):
    out = msgs(PR.chat_assembly(spark.createDataFrame(TURNS, SCHEMA), 2))
    conv1 = [m for m in out if m[0] == 1]
    assert conv1[-1] == (1, 5, "human", "last")


def test_tool_messages_ids_are_deterministic(spark):
    df = spark.createDataFrame(TURNS, SCHEMA)
    a = sorted((r.conv_id, r.turn, r.msg_idx, r.tool_call_id) for r in PR.tool_messages(df).collect())
    b = sorted((r.conv_id, r.turn, r.msg_idx, r.tool_call_id) for r in PR.tool_messages(df).collect())
    assert a == b and len(a) == 4 * 3
    assert all(len(x[3]) == 16 for x in a if x[2] > 0)


def test_token_usage_rollup_totals(spark):
    out = {(r.role, r.phase): r.input_tokens for r in PR.token_usage(spark.createDataFrame(TURNS, SCHEMA)).collect()}
    assert out[(None, None)] == sum(v for (role, ph), v in out.items() if role is not None and ph is not None)


def test_vocabulary_sorted_case_insensitive(spark):
    labels = spark.createDataFrame([("S", "f", "beta"), ("S", "f", "Alpha"), ("S", "f", "alpha"), ("S", "f", " "),
                                    ("S", "f", "beta")], "section string, field string, value string")
    r = VO.value_vocabulary(labels).collect()[0]
    assert (r.n_values, r["values"]) == (3, "Alpha, alpha, beta")


def test_class_f1_numbers(spark):
    pairs = spark.createDataFrame([(1, 1), (1, 0), (0, 0), (0, 0), (0, 1)], "y_true int, y_pred int")
    pc = {r.cls: (r.support, r.predicted, r.tp, round(r.f1, 6)) for r in EV.class_f1(pairs).collect()}
    assert pc[1] == (2, 2, 1, 0.5) and pc[0] == (3, 3, 2, round(2 / 3, 6))
    w = EV.weighted_f1(EV.class_f1(pairs)).collect()[0]
    assert abs(w.weighted_f1 - (0.5 * 2 + 2 / 3 * 3) / 5) < 1e-9 and w.n == 5


def test_run_summary_eta(spark):
    by_file = spark.createDataFrame([("a", 2, 2, 10.0, 4), ("b", 1, 0, 5.0, 0)],
                                    "file string, n_runs long, n_success long, total_duration double, "
                                    "fields_extracted long")
    r = EV.run_summary(by_file, planned_files=5).collect()[0]
    assert (r.total_files, r.success_count, r.error_count, r.success_rate) == (2, 1, 1, 50.0)
    assert r.avg_file_seconds == 7.5 and r.eta_seconds == 22.5


def test_mapping_job_with_supplied_scorer(spark):
    import datetime as dt
    orders = spark.createDataFrame([(k, dt.datetime(2024, 1, k)) for k in range(1, 5)],
                                   "o_orderkey long, o_orderdate timestamp")
    li = spark.createDataFrame([(k, 10 + k, 3, 1, 99.5, "O", dt.datetime(2024, 3, 1)) for k in range(1, 5)],
                               "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, "
                               "l_extendedprice double, l_linestatus string, l_shipdate timestamp")
    cells, docs = K.corpus_cells(orders, li), K.corpus_docs(orders)

    def scorer(pdf):   # answers "Mutual Funds" for even documents, fails to name a class for odd ones
        return pd.Series(["<class>Mutual Funds</class>" if i % 2 == 0 else "unsure" for i in pdf["doc_id"]])

    res = P.map_documents(cells, docs, class_scorer=scorer)
    mapped = {r.doc_id for r in res.mapping.select("doc_id").distinct().collect()}
    finished = {r.doc_id for r in res.finished.collect()}
    assert mapped == {2, 4} and finished == {1, 3}
