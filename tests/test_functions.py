from pyspark.sql import functions as F

from gridmap.functions import cellformat as CF
from gridmap.functions import parse as PA
from gridmap.functions import text as T


def one(spark, expr, data, schema):
    return spark.createDataFrame(data, schema).select(expr.alias("x")).collect()


def test_strip_split_and_tokens(spark):
    r = one(spark, T.split_lines("t"), [("\n  a\nb  \n\t",)], "t string")
    assert r[0].x == ["a", "b"]
    r = one(spark, T.token_estimate("t"), [("abcdefghi",)], "t string")
    assert r[0].x == 2


def test_truncate_budget(spark):
    df = spark.createDataFrame([("x" * 10000, 100), ("abc", 5000)], "t string, base int")
    out = df.select(T.truncate_to_budget("t", F.col("base"), 4000, 0.45).alias("x")).collect()
    assert len(out[0].x) == (1800 - 100) * 4
    assert out[1].x == ""          # budget used up -> nothing


def test_render_keeps_literal_braces(spark):
    df = spark.createDataFrame([("n1",)], "n string")
    out = df.select(T.render('{"a": 1} {doc_name} {other}', doc_name=F.col("n")).alias("x")).collect()[0].x
    assert out == '{"a": 1} n1 {other}'
    left = df.select(T.leftover_placeholder(F.lit(out)).alias("x")).collect()[0].x
    assert left == "{other}"


def test_format_cell_rules(spark):
    data = [(None, "0.00", True), ("abc", "0.00", False), ("1234.5", "General", True),
            ("1234.5", "[$€-407]#,##0.00", True), ("1234.5", "#,##0 [$USD]", True), ("0.0725", "0.00%", True),
            ("0.5", "0%", True), ("5", "0.000", True), ("5.0", "0", True), ("2.675", "0.00", True),
            ("1234567", "#,##0", True)]
    out = [r.x for r in one(spark, CF.format_cell("v", "f", "n"), data, "v string, f string, n boolean")]
    assert out == ["", "abc", "1234.5", "€1,234.50", "1,234 USD", "7.25%", "50%", "5.000", "5.00", "2.68",
                   "1,234,567"]


def test_clean_value_and_durations(spark):
    df = spark.createDataFrame([(12.0,), (3.14159,), (float("nan"),), (None,)], "v double")
    assert [r.x for r in df.select(CF.clean_value("v", "float").alias("x")).collect()] == ["12", "3.1416", "nan", " "]
    df = spark.createDataFrame([(0.25,), (12.345,), (95.0,), (7300.0,)], "s double")
    long_ = [r.x for r in df.select(CF.format_duration("s").alias("x")).collect()]
    short = [r.x for r in df.select(CF.format_duration_short("s").alias("x")).collect()]
    assert long_ == ["0.3 seconds", "12.3 seconds", "1.6 minutes", "2.0 hours"]
    assert short == ["250.00 ms", "12.35 seconds", "1 min 35.00 sec", "121 min 40.00 sec"]


def test_parse_class_ladder(spark):
    answers = [("<sol>ETF</sol>",), ("<class> bonds </class><confidence>High</confidence>",),
               ("I would say Stocks here",), ("<sol>none of those</sol>",), ("no idea",),
               ("<sol>some ETF thing</sol>",), ("Real State and ETF",)]
    out = spark.createDataFrame(answers, "a string").select(PA.parse_class("a").alias("p")).collect()
    got = [(r.p.predicted_class, r.p.confidence) for r in out]
    assert got == [("ETF", "Medium"), ("Bonds", "Medium"), ("Stocks", "Medium"), ("None of those", "Low"),
                   ("None of those", "Low"), ("ETF", "Medium"), ("ETF", "Medium")]


def test_parse_class_validation(spark):
    a = "<class>Index</class><confidence>High</confidence><reason>It lists indices.</reason>"
    r = spark.createDataFrame([(a,), ("??",)], "a string").select(PA.parse_class_validation("a").alias("p")).collect()
    assert (r[0].p.predicted_class, r[0].p.confidence, r[0].p.validation_reason) == ("Index", "High",
                                                                                     "It lists indices.")
    assert (r[1].p.predicted_class, r[1].p.validation_reason) == ("None of those", "Failed to parse output.")
