"""Registry of verification / benchmark queries.

``QUERIES[name] = fn(spark, sf_dir) -> DataFrame`` and, when the result is
expressible in SQL, ``ORACLE[name]`` holds the DuckDB statement computing
the same rows (column names identical).  Every query reads the given tables
(or data Spark derives from them) in full.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridmap.plans import corpus as K
from gridmap.session import gather_rows_by_hash

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: Callable[[], str] | str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql() if callable(sql) else sql
        return fn
    return deco


def read(spark: SparkSession, sf_dir: str, table: str, *cols: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")
    return df.select(*cols) if cols else df


def corpus(spark: SparkSession, sf_dir: str):
    gather_rows_by_hash(spark)
    orders = read(spark, sf_dir, "orders", "o_orderkey", "o_orderdate")
    lineitem = read(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
                    "l_extendedprice", "l_linestatus", "l_shipdate")
    return K.corpus_cells(orders, lineitem), K.corpus_docs(orders), orders


def corpus_context(orders: DataFrame) -> DataFrame:
    """True header context of every corpus document (from the layout rule)."""
    k = F.col("o_orderkey")
    _b, _s, h, nh, c0 = K._layout(k)
    return orders.select(k.alias("doc_id"), h.cast("int").alias("header_start"), (h + nh - 1).cast("int").alias("header_end"),
                         c0.cast("int").alias("content_start"))


SQL_CORPUS_CONTEXT = """corpus_ctx AS (
  SELECT doc_id, h AS header_start, CAST(h + nh - 1 AS INTEGER) AS header_end, CAST(h + nh + s AS INTEGER) AS content_start
  FROM corpus_o)"""
