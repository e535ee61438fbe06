"""Registered queries: flagship mapping job, text core, grid basics, classification."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridmap.functions import text as T
from gridmap.operators import classify as C
from gridmap.operators import grid as G
from gridmap.operators import headers as H
from gridmap.plans import corpus as K
from gridmap.plans import defaults as D
from gridmap.plans import dims
from gridmap.plans import pipeline as P
from gridmap.plans import sqlparts as Q

from gridmap.plans.registry import QUERIES, ORACLE, query, read, corpus  # noqa: F401


# --------------------------------------------------------------------------- flagship
def _map_documents_sql() -> str:
    return Q.with_ctes(*Q.mapping_pipeline_ctes(),
                       select="SELECT doc_id, section, field, header, confidence, source FROM pl_final")


@query("map_documents", _map_documents_sql)
def q_map_documents(spark, sf_dir):
    cells, docs, _ = corpus(spark, sf_dir)
    return P.final_mapping(P.map_documents(cells, docs))


# --------------------------------------------------------------------------- text core
@query("text_lines", Q.with_ctes(Q.text_lines_cte("tl", "documents"), select="SELECT * FROM tl"))
def q_text_lines(spark, sf_dir):
    return G.text_lines(read(spark, sf_dir, "documents", "doc_id", "text"))


@query("fallback_header", Q.with_ctes(Q.text_lines_cte("tl", "documents"), Q.fallback_header_cte("fh", "tl"),
                                      select="SELECT * FROM fh"))
def q_fallback_header(spark, sf_dir):
    return H.fallback_header(G.text_lines(read(spark, sf_dir, "documents", "doc_id", "text")))


@query("token_estimate", "SELECT doc_id, CAST(floor(length(text) / 4) AS BIGINT) AS n_tokens FROM documents")
def q_token_estimate(spark, sf_dir):
    d = read(spark, sf_dir, "documents", "doc_id", "text")
    return d.select("doc_id", T.token_estimate("text").alias("n_tokens"))


def _doc_name(id_col="doc_id", src_col="source"):
    return F.concat(F.lit("doc_"), F.col(id_col).cast("string"), F.lit("_"), F.col(src_col))


def _sql_doc_name():
    return "'doc_' || CAST(doc_id AS VARCHAR) || '_' || source"


def _sql_lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _sql_render(template: str, **vals) -> str:
    out = _sql_lit(template)
    for k, v in vals.items():
        out = f"replace({out}, '{{{k}}}', coalesce(CAST({v} AS VARCHAR), ''))"
    return out


def _budget_sql():
    base = f"CAST(floor(length({_sql_render(D.CLASS_PROMPT, doc_name=_sql_doc_name(), question=_sql_lit(''))}) / 4) AS BIGINT)"
    avail = f"({int(D.CLASS_MAX_TOKENS * D.CLASS_CONTEXT_PCT)} - {base})"
    return (f"SELECT doc_id, {base} AS base_tokens, "
            f"CASE WHEN {avail} <= 0 THEN '' ELSE substr(text, 1, CAST(greatest(0, {avail}) * 4 AS INTEGER)) END "
            f"AS truncated FROM documents")


def _budget_df(spark, sf_dir):
    d = read(spark, sf_dir, "documents", "doc_id", "text", "source")
    base = T.token_estimate(T.render(D.CLASS_PROMPT, doc_name=_doc_name(), question=F.lit("")))
    return d.select("doc_id", base.alias("base_tokens"),
                    T.truncate_to_budget("text", base, D.CLASS_MAX_TOKENS, D.CLASS_CONTEXT_PCT).alias("truncated"),
                    _doc_name().alias("doc_name"))


@query("budget_truncate", _budget_sql)
def q_budget_truncate(spark, sf_dir):
    return _budget_df(spark, sf_dir).drop("doc_name")


def _render_class_sql():
    inner = _budget_sql().replace("SELECT doc_id,", f"SELECT doc_id, {_sql_doc_name()} AS doc_name,", 1)
    return (f"SELECT doc_id, {_sql_render(D.CLASS_PROMPT, doc_name='doc_name', question='truncated')} AS prompt "
            f"FROM ({inner})")


@query("render_class_prompt", _render_class_sql)
def q_render_class_prompt(spark, sf_dir):
    b = _budget_df(spark, sf_dir)
    return b.select("doc_id", T.render(D.CLASS_PROMPT, doc_name=F.col("doc_name"),
                                       question=F.col("truncated")).alias("prompt"))


@query("focus_content", Q.with_ctes(
    Q.text_lines_cte("tl", "documents"), Q.fallback_header_cte("fh", "tl"),
    select=f"""SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.line_no) AS focus,
                      count(*) AS n_focus_lines
               FROM tl l JOIN (SELECT doc_id, coalesce(header_start, 0) AS lo,
                                      coalesce(nullif(content_start, 0), coalesce(header_end, 0) + 1)
                                        + {D.FOCUS_CONTENT_ROWS} AS hi FROM fh) b
                 ON l.doc_id = b.doc_id
               WHERE l.line_no >= b.lo AND l.line_no < b.hi GROUP BY l.doc_id"""))
def q_focus_content(spark, sf_dir):
    lines = G.text_lines(read(spark, sf_dir, "documents", "doc_id", "text"))
    return H.focus_content(lines, H.fallback_header(lines))


# --------------------------------------------------------------------------- grid ops on the corpus
def _corpus_sql(select: str, *ctes: str) -> str:
    return Q.with_ctes(Q.corpus_ctes(), *ctes, select=select)


@query("row_window", _corpus_sql(
    f"SELECT doc_id, row_idx, col_idx, value FROM corpus_cells WHERE row_idx >= {D.START_ROW} AND row_idx < {D.END_ROW}"))
def q_row_window(spark, sf_dir):
    cells, _, _ = corpus(spark, sf_dir)
    return G.row_window(cells, D.START_ROW, D.END_ROW).select("doc_id", "row_idx", "col_idx", "value")


@query("grid_markdown", _corpus_sql("SELECT * FROM gl", Q.rows_to_lines_cte("gl", "corpus_cells")))
def q_grid_markdown(spark, sf_dir):
    cells, _, _ = corpus(spark, sf_dir)
    return G.rows_to_lines(cells)


def _drop_sql(keys: str) -> str:
    return _corpus_sql(f"""SELECT doc_id, row_idx, col_idx, value FROM corpus_cells
        QUALIFY max(CASE WHEN {Q.is_blank('value')} THEN 0 ELSE 1 END) OVER (PARTITION BY {keys}) = 1""")


@query("drop_empty_cols", _drop_sql("doc_id,col_idx"))
def q_drop_empty_cols(spark, sf_dir):
    cells, _, _ = corpus(spark, sf_dir)
    return G.drop_empty_cols(cells).select("doc_id", "row_idx", "col_idx", "value")


@query("drop_empty_rows", _drop_sql("doc_id,row_idx"))
def q_drop_empty_rows(spark, sf_dir):
    cells, _, _ = corpus(spark, sf_dir)
    return G.drop_empty_rows(cells).select("doc_id", "row_idx", "col_idx", "value")


# --------------------------------------------------------------------------- classification
def _classify_docs_sql():
    return Q.with_ctes(
        Q.dims_ctes(),
        Q.tokens_cte("toks", "documents", "text"),
        Q.best_label_cte("best", "toks"),
        Q.classify_cte("cls", "documents", "best"),
        select="SELECT * FROM cls")


@query("classify_docs", _classify_docs_sql)
def q_classify_docs(spark, sf_dir):
    d = read(spark, sf_dir, "documents", "doc_id", "text")
    return C.classify_docs(d, C.tokens(d, "text"), dims.class_terms(spark)).drop("answer")
