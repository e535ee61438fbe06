"""Registered queries: cell formatting, delimiters, identity, HTML, grid slices."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridmap.functions import cellformat as CF
from gridmap.operators import grid as G
from gridmap.operators import headers as H
from gridmap.plans import corpus as K
from gridmap.plans import defaults as D
from gridmap.plans import dims
from gridmap.plans import sqlparts as Q
from gridmap.plans.registry import SQL_CORPUS_CONTEXT, corpus, corpus_context, query, read
from gridmap.sources import delimited as DL
from gridmap.sources import files as FS
from gridmap.sources import html as HT

# Number formats exercised by the formatting queries.
CELL_FORMATS = ["General", "#,##0.00", "0", "0.000", "0.00%", "[$€-407]#,##0.00", "#,##0 [$USD]"]
PRIORITY_FORMATS = {"1-URGENT": "[$€-407]#,##0.00", "2-HIGH": "#,##0.00 [$USD]", "3-MEDIUM": "[$£-809]#,##0",
                    "4-NOT SPECIFIED": "#,##0 [$CHF]", "5-LOW": "[$¥-411]#,##0.00"}
PERCENT_FORMATS = {"A": "0%", "N": "0.0%", "R": "0.00%"}


def _sql_arr(xs):
    return "[" + ", ".join("'" + x + "'" for x in xs) + "]"


def _case_map(col, mapping, default="General"):
    e = F.lit(default)
    for k, v in reversed(list(mapping.items())):
        e = F.when(F.col(col) == k, F.lit(v)).otherwise(e)
    return e


def _sql_case_map(col, mapping, default="General"):
    return "CASE " + " ".join(f"WHEN {col} = '{k}' THEN '{v}'" for k, v in mapping.items()) + f" ELSE '{default}' END"


# --------------------------------------------------------------------------- C1-C4, D23
@query("format_cells", f"""
SELECT l_orderkey, l_partkey, l_linenumber, fmt, {Q.format_cell('raw', 'fmt', 'TRUE')} AS display
FROM (SELECT l_orderkey, l_partkey, l_linenumber, CAST(l_extendedprice AS VARCHAR) AS raw,
             {_sql_arr(CELL_FORMATS)}[CAST((l_linenumber - 1) % {len(CELL_FORMATS)} AS INTEGER) + 1] AS fmt
      FROM lineitem)""")
def q_format_cells(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey", "l_linenumber", "l_extendedprice")
    fmts = F.array(*[F.lit(f) for f in CELL_FORMATS])
    x = li.select("l_orderkey", "l_partkey", "l_linenumber", F.col("l_extendedprice").cast("string").alias("raw"),
                  F.element_at(fmts, ((F.col("l_linenumber") - 1) % len(CELL_FORMATS) + 1).cast("int")).alias("fmt"))
    return x.select("l_orderkey", "l_partkey", "l_linenumber", "fmt",
                    CF.format_cell("raw", "fmt", F.lit(True)).alias("display"))


@query("currency_format", f"""
SELECT o_orderkey, fmt, {Q.currency_symbol('fmt')} AS symbol, {Q.format_cell('raw', 'fmt', 'TRUE')} AS display
FROM (SELECT o_orderkey, CAST(o_totalprice AS VARCHAR) AS raw,
             {_sql_case_map('o_orderpriority', PRIORITY_FORMATS)} AS fmt FROM orders)""")
def q_currency_format(spark, sf_dir):
    o = read(spark, sf_dir, "orders", "o_orderkey", "o_totalprice", "o_orderpriority")
    x = o.select("o_orderkey", F.col("o_totalprice").cast("string").alias("raw"),
                 _case_map("o_orderpriority", PRIORITY_FORMATS).alias("fmt"))
    return x.select("o_orderkey", "fmt", CF.currency_symbol("fmt").alias("symbol"),
                    CF.format_cell("raw", "fmt", F.lit(True)).alias("display"))


@query("percent_format", f"""
SELECT l_orderkey, l_partkey, l_linenumber, fmt, {Q.format_cell('raw', 'fmt', 'TRUE')} AS display
FROM (SELECT l_orderkey, l_partkey, l_linenumber, CAST(l_discount AS VARCHAR) AS raw,
             {_sql_case_map('l_returnflag', PERCENT_FORMATS)} AS fmt FROM lineitem)""")
def q_percent_format(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey", "l_linenumber", "l_discount", "l_returnflag")
    x = li.select("l_orderkey", "l_partkey", "l_linenumber", F.col("l_discount").cast("string").alias("raw"),
                  _case_map("l_returnflag", PERCENT_FORMATS).alias("fmt"))
    return x.select("l_orderkey", "l_partkey", "l_linenumber", "fmt",
                    CF.format_cell("raw", "fmt", F.lit(True)).alias("display"))


@query("clean_value", f"""
SELECT o_orderkey, coalesce({Q.clean_number('o_totalprice')}, ' ') AS price_txt,
       coalesce(strftime(o_orderdate, '%Y-%m-%d'), ' ') AS date_txt,
       coalesce(o_orderpriority, ' ') AS priority_txt, coalesce(CAST(o_custkey AS VARCHAR), ' ') AS cust_txt
FROM orders""")
def q_clean_value(spark, sf_dir):
    o = read(spark, sf_dir, "orders", "o_orderkey", "o_totalprice", "o_orderdate", "o_orderpriority", "o_custkey")
    return o.select("o_orderkey", CF.clean_value("o_totalprice", "float").alias("price_txt"),
                    CF.clean_value("o_orderdate", "timestamp").alias("date_txt"),
                    CF.clean_value("o_orderpriority", "string").alias("priority_txt"),
                    CF.clean_value("o_custkey", "int").alias("cust_txt"))


@query("format_duration", f"""
SELECT event_id, {Q.format_duration('value')} AS duration_txt, {Q.format_duration_short('value')} AS duration_short,
       {Q.format_duration('value * 60')} AS duration_minutes_txt
FROM events""")
def q_format_duration(spark, sf_dir):
    e = read(spark, sf_dir, "events", "event_id", "value")
    return e.select("event_id", CF.format_duration("value").alias("duration_txt"),
                    CF.format_duration_short("value").alias("duration_short"),
                    CF.format_duration(F.col("value") * 60).alias("duration_minutes_txt"))


# --------------------------------------------------------------------------- A5, A6
def _sql_count(s, ch):
    return f"(length({s}) - length(replace({s}, '{ch}', '')))"


@query("delimiter_vote", f"""
SELECT doc_id, n_comma, n_semicolon,
       CASE WHEN n_comma > n_semicolon THEN ',' WHEN n_semicolon > n_comma THEN ';'
            WHEN n_comma > 0 OR n_semicolon > 0 THEN 'Undetermined'
            ELSE 'No delimiters found in the first ' || CAST(n_lines AS VARCHAR) || ' lines.' END AS delimiter
FROM (SELECT doc_id, CAST({_sql_count('head', ',')} AS BIGINT) AS n_comma,
             CAST({_sql_count('head', ';')} AS BIGINT) AS n_semicolon, n_lines
      FROM (SELECT doc_id, array_to_string(string_split(text, chr(10))[1:{DL.VOTE_LINES}], chr(10)) AS head,
                   CASE WHEN text = '' THEN 0
                        ELSE least({DL.VOTE_LINES}, len(string_split(regexp_replace(text, '\\n$', ''), chr(10))))
                   END AS n_lines
            FROM documents))""")
def q_delimiter_vote(spark, sf_dir):
    return DL.delimiter_vote(read(spark, sf_dir, "documents", "doc_id", "text"))


def _sniff_sql():
    lines = "list_filter(string_split(text, chr(10)), lambda x: length(x) > 0)"
    parts, cols = [], []
    for i, c in enumerate(DL.CANDIDATES):
        ch = c.replace("\t", "' || chr(9) || '")
        cnt = f"list_filter(list_transform(ls, lambda x: length(x) - length(replace(x, '{ch}', ''))), lambda y: y > 0)"
        parts.append(f"list_min({cnt}) AS mn{i}, list_max({cnt}) AS mx{i}, len({cnt}) AS np{i}")
        cols.append(i)
    parts.append("len(ls) AS nl")
    ok = [f"coalesce(mn{i} = mx{i} AND np{i} * 2 >= nl, FALSE)" for i in cols]
    best = "greatest(" + ", ".join(f"CASE WHEN {ok[i]} THEN mn{i} ELSE 0 END" for i in cols) + ")"
    pick = ("CASE " + " ".join(
        f"WHEN {ok[i]} AND mn{i} = {best} THEN '{DL.CANDIDATE_NAMES[i]}'" for i in cols) + " ELSE 'comma' END")
    return (f"SELECT doc_id, {pick} AS delimiter FROM (SELECT doc_id, {', '.join(parts)} "
            f"FROM (SELECT doc_id, {lines} AS ls FROM documents))")


@query("sniff_delimiter", _sniff_sql)
def q_sniff_delimiter(spark, sf_dir):
    return DL.sniff_delimiter(read(spark, sf_dir, "documents", "doc_id", "text"))


# --------------------------------------------------------------------------- A2, A13
@query("doc_identity", f"""
SELECT page_id, base, ext, substr(base, 1, length(base) - length(ext)) AS doc_name,
       lower(substr(ext, 2)) AS file_type,
       lower(substr(ext, 2)) IN ({", ".join("'" + t + "'" for t in FS.SUPPORTED)}) AS supported
FROM (SELECT page_id, base,
             CASE WHEN regexp_matches(base, '^[.]*[^.].*[.][^.]*$') THEN regexp_extract(base, '([.][^.]*)$', 1)
                  ELSE '' END AS ext
      FROM (SELECT page_id, regexp_extract(url, '([^/]*)$', 1) AS base FROM pages))""")
def q_doc_identity(spark, sf_dir):
    p = read(spark, sf_dir, "pages", "page_id", "url")
    return FS.doc_identity(p, "url").select("page_id", "base", "ext", "doc_name", "file_type", "supported")


@query("html_cells", f"""
SELECT page_id, CAST(i - 1 AS INTEGER) AS item_idx, {Q.strip("regexp_replace(items[i], '<[^>]+>', '', 'g')")} AS text
FROM (SELECT page_id, regexp_extract_all(html, '{HT.LIST_ITEM_RE}', 1) AS items FROM pages),
     LATERAL (SELECT unnest(range(1, len(items) + 1)) AS i)""")
def q_html_cells(spark, sf_dir):
    return HT.list_items(read(spark, sf_dir, "pages", "page_id", "html"), "page_id", "html")


# --------------------------------------------------------------------------- grid slices on the corpus
def _csql(select, *ctes):
    return Q.with_ctes(Q.corpus_ctes(), *ctes, select=select)


@query("non_empty", _csql(f"""
SELECT doc_id, col_idx, count(*) AS n_cells,
       CAST(sum(CASE WHEN {Q.is_blank('value')} THEN 0 ELSE 1 END) AS BIGINT) AS n_non_empty
FROM corpus_cells GROUP BY doc_id, col_idx"""))
def q_non_empty(spark, sf_dir):
    from gridmap.functions.text import is_blank
    cells, _, _ = corpus(spark, sf_dir)
    return (cells.groupBy("doc_id", "col_idx")
                 .agg(F.count(F.lit(1)).alias("n_cells"),
                      F.sum(F.when(is_blank("value"), 0).otherwise(1)).cast("bigint").alias("n_non_empty")))


@query("first_row_header", _csql("""
SELECT d.doc_id, d.row_idx, d.col_idx, n.value AS column_name, d.value
FROM corpus_cells d LEFT JOIN (SELECT * FROM corpus_cells WHERE row_idx = 0) n
  ON d.doc_id = n.doc_id AND d.col_idx = n.col_idx
WHERE d.row_idx >= 1"""))
def q_first_row_header(spark, sf_dir):
    cells, _, _ = corpus(spark, sf_dir)
    return G.first_row_header(cells).select("doc_id", "row_idx", "col_idx", "column_name", "value")


def _f1_corpus(spark, sf_dir):
    cells, _, orders = corpus(spark, sf_dir)
    # both passes of the fallback rule and the slice read the lines: they are built once and sent once
    lines = G.rows_to_lines(cells).repartition(K.resent_tasks(orders, read(spark, sf_dir, "lineitem", "l_orderkey")), "doc_id")
    return cells, lines, H.fallback_header(lines)


_F1_CTES = (Q.rows_to_lines_cte("cl", "corpus_cells"), Q.fallback_header_cte("cf", "cl"))


@query("flatten_headers", _csql("SELECT * FROM fl", *_F1_CTES, Q.flatten_headers_cte("fl", "corpus_cells", "cf")))
def q_flatten_headers(spark, sf_dir):
    cells, _, ctx = _f1_corpus(spark, sf_dir)
    return G.flatten_headers(cells, ctx)


@query("header_slice", _csql("""
SELECT l.doc_id, l.line_no, l.line FROM cl l JOIN cf x ON l.doc_id = x.doc_id
WHERE l.line_no BETWEEN x.header_start AND x.header_end
   OR (l.line_no >= x.content_start AND l.line_no < x.content_start + 5)""", *_F1_CTES))
def q_header_slice(spark, sf_dir):
    _, lines, ctx = _f1_corpus(spark, sf_dir)
    return G.header_slice(lines, ctx, 5)


def _truth_ctx(spark, sf_dir):
    cells, _, orders = corpus(spark, sf_dir)
    # orders are sent once, as keys, in the partitions of the cells; what comes from them is neither sent again nor broadcast
    orders = K.by_document(orders, read(spark, sf_dir, "lineitem", "l_orderkey"))
    return cells, K.corpus_truth(orders), corpus_context(orders)


_MAP_SQL = f"""mc AS (
  SELECT t.doc_id, t.section, t.field, min(c.col_idx) AS col_idx
  FROM corpus_truth t JOIN corpus_ctx x ON t.doc_id = x.doc_id
  JOIN corpus_cells c ON c.doc_id = t.doc_id AND c.row_idx = x.header_end
   AND lower({Q.strip('c.value')}) = lower({Q.strip('t.header')})
  WHERE t.header IS NOT NULL GROUP BY t.doc_id, t.section, t.field)"""


@query("map_to_columns", _csql("SELECT * FROM mc", SQL_CORPUS_CONTEXT, _MAP_SQL))
def q_map_to_columns(spark, sf_dir):
    cells, truth, ctx = _truth_ctx(spark, sf_dir)
    return G.map_to_columns(cells, ctx, truth)


_PROJ_SQL = """pm AS (
  SELECT c.doc_id, c.row_idx, m.section, m.field, c.value
  FROM corpus_cells c JOIN corpus_ctx x ON c.doc_id = x.doc_id AND c.row_idx >= x.content_start
  JOIN mc m ON m.doc_id = c.doc_id AND m.col_idx = c.col_idx)"""


@query("project_mapped", _csql("SELECT * FROM pm", SQL_CORPUS_CONTEXT, _MAP_SQL, _PROJ_SQL))
def q_project_mapped(spark, sf_dir):
    cells, truth, ctx = _truth_ctx(spark, sf_dir)
    return G.project_mapped(cells, ctx, G.map_to_columns(cells, ctx, truth))


@query("typed_fields", _csql(f"""
SELECT p.doc_id, p.row_idx, p.section, p.field, f.field_type,
       CASE WHEN f.field_type = 'float' THEN TRY_CAST(p.value AS DOUBLE) END AS value_double,
       CASE WHEN f.field_type = 'date' THEN TRY_CAST(p.value AS DATE) END AS value_date,
       CASE WHEN f.field_type = 'int' THEN TRY_CAST(p.value AS BIGINT) END AS value_long,
       CASE WHEN f.field_type = 'bool' THEN TRY_CAST(p.value AS BOOLEAN) END AS value_boolean,
       CASE WHEN f.field_type = 'datetime' THEN TRY_CAST(p.value AS TIMESTAMP) END AS value_timestamp,
       CASE WHEN f.field_type NOT IN ('float', 'date', 'int', 'bool', 'datetime') THEN p.value END AS value_string
FROM pm p JOIN field_defs f ON f.section = p.section AND f.field = p.field""",
                             f"field_defs AS {dims.sql_field_defs()}", SQL_CORPUS_CONTEXT, _MAP_SQL, _PROJ_SQL))
def q_typed_fields(spark, sf_dir):
    from gridmap.operators.sections import typed_values
    cells, truth, ctx = _truth_ctx(spark, sf_dir)
    pm = G.project_mapped(cells, ctx, G.map_to_columns(cells, ctx, truth))
    return typed_values(pm, dims.field_defs(spark))


@query("format_profile", _csql("""
SELECT m.doc_id, m.col_idx, coalesce(p.num_format, m.num_format) AS num_format, p.num_format IS NOT NULL AS from_probe
FROM (SELECT doc_id, col_idx, num_format FROM (
        SELECT doc_id, col_idx, num_format,
               row_number() OVER (PARTITION BY doc_id, col_idx ORDER BY count(*) DESC, num_format) AS rn
        FROM corpus_cells GROUP BY doc_id, col_idx, num_format) WHERE rn = 1) m
LEFT JOIN (SELECT c.doc_id, c.col_idx, c.num_format FROM corpus_cells c JOIN corpus_ctx x
             ON c.doc_id = x.doc_id AND c.row_idx = x.content_start) p
  ON m.doc_id = p.doc_id AND m.col_idx = p.col_idx""", SQL_CORPUS_CONTEXT))
def q_format_profile(spark, sf_dir):
    cells, _, ctx = _truth_ctx(spark, sf_dir)
    return G.format_profile(cells, ctx.select("doc_id", F.col("content_start").alias("probe_row")))


@query("display_cells", _csql(f"""
SELECT doc_id, row_idx, col_idx, {Q.format_cell('value', 'num_format', 'is_number')} AS display
FROM corpus_cells"""))
def q_display_cells(spark, sf_dir):
    cells, _, _ = corpus(spark, sf_dir)
    return G.display_cells(cells).select("doc_id", "row_idx", "col_idx", "display")
