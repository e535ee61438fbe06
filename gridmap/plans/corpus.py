"""A corpus of spreadsheet-like documents derived from ``orders`` and ``lineitem``.

One document per order: optional banner lines, a blank row, one header row
whose spellings vary by document, an optional Markdown rule row, then one
content row per line item, plus an always-empty last column.  The true
mapping of every document is known by construction.

Every cell is computed from its own order / line item; positions depend only
on the order key and on the rank of a line item inside its order (one shuffle
of the narrow columns of each table on the order key; no join).  It scales
linearly with the two tables.

Layout for order key ``k``::

    b = k % 4 banner rows (col 0 only)   rows 0 .. b-1   (20 when k % 50 = 7: the header lies far down)
    a blank row when b > 0               row  b
    nh header rows                       rows h .. h + nh - 1,  h = b + (b > 0)
    rule row '---' when k is even        row  h + nh
    content: n-th line item of the order row  c0 + n - 1,  c0 = h + nh + (k even)
             (ranked by line number, part, supplier, price, ship date)

How a header is spelt depends on ``k % 10``: 3 deals the words of a header over two rows (not the variant of single words), 4 has
lower case, 5 other punctuation, 6 a letter missing in texts of at least six, 7 three rows (first variant, longer texts), 8 a longer
text in two columns.  When ``k % 20 = 9`` a row of terms and values, which looks like a header, stands in place of the banner.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Line items that one task of the corpus turns into cells.  Shuffled they are narrow, so a task sized by shuffled bytes would hold
#: many times that in cells; with a fixed number of them the memory of a task doesn't grow with the tables.
LINES_PER_TASK = 25_000

# Fixed values of the generated corpus.
BANNERS = ["Price list", "Confidential", "All values indicative"]
HEADER_VARIANTS = [
    ["ISIN Code", "Fund Name", "NAV", "Currency", "NAV Date", ""],
    ["Code ISIN", "FONDS", "VL", "Devise", "Date VL", ""],
    ["CODE_ISIN", "Descrizione", "Quota", "Divisa", "Datum", ""],
]
LONG_HEADERS = ["ISIN Code", "Fund Name and Class", "NAV per share", "Share currency", "NAV Date", ""]
TERMS_ROW = ["Currency", "Price", "12.5", "Date", "NAV", "Quota"]
LONGER = {1: " of the share", 2: " (latest)"}  # column -> ending of longer header texts
FILE_TYPES = ["csv", "xls", "xlsx"]
N_COLS = 6
# column -> (section, field) of the true mapping
TRUTH = [("Identifier", "Code"), ("Denomination", "InstrumentName"), ("Valorisation", "Nav"),
         ("Identifier", "Currency"), ("Valorisation", "NavDate")]
LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"]
CELL_COLUMNS = ["doc_id", "row_idx", "col_idx", "value", "num_format", "is_number"]


def _layout(k):
    b = F.when(k % 50 == 7, 20).otherwise(k % 4).cast("int")
    s = F.when(k % 2 == 0, 1).otherwise(0)
    h = b + F.when(b > 0, 1).otherwise(0)
    nh = F.when((k % 10 == 7) & (k % 3 == 0), 3).when((k % 10 == 3) & (k % 3 != 2), 2).otherwise(1)
    return b, s, h, nh, h + nh + s


def _header_text(k, col_idx: int):
    """The whole header text of a column of document ``k``."""
    base = F.array(*_variant_array(col_idx))[(k % 3).cast("int")]
    text = (F.when((k % 10 == 7) & (k % 3 == 0), F.lit(LONG_HEADERS[col_idx]))
            .when(k % 10 == 4, F.lower(base))
            .when((k % 10 == 5) & (base != ""), F.concat(F.replace(base, F.lit(" "), F.lit("-")), F.lit(":")))
            .when((k % 10 == 6) & (F.length(base) >= 6), F.concat(F.substring(base, 1, 2), F.substring(base, 4, 100))))
    if col_idx in LONGER:
        text = text.when(k % 10 == 8, F.concat(base, F.lit(LONGER[col_idx])))
    return text.otherwise(base)


def _header_part(text, nh, j):
    """What of a header text stands in header row ``j`` of ``nh``: one word each, the rest in the last."""
    first, second = F.split_part(text, F.lit(" "), F.lit(1)), F.split_part(text, F.lit(" "), F.lit(2))
    rest1 = F.substr(text, F.length(first) + 2)
    rest2 = F.substr(text, F.length(first) + F.length(second) + 3)
    return F.when(nh == 1, text).when(j == 0, first).when(nh == 2, rest1).when(j == 1, second).otherwise(rest2)


def corpus_docs(orders: DataFrame) -> DataFrame:
    """doc_id, doc_name, file_type per order."""
    k = F.col("o_orderkey")
    return orders.select(
        k.alias("doc_id"),
        F.concat(F.lit("prices_"), k.cast("string"), F.lit("."),
                 F.date_format("o_orderdate", "yyyy.MM.dd")).alias("doc_name"),
        F.element_at(F.array(*[F.lit(t) for t in FILE_TYPES]), (k % 3 + 1).cast("int")).alias("file_type"),
    )


def _variant_array(col_idx):
    return [F.lit(v[col_idx]) for v in HEADER_VARIANTS]


def corpus_tasks(orders: DataFrame, lineitem: DataFrame) -> int:
    """Partitions of the corpus: in proportion to its rows, so that a task holds a bounded number of them."""
    rows = max(lineitem.count(), orders.count())
    return max(-(-rows // LINES_PER_TASK), orders.sparkSession.sparkContext.defaultParallelism)


def resent_tasks(orders: DataFrame, lineitem: DataFrame) -> int:
    """Partitions for rows of the corpus that are sent once more, so that all who read them share one exchange: another number than
    ``corpus_tasks`` (Spark drops the exchange else), of which a task's rows go to one partition, or to two."""
    tasks = corpus_tasks(orders, lineitem)
    return tasks // 2 if tasks % 2 == 0 else tasks * 2


def by_document(orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    """``orders`` in the partitions that ``corpus_cells`` of the same tables has, so that the truth and the context meet the cells unsent."""
    return orders.repartition(corpus_tasks(orders, lineitem), "o_orderkey")


def corpus_cells(orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    """Long cells table ``(doc_id, row_idx, col_idx, value, num_format, is_number)``."""
    k, tasks = F.col("o_orderkey"), corpus_tasks(orders, lineitem)
    b, s, h, nh, _c0 = _layout(k)
    # both halves are partitioned by document, as narrow rows, so that no operator on documents or their rows shuffles cells again
    o = orders.repartition(tasks, k).select(k.alias("doc_id"), b.alias("b"), s.alias("s"), h.alias("h"), nh.alias("nh"),
                      F.array(*[_header_text(k, c) for c in range(N_COLS)]).alias("texts"))

    # all top rows of a document (banners, blank row, header, rule row) from one scan of orders:
    # one array of (row, col, value) structs per order, exploded once
    def cell(r, c, v):
        return F.struct(r.cast("int").alias("row_idx"), F.lit(c).alias("col_idx") if isinstance(c, int)
                        else c.cast("int").alias("col_idx"), v.alias("value"))

    b_, s_, h_, nh_ = F.col("b"), F.col("s"), F.col("h"), F.col("nh")
    empty = F.array().cast("array<struct<row_idx:int,col_idx:int,value:string>>")
    texts = F.array(*[F.lit(x) for x in BANNERS])
    terms = F.array(*[cell(F.lit(0), c, F.lit(t)) for c, t in enumerate(TERMS_ROW)])
    banners = [F.when(F.col("doc_id") % 20 == 9, terms)
               .when(b_ > 0, F.transform(F.sequence(F.lit(0), b_ - 1), lambda i: cell(i, 0, F.get(texts, i % len(BANNERS)))))
               .otherwise(empty)]
    blank = F.when(b_ > 0, F.array(*[cell(b_, c, F.lit("")) for c in range(N_COLS)])).otherwise(empty)
    header = F.flatten(F.transform(F.sequence(F.lit(0), nh_ - 1), lambda j: F.array(
        *[cell(h_ + j, c, _header_part(F.get("texts", F.lit(c)), nh_, j)) for c in range(N_COLS)])))
    rule = F.when(s_ == 1, F.array(*[cell(h_ + nh_, c, F.lit("---" if c < N_COLS - 1 else ""))
                                     for c in range(N_COLS)])).otherwise(empty)
    top = (o.select("doc_id", F.explode(F.concat(*banners, blank, header, rule)).alias("x"))
            .select("doc_id", "x.row_idx", "x.col_idx", "x.value")
            .withColumn("num_format", F.lit("General")).withColumn("is_number", F.lit(False)))

    lk = F.col("l_orderkey")
    *_top, c0 = _layout(lk)
    vals = F.array(
        F.concat(F.lit("LU"), F.lpad(F.col("l_partkey").cast("string"), 10, "0")),
        F.concat(F.lit("Fund "), F.col("l_suppkey").cast("string")),
        F.col("l_extendedprice").cast("decimal(18,2)").cast("string"),
        F.when(F.col("l_linestatus") == "O", F.lit("EUR")).otherwise(F.lit("USD")),
        F.date_format("l_shipdate", "yyyy-MM-dd"),
        F.lit(""),
    )
    w = Window.partitionBy("l_orderkey").orderBy(*LINE_ORDER)
    ranked = lineitem.repartition(tasks, lk).select("*", (c0 + F.row_number().over(w) - 1).alias("row_idx"))
    content = (ranked.select(lk.alias("doc_id"), "row_idx", F.posexplode(vals).alias("col_idx", "value"))
                       .withColumn("num_format", F.when(F.col("col_idx") == 2, F.lit("#,##0.00"))
                                   .when(F.col("col_idx") == 4, F.lit("yyyy-mm-dd")).otherwise(F.lit("General")))
                       .withColumn("is_number", F.col("col_idx") == 2))
    return top.select(*CELL_COLUMNS).unionByName(content.select(*CELL_COLUMNS))


def corpus_truth(orders: DataFrame) -> DataFrame:
    """True mapping ``(doc_id, section, field, header, col_idx)`` of every document."""
    k = F.col("o_orderkey")
    entries = F.array(*[
        F.struct(F.lit(sec).alias("section"), F.lit(fld).alias("field"), F.lit(c).alias("col_idx"), _header_text(k, c).alias("header"))
        for c, (sec, fld) in enumerate(TRUTH)])
    return (orders.select(k.alias("doc_id"), F.explode(entries).alias("t"))
                  .select("doc_id", "t.section", "t.field", "t.header", "t.col_idx"))


# ------------------------------------------------------------------ SQL twin
def _sql_arr(xs):
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in xs) + "]"


def sql_corpus_ctes() -> str:
    """DuckDB CTEs ``corpus_docs``, ``corpus_cells``, ``corpus_truth`` (oracle side)."""
    hv = "[" + ", ".join(_sql_arr(v) for v in HEADER_VARIANTS) + "]"
    base = f"({hv})[v + 1][c + 1]"
    longer = " ".join(f"WHEN c = {c} AND doc_id % 10 = 8 THEN {base} || '{t}'" for c, t in LONGER.items())
    text = f"""CASE WHEN nh = 3 THEN {_sql_arr(LONG_HEADERS)}[c + 1] WHEN doc_id % 10 = 4 THEN lower({base})
                WHEN doc_id % 10 = 5 AND {base} <> '' THEN replace({base}, ' ', '-') || ':'
                WHEN doc_id % 10 = 6 AND length({base}) >= 6 THEN substr({base}, 1, 2) || substr({base}, 4) {longer} ELSE {base} END"""
    first, second = "split_part(header, ' ', 1)", "split_part(header, ' ', 2)"
    part = f"""CASE WHEN nh = 1 THEN header WHEN j = 0 THEN {first} WHEN nh = 2 THEN substr(header, length({first}) + 2)
                WHEN j = 1 THEN {second} ELSE substr(header, length({first}) + length({second}) + 3) END"""
    nh = "CASE WHEN {k} % 10 = 7 AND {k} % 3 = 0 THEN 3 WHEN {k} % 10 = 3 AND {k} % 3 <> 2 THEN 2 ELSE 1 END"
    truth = ", ".join(f"('{s}', '{f}', {c})" for c, (s, f) in enumerate(TRUTH))
    return f"""
corpus_o AS (
  SELECT *, b + CASE WHEN b > 0 THEN 1 ELSE 0 END AS h FROM (
    SELECT o_orderkey AS doc_id, o_orderdate, {nh.format(k='o_orderkey')} AS nh, CAST(CASE WHEN o_orderkey % 50 = 7 THEN 20 ELSE o_orderkey % 4 END AS INTEGER) AS b,
           CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 0 END AS s, CAST(o_orderkey % 3 AS INTEGER) AS v
    FROM orders)),
corpus_docs AS (
  SELECT doc_id, 'prices_' || CAST(doc_id AS VARCHAR) || '.' || strftime(o_orderdate, '%Y.%m.%d') AS doc_name,
         {_sql_arr(FILE_TYPES)}[CAST(doc_id % 3 AS INTEGER) + 1] AS file_type
  FROM corpus_o),
corpus_headers AS (
  SELECT *, {text} AS header FROM corpus_o, LATERAL (SELECT unnest(range({N_COLS})) AS c)),
corpus_top AS (
  SELECT doc_id, CAST(r AS INTEGER) AS row_idx, 0 AS col_idx, {_sql_arr(BANNERS)}[r % {len(BANNERS)} + 1] AS value
  FROM corpus_o, LATERAL (SELECT unnest(range(b)) AS r) WHERE doc_id % 20 <> 9
  UNION ALL
  SELECT doc_id, 0, CAST(c AS INTEGER), {_sql_arr(TERMS_ROW)}[c + 1]
  FROM corpus_o, LATERAL (SELECT unnest(range({N_COLS})) AS c) WHERE doc_id % 20 = 9
  UNION ALL
  SELECT doc_id, b, CAST(c AS INTEGER), '' FROM corpus_o, LATERAL (SELECT unnest(range({N_COLS})) AS c) WHERE b > 0
  UNION ALL
  SELECT doc_id, CAST(h + j AS INTEGER), CAST(c AS INTEGER), {part} FROM corpus_headers, LATERAL (SELECT unnest(range(nh)) AS j)
  UNION ALL
  SELECT doc_id, h + nh, CAST(c AS INTEGER), CASE WHEN c < {N_COLS - 1} THEN '---' ELSE '' END
  FROM corpus_o, LATERAL (SELECT unnest(range({N_COLS})) AS c) WHERE s = 1),
corpus_li AS (
  SELECT l_orderkey AS doc_id,
         CASE WHEN l_orderkey % 50 = 7 THEN 21 ELSE CAST(l_orderkey % 4 AS INTEGER) + CASE WHEN l_orderkey % 4 > 0 THEN 1 ELSE 0 END END
           + {nh.format(k='l_orderkey')} + CASE WHEN l_orderkey % 2 = 0 THEN 1 ELSE 0 END
           + row_number() OVER (PARTITION BY l_orderkey ORDER BY {", ".join(LINE_ORDER)}) - 1 AS row_idx,
         ['LU' || lpad(CAST(l_partkey AS VARCHAR), 10, '0'),
          'Fund ' || CAST(l_suppkey AS VARCHAR),
          CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR),
          CASE WHEN l_linestatus = 'O' THEN 'EUR' ELSE 'USD' END,
          strftime(l_shipdate, '%Y-%m-%d'),
          ''] AS vals
  FROM lineitem),
corpus_cells AS MATERIALIZED (
  SELECT doc_id, row_idx, col_idx, value, 'General' AS num_format, FALSE AS is_number FROM corpus_top
  UNION ALL
  SELECT doc_id, CAST(row_idx AS INTEGER), CAST(c AS INTEGER), vals[c + 1],
         CASE WHEN c = 2 THEN '#,##0.00' WHEN c = 4 THEN 'yyyy-mm-dd' ELSE 'General' END,
         c = 2
  FROM corpus_li, LATERAL (SELECT unnest(range({N_COLS})) AS c)),
corpus_truth AS (
  SELECT doc_id, t.section, t.field, o.header, t.col_idx
  FROM corpus_headers o JOIN (VALUES {truth}) AS t(section, field, col_idx) ON o.c = t.col_idx)"""
