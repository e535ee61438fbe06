"""Registered queries checked by rows only: file sources, encodings, workbooks, XML,
streaming ingestion, the user scorer hook and JSON results."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F

from gridmap.functions import parse as PA
from gridmap.functions import text as T
from gridmap.operators import grid as G
from gridmap.operators import headers as H
from gridmap.operators import prompts as PR
from gridmap.plans import corpus as K
from gridmap.plans import defaults as D
from gridmap.plans import pipeline as P
from gridmap.plans import results as R
from gridmap.plans import sqlparts as Q
from gridmap.plans.registry import SQL_CORPUS_CONTEXT, corpus, corpus_context, query, read
from gridmap.session import scratch_path
from gridmap.sources import delimited as DL
from gridmap.sources import files as FS
from gridmap.sources import workbook as WB


@query("scan_files", f"""
SELECT k.file_type, k.supported, k.code, count(DISTINCT c_nationkey) AS n_files, TRUE AS have_content
FROM customer, (VALUES ('csv', TRUE, NULL), ('json', FALSE, '{FS.UNSUPPORTED_CODE}')) AS k(file_type, supported, code) GROUP BY ALL""")
def q_scan_files(spark, sf_dir):
    """Customers written as one CSV and one JSON file for each nation; the folders are listed, other types than sheets are flagged."""
    c = read(spark, sf_dir, "customer", "c_custkey", "c_name", "c_nationkey").repartition("c_nationkey")
    root = scratch_path(spark, "listed")
    c.write.partitionBy("c_nationkey").csv(f"{root}/a", header=True)
    c.write.partitionBy("c_nationkey").json(f"{root}/b")
    files = FS.scan_files(spark, root)
    _, bad = FS.split_supported(files)
    coded = files.join(bad.select("doc_id", "code"), "doc_id", "left")
    return coded.groupBy("file_type", "supported", "code").agg(F.count_distinct("path").alias("n_files"), (F.min("length") > 0).alias("have_content"))


def _sql_character(name: str) -> str:
    return "CASE " + name + " " + " ".join(f"WHEN '{n}' THEN chr({ord(c)})" for n, c in DL.NAME_TO_DELIM.items()) + " END"


def _sql_grid(delimiters: str) -> str:
    """Quotes held, lines and fields cut, as ``csv_grid`` does."""
    held = "list_transform(p, lambda x, i: CASE WHEN i % 2 = 0 THEN translate(x, d || chr(10), chr(1) || chr(2)) ELSE x END)"
    quoted = "length(x) >= 2 AND starts_with(x, chr(34)) AND ends_with(x, chr(34))"
    return f"""pieces AS (
  SELECT doc_id, d, string_split(t, chr(34)) AS p, t FROM (SELECT x.doc_id, replace(x.text, chr(13) || chr(10), chr(10)) AS t, {_sql_character('s.delimiter')} AS d
  FROM documents x JOIN ({delimiters}) s ON s.doc_id = x.doc_id WHERE x.text IS NOT NULL)),
lines AS (
  SELECT doc_id, d, ls[i] AS line, CAST(i - 1 AS INTEGER) AS row_idx FROM (
    SELECT doc_id, d, string_split(CASE WHEN len(p) % 2 = 1 THEN array_to_string({held}, chr(34)) ELSE t END, chr(10)) AS ls FROM pieces),
    LATERAL (SELECT unnest(range(1, len(ls) + 1)) AS i)),
fields AS (
  SELECT doc_id, row_idx, d, fs, CAST(i - 1 AS INTEGER) AS col_idx, ltrim(fs[i], ' ') AS x FROM (SELECT *, string_split(line, d) AS fs FROM lines),
    LATERAL (SELECT unnest(range(1, len(fs) + 1)) AS i)),
grid AS (
  SELECT doc_id, row_idx, CAST(len(fs) AS INTEGER) AS n_cells, col_idx,
         replace(translate(CASE WHEN {quoted} THEN substr(x, 2, length(x) - 2) ELSE x END, chr(1) || chr(2), d || chr(10)), chr(34) || chr(34), chr(34)) AS value
  FROM fields)"""


def _grid_oracle() -> str:
    from gridmap.plans.queries_cells import _sniff_sql

    return Q.with_ctes(_sql_grid(_sniff_sql()), select="SELECT * FROM grid")


@query("csv_grid", _grid_oracle)
def q_csv_grid(spark, sf_dir):
    """Each document text read as delimited text with its sniffed delimiter -> long cells."""
    d = read(spark, sf_dir, "documents", "doc_id", "text")
    return DL.csv_grid(d.join(DL.sniff_delimiter(d), "doc_id"))


@query("config_scan", """
SELECT c_custkey, CASE WHEN bad OR c_custkey % 4 = 1 THEN 'input' ELSE c_name END AS input_dir,
       CASE WHEN bad OR wrong THEN 0 ELSE CAST(c_custkey % 5 AS INTEGER) END AS start_row,
       CASE WHEN bad OR c_custkey % 4 = 2 THEN 15 ELSE 40 END AS end_row, NOT bad AND c_custkey % 2 = 0 AS all_sheets,
       CASE WHEN bad THEN 'INVALID_JSON' WHEN wrong THEN 'CONFIG_INVALID_TYPE' ELSE 'OK' END AS status
FROM (SELECT *, c_custkey % 11 = 5 AS bad, c_custkey % 7 = 3 AS wrong FROM customer)""")
def q_config_scan(spark, sf_dir):
    """A configuration text for each customer: keys left out take their defaults, broken and ill-typed ones are told apart."""
    c = read(spark, sf_dir, "customer", "c_custkey", "c_name")
    k = F.col("c_custkey")
    start = F.when(k % 7 == 3, F.lit('"many"')).otherwise((k % 5).cast("string"))
    text = F.concat(F.lit('{'), F.when(k % 4 == 1, "").otherwise(F.concat(F.lit('"input_dir":"'), F.col("c_name"), F.lit('",'))),
                    F.when(k % 4 == 2, "").otherwise('"end_row":40,'), F.lit('"start_row":'), start,
                    F.when(k % 2 == 0, ',"all_sheets":true').otherwise(""), F.when(k % 11 == 5, "").otherwise("}"))
    from gridmap.sources.labels import parse_configs
    found = parse_configs(c.select(k.cast("string").alias("path"), text.alias("text")))
    return found.select(F.col("path").cast("long").alias("c_custkey"), "input_dir", "start_row", "end_row", "all_sheets", "status")


@query("prompt_dim", """
SELECT name, template, CASE WHEN template IS NULL THEN 'PROMPT_FILE_NOT_FOUND' ELSE 'OK' END AS status FROM (
  SELECT p_brand || '_' || CAST(p_partkey AS VARCHAR) || '.md' AS name,
         CASE WHEN p_partkey % 3 <> 0 THEN 'Describe {doc_name}, a ' || p_type || ', in one line.' END AS template
  FROM part WHERE p_size <= 25)""")
def q_prompt_dim(spark, sf_dir):
    """Templates of parts (two of three are *.md files) looked up by the names that small parts require."""
    from gridmap.sources.labels import missing_prompts, prompt_table
    p = read(spark, sf_dir, "part", "p_partkey", "p_brand", "p_type", "p_size")
    name = F.concat(F.col("p_brand"), F.lit("_"), F.col("p_partkey").cast("string"))
    files = p.select(F.concat(F.lit("/prompts/"), name, F.when(F.col("p_partkey") % 3 != 0, ".md").otherwise(".txt")).alias("path"),
                     F.concat(F.lit("Describe {doc_name}, a "), F.col("p_type"), F.lit(", in one line.")).alias("template"))
    table, required = prompt_table(files), p.where("p_size <= 25").select(F.concat(name, F.lit(".md")).alias("name"))
    missing = missing_prompts(required, table).select("name", F.lit(None).cast("string").alias("template"), F.col("code").alias("status"))
    return required.join(table, "name").select("name", "template", F.lit("OK").alias("status")).unionByName(missing)


@query("encoding_choice", """
SELECT doc_id, lang, CASE WHEN lang = 'de' THEN 'UTF-16LE'
            WHEN lang = 'es' AND length(text) < strlen(text) AND NOT regexp_matches(text, '[^\\x{00}-\\x{FF}]') THEN 'ISO-8859-1'
            ELSE 'UTF-8' END AS charset, TRUE AS roundtrip_ok
FROM documents""")
def q_encoding_choice(spark, sf_dir):
    """Documents encoded per language (BOMs, UTF-16, Latin-1), then detected and decoded back."""
    d = read(spark, sf_dir, "documents", "doc_id", "lang", "text")
    latin1_ok = F.col("text").rlike("(?s)^[\\x00-\\xFF]*$")
    raw = (F.when(F.col("lang") == "fr", F.concat(F.unhex(F.lit("EFBBBF")), F.encode("text", "UTF-8")))
            .when(F.col("lang") == "de", F.concat(F.unhex(F.lit("FFFE")), F.encode("text", "UTF-16LE")))
            .when((F.col("lang") == "es") & latin1_ok, F.encode("text", "ISO-8859-1"))
            .otherwise(F.encode("text", "UTF-8")))
    x = d.select("doc_id", "lang", "text", raw.alias("content"))
    cs = DL.encoding_choice("content")
    return x.select("doc_id", "lang", cs.alias("charset"),
                    (DL.decode_bytes("content", cs) == F.col("text")).alias("roundtrip_ok"))


def _cell(c, v, f, n):
    return F.struct(F.lit(c).alias("c"), v.alias("v"), F.lit(f).alias("f"), F.lit(n).alias("n"))


def _customer_books(spark, sf_dir):
    c = read(spark, sf_dir, "customer", "c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")
    n = read(spark, sf_dir, "nation", "n_nationkey", "n_name")
    j = c.join(F.broadcast(n), c.c_nationkey == n.n_nationkey)
    book = F.concat(F.regexp_replace("n_name", "[^A-Za-z0-9]", "_"), F.lit("_"),
                    (F.col("c_custkey") / 500).cast("bigint").cast("string"))
    w = j.select(book.alias("book"), "c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    from pyspark.sql import Window
    rk = w.withColumn("row_idx", F.row_number().over(Window.partitionBy("book").orderBy("c_custkey")))
    vals = F.array(_cell(0, F.col("c_custkey").cast("string"), "0", True),
                   _cell(1, F.col("c_name"), "General", False),
                   _cell(2, F.col("c_acctbal").cast("string"), "#,##0.00", True),
                   _cell(3, F.col("c_mktsegment"), "General", False))
    body = rk.select("book", F.lit("customers").alias("sheet"), "row_idx", F.explode(vals).alias("x")).select(
        "book", "sheet", "row_idx", F.col("x.c").alias("col_idx"), F.col("x.v").alias("value"),
        F.col("x.f").alias("num_format"), F.col("x.n").alias("is_number"))
    books = body.select("book").distinct()
    header = books.select("book", F.lit("customers").alias("sheet"), F.lit(0).alias("row_idx"),
                          F.explode(F.array(*[F.struct(F.lit(i).alias("c"), F.lit(h).alias("v"))
                                              for i, h in enumerate(["Code", "Name", "Balance", "Segment"])]))
                          .alias("x")).select("book", "sheet", "row_idx", F.col("x.c").alias("col_idx"),
                                              F.col("x.v").alias("value"), F.lit("General").alias("num_format"),
                                              F.lit(False).alias("is_number"))
    notes = books.select("book", F.lit("notes").alias("sheet"), F.lit(0).alias("row_idx"), F.lit(0).alias("col_idx"),
                         F.concat(F.lit("Customer list "), F.col("book")).alias("value"),
                         F.lit("General").alias("num_format"), F.lit(False).alias("is_number"))
    out = scratch_path(spark, "workbooks")
    WB.write_workbooks(header.unionByName(body).unionByName(notes), out).write.format("noop").mode("overwrite").save()
    return out


SQL_BOOKS = """books AS (
  SELECT regexp_replace(n_name, '[^A-Za-z0-9]', '_', 'g') || '_' || CAST(c_custkey // 500 AS VARCHAR) AS book, c.*
  FROM customer c JOIN nation ON c_nationkey = n_nationkey),
book_rows AS (SELECT *, CAST(row_number() OVER (PARTITION BY book ORDER BY c_custkey) AS INTEGER) AS row_idx FROM books),
book_cells AS (
  SELECT book, row_idx, 0 AS col_idx, CAST(CAST(c_custkey AS DOUBLE) AS VARCHAR) AS value, '0' AS num_format, TRUE AS is_number FROM book_rows
  UNION ALL SELECT book, row_idx, 1, c_name, 'General', FALSE FROM book_rows
  UNION ALL SELECT book, row_idx, 2, CAST(CAST(c_acctbal AS DOUBLE) AS VARCHAR), '#,##0.00', TRUE FROM book_rows
  UNION ALL SELECT book, row_idx, 3, c_mktsegment, 'General', FALSE FROM book_rows
  UNION ALL SELECT book, 0, h.i, h.name, 'General', FALSE FROM (SELECT DISTINCT book FROM books),
    (VALUES (0, 'Code'), (1, 'Name'), (2, 'Balance'), (3, 'Segment')) AS h(i, name))"""


@query("xlsx_cells", Q.with_ctes(SQL_BOOKS, select=f"""
SELECT book || '.xlsx' AS file, 'customers' AS sheet, row_idx, col_idx, value, num_format,
       {Q.format_cell('value', 'num_format', 'is_number')} AS display
FROM book_cells"""))
def q_xlsx_cells(spark, sf_dir):
    """Workbooks written from customer x nation, read back: first sheet, displayed values."""
    path = _customer_books(spark, sf_dir)
    cells = WB.read_workbooks(spark, path, all_sheets=False)
    return G.display_cells(cells).select(F.element_at(F.split("path", "/"), -1).alias("file"), "sheet", "row_idx",
                                         "col_idx", "value", "num_format", "display")


@query("all_sheets", Q.with_ctes(SQL_BOOKS, select="""
SELECT book || '.xlsx' AS file, 'customers' AS sheet, 0 AS sheet_idx, count(*) AS n_cells, count(DISTINCT row_idx) AS n_rows
FROM book_cells GROUP BY book
UNION ALL SELECT DISTINCT book || '.xlsx', 'notes', 1, 1, 1 FROM books"""))
def q_all_sheets(spark, sf_dir):
    """Every sheet of every workbook, whole sheets: cells and rows per sheet."""
    path = _customer_books(spark, sf_dir)
    cells = WB.read_workbooks(spark, path, all_sheets=True)
    return cells.groupBy(F.element_at(F.split("path", "/"), -1).alias("file"), "sheet", "sheet_idx").agg(
        F.count(F.lit(1)).alias("n_cells"), F.count_distinct("row_idx").alias("n_rows"))


def _xml_record(k, fields):
    """A record of an order, some of them damaged: no end tag, tags out of order, a bare '<'."""
    inner = F.concat(*[F.concat(F.lit(f"<{f}>"), F.col(f).cast("string"), F.lit(f"</{f}>")) for f in fields])
    return (F.when(k % 10 == 3, F.concat(F.lit("<row>"), inner)).when(k % 10 == 6, F.concat(F.lit("<row><b>"), inner, F.lit("</row></b>")))
            .when(k % 50 == 9, F.concat(F.lit("<row>"), inner, F.lit("<o_note>1 < 2</o_note></row>"))).otherwise(F.concat(F.lit("<row>"), inner, F.lit("</row>"))))


_XML_FIELDS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]


@query("xml_rows", """
SELECT CASE WHEN code IS NULL THEN o_orderkey END AS o_orderkey, CASE WHEN code IS NULL THEN o_custkey END AS o_custkey,
       CASE WHEN code IS NULL THEN o_orderstatus END AS o_orderstatus, CASE WHEN code IS NULL THEN CAST(o_totalprice AS DOUBLE) END AS o_totalprice,
       CASE WHEN code IS NULL THEN o_orderpriority END AS o_orderpriority, code, CASE WHEN code IS NOT NULL THEN o_orderkey END AS damaged_key
FROM (SELECT *, CASE WHEN o_orderkey % 10 = 3 THEN 'XML_RECORD_NOT_CLOSED' WHEN o_orderkey % 10 = 6 OR o_orderkey % 50 = 9 THEN 'XML_RECORD_MALFORMED' END AS code
      FROM orders)""")
def q_xml_rows(spark, sf_dir):
    """orders written as XML records, some of them damaged: every other record comes back typed, the damaged ones in quarantine."""
    from gridmap.sources.xml import recover_rows
    o = read(spark, sf_dir, "orders", *_XML_FIELDS)
    path = scratch_path(spark, "xml")
    o.select(_xml_record(F.col("o_orderkey"), _XML_FIELDS).alias("value")).write.text(path)
    schema = "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderpriority string"
    rows, damaged = recover_rows(spark, path, "row", schema)
    key = F.regexp_extract("record", "<o_orderkey>([0-9]+)<", 1).cast("long")
    bad = damaged.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema], "code", key.alias("damaged_key"))
    return rows.select("*", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("damaged_key")).unionByName(bad)


@query("stream_ingest", """
SELECT DISTINCT 'doc_' || CAST(doc_id AS VARCHAR) || '.txt' AS doc_name, sha256(t) AS sha256, strlen(t) AS length
FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents
      UNION ALL SELECT doc_id, coalesce(text, '') || ' v2' FROM documents WHERE doc_id % 3 = 0)""")
def q_stream_ingest(spark, sf_dir):
    """Documents uploaded in four triggers, many of them again and some changed: each (name, content) gives one result."""
    from gridmap.streaming.ingest import first_uploads, run_batches
    d = read(spark, sf_dir, "documents", "doc_id", "text")
    text, path = F.coalesce("text", F.lit("")), scratch_path(spark, "uploads")
    for k, part in enumerate([d.select("doc_id", text.alias("t")), d.where("doc_id % 2 = 0").select("doc_id", text.alias("t")),
                              d.where("doc_id % 3 = 0").select("doc_id", F.concat(text, F.lit(" v2")).alias("t")), d.select("doc_id", text.alias("t"))]):
        up = part.select(F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("doc_name"), F.col("t").cast("binary").alias("content"))
        up.withColumn("uploaded_at", F.lit(f"2024-01-0{k + 1} 00:00:00").cast("timestamp")).write.mode("append").parquet(path)
    schema = "doc_name string, content binary, uploaded_at timestamp"
    uploads = spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).parquet(path)
    first = first_uploads(uploads).select("doc_name", "sha256", F.octet_length("content").cast("long").alias("length"))
    return spark.read.parquet(run_batches(first, scratch_path(spark, "stream-out"), scratch_path(spark, "stream-ckpt"))).drop("epoch")


def demo_scorer(pdf: pd.DataFrame) -> pd.Series:
    """Stand-in for a model: answers with the first asset word found in the prompt, else 'None of those'."""
    text = pdf["prompt"].str.lower()
    out = pd.Series(["<class>None of those</class><confidence>Low</confidence>"] * len(pdf), index=pdf.index)
    for word, label in [("etf", "ETF"), ("bond", "Bonds"), ("stock", "Stocks"), ("fund", "Mutual Funds")]:
        hit = text.str.contains(rf"\b{word}", regex=True, flags=re.ASCII) & out.str.contains("None of those")
        out[hit] = f"<class>{label}</class><confidence>Medium</confidence>"
    return out


def _demo_label(prompt: str) -> str:
    """The demo scorer's label in SQL."""
    return "CASE " + " ".join(f"WHEN regexp_matches(lower({prompt}), '\\b{w}') THEN '{x}'" for w, x in [
        ("etf", "ETF"), ("bond", "Bonds"), ("stock", "Stocks"), ("fund", "Mutual Funds")]) + f" ELSE '{D.NONE_LABEL}' END"


def _sql_prompt(name: str, part: str) -> str:
    template = "'" + D.CLASS_PROMPT.replace("'", "''") + "'"
    return f"replace(replace({template}, '{{doc_name}}', {name}), '{{question}}', {part})"


def _sql_budget(name: str) -> str:
    base = f"CAST(floor(length({_sql_prompt(name, chr(39) * 2)}) / 4) AS BIGINT)"
    return f"greatest({int(D.CLASS_MAX_TOKENS * D.CLASS_CONTEXT_PCT)} - {base}, 1) * 4"


def _sql_merged(labelled: str) -> list[str]:
    """The class that most windows (doc_id, label) name, ties by label order."""
    order = "CASE label " + " ".join(f"WHEN '{x}' THEN {i}" for i, x in enumerate(D.CLASS_LABELS)) + " END"
    return [f"votes AS (SELECT doc_id, label, count(*) AS n FROM {labelled} GROUP BY ALL)",
            f"""merged_class AS (
  SELECT doc_id, coalesce(arg_min(label, -1000 * n + {order}) FILTER (WHERE label <> '{D.NONE_LABEL}'), '{D.NONE_LABEL}') AS predicted_class,
         CAST(sum(n) AS BIGINT) AS n_windows, CAST(coalesce(max(n) FILTER (WHERE label <> '{D.NONE_LABEL}'), 0) AS BIGINT) AS n_votes
  FROM votes GROUP BY doc_id)"""]


@query("score_hook", Q.with_ctes(
    f"named AS (SELECT doc_id, 'doc_' || CAST(doc_id AS VARCHAR) || '_' || source AS doc_name, coalesce(text, '') AS t FROM documents)",
    f"budgets AS (SELECT *, {_sql_budget('doc_name')} AS budget FROM named)",
    f"""labelled AS (
  SELECT doc_id, {_demo_label(_sql_prompt('doc_name', 'substr(t, CAST(w * budget + 1 AS BIGINT), budget)'))} AS label
  FROM budgets, LATERAL (SELECT unnest(range(CAST(greatest(ceil(length(t) / budget), 1) AS BIGINT))) AS w))""",
    *_sql_merged("labelled"), select=f"""
SELECT doc_id, predicted_class, CASE WHEN predicted_class = '{D.NONE_LABEL}' THEN 'Low' ELSE 'Medium' END AS confidence, n_windows, n_votes
FROM merged_class"""))
def q_score_hook(spark, sf_dir):
    """Whole documents in prompt-sized windows, scored by a user callable (mapInPandas) through an answer store, merged."""
    from gridmap.operators import scorer as SC
    d = read(spark, sf_dir, "documents", "doc_id", "text", "source")
    name = F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit("_"), F.col("source"))
    windows = SC.text_windows(d.select("doc_id", name.alias("doc_name"), "text"), SC.class_budget(F.col("doc_name")))
    answers = SC.stored_answers(SC.class_prompts(windows), demo_scorer, scratch_path(spark, "answers"))
    return SC.merge_classes(answers).select("doc_id", "predicted_class", "confidence", "n_windows", "n_votes")


_RESULT_SQL = """slot AS (
  SELECT doc_id, section, section_ord, string_agg('"' || field || '":' || coalesce('"' || header || '"', 'null'), ',' ORDER BY field_ord) AS j
  FROM pl_final GROUP BY ALL),
secs AS (SELECT doc_id, string_agg('"' || section || '":{' || j || '}', ',' ORDER BY section_ord) AS j FROM slot GROUP BY doc_id)"""


@query("result_json", Q.with_ctes(*Q.mapping_pipeline_ctes(), _RESULT_SQL, select="""
SELECT c.doc_id, c.validated_class AS doc_class, '{"Classification":{"predicted_class":"' || c.validated_class || '","confidence":"' || c.confidence
       || '","validation_reason":"' || c.validation_reason || '"},"Context":' || coalesce('{"ValidationConfidence":'
       || CAST(CAST(p.confidence AS DOUBLE) AS VARCHAR) || ',"FileName":"' || d.doc_name || '","HeaderStartLine":' || p.header_start
       || ',"HeaderEndLine":' || p.header_end || ',"ContentStartLine":' || p.content_start || ',"FileType":"' || d.file_type
       || '","ProcessingTimeSeconds":null}', 'null') || ',"Sections":' || coalesce('{' || s.j || '}', 'null') || '}' AS json
FROM pl_checked c JOIN corpus_docs d ON d.doc_id = c.doc_id LEFT JOIN pl_pass p ON p.doc_id = c.doc_id LEFT JOIN secs s ON s.doc_id = c.doc_id"""))
def q_result_json(spark, sf_dir):
    """One JSON document per mapped spreadsheet (Classification, Context, sections; nulls kept)."""
    cells, docs, _ = corpus(spark, sf_dir)
    return R.result_json(P.map_documents(cells, docs), docs)


@query("assemble_results", Q.with_ctes(*Q.mapping_pipeline_ctes(), select="""
SELECT c.doc_id, c.validated_class AS doc_class, c.confidence, p.header_start, p.content_start, f.section,
       CAST(dense_rank() OVER (PARTITION BY c.doc_id ORDER BY f.section_ord) - 1 AS INTEGER) AS section_place, f.field,
       CAST(row_number() OVER (PARTITION BY c.doc_id, f.section_ord ORDER BY f.field_ord) - 1 AS INTEGER) AS field_place, f.header
FROM pl_checked c JOIN pl_final f ON f.doc_id = c.doc_id JOIN pl_pass p ON p.doc_id = c.doc_id"""))
def q_assemble_results(spark, sf_dir):
    """The assembled result records, taken apart again in their order."""
    cells, docs, _ = corpus(spark, sf_dir)
    a = R.assemble(P.map_documents(cells, docs), docs)
    s = a.select("doc_id", "doc_class", "result.Classification.confidence", F.col("result.Context.HeaderStartLine").alias("header_start"),
                 F.col("result.Context.ContentStartLine").alias("content_start"), F.posexplode("result.Sections").alias("section_place", "section", "_f"))
    return s.select("doc_id", "doc_class", "confidence", "header_start", "content_start", "section", "section_place",
                    F.posexplode("_f").alias("field_place", "field", "header"))


@query("context_build", Q.with_ctes(*Q.mapping_pipeline_ctes(), select="""
SELECT p.doc_id, '{"ValidationConfidence":' || CAST(CAST(p.confidence AS DOUBLE) AS VARCHAR) || ',"FileName":"' || d.doc_name
       || '","HeaderStartLine":' || p.header_start || ',"HeaderEndLine":' || p.header_end || ',"ContentStartLine":' || p.content_start
       || ',"FileType":"' || d.file_type || '"}' AS context_json
FROM pl_pass p JOIN corpus_docs d ON p.doc_id = d.doc_id"""))
def q_context_build(spark, sf_dir):
    cells, docs, _ = corpus(spark, sf_dir)
    res = P.map_documents(cells, docs)
    return H.context_struct(res.context, docs).select("doc_id", F.to_json("context").alias("context_json"))


@query("render_validation_input", Q.with_ctes(Q.corpus_ctes(), SQL_CORPUS_CONTEXT, Q.rows_to_lines_cte("ls", "corpus_cells"), select=f"""
SELECT x.doc_id, '# Original Table' || chr(10) || string_agg(l.line, chr(10) ORDER BY l.line_no) || chr(10) || chr(10)
       || '# Detected Headers' || chr(10) || '```json' || chr(10) || '{{"HeaderStartLine":' || any_value(x.header_start)
       || ',"HeaderEndLine":' || any_value(x.header_end) || ',"ContentStartLine":' || any_value(x.content_start) || '}}'
       || chr(10) || '```' AS validation_input
FROM corpus_ctx x JOIN ls l ON l.doc_id = x.doc_id AND l.line_no >= x.header_start
     AND l.line_no < x.content_start + {D.FOCUS_CONTENT_ROWS}
GROUP BY x.doc_id"""))
def q_render_validation_input(spark, sf_dir):
    cells, docs, orders = corpus(spark, sf_dir)
    lines = G.rows_to_lines(cells)
    ctx = corpus_context(orders)
    return PR.render_validation_input(H.focus_content(lines, ctx), ctx)


@query("header_examples", Q.with_ctes(Q.corpus_ctes(), SQL_CORPUS_CONTEXT, Q.rows_to_lines_cte("ls", "corpus_cells"), select="""
SELECT x.doc_id, string_agg(l.line, chr(10) ORDER BY l.line_no) AS "table",
       '{"HeaderStartLine":' || any_value(x.header_start) || ',"HeaderEndLine":' || any_value(x.header_end)
       || ',"ContentStartLine":' || any_value(x.content_start) || ',"ValidationConfidence":'
       || CAST(CAST((900 + x.doc_id * 7919 % 101) / 1000.0 AS DECIMAL(4, 3)) AS VARCHAR) || '}' AS expected
FROM corpus_ctx x JOIN ls l ON l.doc_id = x.doc_id GROUP BY x.doc_id"""))
def q_header_examples(spark, sf_dir):
    """Header-detection examples: the rows as Markdown + true context with a deterministic confidence."""
    cells, _, orders = corpus(spark, sf_dir)
    lines = G.rows_to_lines(cells)
    text = G.lines_to_text(lines)
    ctx = corpus_context(orders)
    conf = ((F.lit(900) + F.pmod(F.col("doc_id") * 7919, F.lit(101))) / F.lit(1000.0)).cast("decimal(4,3)")
    js = F.to_json(F.struct(F.col("header_start").alias("HeaderStartLine"),
                            F.col("header_end").alias("HeaderEndLine"),
                            F.col("content_start").alias("ContentStartLine"), conf.alias("ValidationConfidence")))
    return text.join(ctx, "doc_id").select("doc_id", F.col("text").alias("table"), js.alias("expected"))


@query("render_conflict_input", Q.with_ctes(*Q.mapping_pipeline_ctes(), f"""told AS (
  SELECT doc_id, string_agg('"' || section || '.' || field || '":"' || header || '"', ',' ORDER BY section || '.' || field) AS j
  FROM pl_merged WHERE header IS NOT NULL GROUP BY doc_id),
claims AS (
  SELECT doc_id, header, string_agg('"' || section || '.' || field || '"', ',' ORDER BY section_ord, field_ord) AS members
  FROM pl_merged WHERE header IS NOT NULL AND section <> 'Context' AND field <> 'ValidationConfidence' GROUP BY doc_id, header HAVING count(*) > 1),
claimed AS (
  SELECT doc_id, string_agg('{{"header":"' || header || '","conflicts":[' || members || ']}}', ',' ORDER BY header) AS j FROM claims GROUP BY doc_id),
shown AS (
  SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.line_no) AS focus FROM pl_lines l JOIN pl_pass p ON p.doc_id = l.doc_id
   AND l.line_no >= p.header_start AND l.line_no < coalesce(nullif(p.content_start, 0), p.header_end + 1) + {D.FOCUS_CONTENT_ROWS} GROUP BY l.doc_id)""",
    select="""
SELECT c.doc_id, '# Original Table' || chr(10) || s.focus || chr(10) || chr(10) || '# Extracted Data' || chr(10) || '```json' || chr(10) || '{' || t.j
       || '}' || chr(10) || '```' || chr(10) || chr(10) || '# Conflicts' || chr(10) || '```json' || chr(10) || '[' || c.j || ']' || chr(10) || '```' AS conflict_input
FROM claimed c JOIN told t ON t.doc_id = c.doc_id JOIN shown s ON s.doc_id = c.doc_id"""))
def q_render_conflict_input(spark, sf_dir):
    """Conflict-resolution inputs for the documents whose mapping has conflicts."""
    from gridmap.operators import sections as S
    cells, docs, orders = corpus(spark, sf_dir)
    res = P.map_documents(cells, docs)
    before = res.mapping.drop("header").withColumnRenamed("header_before", "header")
    lines = G.rows_to_lines(cells)
    focus = H.focus_content(lines, res.context)
    return PR.render_conflict_input(focus, before, S.field_conflicts(before))


def _model_ctes() -> list[str]:
    """The mapping job with the demo scorer's classes, over windows of whole lines."""
    return [f"model_budget AS (SELECT doc_id, doc_name, {_sql_budget('doc_name')} AS budget FROM corpus_docs)",
            f"""labelled AS (
  SELECT doc_id, {_demo_label(_sql_prompt('any_value(doc_name)', "string_agg(line, chr(10) ORDER BY line_no)"))} AS label
  FROM (SELECT l.doc_id, l.line_no, l.line, b.doc_name,
               floor(coalesce(sum(length(l.line) + 1) OVER (PARTITION BY l.doc_id ORDER BY l.line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / b.budget) AS w
        FROM pl_lines l JOIN model_budget b ON b.doc_id = l.doc_id) GROUP BY doc_id, w)""", *_sql_merged("labelled"),
            "pl_checked AS (SELECT doc_id, predicted_class AS validated_class FROM merged_class)"]


@query("map_documents_model", Q.with_ctes(*Q.mapping_pipeline_ctes(_model_ctes()), select="SELECT doc_id, section, field, header, confidence, source FROM pl_final"))
def q_map_documents_model(spark, sf_dir):
    """The mapping job with a supplied class scorer (mapInPandas) over whole sheets instead of the rule scorer."""
    cells, docs, _ = corpus(spark, sf_dir)
    return P.final_mapping(P.map_documents(cells, docs, class_scorer=demo_scorer))


@query("stream_map_documents")
def q_stream_map_documents(spark, sf_dir):
    """Price-list CSV files written from orders (chunks of at most 1000 orders each, ';'-separated, with a
    header row), mapped as they arrive: the stream runs the whole mapping job on every micro-batch."""
    from gridmap.streaming.ingest import ingest_folder, map_arrivals
    o = read(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", "o_orderstatus")
    lists = o.select((F.col("o_orderkey") / 1000).cast("bigint").alias("chunk"),
                     F.concat(F.lit("ORD"), F.lpad(F.col("o_orderkey").cast("string"), 9, "0")).alias("ISIN Code"),
                     F.concat(F.lit("Fund "), F.col("o_custkey").cast("string")).alias("Fund Name"),
                     F.col("o_totalprice").cast("decimal(18,2)").cast("string").alias("NAV"),
                     F.when(F.col("o_orderstatus") == "F", F.lit("EUR")).otherwise(F.lit("USD")).alias("Devise"),
                     F.date_format("o_orderdate", "yyyy-MM-dd").alias("Date VL"))
    src = scratch_path(spark, "price-lists")
    (lists.repartition("chunk").write.partitionBy("chunk").option("header", True).option("sep", ";")
          .csv(src))
    out = ingest_folder(spark, src, scratch_path(spark, "stream-mapping"), scratch_path(spark, "stream-ckpt"),
                        batch_fn=map_arrivals)
    return spark.read.parquet(out).drop("epoch")
