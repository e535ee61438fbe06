"""Registered queries: prompts and chat rows, label profiling, evaluation, errors."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gridmap.functions import text as T
from gridmap.operators import evaluate as EV
from gridmap.operators import prompts as PR
from gridmap.operators import sections as S
from gridmap.operators import structures as ST
from gridmap.operators import vocab as VO
from gridmap.plans import corpus as K
from gridmap.plans import defaults as D
from gridmap.plans import dims
from gridmap.plans import pipeline as P
from gridmap.plans import sqlparts as Q
from gridmap.plans.registry import corpus, query, read

# --------------------------------------------------------------------------- conversations: D11, D13, D14, G8
_PAIRS_SQL = """pairs AS (
  SELECT u.conv_id, u.turn, u.text AS user_text, a.text AS assistant_text,
         row_number() OVER (PARTITION BY u.conv_id ORDER BY u.turn) AS pair_no
  FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
  WHERE u.role = 'user' AND a.role = 'assistant')"""
_SYS_SQL = f"""sys AS (
  SELECT c.conv_id, CAST(0 AS BIGINT) AS msg_idx, 'system' AS role, coalesce(s.text, '{D.DEFAULT_SYSTEM_MESSAGE}') AS content
  FROM (SELECT DISTINCT conv_id FROM conversations) c
  LEFT JOIN (SELECT conv_id, arg_min(text, turn) AS text FROM conversations WHERE role = 'system' GROUP BY conv_id) s
    ON c.conv_id = s.conv_id)"""
_SHOTS_SQL = """shots AS (
  SELECT * FROM sys
  UNION ALL SELECT conv_id, CAST(pair_no * 2 - 1 AS BIGINT), 'user', '# Example ' || CAST(pair_no AS VARCHAR) || chr(10) || user_text
  FROM pairs WHERE pair_no <= 2
  UNION ALL SELECT conv_id, CAST(pair_no * 2 AS BIGINT), 'assistant', assistant_text FROM pairs WHERE pair_no <= 2)"""


def _turns(spark, sf_dir):
    return read(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")


def _msgs(df):
    return df.select("conv_id", F.col("msg_idx").cast("bigint").alias("msg_idx"), "role", "content")


@query("few_shot_messages", Q.with_ctes(_PAIRS_SQL, _SYS_SQL, _SHOTS_SQL, select="SELECT * FROM shots"))
def q_few_shot_messages(spark, sf_dir):
    return _msgs(PR.few_shot_messages(_turns(spark, sf_dir), 2))


@query("chat_assembly", Q.with_ctes(_PAIRS_SQL, _SYS_SQL, _SHOTS_SQL, select="""
SELECT * FROM shots
UNION ALL
SELECT h.conv_id, CAST(m.mx + 1 AS BIGINT), 'human', h.text
FROM (SELECT conv_id, arg_max(text, turn) AS text FROM conversations WHERE role = 'user' GROUP BY conv_id) h
JOIN (SELECT conv_id, max(msg_idx) AS mx FROM shots GROUP BY conv_id) m ON h.conv_id = m.conv_id"""))
def q_chat_assembly(spark, sf_dir):
    return _msgs(PR.chat_assembly(_turns(spark, sf_dir), 2))


@query("tool_messages", Q.with_ctes(_PAIRS_SQL, select=f"""
SELECT conv_id, turn, CAST(m AS INTEGER) AS msg_idx,
       CASE m WHEN 0 THEN 'human' WHEN 1 THEN 'ai' ELSE 'tool' END AS role,
       CASE m WHEN 0 THEN user_text WHEN 1 THEN '' ELSE '{D.TOOL_OUTPUT_TEXT}' END AS content,
       CASE WHEN m = 0 THEN NULL
            ELSE substr(sha256(CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR)), 1, 16) END AS tool_call_id
FROM pairs, (VALUES (0), (1), (2)) AS t(m)"""))
def q_tool_messages(spark, sf_dir):
    return PR.tool_messages(_turns(spark, sf_dir))


@query("token_usage", """
SELECT role, phase, count(*) AS n_calls, CAST(sum(floor(length(text) / 4)) AS BIGINT) AS input_tokens
FROM (SELECT role, CASE WHEN turn < 2 THEN 'opening' ELSE 'follow-up' END AS phase, text FROM conversations)
GROUP BY ROLLUP (role, phase)""")
def q_token_usage(spark, sf_dir):
    return PR.token_usage(_turns(spark, sf_dir))


# --------------------------------------------------------------------------- documents: D10
TEMPLATE_WITH_GAP = "Document {doc_name} ({lang}): {question} -- source {source_url}"


@query("template_fill", f"""
SELECT doc_id, length(filled) AS filled_length, regexp_extract(filled, '({T.PLACEHOLDER_RE})', 1) AS leftover
FROM (SELECT doc_id, replace(replace(replace('{TEMPLATE_WITH_GAP}', '{{doc_name}}', 'doc_' || CAST(doc_id AS VARCHAR)),
                                     '{{lang}}', coalesce(lang, '')), '{{question}}', coalesce(text, '')) AS filled
      FROM documents)""")
def q_template_fill(spark, sf_dir):
    d = read(spark, sf_dir, "documents", "doc_id", "lang", "text")
    filled = T.render(TEMPLATE_WITH_GAP, doc_name=F.concat(F.lit("doc_"), F.col("doc_id").cast("string")),
                      lang=F.col("lang"), question=F.col("text"))
    return d.select("doc_id", filled.alias("f")).select(
        "doc_id", F.length("f").cast("bigint").alias("filled_length"), T.leftover_placeholder("f").alias("leftover"))


# --------------------------------------------------------------------------- part: D12
@query("corrupt_examples", f"""
SELECT p_partkey, upper(p_name) AS name, upper(p_brand) AS brand, upper(p_type) AS type, p_size, p_retailprice,
       '{D.CORRECTION_TEXT}' AS expected_correction
FROM part""")
def q_corrupt_examples(spark, sf_dir):
    p = read(spark, sf_dir, "part", "p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice")
    return p.select("p_partkey", F.upper("p_name").alias("name"), F.upper("p_brand").alias("brand"),
                    F.upper("p_type").alias("type"), "p_size", "p_retailprice",
                    F.lit(D.CORRECTION_TEXT).alias("expected_correction"))


# --------------------------------------------------------------------------- corpus truth as labels: G2, G4, D8, D9
_VOCAB_SQL = f"""vocab AS (
  SELECT section, field, count(*) AS n_values, string_agg(header, ', ' ORDER BY lower(header), header) AS "values"
  FROM (SELECT DISTINCT section, field, header FROM corpus_truth WHERE NOT {Q.is_blank('header')})
  GROUP BY section, field)"""


def _truth_labels(spark, sf_dir):
    orders = read(spark, sf_dir, "orders", "o_orderkey", "o_orderdate")
    return K.corpus_truth(orders).withColumnRenamed("header", "value"), orders


@query("value_vocabulary", Q.with_ctes(Q.corpus_ctes(), _VOCAB_SQL, select="SELECT * FROM vocab"))
def q_value_vocabulary(spark, sf_dir):
    labels, _ = _truth_labels(spark, sf_dir)
    return VO.value_vocabulary(labels)


def _desc_sql():
    return "'Header of the ' || f.field || ' field (' || f.field_type || ')'"


@query("field_description", Q.with_ctes(Q.corpus_ctes(), _VOCAB_SQL, f"field_defs AS {dims.sql_field_defs()}", select=f"""
SELECT f.section, f.field,
       CASE WHEN v."values" IS NOT NULL AND v."values" <> '' THEN {_desc_sql()} || '. Possible headers values: ' || v."values"
            ELSE {_desc_sql()} END AS description
FROM field_defs f LEFT JOIN vocab v ON v.section = f.section AND v.field = f.field"""))
def q_field_description(spark, sf_dir):
    return _described(spark, sf_dir).select("section", "field", PR.field_description("description", "examples")
                                            .alias("description"))


def _described(spark, sf_dir):
    labels, _ = _truth_labels(spark, sf_dir)
    vocab = VO.value_vocabulary(labels).select("section", "field", F.col("values").alias("examples"))
    fd = dims.field_defs(spark)
    desc = F.concat(F.lit("Header of the "), F.col("field"), F.lit(" field ("), F.col("field_type"), F.lit(")"))
    return fd.join(vocab, ["section", "field"], "left").select("section", "section_ord", "field", "field_ord",
                                                                desc.alias("description"), "examples")


@query("field_example_block", Q.with_ctes(Q.corpus_ctes(), _VOCAB_SQL, f"field_defs AS {dims.sql_field_defs()}", select=f"""
SELECT section, section_ord, string_agg(l, chr(10) ORDER BY field_ord, field, l) AS block,
       CAST(max(CASE WHEN ex IS NOT NULL AND ex <> '' THEN 1 ELSE 0 END) AS BOOLEAN) AS has_examples
FROM (SELECT f.section, f.section_ord, f.field, f.field_ord, v."values" AS ex,
             '- **`' || f.field || '`**: ' || {_desc_sql()}
             || CASE WHEN v."values" IS NOT NULL AND v."values" <> '' THEN ' - _e.g._: ' || v."values" ELSE '' END AS l
      FROM field_defs f LEFT JOIN vocab v ON v.section = f.section AND v.field = f.field)
GROUP BY section, section_ord"""))
def q_field_example_block(spark, sf_dir):
    return PR.field_example_block(_described(spark, sf_dir))


@query("completeness", Q.with_ctes(Q.corpus_ctes(), f"field_defs AS {dims.sql_field_defs()}", select=f"""
SELECT d.doc_id, f.section, count(*) AS n_fields,
       CAST(sum(CASE WHEN {Q.is_blank('t.header')} THEN 1 ELSE 0 END) AS BIGINT) AS n_blank,
       sum(CASE WHEN {Q.is_blank('t.header')} THEN 1 ELSE 0 END) / count(*) AS blank_share
FROM corpus_docs d JOIN field_defs f ON TRUE
LEFT JOIN corpus_truth t ON t.doc_id = d.doc_id AND t.section = f.section AND t.field = f.field
GROUP BY d.doc_id, f.section"""))
def q_completeness(spark, sf_dir):
    labels, orders = _truth_labels(spark, sf_dir)
    # the class is a column, not a constant that would fold the join key away
    docs = K.corpus_docs(orders).select("doc_id", F.when(F.col("doc_id").isNotNull(), F.lit("Mutual Funds")).alias("doc_class"))
    slots = S.slot_rows(docs.repartition("doc_id"), dims.field_defs(spark), labels.repartition("doc_id"), ["value"], "s.found.value")
    return VO.completeness(slots.select("doc_id", "section", "field", "value"))


# --------------------------------------------------------------------------- events.props: A15, D17, G3
# nested label documents, one for each event: objects, lists of objects and of texts, empty and null values
_NESTED_SQL = """nested AS (
  SELECT event_id, event_type, '{"user":{"id":' || user_id || ',"tags":["' || event_type || '","' || upper(event_type) || '",""]},"items":[{"k":'
         || json_extract_string(props, '$.k') || ',"note":"  "},{"k":' || user_id || ',"extra":{"day":"' || strftime(ts, '%Y-%m-%d')
         || '","more":[]}}],"props":' || props || ',"none":null}' AS doc
  FROM events WHERE json_valid(props)),
leaves AS (
  SELECT n.event_id, n.event_type, regexp_replace(substr(t.fullkey, 3), '\\[[0-9]+\\]', '[]', 'g') AS path,
         array_to_string(regexp_extract_all(t.fullkey, '\\[([0-9]+)\\]', 1), '.') AS place,
         CASE t.type WHEN 'VARCHAR' THEN 'string' WHEN 'NULL' THEN 'null' WHEN 'ARRAY' THEN 'empty' WHEN 'OBJECT' THEN 'empty'
                     WHEN 'BOOLEAN' THEN 'boolean' ELSE 'number' END AS kind,
         CASE WHEN t.type NOT IN ('NULL', 'ARRAY', 'OBJECT') THEN t.atom ->> '$' END AS value
  FROM nested n, json_tree(n.doc) t
  WHERE t.type NOT IN ('ARRAY', 'OBJECT') OR t.value IN ('[]', '{}'))"""


def _nested(spark, sf_dir):
    e = read(spark, sf_dir, "events", "event_id", "event_type", "user_id", "ts", "props").where(F.try_parse_json("props").isNotNull())
    k = F.try_variant_get(F.try_parse_json("props"), "$.k", "string")
    parts = ['{"user":{"id":', F.col("user_id"), ',"tags":["', F.col("event_type"), '","', F.upper("event_type"), '",""]},"items":[{"k":', k,
             ',"note":"  "},{"k":', F.col("user_id"), ',"extra":{"day":"', F.date_format("ts", "yyyy-MM-dd"), '","more":[]}}],"props":', F.col("props"), ',"none":null}']
    return e.select("event_id", "event_type", F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]).alias("doc"))


@query("label_scan", Q.with_ctes(_NESTED_SQL, select="SELECT event_id, path, place, kind, value FROM leaves"))
def q_label_scan(spark, sf_dir):
    return ST.walk_json(_nested(spark, sf_dir), ["event_id"], "doc")


@query("parse_structured", """
SELECT event_id, TRY_CAST(json_extract(props, '$.k') AS INTEGER) AS k, coalesce(json_valid(props), FALSE) AS is_valid
FROM events""")
def q_parse_structured(spark, sf_dir):
    from gridmap.sources.labels import parse_structured
    e = read(spark, sf_dir, "events", "event_id", "props")
    return parse_structured(e, "props", "k int").select("event_id", "parsed.k", "is_valid")


_MERGED_SQL = f"""merged AS (
  SELECT event_type, path, row_number() OVER (PARTITION BY event_type, path ORDER BY lower(value), value) - 1 AS position, value
  FROM (SELECT DISTINCT event_type, path, value FROM leaves WHERE NOT {Q.is_blank('value')}))"""


@query("structure_merge", Q.with_ctes(_NESTED_SQL, _MERGED_SQL, select="SELECT * FROM merged"))
def q_structure_merge(spark, sf_dir):
    return ST.merge_structures(_nested(spark, sf_dir), ["event_type"], "doc")


@query("vocabulary_json", Q.with_ctes(_NESTED_SQL, _MERGED_SQL, select="""
SELECT event_type, '{' || string_agg('"' || path || '":[' || vals || ']', ',' ORDER BY path) || '}' AS json
FROM (SELECT event_type, path, string_agg('"' || value || '"', ',' ORDER BY position) AS vals FROM merged WHERE position < 20 GROUP BY ALL)
GROUP BY event_type"""))
def q_vocabulary_json(spark, sf_dir):
    """The merged structure as JSON, at most 20 values a path (what a prompt shows)."""
    return ST.vocabulary_json(ST.merge_structures(_nested(spark, sf_dir), ["event_type"], "doc"), ["event_type"], 20)


@query("vocabulary_rows", """
SELECT n_name, c_mktsegment, row_number() OVER (PARTITION BY n_name, c_mktsegment ORDER BY lower(c_name), c_name) - 1 AS position, c_name
FROM (SELECT DISTINCT n_name, c_mktsegment, c_name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE trim(c_name) <> '')""")
def q_vocabulary_rows(spark, sf_dir):
    """Vocabulary of any size: a row for each distinct value with its position."""
    c = read(spark, sf_dir, "customer", "c_nationkey", "c_mktsegment", "c_name")
    n = read(spark, sf_dir, "nation", "n_nationkey", "n_name")
    return ST.ordered_distinct(c.join(n, c.c_nationkey == n.n_nationkey), ["n_name", "c_mktsegment"], "c_name")


# --------------------------------------------------------------------------- events as run records: G5-G7, B4
_RUNS_SQL = """runs AS (
  SELECT 'file_' || CAST(user_id AS VARCHAR) AS file, event_type AS sheet, CAST(value AS DECIMAL(18,2)) AS duration,
         event_type <> 'error' AS success, coalesce(TRY_CAST(json_extract(props, '$.k') AS INTEGER), 0) AS fields_extracted
  FROM events)"""


def _by_sql(keys):
    return f"""SELECT {keys}, count(*) AS n_runs, CAST(sum(CAST(success AS INTEGER)) AS BIGINT) AS n_success,
       CAST(sum(duration) AS DOUBLE) AS total_duration, CAST(sum(fields_extracted) AS BIGINT) AS fields_extracted
FROM runs GROUP BY {keys}"""


def _runs(spark, sf_dir):
    return EV.run_records(read(spark, sf_dir, "events", "user_id", "event_type", "value", "props"))


@query("run_by_file", Q.with_ctes(_RUNS_SQL, select=_by_sql("file")))
def q_run_by_file(spark, sf_dir):
    return EV.run_by_file(_runs(spark, sf_dir))


@query("run_by_sheet", Q.with_ctes(_RUNS_SQL, select=_by_sql("file, sheet")))
def q_run_by_sheet(spark, sf_dir):
    return EV.run_by_file(_runs(spark, sf_dir), ("file", "sheet"))


@query("run_summary", Q.with_ctes(_RUNS_SQL, f"byf AS ({_by_sql('file')})", select="""
SELECT total_files, success_count, error_count,
       CASE WHEN total_files > 0 THEN success_count / total_files * 100.0 ELSE 0.0 END AS success_rate,
       total_fields_extracted,
       CASE WHEN success_count > 0 THEN fs / success_count ELSE 0.0 END AS avg_fields_per_success,
       total_duration,
       CASE WHEN total_files > 0 THEN total_duration / total_files ELSE 0.0 END AS avg_file_seconds
FROM (SELECT count(*) AS total_files,
             CAST(sum(CASE WHEN n_success = n_runs THEN 1 ELSE 0 END) AS BIGINT) AS success_count,
             CAST(sum(CASE WHEN n_success = n_runs THEN 0 ELSE 1 END) AS BIGINT) AS error_count,
             CAST(sum(fields_extracted) AS BIGINT) AS total_fields_extracted,
             CAST(sum(CAST(total_duration AS DECIMAL(38,2))) AS DOUBLE) AS total_duration,
             CAST(sum(CASE WHEN n_success = n_runs THEN fields_extracted ELSE 0 END) AS BIGINT) AS fs
      FROM byf)"""))
def q_run_summary(spark, sf_dir):
    return EV.run_summary(EV.run_by_file(_runs(spark, sf_dir)))


@query("error_summary", """
SELECT coalesce(stage, 'unknown') AS stage,
       CASE WHEN stage IS NULL THEN 'UNHANDLED_ERROR' ELSE 'PIPELINE_' || upper(stage) END AS code,
       severity, count(*) AS n_errors
FROM (SELECT CASE WHEN value < 10 THEN 'header' WHEN value < 100 THEN 'sections' WHEN value < 400 THEN 'config' END AS stage,
             CASE WHEN TRY_CAST(json_extract(props, '$.k') AS INTEGER) >= 50 THEN 'ERROR' ELSE 'WARNING' END AS severity
      FROM events WHERE event_type = 'error')
GROUP BY 1, 2, 3""")
def q_error_summary(spark, sf_dir):
    e = read(spark, sf_dir, "events", "event_id", "event_type", "value", "props")
    return EV.error_summary(EV.error_records(e))


# --------------------------------------------------------------------------- G11 on labels x documents
_PAIRS_F1_SQL = """yp AS (
  SELECT l.quality AS y_true, CASE WHEN d.n_chars >= 1000 THEN 1 ELSE 0 END AS y_pred
  FROM labels l JOIN documents d ON l.doc_id = d.doc_id),
ct AS (SELECT y_true AS t, y_pred AS p, count(*) AS n FROM yp GROUP BY 1, 2),
pc AS (
  SELECT cls, CAST(support AS BIGINT) AS support, CAST(predicted AS BIGINT) AS predicted, CAST(tp AS BIGINT) AS tp,
         CASE WHEN predicted > 0 THEN tp / predicted ELSE 0.0 END AS precision,
         CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS recall
  FROM (SELECT coalesce(s.cls, p.cls) AS cls, coalesce(s.support, 0) AS support, coalesce(p.predicted, 0) AS predicted,
               coalesce(t.tp, 0) AS tp
        FROM (SELECT t AS cls, sum(n) AS support FROM ct GROUP BY t) s
        FULL OUTER JOIN (SELECT p AS cls, sum(n) AS predicted FROM ct GROUP BY p) p ON s.cls = p.cls
        LEFT JOIN (SELECT t AS cls, n AS tp FROM ct WHERE t = p) t ON t.cls = coalesce(s.cls, p.cls))),
f1 AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2.0 * precision * recall / (precision + recall) ELSE 0.0 END
                   AS f1 FROM pc)"""


def _f1_pairs(spark, sf_dir):
    lab = read(spark, sf_dir, "labels", "doc_id", "quality")
    doc = read(spark, sf_dir, "documents", "doc_id", "n_chars")
    return lab.join(doc, "doc_id").select(F.col("quality").alias("y_true"),
                                          F.when(F.col("n_chars") >= 1000, 1).otherwise(0).alias("y_pred"))


@query("class_f1", Q.with_ctes(_PAIRS_F1_SQL, select="SELECT * FROM f1"))
def q_class_f1(spark, sf_dir):
    return EV.class_f1(_f1_pairs(spark, sf_dir))


@query("weighted_f1", Q.with_ctes(_PAIRS_F1_SQL, select="""
SELECT round(sum(f1 * support) / sum(support), 10) AS weighted_f1, round(avg(f1), 10) AS macro_f1,
       round(sum(tp) / sum(support), 10) AS accuracy, CAST(sum(support) AS BIGINT) AS n FROM f1"""))
def q_weighted_f1(spark, sf_dir):
    return EV.weighted_f1(EV.class_f1(_f1_pairs(spark, sf_dir)))


# --------------------------------------------------------------------------- B3 on the mapping job
@query("quarantine", Q.with_ctes(*Q.mapping_pipeline_ctes(), select=f"""
SELECT doc_id, 'header' AS stage,
       CASE WHEN confidence IS NULL THEN 'HEADER_NOT_DETECTED' ELSE 'HEADER_VALIDATION_LOW_CONFIDENCE' END AS code,
       'ERROR' AS severity
FROM pl_ctx WHERE NOT coalesce(confidence >= {D.HEADER_CONFIDENCE_THRESHOLD}, FALSE)
UNION ALL
SELECT c.doc_id, 'config', 'CONFIG_FILE_NOT_FOUND', 'ERROR' FROM pl_checked c
WHERE c.validated_class <> '{D.NONE_LABEL}' AND c.doc_id NOT IN (SELECT doc_id FROM pl_active)"""))
def q_quarantine(spark, sf_dir):
    cells, docs, _ = corpus(spark, sf_dir)
    return P.map_documents(cells, docs).errors.select("doc_id", "stage", "code", "severity")


# --------------------------------------------------------------------------- mapping quality vs truth
@query("mapping_f1", Q.with_ctes(*Q.mapping_pipeline_ctes(), select="""
SELECT section, field, CAST(sum(CASE WHEN t.header IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS support,
       CAST(sum(CASE WHEN p.header IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS predicted,
       CAST(sum(CASE WHEN p.header IS NOT NULL AND p.header = t.header THEN 1 ELSE 0 END) AS BIGINT) AS tp
FROM (SELECT doc_id, section, field, header FROM pl_final) p
FULL OUTER JOIN (SELECT doc_id, section, field, header FROM corpus_truth) t USING (doc_id, section, field)
GROUP BY section, field"""))
def q_mapping_f1(spark, sf_dir):
    cells, docs, orders = corpus(spark, sf_dir)
    pred = P.final_mapping(P.map_documents(cells, docs)).select("doc_id", "section", "field", "header")
    return EV.mapping_scores(pred, K.corpus_truth(orders).select("doc_id", "section", "field", "header"))
