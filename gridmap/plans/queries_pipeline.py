"""Registered queries: pipeline stages, conflicts and merge, answer parsing, class routing."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridmap.functions import parse as PA
from gridmap.operators import classify as C
from gridmap.operators import headers as H
from gridmap.operators import sections as S
from gridmap.plans import defaults as D
from gridmap.plans import dims
from gridmap.plans import pipeline as P
from gridmap.plans import sqlparts as Q
from gridmap.plans.registry import corpus, query, read

_PL = Q.mapping_pipeline_ctes()


def _pl_sql(select: str, *extra: str) -> str:
    return Q.with_ctes(*_PL, *extra, select=select)


def _run(spark, sf_dir):
    cells, docs, _ = corpus(spark, sf_dir)
    return P.map_documents(cells, docs)


# --------------------------------------------------------------------------- E3, E4, D20, E5, E6, G13
@query("detect_header", _pl_sql("SELECT * FROM pl_det"))
def q_detect_header(spark, sf_dir):
    return _run(spark, sf_dir).detected.drop("header_numeric", "content_digit")


@query("validate_header", _pl_sql("SELECT * FROM pl_ctx"))
def q_validate_header(spark, sf_dir):
    return _run(spark, sf_dir).validated_ctx


@query("header_gate", _pl_sql(f"""
SELECT doc_id, CASE WHEN confidence IS NULL THEN '{H.NOT_DETECTED}' ELSE '{H.LOW_CONFIDENCE}' END AS code,
       round(confidence, 2) AS confidence
FROM pl_ctx WHERE NOT coalesce(confidence >= {D.HEADER_CONFIDENCE_THRESHOLD}, FALSE)"""))
def q_header_gate(spark, sf_dir):
    r = _run(spark, sf_dir)
    _, errors = H.header_gate(r.validated_ctx)
    return r.validated_ctx.select("doc_id", "confidence").join(errors.hint("shuffle_hash"), "doc_id").select(
        "doc_id", "code", F.round("confidence", 2).alias("confidence"))


@query("extract_sections", _pl_sql(
    "SELECT doc_id, section, field, header, col_idx, match_kind, confidence FROM pl_ext"))
def q_extract_sections(spark, sf_dir):
    return _run(spark, sf_dir).extracted.select("doc_id", "section", "field", "header", "col_idx", "match_kind",
                                                "confidence")


@query("validate_sections", _pl_sql(
    "SELECT doc_id, section, field, header, extracted_header, validation_confidence FROM pl_val"))
def q_validate_sections(spark, sf_dir):
    return _run(spark, sf_dir).validated.select("doc_id", "section", "field", "header", "extracted_header",
                                                "validation_confidence")


@query("correction_summary", _pl_sql("""
SELECT section, status AS error_type, count(*) AS n_corrections FROM pl_val
WHERE status NOT IN ('ok', 'none') GROUP BY section, status"""))
def q_correction_summary(spark, sf_dir):
    return S.correction_summary(_run(spark, sf_dir).corrections)


# --------------------------------------------------------------------------- E6, G13 on answers with every kind of mistake
_MISTAKE = "(doc_id * 31 + field_ord * 7 + section_ord * 3) % 11"


def _mistaken(extracted, header_cells):
    """Section answers as a careless model would give them: left out, in capitals, with a colon, made up, or of the first column."""
    m = (F.col("doc_id") * 31 + F.col("field_ord") * 7 + F.col("section_ord") * 3) % 11
    first = header_cells.where("col_idx = 0").select("doc_id", F.col("header").alias("_first"))
    h = F.col("header")
    told = h.isNotNull()
    answer = (F.when(told & (m == 0), F.lit(None).cast("string")).when(told & (m == 1), F.upper(h)).when(told & (m == 2), F.concat(h, F.lit(":")))
              .when(told & (m == 3), F.lit("No such column")).when(told & (m == 4), F.coalesce(F.col("_first"), h))
              .when(~told & (m == 5), F.concat(F.lit("Column "), F.col("field"))).otherwise(h))
    # slots that stay without an answer and match nothing are left to the fan-out after validation
    asked = extracted.where(told | (m == 5))
    return asked.join(first.hint("shuffle_hash"), "doc_id", "left").withColumn("header", answer).drop("_first")


_ANSWERS = [f"""an_ext AS MATERIALIZED (
  SELECT e.* EXCLUDE (header), CASE WHEN header IS NOT NULL AND m = 0 THEN NULL WHEN header IS NOT NULL AND m = 1 THEN upper(header)
         WHEN header IS NOT NULL AND m = 2 THEN header || ':' WHEN header IS NOT NULL AND m = 3 THEN 'No such column'
         WHEN header IS NOT NULL AND m = 4 THEN coalesce(first_header, header) WHEN header IS NULL AND m = 5 THEN 'Column ' || field
         ELSE header END AS header
  FROM (SELECT *, {_MISTAKE} AS m FROM pl_ext) e LEFT JOIN (SELECT doc_id AS d, header AS first_header FROM pl_hdr WHERE col_idx = 0) ON d = doc_id)""",
            Q.validate_sections_cte("an_val", "an_ext", "pl_hdr", "pl_fit")]


def _validated_answers(spark, sf_dir):
    r = _run(spark, sf_dir)
    answers = _mistaken(r.extracted, r.header_cells)  # partitioned by document, and read once
    checked, corrections = S.validate_sections(answers, r.header_cells, candidates=r.candidates.repartition(r.tasks, "doc_id"))
    return r.full_width_of(checked), corrections


@query("validate_answers", _pl_sql(
    "SELECT doc_id, section, field, header, col_idx, extracted_header, validation_confidence FROM an_val", *_ANSWERS))
def q_validate_answers(spark, sf_dir):
    return _validated_answers(spark, sf_dir)[0].select("doc_id", "section", "field", "header", "col_idx", "extracted_header", "validation_confidence")


@query("answer_corrections", _pl_sql("""
SELECT doc_id, section, field, extracted_header AS original_value, header AS corrected_value, status AS error_type
FROM an_val WHERE status NOT IN ('ok', 'none')""", *_ANSWERS))
def q_answer_corrections(spark, sf_dir):
    return _validated_answers(spark, sf_dir)[1]


@query("answer_correction_summary", _pl_sql("""
SELECT section, status AS error_type, count(*) AS n_corrections FROM an_val WHERE status NOT IN ('ok', 'none') GROUP BY ALL""", *_ANSWERS))
def q_answer_correction_summary(spark, sf_dir):
    return S.correction_summary(_validated_answers(spark, sf_dir)[1])


@query("section_fanout", _pl_sql("""
SELECT a.doc_id, f.section, f.section_ord, f.field, f.field_ord
FROM pl_active a JOIN field_defs f ON f.doc_class = a.doc_class"""))
def q_section_fanout(spark, sf_dir):
    r = _run(spark, sf_dir)
    return S.section_fanout(r.active, dims.field_defs(spark)).select("doc_id", "section", "section_ord", "field",
                                                                      "field_ord")


@query("step_count", _pl_sql("""
SELECT a.doc_id, count(DISTINCT f.section) AS n_sections, 4 + 2 * count(DISTINCT f.section) + 1 AS n_steps
FROM pl_active a JOIN field_defs f ON f.doc_class = a.doc_class GROUP BY a.doc_id"""))
def q_step_count(spark, sf_dir):
    r = _run(spark, sf_dir)
    fo = S.section_fanout(r.active, dims.field_defs(spark))
    return fo.groupBy("doc_id").agg(F.count_distinct("section").alias("n_sections")).withColumn(
        "n_steps", F.lit(4) + F.lit(2) * F.col("n_sections") + F.lit(1))


@query("field_conflicts_pipeline", _pl_sql("""
SELECT doc_id, header, count(*) AS n_members,
       string_agg(section || '.' || field, ', ' ORDER BY section_ord, field_ord, section || '.' || field) AS members
FROM pl_merged WHERE header IS NOT NULL AND section <> 'Context' AND field <> 'ValidationConfidence'
GROUP BY doc_id, header HAVING count(*) > 1"""))
def q_field_conflicts_pipeline(spark, sf_dir):
    r = _run(spark, sf_dir)
    return S.field_conflicts(r.conflicting.drop("header").withColumnRenamed("header_before", "header"))


# --------------------------------------------------------------------------- lineitem as mapping rows: G1, H1, G9
_LI_MAP_SQL = """li_map AS (
  SELECT l_orderkey AS doc_id, l_returnflag AS section, ascii(l_returnflag) AS section_ord,
         'F' || CAST(l_linenumber AS VARCHAR) AS field, l_linenumber AS field_ord,
         'H' || CAST(l_partkey % 7 AS VARCHAR) AS header, l_partkey % 7 AS col_idx, 1 - l_discount AS confidence
  FROM lineitem)"""


def _li_map(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem", "l_orderkey", "l_returnflag", "l_linenumber", "l_partkey", "l_discount")
    return li.select(F.col("l_orderkey").alias("doc_id"), F.col("l_returnflag").alias("section"),
                     F.ascii("l_returnflag").alias("section_ord"),
                     F.concat(F.lit("F"), F.col("l_linenumber").cast("string")).alias("field"),
                     F.col("l_linenumber").alias("field_ord"),
                     F.concat(F.lit("H"), (F.col("l_partkey") % 7).cast("string")).alias("header"),
                     (F.col("l_partkey") % 7).alias("col_idx"), (F.lit(1) - F.col("l_discount")).alias("confidence"))


@query("field_conflicts", Q.with_ctes(_LI_MAP_SQL, select="""
SELECT doc_id, header, count(*) AS n_members,
       string_agg(section || '.' || field, ', ' ORDER BY section_ord, field_ord, section || '.' || field) AS members
FROM li_map GROUP BY doc_id, header HAVING count(*) > 1"""))
def q_field_conflicts(spark, sf_dir):
    return S.field_conflicts(_li_map(spark, sf_dir))


@query("resolve_conflicts", Q.with_ctes(_LI_MAP_SQL, Q.resolve_conflicts_cte("rc", "li_map"), select="""
SELECT doc_id, section, field, confidence, header_before, header FROM rc"""))
def q_resolve_conflicts(spark, sf_dir):
    return S.resolve_conflicts(_li_map(spark, sf_dir)).select("doc_id", "section", "field", "confidence",
                                                               "header_before", "header")


@query("section_merge", f"""
SELECT l_orderkey AS doc_id, l_returnflag AS section, 'F' || CAST(l_linenumber AS VARCHAR) AS field,
       CASE WHEN l_linestatus = 'F' THEN CASE WHEN l_tax > 0.04 THEN 'H' || CAST(l_suppkey % 7 AS VARCHAR) END
            WHEN l_quantity >= 5 THEN 'H' || CAST(l_partkey % 7 AS VARCHAR) END AS header,
       CASE WHEN l_linestatus = 'F' THEN coalesce(CASE WHEN l_tax = 0.08 THEN NULL ELSE 1 - l_tax END, {D.CONF_NOT_SCORED})
            WHEN l_quantity >= 5 THEN {D.CONF_EXTRACTED_ONLY} ELSE {D.CONF_NOT_EXTRACTED} END AS confidence,
       CASE WHEN l_linestatus = 'F' THEN 'validated' WHEN l_quantity >= 5 THEN 'extracted' ELSE 'none' END AS source
FROM lineitem""")
def q_section_merge(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem", "l_orderkey", "l_returnflag", "l_linenumber", "l_partkey", "l_suppkey",
              "l_linestatus", "l_tax", "l_quantity")
    slots = li.select(
        F.col("l_orderkey").alias("doc_id"), F.col("l_returnflag").alias("section"),
        F.concat(F.lit("F"), F.col("l_linenumber").cast("string")).alias("field"),
        (F.col("l_quantity") >= 5).alias("has_extracted"),
        F.concat(F.lit("H"), (F.col("l_partkey") % 7).cast("string")).alias("extracted_header"),
        (F.col("l_linestatus") == "F").alias("has_validated"),
        F.when(F.col("l_tax") > 0.04, F.concat(F.lit("H"), (F.col("l_suppkey") % 7).cast("string")))
         .alias("validated_header"),
        F.when(F.col("l_tax") == 0.08, F.lit(None)).otherwise(F.lit(1) - F.col("l_tax")).alias("validated_confidence"))
    return S.section_merge(slots)


# --------------------------------------------------------------------------- D15, D16 on customer answers
SEGMENT_LABELS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY", D.NONE_LABEL]


def _answers(spark, sf_dir):
    c = read(spark, sf_dir, "customer", "c_custkey", "c_name", "c_mktsegment", "c_acctbal")
    seg, k = F.col("c_mktsegment"), F.col("c_custkey")
    bal = F.col("c_acctbal").cast("decimal(12,2)").cast("string")
    a1 = (F.when(k % 4 == 0, F.concat(F.lit("<sol>"), seg, F.lit("</sol>")))
           .when(k % 4 == 1, F.concat(F.lit("<class> "), F.lower(seg), F.lit(" </class><confidence>High</confidence>")))
           .when(k % 4 == 2, F.concat(F.lit("I think this is "), seg, F.lit(" data, reason: "), F.col("c_name")))
           .otherwise(F.concat(F.lit("<sol>none of those</sol> "), F.col("c_name"))))
    a2 = (F.when(k % 3 == 0, F.concat(F.lit("<class>"), seg, F.lit("</class><confidence>"),
                                       F.when(F.col("c_acctbal") > 5000, F.lit("High")).otherwise(F.lit("Medium")),
                                       F.lit("</confidence><reason>balance "), bal, F.lit("</reason>")))
           .when(k % 3 == 1, F.concat(F.lit("Looks like "), F.lower(seg), F.lit(" to me")))
           .otherwise(F.lit("no idea")))
    return c.select("c_custkey", a1.alias("answer"), a2.alias("validation_answer"))


_ANSWERS_SQL = """ans AS (
  SELECT c_custkey,
         CASE WHEN c_custkey % 4 = 0 THEN '<sol>' || c_mktsegment || '</sol>'
              WHEN c_custkey % 4 = 1 THEN '<class> ' || lower(c_mktsegment) || ' </class><confidence>High</confidence>'
              WHEN c_custkey % 4 = 2 THEN 'I think this is ' || c_mktsegment || ' data, reason: ' || c_name
              ELSE '<sol>none of those</sol> ' || c_name END AS answer,
         CASE WHEN c_custkey % 3 = 0 THEN '<class>' || c_mktsegment || '</class><confidence>'
                   || CASE WHEN c_acctbal > 5000 THEN 'High' ELSE 'Medium' END || '</confidence><reason>balance '
                   || CAST(CAST(c_acctbal AS DECIMAL(12,2)) AS VARCHAR) || '</reason>'
              WHEN c_custkey % 3 = 1 THEN 'Looks like ' || lower(c_mktsegment) || ' to me'
              ELSE 'no idea' END AS validation_answer
  FROM customer)"""


def _sql_tag(ans: str, pattern: str) -> str:
    return f"CASE WHEN regexp_matches({ans}, '{pattern}') THEN {Q.strip(f'regexp_extract({ans}, {chr(39)}{pattern}{chr(39)}, 1)')} END"


def _sql_first(conds):
    return "CASE " + " ".join(f"WHEN {c} THEN '{v}'" for c, v in conds) + " END"


def _sql_parse_class(ans: str, labels, validation: bool = False) -> tuple[str, str]:
    raw = _sql_tag(ans, PA.VALIDATION_CLASS_RE if validation else PA.CLASS_TAG_RE)
    exact = _sql_first([(f"lower({raw}) = '{x.lower()}'", x) for x in labels])
    contained = _sql_first([(f"instr(lower({raw}), '{x.lower()}') > 0", x) for x in labels])
    none = f"CASE WHEN instr(lower({raw}), '{D.NONE_LABEL.lower()}') > 0 THEN '{D.NONE_LABEL}' END"
    word = _sql_first([(f"regexp_matches({ans}, '(?i)\\b\\Q{x}\\E\\b')", x) for x in labels])
    tag_part = f"coalesce({exact}, {none})" if validation else f"coalesce({exact}, {contained}, {none})"
    found = f"coalesce(CASE WHEN {raw} IS NOT NULL THEN {tag_part} END, {word})"
    return found, raw


@query("parse_class", lambda: Q.with_ctes(_ANSWERS_SQL, select=f"""
SELECT c_custkey, coalesce(found, '{D.NONE_LABEL}') AS predicted_class,
       CASE WHEN found IS NOT NULL AND found <> '{D.NONE_LABEL}' THEN 'Medium' ELSE 'Low' END AS confidence
FROM (SELECT c_custkey, {_sql_parse_class('answer', SEGMENT_LABELS)[0]} AS found FROM ans)"""))
def q_parse_class(spark, sf_dir):
    a = _answers(spark, sf_dir)
    return a.select("c_custkey", PA.parse_class("answer", SEGMENT_LABELS).alias("p")).select(
        "c_custkey", "p.predicted_class", "p.confidence")


@query("parse_class_validation", lambda: Q.with_ctes(_ANSWERS_SQL, select=f"""
SELECT c_custkey, coalesce(found, '{D.NONE_LABEL}') AS predicted_class,
       CASE WHEN found IS NOT NULL THEN coalesce({_sql_tag('validation_answer', PA.CONFIDENCE_RE)}, 'Low')
            ELSE 'Low' END AS confidence,
       CASE WHEN found IS NOT NULL THEN {_sql_tag('validation_answer', PA.REASON_RE)}
            ELSE 'Failed to parse output.' END AS validation_reason
FROM (SELECT c_custkey, validation_answer,
             {_sql_parse_class('validation_answer', SEGMENT_LABELS, True)[0]} AS found FROM ans)"""))
def q_parse_class_validation(spark, sf_dir):
    a = _answers(spark, sf_dir)
    return a.select("c_custkey", PA.parse_class_validation("validation_answer", SEGMENT_LABELS).alias("p")).select(
        "c_custkey", "p.predicted_class", "p.confidence", "p.validation_reason")


# --------------------------------------------------------------------------- E2, D19, J1, J7/G12 on documents
def _doc_classes(spark, sf_dir):
    d = read(spark, sf_dir, "documents", "doc_id", "text", "source")
    docs = d.select("doc_id", F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit("_"),
                                       F.col("source")).alias("doc_name"), "text")
    scores = C.source_scores(C.tokens(docs, "doc_name"), C.tokens(docs, "text"), dims.class_terms(spark))
    return C.class_decisions(docs, scores)


_DOC_CLASS_SQL = [
    Q.dims_ctes(),
    "dn AS (SELECT doc_id, 'doc_' || CAST(doc_id AS VARCHAR) || '_' || source AS doc_name, text FROM documents)",
    Q.tokens_cte("name_toks", "dn", "doc_name"),
    Q.tokens_cte("text_toks", "dn", "text"),
    "all_toks AS (SELECT * FROM name_toks UNION ALL SELECT * FROM text_toks)",
    Q.best_label_cte("best_all", "all_toks"),
    Q.best_label_cte("best_name", "name_toks"),
    Q.best_label_cte("best_text", "text_toks"),
    Q.classify_cte("cls", "dn", "best_all"),
    Q.validate_class_cte("vc", "cls", "best_name", "best_text"),
]


@query("validate_class", Q.with_ctes(*_DOC_CLASS_SQL, select="SELECT * FROM vc"))
def q_validate_class(spark, sf_dir):
    d = _doc_classes(spark, sf_dir)
    return d.select("doc_id", F.col("predicted_class").alias("first_class"), "validated_class",
                    F.col("validation_confidence").alias("confidence"), "validation_reason")


@query("early_exit", Q.with_ctes(*_DOC_CLASS_SQL, select=f"""
SELECT doc_id, validated_class, CASE WHEN validated_class = '{D.NONE_LABEL}' THEN 'finished' ELSE 'continue' END
  AS route FROM vc"""))
def q_early_exit(spark, sf_dir):
    d = _doc_classes(spark, sf_dir)
    todo, done = C.early_exit(d)
    return (todo.select("doc_id", "validated_class", F.lit("continue").alias("route"))
                .unionByName(done.select("doc_id", "validated_class", F.lit("finished").alias("route"))))


_CFG_VALUES = ", ".join(f"('{n.replace(' ', '_')}')" for n in D.CLASS_CONFIGS)


@query("config_join", Q.with_ctes(*_DOC_CLASS_SQL, select=f"""
SELECT v.doc_id, v.validated_class AS doc_class, replace(v.validated_class, ' ', '_') AS config_name,
       CASE WHEN g.n IS NULL THEN '{S.CONFIG_NOT_FOUND}' ELSE 'OK' END AS status
FROM vc v LEFT JOIN (VALUES {_CFG_VALUES}) AS g(n) ON replace(v.validated_class, ' ', '_') = g.n
WHERE v.validated_class <> '{D.NONE_LABEL}'"""))
def q_config_join(spark, sf_dir):
    d = _doc_classes(spark, sf_dir)
    todo, _ = C.early_exit(d)
    docs = todo.select("doc_id", F.col("validated_class").alias("doc_class"))
    matched, errors = S.config_join(docs, P.configs_frame(spark))
    return (matched.select("doc_id", "doc_class", "config_name", F.lit("OK").alias("status"))
                   .unionByName(errors.join(docs, "doc_id").select(
                       "doc_id", "doc_class", S.config_name("doc_class").alias("config_name"),
                       F.col("code").alias("status"))))


@query("agreement_route", Q.with_ctes(*_DOC_CLASS_SQL, select="""
SELECT first_class AS class_a, count(*) AS n_docs,
       avg(CASE WHEN first_class = validated_class THEN 1.0 ELSE 0.0 END) AS agreement_rate,
       CAST(sum(CASE WHEN first_class = validated_class THEN 0 ELSE 1 END) AS BIGINT) AS n_human_check
FROM vc GROUP BY first_class"""))
def q_agreement_route(spark, sf_dir):
    d = _doc_classes(spark, sf_dir)
    routes = C.agreement_route(d.select("doc_id", "predicted_class"),
                               d.select("doc_id", F.col("validated_class").alias("predicted_class")))
    rate = C.agreement_rate(routes)
    hc = routes.groupBy("class_a").agg(F.sum(F.when(F.col("route") == "human check", 1).otherwise(0))
                                        .cast("bigint").alias("n_human_check"))
    return rate.join(hc, "class_a")


# --------------------------------------------------------------------------- J3 field lookup
@query("field_lookup", Q.with_ctes(Q.corpus_ctes(), f"field_defs AS {dims.sql_field_defs()}", select=f"""
SELECT r.doc_id, r.section, CASE WHEN count(f.field) > 0 THEN 'OK' ELSE '{S.MODEL_NOT_FOUND}' END AS status,
       count(f.field) AS n_fields
FROM (SELECT DISTINCT doc_id, section FROM corpus_truth
      UNION ALL SELECT doc_id, 'Context' FROM corpus_docs) r
LEFT JOIN field_defs f ON f.doc_class = 'Mutual Funds' AND f.section = r.section
GROUP BY r.doc_id, r.section"""))
def q_field_lookup(spark, sf_dir):
    """Section requests of every document (truth sections + Context) resolved against the class config."""
    from gridmap.plans import corpus as K
    orders = read(spark, sf_dir, "orders", "o_orderkey", "o_orderdate")
    truth = K.corpus_truth(orders).select("doc_id", "section").distinct()
    ctx_req = K.corpus_docs(orders).select("doc_id", F.lit("Context").alias("section"))
    # the class is a column, not a constant that would fold the join key away
    req = truth.unionByName(ctx_req).withColumn("doc_class", F.when(F.col("doc_id").isNotNull(), F.lit("Mutual Funds")))
    fields, errors = S.field_lookup(req, dims.field_defs(spark))
    ok = fields.groupBy("doc_id", "section").agg(F.count(F.lit(1)).alias("n_fields")).withColumn("status", F.lit("OK"))
    bad = errors.select("doc_id", "section", F.lit(0).cast("bigint").alias("n_fields"), F.col("code").alias("status"))
    return ok.select("doc_id", "section", "status", "n_fields").unionByName(bad.select("doc_id", "section", "status",
                                                                                        "n_fields"))
