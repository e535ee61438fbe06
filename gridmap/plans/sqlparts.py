"""SQL (DuckDB dialect) twins of the Spark operators, used as correctness oracles.

Each function returns a CTE body or an expression; ``with_ctes`` joins them.
The regular expressions are the same ASCII-class patterns the Spark side uses.
"""

from __future__ import annotations

from gridmap.plans import defaults as D
from gridmap.plans import dims
from gridmap.plans.corpus import sql_corpus_ctes

WS = r"[ \t\n\r\f\x0B]"


def strip(e: str) -> str:
    return f"trim({e}, ' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(11))"


def is_blank(e: str) -> str:
    return f"({e} IS NULL OR {strip(e)} = '')"


def has_digit(e: str) -> str:
    return f"regexp_matches({e}, '[0-9]')"


def is_numeric_text(e: str) -> str:
    return f"regexp_matches({strip(e)}, '^[-+]?[0-9][0-9,. ]*%?$')"


def split_lines(e: str) -> str:
    return f"string_split({strip(e)}, chr(10))"


def with_ctes(*ctes: str, select: str) -> str:
    body = ",\n".join(c.strip().rstrip(",") for c in ctes if c and c.strip())
    return f"WITH {body}\n{select}"


def text_lines_cte(name: str, src: str, id_col: str = "doc_id", text_col: str = "text") -> str:
    return f"""{name} AS (
  SELECT {id_col} AS doc_id, CAST(i - 1 AS INTEGER) AS line_no, arr[i] AS line
  FROM (SELECT {id_col}, {split_lines(text_col)} AS arr FROM {src}) s,
       LATERAL (SELECT unnest(range(1, len(arr) + 1)) AS i))"""


def rows_to_lines_cte(name: str, cells: str, value_col: str = "value") -> str:
    return f"""{name} AS (
  SELECT doc_id, row_idx AS line_no,
         '| ' || string_agg(coalesce({value_col}, ''), ' | ' ORDER BY col_idx) || ' |' AS line
  FROM {cells} GROUP BY doc_id, row_idx)"""


def fallback_header_cte(name: str, lines: str) -> str:
    rule = f"regexp_matches({strip('line')}, '^[-|+ \\t\\n\\r\\f\\x0B]+$')"
    return f"""{name}_sep AS (
  SELECT doc_id, min(CASE WHEN line_no > 0 AND {rule} THEN line_no END) AS sep, count(*) AS n_rows
  FROM {lines} GROUP BY doc_id),
{name} AS (
  SELECT s.doc_id, 0 AS header_start, CAST(coalesce(s.sep - 1, 0) AS INTEGER) AS header_end,
         CAST(coalesce(min(CASE WHEN l.line_no > coalesce(s.sep - 1, 0) AND {has_digit('l.line')}
                                THEN l.line_no END), s.sep + 1, 1) AS INTEGER) AS content_start,
         CAST(s.n_rows AS INTEGER) AS n_rows
  FROM {name}_sep s JOIN {lines} l ON l.doc_id = s.doc_id
  GROUP BY s.doc_id, s.sep, s.n_rows)"""


def tokens_cte(name: str, src: str, text_col: str, id_col: str = "doc_id") -> str:
    return f"""{name} AS (
  SELECT doc_id, token FROM (
    SELECT {id_col} AS doc_id, unnest(string_split_regex(lower({text_col}), '[^\\p{{L}}\\p{{N}}]+')) AS token
    FROM {src}) WHERE token <> '')"""


def best_label_cte(name: str, toks: str, terms: str = "class_terms") -> str:
    return f"""{name} AS (
  SELECT doc_id, label, score FROM (
    SELECT doc_id, label, score,
           row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, label_ord) AS rn
    FROM (SELECT t.doc_id, c.label, c.label_ord, CAST(sum(c.weight) AS BIGINT) AS score
          FROM {toks} t JOIN {terms} c ON t.token = c.term GROUP BY t.doc_id, c.label, c.label_ord))
  WHERE rn = 1)"""


def score_confidence(e: str) -> str:
    return f"CASE WHEN {e} >= 4 THEN 'High' WHEN {e} >= 2 THEN 'Medium' ELSE 'Low' END"


def classify_cte(name: str, docs: str, best: str) -> str:
    return f"""{name} AS (
  SELECT d.doc_id, coalesce(b.label, '{D.NONE_LABEL}') AS predicted_class,
         CAST(coalesce(b.score, 0) AS BIGINT) AS score,
         CASE WHEN b.label IS NULL THEN 'Low' ELSE {score_confidence('coalesce(b.score, 0)')} END AS confidence
  FROM {docs} d LEFT JOIN {best} b ON d.doc_id = b.doc_id)"""


def validate_class_cte(name: str, classified: str, name_best: str, content_best: str) -> str:
    a_n = "coalesce(n.label = c.predicted_class, FALSE)"
    a_c = "coalesce(b.label = c.predicted_class, FALSE)"
    return f"""{name} AS (
  SELECT c.doc_id, c.predicted_class AS first_class,
         CASE WHEN {a_n} OR {a_c} THEN c.predicted_class
              ELSE coalesce(b.label, n.label, '{D.NONE_LABEL}') END AS validated_class,
         CASE CAST({a_n} AS INTEGER) + CAST({a_c} AS INTEGER) WHEN 2 THEN 'High' WHEN 1 THEN 'Medium' ELSE 'Low' END
           AS confidence,
         'name suggests ' || coalesce(n.label, 'nothing') || '; content suggests ' || coalesce(b.label, 'nothing')
           || '.' AS validation_reason
  FROM {classified} c LEFT JOIN {name_best} n ON c.doc_id = n.doc_id LEFT JOIN {content_best} b
    ON c.doc_id = b.doc_id)"""


def words_key(e: str) -> str:
    return f"trim(regexp_replace(lower({e}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"


def spelling_key(e: str) -> str:
    return f"coalesce(nullif({words_key(e)}, ''), lower({strip(e)}))"


def row_stats_cte(name: str, cells: str) -> str:
    from gridmap.operators.headers import parts_of

    keys = sorted({r[5].strip().lower() for r in dims.alias_rows()})
    parts = ", ".join("(" + dims.sql_lit(p) + ")" for p in parts_of(keys))
    nb = f"NOT {is_blank('c.value')}"

    def count(cond: str) -> str:
        return f"CAST(sum(CASE WHEN {nb} AND {cond} THEN 1 ELSE 0 END) AS INTEGER)"

    return f"""{name}_keys AS (SELECT DISTINCT lower({strip('alias')}) AS k FROM aliases),
{name}_parts AS (SELECT * FROM (VALUES {parts}) AS t(k)),
{name} AS MATERIALIZED (
  SELECT c.doc_id, c.row_idx, {count('TRUE')} AS n_nonblank, {count('a.k IS NOT NULL')} AS n_alias,
         {count('p.k IS NOT NULL')} AS n_part, {count(is_numeric_text('c.value'))} AS n_numeric,
         CAST(max(CASE WHEN {has_digit('c.value')} THEN 1 ELSE 0 END) AS INTEGER) AS has_digit
  FROM {cells} c LEFT JOIN {name}_keys a ON lower({strip('c.value')}) = a.k LEFT JOIN {name}_parts p ON lower({strip('c.value')}) = p.k
  GROUP BY c.doc_id, c.row_idx)"""


def header_blocks_cte(name: str, cells: str, stats: str) -> str:
    """Blocks of two or three neighbouring header-like rows with the hits of their joined texts."""
    return f"""{name}_like AS MATERIALIZED (SELECT doc_id, row_idx FROM {stats} WHERE n_part > 0 AND has_digit = 0),
{name}_all AS MATERIALIZED (
  SELECT a.doc_id, a.row_idx AS s, b.row_idx AS e FROM {name}_like a JOIN {name}_like b ON b.doc_id = a.doc_id AND b.row_idx = a.row_idx + 1
  UNION ALL
  SELECT a.doc_id, a.row_idx, c.row_idx FROM {name}_like a JOIN {name}_like b ON b.doc_id = a.doc_id AND b.row_idx = a.row_idx + 1
  JOIN {name}_like c ON c.doc_id = a.doc_id AND c.row_idx = a.row_idx + 2),
{name}_texts AS (
  SELECT x.doc_id, x.s, x.e, c.col_idx, string_agg(c.value, ' ' ORDER BY c.row_idx) AS t
  FROM {name}_all x JOIN {cells} c ON c.doc_id = x.doc_id AND c.row_idx BETWEEN x.s AND x.e WHERE NOT {is_blank('c.value')}
  GROUP BY x.doc_id, x.s, x.e, c.col_idx),
{name} AS MATERIALIZED (
  SELECT doc_id, s, e, count(a.k) AS n_alias, count(*) AS n_texts FROM {name}_texts
  LEFT JOIN {stats}_keys a ON lower({strip('t')}) = a.k GROUP BY doc_id, s, e HAVING count(a.k) > 0)"""


def header_candidates_cte(name: str, stats: str, blocks: str) -> str:
    share = "CASE WHEN n_nonblank > 0 THEN (n_nonblank - n_numeric) / n_nonblank END"
    return f"""{name} AS (
  SELECT doc_id, row_idx AS s, row_idx AS e, n_alias, CASE WHEN n_alias = 0 AND n_nonblank >= 2 THEN {share} ELSE 0.0 END AS txt,
         CASE WHEN n_alias > 0 THEN n_alias / n_nonblank ELSE coalesce({share}, 0.0) END AS conf, n_numeric FROM {stats}
  UNION ALL
  SELECT doc_id, s, e, n_alias, 0.0, n_alias / n_texts, 0 FROM {blocks})"""


def detect_header_cte(name: str, stats: str, candidates: str) -> str:
    return f"""{name}_h AS (
  SELECT doc_id, s, e, conf, max(e) OVER (PARTITION BY doc_id) + 1 AS n FROM {candidates}
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n_alias DESC, txt DESC, e - s, s) = 1),
{name} AS MATERIALIZED (
  SELECT h.doc_id, CAST(h.s AS INTEGER) AS header_start, CAST(h.e AS INTEGER) AS header_end,
         CAST(coalesce(min(CASE WHEN r.row_idx > h.e AND r.has_digit = 1 THEN r.row_idx END), h.e + 1) AS INTEGER) AS content_start,
         CAST(h.n AS INTEGER) AS n_rows, CAST(h.conf AS DOUBLE) AS confidence
  FROM {name}_h h JOIN {stats} r ON r.doc_id = h.doc_id
  GROUP BY h.doc_id, h.s, h.e, h.n, h.conf)"""


def validate_header_cte(name: str, ctx: str, stats: str, candidates: str) -> str:
    from gridmap.operators.headers import REACH

    def passed(s, e, c, n, numeric, digit):
        checks = [f"{s} >= 0 AND {s} <= {e} AND {e} < {c} AND {c} <= {n}", f"coalesce({numeric}, 1) = 0", f"coalesce({digit}, 0) = 1"]
        return " + ".join(f"CASE WHEN coalesce({x}, FALSE) THEN 1 ELSE 0 END" for x in checks)

    return f"""{name}_checked AS MATERIALIZED (
  SELECT x.doc_id, x.header_start, x.header_end, x.content_start, x.n_rows,
         {passed('x.header_start', 'x.header_end', 'x.content_start', 'x.n_rows', 'hs.n_numeric', 'cs.has_digit')} AS passed
  FROM {ctx} x LEFT JOIN {stats} hs ON hs.doc_id = x.doc_id AND hs.row_idx = x.header_end
               LEFT JOIN {stats} cs ON cs.doc_id = x.doc_id AND cs.row_idx = x.content_start),
{name}_near AS (
  SELECT c.doc_id, c.s, c.e, c.n_alias, c.n_numeric, f.header_start AS anchor, f.n_rows, min(d.row_idx) AS cs
  FROM {candidates} c JOIN {name}_checked f ON f.doc_id = c.doc_id AND f.passed < 3 AND abs(c.s - f.header_start) <= {REACH}
  LEFT JOIN {stats} d ON d.doc_id = c.doc_id AND d.has_digit = 1 AND d.row_idx > c.e
                     AND d.row_idx BETWEEN f.header_start - {REACH} AND f.header_start + {2 * REACH}
  GROUP BY ALL),
{name}_better AS (
  SELECT doc_id, s, e, coalesce(cs, e + 1) AS c,
         {passed('s', 'e', 'coalesce(cs, e + 1)', 'n_rows', 'n_numeric', 'CASE WHEN cs IS NULL THEN 0 ELSE 1 END')} AS p
  FROM {name}_near QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY p DESC, n_alias DESC, abs(s - anchor), s, e) = 1),
{name} AS MATERIALIZED (
  SELECT x.doc_id, CAST(CASE WHEN b.p > x.passed THEN b.s ELSE x.header_start END AS INTEGER) AS header_start,
         CAST(CASE WHEN b.p > x.passed THEN b.e ELSE x.header_end END AS INTEGER) AS header_end,
         CAST(CASE WHEN b.p > x.passed THEN b.c ELSE x.content_start END AS INTEGER) AS content_start, x.n_rows,
         greatest(x.passed, coalesce(b.p, 0)) / 3.0 AS confidence, coalesce(b.p > x.passed, FALSE) AS moved
  FROM {name}_checked x LEFT JOIN {name}_better b ON b.doc_id = x.doc_id)"""


def flatten_headers_cte(name: str, cells: str, ctx: str) -> str:
    return f"""{name} AS MATERIALIZED (
  SELECT c.doc_id, c.col_idx, string_agg(c.value, ' ' ORDER BY c.row_idx) AS header
  FROM {cells} c JOIN {ctx} x ON c.doc_id = x.doc_id
  WHERE c.row_idx BETWEEN x.header_start AND x.header_end AND NOT {is_blank('c.value')}
  GROUP BY c.doc_id, c.col_idx)"""


def match_candidates_cte(name: str, hdr: str, docs_cls: str) -> str:
    """All fits of header cells and spellings; texts that equal no spelling are held against all of them."""
    longer = "greatest(length(key), length(akey))"
    allowed = f"CASE WHEN {longer} >= 16 THEN 3 WHEN {longer} >= 9 THEN 2 WHEN {longer} >= 5 THEN 1 ELSE 0 END"
    inside = "instr(' ' || key || ' ', ' ' || akey || ' ') > 0 OR (instr(' ' || akey || ' ', ' ' || key || ' ') > 0 AND instr(key, ' ') > 0)"
    near = f"length(key) >= 4 AND length(akey) >= 4 AND levenshtein(key, akey) <= {allowed}"
    h, a = strip("header"), strip("alias")
    return f"""{name}_al AS MATERIALIZED (SELECT *, {spelling_key('alias')} AS akey FROM aliases),
{name}_hc AS MATERIALIZED (
  SELECT h.doc_id, d.doc_class, h.col_idx, h.header, {spelling_key('h.header')} AS key
  FROM {hdr} h JOIN {docs_cls} d ON h.doc_id = d.doc_id WHERE NOT {is_blank('h.header')}),
{name}_odd AS MATERIALIZED (
  SELECT DISTINCT doc_class, key FROM {name}_hc WHERE (doc_class, key) NOT IN (SELECT (doc_class, akey) FROM {name}_al)),
{name}_sim AS MATERIALIZED (
  SELECT t.key, a.*, CASE WHEN {inside} THEN 4 ELSE 5 END AS kind,
         CASE WHEN {inside} THEN least(length(key), length(akey)) / {longer} ELSE 1 - levenshtein(key, akey) / {longer} END AS similarity
  FROM {name}_odd t JOIN {name}_al a ON a.doc_class = t.doc_class WHERE {inside} OR ({near})),
{name} AS MATERIALIZED (
  SELECT c.doc_id, c.doc_class, c.col_idx, c.header, a.section, a.section_ord, a.field, a.field_ord, a.alias, a.alias_ord,
         CASE WHEN {h} = {a} THEN 1 WHEN lower({h}) = lower({a}) THEN 2 ELSE 3 END AS kind, 1.0 AS similarity
  FROM {name}_hc c JOIN {name}_al a ON a.doc_class = c.doc_class AND a.akey = c.key
  UNION ALL
  SELECT c.doc_id, c.doc_class, c.col_idx, c.header, a.section, a.section_ord, a.field, a.field_ord, a.alias, a.alias_ord, a.kind, a.similarity
  FROM {name}_hc c JOIN {name}_sim a ON a.doc_class = c.doc_class AND a.key = c.key)"""


def extract_sections_cte(name: str, candidates: str, docs_cls: str) -> str:
    return f"""{name}_best AS (
  SELECT doc_id, section, field, col_idx, CASE WHEN kind IN (2, 3) THEN alias ELSE header END AS header, kind AS match_kind
  FROM {candidates}
  QUALIFY row_number() OVER (PARTITION BY doc_id, section, field ORDER BY kind, similarity DESC, col_idx, alias_ord) = 1),
{name} AS MATERIALIZED (
  SELECT d.doc_id, d.doc_class, f.section, f.section_ord, f.field, f.field_ord, f.field_type,
         b.header, b.col_idx, b.match_kind,
         count(b.header) OVER (PARTITION BY d.doc_id, f.section) / count(*) OVER (PARTITION BY d.doc_id, f.section)
           AS confidence
  FROM {docs_cls} d JOIN field_defs f ON f.doc_class = d.doc_class
  LEFT JOIN {name}_best b ON b.doc_id = d.doc_id AND b.section = f.section AND b.field = f.field)"""


def validate_sections_cte(name: str, mapping: str, hdr: str, candidates: str | None = None, rounds: int = 6) -> str:
    """``candidates``: fits of cells and fields, for missing and wrong answers; they are assigned in rounds of mutual best pairs."""
    c, m = strip("c.header"), strip("m.header")
    pref = f"CASE WHEN {c} = {m} THEN 0 WHEN lower({c}) = lower({m}) THEN 1 ELSE 2 END"
    ctes = [f"""{name}_j AS MATERIALIZED (
  SELECT m.*, c.header AS cell, c.col_idx AS ccol,
         CASE WHEN m.header IS NULL THEN 'none' WHEN c.header IS NULL THEN 'extra' WHEN {c} = {m} THEN 'ok'
              WHEN lower({c}) = lower({m}) THEN 'capitalization' ELSE 'formatting' END AS found
  FROM {mapping} m LEFT JOIN (SELECT * FROM {hdr} WHERE NOT {is_blank('header')}) c
    ON c.doc_id = m.doc_id AND {spelling_key('c.header')} = {spelling_key('m.header')}
  QUALIFY row_number() OVER (PARTITION BY m.doc_id, m.section, m.field ORDER BY {pref}, c.col_idx NULLS LAST) = 1)"""]
    taken = f"(SELECT CAST(NULL AS BIGINT) AS doc_id, '' AS section, '' AS field, CAST(NULL AS INTEGER) AS col_idx, '' AS cell WHERE FALSE)"
    if candidates:
        ctes.append(f"""{name}_fits AS MATERIALIZED (
  SELECT doc_id, section, field, col_idx, header AS cell, kind, similarity FROM {candidates}
  QUALIFY row_number() OVER (PARTITION BY doc_id, section, field, col_idx ORDER BY kind, similarity DESC) = 1),
{name}_fj AS MATERIALIZED (
  SELECT j.*, f.doc_id IS NOT NULL AS fit FROM {name}_j j LEFT JOIN {name}_fits f
    ON f.doc_id = j.doc_id AND f.section = j.section AND f.field = j.field AND f.col_idx = j.ccol),
{name}_r0 AS MATERIALIZED (
  SELECT f.*, row_number() OVER (PARTITION BY f.doc_id ORDER BY f.kind, f.similarity DESC, f.col_idx, j.section_ord, j.field_ord) AS rn
  FROM {name}_fits f JOIN {name}_fj j ON f.doc_id = j.doc_id AND f.section = j.section AND f.field = j.field
  WHERE (j.found IN ('none', 'extra') OR NOT j.fit)
    AND (f.doc_id, f.col_idx) NOT IN (SELECT (doc_id, ccol) FROM {name}_fj WHERE found NOT IN ('none', 'extra') AND fit))""")
        for i in range(rounds):
            ctes.append(f"""{name}_t{i} AS MATERIALIZED (
  SELECT * FROM {name}_r{i} QUALIFY rn = min(rn) OVER (PARTITION BY doc_id, section, field) AND rn = min(rn) OVER (PARTITION BY doc_id, col_idx)),
{name}_r{i + 1} AS MATERIALIZED (
  SELECT r.* FROM {name}_r{i} r WHERE NOT EXISTS (SELECT 1 FROM {name}_t{i} t WHERE t.doc_id = r.doc_id AND t.col_idx = r.col_idx)
    AND NOT EXISTS (SELECT 1 FROM {name}_t{i} t WHERE t.doc_id = r.doc_id AND t.section = r.section AND t.field = r.field))""")
        taken = "(" + " UNION ALL ".join(f"SELECT doc_id, section, field, col_idx, cell FROM {name}_t{i}" for i in range(rounds)) + ")"
    ctes.append(f"""{name}_s AS MATERIALIZED (
  SELECT j.*, t.cell AS tcell, t.col_idx AS tcol,
         CASE WHEN t.cell IS NOT NULL AND j.found = 'none' THEN 'missing' WHEN t.cell IS NOT NULL THEN 'wrong mapping' ELSE j.found END AS status
  FROM {name}_j j LEFT JOIN {taken} t ON t.doc_id = j.doc_id AND t.section = j.section AND t.field = j.field),
{name} AS MATERIALIZED (
  SELECT doc_id, doc_class, section, section_ord, field, field_ord, field_type, match_kind, confidence,
         coalesce(tcol, ccol) AS col_idx,
         CASE WHEN tcell IS NOT NULL THEN tcell WHEN status = 'extra' THEN NULL WHEN status IN ('capitalization', 'formatting') THEN cell
              ELSE header END AS header,
         header AS extracted_header, status,
         CASE WHEN count(*) FILTER (WHERE status <> 'none') OVER w = 0 THEN 1.0
              ELSE count(*) FILTER (WHERE status = 'ok') OVER w / count(*) FILTER (WHERE status <> 'none') OVER w END AS validation_confidence
  FROM {name}_s WINDOW w AS (PARTITION BY doc_id, section))""")
    return ",\n".join(ctes)


def name_similarity(f: str, h: str) -> str:
    lf, lh = f"lower({f})", f"lower({h})"
    return (f"CASE WHEN {lf} = {lh} THEN 1.0 WHEN instr({lh}, {lf}) > 0 OR instr({lf}, {lh}) > 0 THEN 0.5 "
            f"ELSE 1.0 - levenshtein({lf}, {lh}) / greatest(length({lf}), length({lh}), 1) END")


def resolve_conflicts_cte(name: str, mapping: str) -> str:
    elig = "(header IS NOT NULL AND section <> 'Context' AND field <> 'ValidationConfidence')"
    cols = "list(CASE WHEN sure THEN col_idx END) OVER s"
    return f"""{name}_sure AS (
  SELECT *, {elig} AND count(*) OVER (PARTITION BY doc_id, CASE WHEN {elig} THEN header END) = 1 AS sure FROM {mapping}),
{name}_near AS (
  SELECT *, CASE WHEN list_contains({cols}, col_idx - 1) THEN 1 ELSE 0 END + CASE WHEN list_contains({cols}, col_idx + 1) THEN 1 ELSE 0 END AS beside,
         count(*) FILTER (WHERE sure) OVER s AS settled
  FROM {name}_sure WINDOW s AS (PARTITION BY doc_id, section)),
{name} AS (
  SELECT * EXCLUDE (rn, header, sure, beside, settled), header AS header_before,
         CASE WHEN coalesce(rn, 1) = 1 THEN header END AS header
  FROM (SELECT *, CASE WHEN {elig} THEN row_number() OVER (
                     PARTITION BY doc_id, CASE WHEN {elig} THEN header END
                     ORDER BY confidence DESC NULLS LAST, {name_similarity('field', 'header')} DESC, beside DESC, settled DESC,
                              section_ord, field_ord) END AS rn
        FROM {name}_near))"""


def dims_ctes() -> str:
    return (f"field_defs AS {dims.sql_field_defs()},\naliases AS {dims.sql_aliases()},\n"
            f"class_terms AS {dims.sql_class_terms()}")


def corpus_ctes() -> str:
    return sql_corpus_ctes()


def mapping_pipeline_ctes(classes: list[str] | None = None) -> list[str]:
    """The whole mapping job as CTEs ending in ``pl_final``; ``classes``: CTEs that end in ``pl_checked`` instead of the rule scorer's."""
    configs = ", ".join(f"('{n.replace(' ', '_')}', '{n}')" for n in D.CLASS_CONFIGS)
    return [
        dims_ctes(), corpus_ctes(),
        "pl_win AS (SELECT doc_id, row_idx, col_idx, value FROM corpus_cells)",
        rows_to_lines_cte("pl_lines", "pl_win"),
        *(classes or [
            tokens_cte("pl_name_toks", "corpus_docs", "doc_name"),
            tokens_cte("pl_line_toks", "pl_lines", "line"),
            "pl_all_toks AS (SELECT * FROM pl_line_toks UNION ALL SELECT * FROM pl_name_toks)",
            best_label_cte("pl_best", "pl_all_toks"),
            classify_cte("pl_cls", "corpus_docs", "pl_best"),
            best_label_cte("pl_nbest", "pl_name_toks"),
            best_label_cte("pl_cbest", "pl_line_toks"),
            validate_class_cte("pl_checked", "pl_cls", "pl_nbest", "pl_cbest")]),
        f"pl_cfg AS (SELECT * FROM (VALUES {configs}) AS t(config_name, config_class))",
        f"pl_active AS MATERIALIZED (SELECT c.doc_id, c.validated_class AS doc_class FROM pl_checked c "
        f"JOIN pl_cfg g ON replace(c.validated_class, ' ', '_') = g.config_name "
        f"WHERE c.validated_class <> '{D.NONE_LABEL}')",
        "pl_win_a AS MATERIALIZED (SELECT * FROM pl_win WHERE doc_id IN (SELECT doc_id FROM pl_active))",
        row_stats_cte("pl_stats", "pl_win_a"),
        header_blocks_cte("pl_blocks", "pl_win_a", "pl_stats"),
        header_candidates_cte("pl_cand", "pl_stats", "pl_blocks"),
        detect_header_cte("pl_det", "pl_stats", "pl_cand"),
        validate_header_cte("pl_ctx", "pl_det", "pl_stats", "pl_cand"),
        f"pl_pass AS (SELECT * FROM pl_ctx WHERE coalesce(confidence >= {D.HEADER_CONFIDENCE_THRESHOLD}, FALSE))",
        flatten_headers_cte("pl_hdr", "pl_win_a", "pl_pass"),
        "pl_docs_ok AS (SELECT * FROM pl_active WHERE doc_id IN (SELECT doc_id FROM pl_pass))",
        match_candidates_cte("pl_fit", "pl_hdr", "pl_docs_ok"),
        extract_sections_cte("pl_ext", "pl_fit", "pl_docs_ok"),
        validate_sections_cte("pl_val", "pl_ext", "pl_hdr"),
        """pl_merged AS (
  SELECT e.doc_id, e.doc_class, e.section, e.section_ord, e.field, e.field_ord, e.field_type, v.col_idx,
         v.header AS header, coalesce(v.validation_confidence, 0.9) AS confidence, 'validated' AS source
  FROM pl_ext e JOIN pl_val v ON e.doc_id = v.doc_id AND e.section = v.section AND e.field = v.field)""",
        resolve_conflicts_cte("pl_final", "pl_merged"),
    ]


# ------------------------------------------------------------------ cell formatting twins
CUR_RE = r"\[\$([^\-\]]+)(?:\-[0-9A-F]+)?\]"


def _dec(raw: str) -> str:
    return f"TRY_CAST({raw} AS DECIMAL(38,12))"


def _fmt(dec: str, dp: str) -> str:
    return (f"CASE {dp} WHEN 0 THEN format('{{:,.0f}}', round_even({dec}, 0)) "
            f"WHEN 1 THEN format('{{:,.1f}}', round_even({dec}, 1)) "
            f"WHEN 2 THEN format('{{:,.2f}}', round_even({dec}, 2)) "
            f"ELSE format('{{:,.3f}}', round_even({dec}, 3)) END")


def currency_symbol(fmt: str) -> str:
    return f"regexp_extract({fmt}, '{CUR_RE}', 1)"


def format_currency(raw: str, fmt: str) -> str:
    num = _fmt(_dec(raw), f"CASE WHEN instr({fmt}, '.00') > 0 THEN 2 ELSE 0 END")
    return (f"CASE WHEN starts_with({fmt}, '[') THEN {currency_symbol(fmt)} || ({num}) "
            f"ELSE ({num}) || ' ' || {currency_symbol(fmt)} END")


def format_percent(raw: str, fmt: str) -> str:
    dp = f"CASE WHEN instr({fmt}, '.0%') > 0 THEN 1 WHEN instr({fmt}, '.00%') > 0 THEN 2 ELSE 0 END"
    return f"({_fmt(_dec(raw) + ' * 100', dp)}) || '%'"


def format_plain(raw: str, fmt: str) -> str:
    dp = (f"CASE WHEN instr({fmt}, '.000') > 0 THEN 3 WHEN instr({fmt}, '.00') > 0 THEN 2 "
          f"WHEN instr({raw}, '.') > 0 THEN 2 ELSE 0 END")
    return _fmt(_dec(raw), dp)


def format_cell(raw: str, fmt: str, is_number: str) -> str:
    formatted = (f"CASE WHEN length({currency_symbol(fmt)}) > 0 THEN {format_currency(raw, fmt)} "
                 f"WHEN instr({fmt}, '%') > 0 THEN {format_percent(raw, fmt)} ELSE {format_plain(raw, fmt)} END")
    return (f"CASE WHEN {raw} IS NULL THEN '' WHEN NOT coalesce({is_number}, FALSE) OR {fmt} IS NULL OR {fmt} = '' "
            f"OR {fmt} = 'General' THEN {raw} ELSE coalesce({formatted}, {raw}) END")


def fixed(x: str, dp: int) -> str:
    return f"replace(format('{{:,.{dp}f}}', round(CAST(CAST({x} AS VARCHAR) AS DECIMAL(38,12)), {dp})), ',', '')"


def clean_number(x: str) -> str:
    return (f"CASE WHEN isnan({x}) THEN 'nan' ELSE "
            f"regexp_replace(regexp_replace({fixed(x, 4)}, '0+$', ''), '\\.$', '') END")


def format_duration(s: str) -> str:
    return (f"CASE WHEN {s} < 60 THEN {fixed(s, 1)} || ' seconds' WHEN {s} < 3600 THEN {fixed(f'({s}) / 60', 1)} "
            f"|| ' minutes' ELSE {fixed(f'({s}) / 3600', 1)} || ' hours' END")


def format_duration_short(s: str) -> str:
    return (f"CASE WHEN {s} < 1 THEN {fixed(f'({s}) * 1000', 2)} || ' ms' WHEN {s} < 60 THEN {fixed(s, 2)} "
            f"|| ' seconds' ELSE CAST(CAST(floor(({s}) / 60) AS BIGINT) AS VARCHAR) || ' min ' "
            f"|| {fixed(f'({s}) - floor(({s}) / 60) * 60', 2)} || ' sec' END")
