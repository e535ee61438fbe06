"""Small dimension tables (configuration) as DataFrames and as SQL VALUES.

These tables are bounded by configuration size (tens to a few hundred rows),
never by data size, so they are the only ones the jobs broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridmap.plans import defaults as D

FIELD_DEFS_SCHEMA = ("doc_class string, section string, section_ord int, field string, field_ord int, "
                     "field_type string, n_aliases int")
ALIAS_SCHEMA = ("doc_class string, section string, section_ord int, field string, field_ord int, "
                "alias string, alias_ord int")
TERMS_SCHEMA = "label string, label_ord int, term string, weight int"
LABELS_SCHEMA = "label string, label_ord int"


def field_def_rows(configs=None):
    configs = configs or D.CLASS_CONFIGS
    out = []
    for cls, sections in configs.items():
        for s_ord, (section, fields) in enumerate(sections):
            for f_ord, (field, ftype, aliases) in enumerate(fields):
                out.append((cls, section, s_ord, field, f_ord, ftype, len(aliases)))
    return out


def alias_rows(configs=None):
    configs = configs or D.CLASS_CONFIGS
    out = []
    for cls, sections in configs.items():
        for s_ord, (section, fields) in enumerate(sections):
            for f_ord, (field, _t, aliases) in enumerate(fields):
                for a_ord, alias in enumerate(aliases):
                    out.append((cls, section, s_ord, field, f_ord, alias, a_ord))
    return out


def term_rows():
    out = []
    for l_ord, label in enumerate(D.CLASS_LABELS):
        for term, w in D.CLASS_TERMS.get(label, []):
            out.append((label, l_ord, term, w))
    return out


def label_rows():
    return [(label, i) for i, label in enumerate(D.CLASS_LABELS)]


def _df(spark: SparkSession, rows, schema) -> DataFrame:
    return F.broadcast(spark.createDataFrame(rows, schema))


def field_defs(spark, configs=None) -> DataFrame:
    return _df(spark, field_def_rows(configs), FIELD_DEFS_SCHEMA)


def aliases(spark, configs=None) -> DataFrame:
    return _df(spark, alias_rows(configs), ALIAS_SCHEMA)


def class_terms(spark) -> DataFrame:
    return _df(spark, term_rows(), TERMS_SCHEMA)


def class_labels(spark) -> DataFrame:
    return _df(spark, label_rows(), LABELS_SCHEMA)


# ---------------------------------------------------------------- SQL side
def sql_lit(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "TRUE" if v else "FALSE"
    if isinstance(v, (int, float)):
        return repr(v)
    return "'" + str(v).replace("'", "''") + "'"


def sql_values(rows, schema: str) -> str:
    """``(VALUES ...) AS t(cols)`` with explicit casts so types match Spark."""
    cols = [c.strip().split(" ") for c in schema.split(",")]
    names = ", ".join(c[0] for c in cols)
    typemap = {"string": "VARCHAR", "int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "boolean": "BOOLEAN"}
    body = ",\n".join("(" + ", ".join(f"CAST({sql_lit(v)} AS {typemap[c[1]]})" for v, c in zip(r, cols)) + ")"
                      for r in rows)
    return f"(SELECT * FROM (VALUES {body}) AS t({names}))"


def sql_field_defs(configs=None) -> str:
    return sql_values(field_def_rows(configs), FIELD_DEFS_SCHEMA)


def sql_aliases(configs=None) -> str:
    return sql_values(alias_rows(configs), ALIAS_SCHEMA)


def sql_class_terms() -> str:
    return sql_values(term_rows(), TERMS_SCHEMA)


def sql_class_labels() -> str:
    return sql_values(label_rows(), LABELS_SCHEMA)
