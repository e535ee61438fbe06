"""Per-document result assembly: Classification, Context and sections, nulls kept.

Each document's result is gathered from rows bounded by its configuration
(fields x sections), never by the size of the source sheet.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridmap.operators.headers import context_struct


def _gathered_sections(m: DataFrame) -> DataFrame:
    """(doc_id, sections) from mapping rows."""
    per_section = (m.groupBy("doc_id", "section", "section_ord")
                    .agg(F.array_sort(F.collect_list(F.struct("field_ord", "field", "header"))).alias("_f"))
                    .select("doc_id", "section_ord", "section",
                            F.map_from_entries(F.transform("_f", lambda x: F.struct(x["field"], x["header"])))
                            .alias("fields")))
    return (per_section.groupBy("doc_id")
                       .agg(F.array_sort(F.collect_list(F.struct("section_ord", "section", "fields")),
                                         lambda a, b: F.signum(a["section_ord"] - b["section_ord"]).cast("int"))
                            .alias("_s"))
                       .select("doc_id", F.map_from_entries(F.transform(
                           "_s", lambda x: F.struct(x["section"], x["fields"]))).alias("sections")))


def assemble(res, docs: DataFrame) -> DataFrame:
    """(doc_id, doc_class, result struct<Classification, Context, Sections map<section, map<field, header>>>)."""
    if res.slots is None:
        per_doc = _gathered_sections(res.mapping)
    else:  # the slots of a document are one row already: they are put in order, nothing is shuffled or sorted across documents
        ordered = F.array_sort(F.transform("slots", lambda s: F.struct(s["section_ord"], s["section"], s["field_ord"], s["field"],
                                                                        s["found"]["header"].alias("header"))))
        sections = F.array_distinct(F.transform("_o", lambda x: x["section"]))
        fields = lambda name: F.map_from_entries(F.transform(F.filter("_o", lambda x: x["section"] == name), lambda x: F.struct(x["field"], x["header"])))
        per_doc = res.slots.select("doc_id", ordered.alias("_o")).select("doc_id", F.map_from_entries(
            F.transform(sections, lambda name: F.struct(name, fields(name)))).alias("sections"))
    cls = res.classes.select("doc_id", F.struct(
        F.col("validated_class").alias("predicted_class"), F.col("validation_confidence").alias("confidence"),
        F.col("validation_reason").alias("validation_reason")).alias("classification"),
        F.col("validated_class").alias("doc_class"))
    ctx = context_struct(res.context, docs)
    j = cls.join(ctx.hint("shuffle_hash"), "doc_id", "left").join(per_doc.hint("shuffle_hash"), "doc_id", "left")
    return j.select("doc_id", "doc_class", F.struct(F.col("classification").alias("Classification"),
                                                    F.col("context").alias("Context"),
                                                    F.col("sections").alias("Sections")).alias("result"))


def result_json(res, docs: DataFrame) -> DataFrame:
    """(doc_id, doc_class, json): the result document as JSON text, null fields written out."""
    a = assemble(res, docs)
    return a.select("doc_id", "doc_class", F.to_json("result", {"ignoreNullFields": "false"}).alias("json"))


def write_results(results: DataFrame, path: str) -> None:
    """JSON lines partitioned by class; the document name stays a column (one file per doc is not a goal)."""
    results.write.mode("overwrite").partitionBy("doc_class").json(path)


def markdown_documents(lines: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc_id, doc_name, file_type, markdown): the windowed Markdown text of each document.

    ``lines`` must be windowed (the text of one document is then bounded).
    """
    arr = F.array_sort(F.collect_list(F.struct("line_no", "line")))
    text = lines.groupBy("doc_id").agg(F.array_join(F.transform(arr, lambda x: x["line"]), "\n").alias("markdown"))
    return docs.select("doc_id", "doc_name", "file_type").join(text, "doc_id")


def write_markdown(md: DataFrame, path: str) -> None:
    """Markdown sink: JSON lines partitioned by file type, document name kept as a column."""
    md.write.mode("overwrite").partitionBy("file_type").json(path)
