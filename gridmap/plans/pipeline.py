"""The end-to-end field-mapping job over many documents at once.

cells --window--> lines --> class scorer --> class validation --> early exit
      --> config join --> header detection/validation/gate --> section scorer
      --> section validation --> merge --> conflict resolution --> mapping

Every stage is a DataFrame keyed by ``doc_id``.  Whole sheets are read unless
the caller gives a row window.  Rows are gathered by grid row only, header
detection is made of partial aggregations, so a long sheet is spread over many
tasks.  Failed documents are collected in an ``errors`` table instead of
failing the job.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridmap.operators import classify as C
from gridmap.operators import grid as G
from gridmap.operators import headers as H
from gridmap.operators import sections as S
from gridmap.plans import defaults as D
from gridmap.plans import dims
from gridmap.session import co_partition_by_document, cut_lineage, document_tasks, stored

ERROR_COLUMNS = ["doc_id", "stage", "code", "message", "severity"]


@dataclass
class MappingResult:
    context: DataFrame        # per document header context (passed the gate)
    classes: DataFrame        # class stage outputs per document
    finished: DataFrame       # documents stopped early ('None of those')
    errors: DataFrame         # quarantine: doc_id, stage, code, message, severity
    header_cells: DataFrame   # header text per (doc, column)
    detected: DataFrame       # header scorer output before validation
    validated_ctx: DataFrame  # header context after validation (before the gate)
    active: DataFrame         # documents with a configured class
    tasks: int                # partitions of tables with a few rows a document
    sections: Callable        # builds the section stages below, of which one is stored, once one of them is asked for

    @cached_property
    def _sections(self) -> dict:
        return self.sections()

    mapping = property(lambda self: self._sections["mapping"])          # doc_id, section, field, header (resolved), confidence, ...
    corrections = property(lambda self: self._sections["corrections"])  # section validation corrections
    candidates = property(lambda self: self._sections["candidates"])    # all fits of header cells and fields
    checked = property(lambda self: self._sections["checked"])          # section validation output, mapped fields only
    conflicting = property(lambda self: self._sections["conflicting"])  # mapped fields only, before (header_before) and after conflict resolution
    slots = property(lambda self: self._sections["slots"])              # the mapping, one row a document (S.fanned_out)
    full_width_of = property(lambda self: self._sections["full_width_of"])  # builds the section validation output for all fields from that for some

    @cached_property
    def extracted(self) -> DataFrame:
        """Section scorer output, a row for each field; built only when asked for (stage queries, debugging)."""
        return self._sections["full_width"]()

    @cached_property
    def validated(self) -> DataFrame:
        """Section validation output, a row for each field."""
        return self.full_width_of(self.checked)


def configs_frame(spark, configs=None) -> DataFrame:
    configs = configs or D.CLASS_CONFIGS
    rows = [(name.replace(" ", "_"), name) for name in configs]
    return spark.createDataFrame(rows, "config_name string, config_class string")


def map_documents(cells: DataFrame, docs: DataFrame, start_row: int = 0, end_row: int | None = None,
                  dedup: bool = True, configs=None, checkpoint: bool = True,
                  section_threshold: float | None = None, class_scorer=None, answer_store: str | None = None) -> MappingResult:
    """Run the whole mapping job.

    ``cells``: doc_id, row_idx, col_idx, value (+ num_format, is_number);
    ``docs``: doc_id, doc_name, file_type.

    ``class_scorer``: optional user callable (pandas batch of doc_id/prompt ->
    answers) used instead of the rule class scorer; its answers are parsed by
    the same ladder, and documents whose scoring failed go to ``errors``.  Whole
    sheets are scored, in windows of the prompt budget.  ``answer_store``: folder
    of answers by prompt hash; prompts answered there are not sent again.

    ``checkpoint`` (default on) cuts the lineage at seven boundaries with compressed
    Parquet in the shared checkpoint folder: the summary of each grid row, the
    per-document class decisions, header blocks, the detected headers, the
    validated header contexts, the header cells and, once the section stages are asked for, their fits.  Later stages then start
    from stored data after an executor loss and read only the columns they need,
    and the plan stays small even though several stages read the same inputs.

    Stored tables compress to a few bytes a document, by which Catalyst judges them: it would broadcast (through the driver) tables of
    millions of documents.  So the joins on doc_id are hinted (``shuffle_hash``); only configuration is broadcast.
    """
    spark = cells.sparkSession
    fd, al, terms = dims.field_defs(spark, configs), dims.aliases(spark, configs), dims.class_terms(spark)
    cut = (lambda df, name: stored(df, f"mapping-{name}")) if checkpoint else (lambda df, name: df)
    co_partition_by_document(spark)

    # 1. row window (if any) first, then one aggregation per grid row: Markdown line, header statistics and
    #    the row's cells (everything later stages need), stored as Parquet
    win = G.row_window(cells, start_row, end_row).select("doc_id", "row_idx", "col_idx", "value")
    vocab = [a for (_c, _s, _so, _f, _fo, a, _ao) in dims.alias_rows(configs)]   # configuration, not data
    rows = cut(H.row_summary(win, vocab).drop("line"), "rows")   # the line is put together from the cells again
    lines = rows.select("doc_id", F.col("row_idx").alias("line_no"), H.markdown_line("cells").alias("line"))

    # 2. class scorer + validation from one keyword aggregation, early exit, config join
    scorer_errors = None
    if class_scorer is None:
        scores = C.source_scores(C.tokens(docs, "doc_name"), C.tokens(lines, "line"), terms)
        decided = cut(C.class_decisions(docs, scores), "classes")
    else:
        decided, scorer_errors = _model_decisions(docs, lines, class_scorer, answer_store)
        decided = cut(decided, "classes")
    todo, finished = C.early_exit(decided)
    matched, cfg_errors = S.config_join(todo.select("doc_id", F.col("validated_class").alias("doc_class")),
                                        configs_frame(spark, configs))
    active = matched.select("doc_id", "doc_class")

    # 3. header detection, validation and gate.  Detection is a partial aggregation over all documents, of which the active ones are
    #    kept: a join before it would send every row of every sheet
    stats = rows.drop("cells")
    blocks = cut(H.header_blocks(rows, vocab), "blocks")
    detected = cut(H.detect_header(stats, blocks).join(active.select("doc_id"), "doc_id", "left_semi"), "detected")
    ctx = cut(H.validate_header(detected, stats, blocks), "contexts")
    passed, hdr_errors = H.header_gate(ctx)

    # 4. section scorer, validation, merge, conflict resolution
    # every later table is keyed by doc_id and bounded per document by the configuration, so one
    # hash partitioning on doc_id serves all joins and windows below (no further exchanges); tasks hold a bounded number of documents
    tasks = document_tasks(active)
    hdr_cells = cut(H.header_texts(H.possible_header_rows(rows), passed.repartition(tasks, "doc_id")), "header-cells")
    docs_ok = active.repartition(tasks, "doc_id").join(passed.select("doc_id").repartition(tasks, "doc_id").hint("shuffle_hash"), "doc_id", "left_semi")

    def sections() -> dict:
        # score, validate, merge and resolve only the fields that matched a header cell
        candidates = cut(S.match_candidates(hdr_cells, docs_ok, al), "matches")
        best = S.best_fits(candidates, tasks)
        checked, corrections = S.validate_sections(best.withColumn("confidence", F.lit(None).cast("double")), hdr_cells)
        merged_small = S.section_merge(checked.select(
            "doc_id", "doc_class", "section", "section_ord", "field", "field_ord", "col_idx",
            F.lit(True).alias("has_extracted"), "extracted_header", F.lit(True).alias("has_validated"),
            F.col("header").alias("validated_header"), F.col("validation_confidence").alias("validated_confidence")))
        resolved = (S.resolve_conflicts(merged_small) if dedup
                    else merged_small.withColumn("header_before", F.col("header")))
        # then fan out once to every field slot of the document's class (nulls kept); a slot without a match takes its section's
        # validation confidence, 1.0 when nothing in the section was mapped.  What was mapped is joined to its document before the
        # fan-out, so that the many empty slots are neither shuffled nor sorted.
        slots = S.fanned_out(docs_ok, fd, resolved, ["header"])   # one row a document, for the assembled results
        sec_conf = F.array_max(F.transform("s.in_section", lambda v: v["confidence"]))
        mapping = S.slot_rows(docs_ok, fd, resolved, ["header", "header_before", "confidence"], "s.found.header", F.coalesce("s.found.confidence", sec_conf, F.lit(1.0)).alias("confidence"),
                              F.lit("validated").alias("source"), "s.found.header_before")
        if section_threshold is not None:   # optional section gate (off by default)
            mapping = mapping.withColumn("header", F.when(F.col("confidence") >= section_threshold, F.col("header")))
        return {"mapping": mapping, "corrections": corrections, "candidates": candidates, "checked": checked, "conflicting": resolved,
                "slots": slots if section_threshold is None else None, "full_width": lambda: S.extracted_slots(best, docs_ok, fd),
                "full_width_of": lambda answers: S.validated_slots(answers, docs_ok, fd)}

    errors = cfg_errors.select(*ERROR_COLUMNS).unionByName(hdr_errors.select(*ERROR_COLUMNS))
    if scorer_errors is not None:
        errors = errors.unionByName(scorer_errors.select(*ERROR_COLUMNS))
    return MappingResult(context=passed, classes=decided, finished=finished, errors=errors, header_cells=hdr_cells, detected=detected,
                         validated_ctx=ctx, active=active, tasks=tasks, sections=sections)


def _model_decisions(docs: DataFrame, lines: DataFrame, class_scorer, store: str | None = None):
    """Class decisions from a user scorer over whole sheets: windows of lines -> prompts -> answers -> one class a document."""
    from gridmap.operators import scorer as SC
    from gridmap.session import scratch_path

    named = docs.select("doc_id", "doc_name", SC.class_budget(F.col("doc_name")).alias("budget"))
    windows = SC.line_windows(lines, named.select("doc_id", "budget"))
    windows = named.select("doc_id", "doc_name").join(windows, "doc_id", "left")  # a document without lines has one empty window
    prompts = SC.class_prompts(windows.withColumn("window", F.coalesce("window", F.lit(0))))
    answers = SC.stored_answers(prompts, class_scorer, store or scratch_path(docs.sparkSession, "answers"))
    merged = cut_lineage(SC.merge_classes(answers))
    failed = F.col("n_failed") == F.col("n_windows")
    decided = merged.select(
        "doc_id", "predicted_class", F.col("n_votes").alias("score"), "confidence", F.col("predicted_class").alias("validated_class"),
        F.col("confidence").alias("validation_confidence"),
        F.concat(F.lit("named by "), F.col("n_votes"), F.lit(" of "), F.col("n_windows"), F.lit(" windows")).alias("validation_reason"))
    errors = merged.where(failed).select(
        "doc_id", F.lit("classification").alias("stage"), F.lit("SCORER_FAILED").alias("code"),
        F.coalesce(F.col("error"), F.lit("no answer")).alias("message"), F.lit("ERROR").alias("severity"))
    return decided, errors


def final_mapping(res: MappingResult) -> DataFrame:
    """The flagship result: one row per (document, section, field), nulls kept."""
    return res.mapping.select("doc_id", "section", "field", "header", "confidence", "source")
