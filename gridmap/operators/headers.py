"""Header detection, validation and gating; focused content for extraction.

``ctx`` (the per-document context) has: doc_id, header_start, header_end,
content_start, n_rows, confidence.  Line / row numbers are 0-based.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridmap.functions import text as T
from gridmap.operators.grid import gap_filled
from gridmap.plans import defaults as D

LOW_CONFIDENCE = "HEADER_VALIDATION_LOW_CONFIDENCE"
NOT_DETECTED = "HEADER_NOT_DETECTED"


def fallback_header(lines: DataFrame) -> DataFrame:
    """Rule-only header detection on text lines.

    start = 0; the first line i > 0 that is a Markdown rule line gives
    end = i - 1 and content = i + 1 (defaults end 0, content 1); then the
    first line after ``end`` holding a digit becomes the content start.

    Two partial aggregations around an equi-join on doc_id (no ordered
    window), so one very long document is still spread over many tasks.
    """
    is_rule = (F.col("line_no") > 0) & T.strip("line").rlike(T.RULE_LINE_RE)
    first = lines.groupBy("doc_id").agg(F.min(F.when(is_rule, F.col("line_no"))).alias("_sep"),
                                        F.count(F.lit(1)).alias("n_rows"))
    he = F.coalesce(F.col("_sep") - 1, F.lit(0))
    # what is known of a document goes along as a key, so that its first aggregation isn't worked out (and its lines read) once more
    dig = (lines.join(first.hint("shuffle_hash"), "doc_id")
                .groupBy("doc_id", "_sep", "n_rows")
                .agg(F.min(F.when((F.col("line_no") > he) & T.has_digit("line"), F.col("line_no"))).alias("_dig")))
    return dig.select("doc_id",
                      F.lit(0).alias("header_start"),
                      F.coalesce(F.col("_sep") - 1, F.lit(0)).cast("int").alias("header_end"),
                      F.coalesce(F.col("_dig"), F.col("_sep") + 1, F.lit(1)).cast("int").alias("content_start"),
                      F.col("n_rows").cast("int").alias("n_rows"))


#: Header rows that are looked at together, and rows around a failing proposal that are searched for a better one.
MAX_HEADER_ROWS, REACH = 3, 20


def alias_keys(aliases: DataFrame) -> DataFrame:
    """Distinct normalised header spellings (lower, stripped) of the vocabulary."""
    return F.broadcast(aliases.select(F.lower(T.strip("alias")).alias("_k")).distinct())


def parts_of(spellings) -> list[str]:
    """All runs of consecutive words of normalised spellings, whole spellings included."""
    out = set()
    for spelling in spellings:
        words = spelling.split(" ")
        out |= {" ".join(words[i:j]) for i in range(len(words)) for j in range(i + 1, len(words) + 1)}
    return sorted(out)


def _alias_parts(aliases: DataFrame) -> DataFrame:
    words = F.split(F.lower(T.strip("alias")), " ")
    ends = lambda i: F.transform(F.sequence(i, F.size("w")), lambda j: F.array_join(F.slice("w", i, j - i + 1), " "))
    runs = F.flatten(F.transform(F.sequence(F.lit(1), F.size("w")), ends))
    return F.broadcast(aliases.select(words.alias("w")).select(F.explode(runs).alias("_k")).distinct())


def _row_counts():
    """Aggregates of one grid row over its cells; ``_hit`` and ``_part``: the cell is a spelling, or a run of words of one."""
    nb = ~T.is_blank("value")

    def count(condition):
        return F.sum(F.when(nb & condition, 1).otherwise(0)).cast("int")

    return [count(F.lit(True)).alias("n_nonblank"), count(F.col("_hit").isNotNull()).alias("n_alias"),
            count(F.col("_part").isNotNull()).alias("n_part"), count(T.is_numeric_text("value")).alias("n_numeric"),
            F.max(F.when(T.has_digit("value"), 1).otherwise(0)).cast("int").alias("has_digit")]


def _marked(cells: DataFrame, aliases) -> DataFrame:
    """Cells with ``_hit`` and ``_part``; the vocabulary is a DataFrame (broadcast joins) or a list of spellings (in-set tests)."""
    key = F.lower(T.strip("value"))
    if isinstance(aliases, (list, tuple, set, frozenset)):
        keys = sorted({str(a).strip(T.STRIP_CHARS).lower() for a in aliases})
        return cells.withColumn("_k", key).withColumns({"_hit": F.when(T.is_one_of("_k", keys), 1), "_part": F.when(T.is_one_of("_k", parts_of(keys)), 1)})
    c = cells.withColumn("_k", key)
    c = c.join(alias_keys(aliases).withColumn("_hit", F.lit(1)), "_k", "left")
    return c.join(_alias_parts(aliases).withColumn("_part", F.lit(1)), "_k", "left")


def row_stats(cells: DataFrame, aliases) -> DataFrame:
    """Per grid row: non-blank cells, vocabulary hits, parts of spellings, numeric cells, any digit."""
    return _marked(cells, aliases).groupBy("doc_id", "row_idx").agg(*_row_counts())


def header_blocks(rows: DataFrame, aliases) -> DataFrame:
    """Blocks of two or three consecutive rows that may be one header: doc_id, header_start, header_end, n_alias, n_texts.

    ``rows`` is what ``row_summary`` returns.  A row counts as header-like when it has a spelling or a run of words of one, and no
    digit.  In a block the texts of each column are read from top to bottom; ``n_alias`` of its ``n_texts`` joined texts are
    spellings.  Only header-like rows move, each once: a window over those of a document shows every one the rows right below it.
    """
    like = rows.where((F.col("n_part") > 0) & (F.col("has_digit") == 0)).select("doc_id", F.col("row_idx").alias("s"), "cells")
    order = Window.partitionBy("doc_id").orderBy("s")
    below = like.select("*", *[x for j in range(1, MAX_HEADER_ROWS) for x in (F.lead("s", j).over(order).alias(f"_s{j}"), F.lead("cells", j).over(order).alias(f"_c{j}"))])
    follows = [F.col(f"_s{j}") == F.col("s") + j for j in range(1, MAX_HEADER_ROWS)]
    row_cells = lambda cells, j: F.transform(cells, lambda c: F.struct(F.lit(j).alias("j"), c["col_idx"].alias("col_idx"), c["value"].alias("value")))
    none = F.slice(row_cells(F.col("cells"), 0), 1, 0)
    placed = F.concat(row_cells(F.col("cells"), 0), *[F.when(f, row_cells(F.col(f"_c{j}"), j)).otherwise(none) for j, f in enumerate(follows, 1)])
    cells = (below.where(follows[0]).select("doc_id", "s", F.explode(placed).alias("c"))
             .select("doc_id", "s", "c.j", "c.col_idx", "c.value").where(~T.is_blank("value")))
    parts = [F.max(F.when(F.col("j") == j, F.col("value"))).alias(f"t{j}") for j in range(MAX_HEADER_ROWS)]
    columns = cells.groupBy("doc_id", "s", "col_idx").agg(*parts)  # partitioned by doc_id since the window
    texts = [F.concat_ws(" ", *[f"t{j}" for j in range(n)]) for n in range(2, MAX_HEADER_ROWS + 1)]
    if isinstance(aliases, (list, tuple, set, frozenset)):
        keys = sorted({str(a).strip(T.STRIP_CHARS).lower() for a in aliases})
        columns = columns.withColumns({f"_k{n}": F.lower(T.strip(t)) for n, t in enumerate(texts)})
        hits = [T.is_one_of(f"_k{n}", keys) for n in range(len(texts))]
    else:
        for n, t in enumerate(texts):
            columns = columns.withColumn("_k", F.lower(T.strip(t))).join(alias_keys(aliases).withColumn(f"_h{n}", F.lit(1)), "_k", "left").drop("_k")
        hits = [F.col(f"_h{n}").isNotNull() for n in range(len(texts))]
    count = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("int")
    blocks = columns.groupBy("doc_id", "s").agg(*[F.max(F.col(f"t{j}").isNotNull()).alias(f"p{j}") for j in range(MAX_HEADER_ROWS)],
                                                *[count(h).alias(f"a{n}") for n, h in enumerate(hits)],
                                                *[count(t != "").alias(f"n{n}") for n, t in enumerate(texts)])
    found = []
    for n in range(len(texts)):
        whole = F.col("p0")
        for j in range(1, n + 2):
            whole = whole & F.col(f"p{j}")
        found.append(F.when(whole, F.struct((F.col("s") + n + 1).alias("header_end"), F.col(f"a{n}").alias("n_alias"), F.col(f"n{n}").alias("n_texts"))))
    return (blocks.select("doc_id", F.col("s").alias("header_start"), F.explode(F.array(*found)).alias("b"))
            .where("b is not null").select("doc_id", "header_start", "b.*").where("n_alias > 0"))


def header_candidates(stats: DataFrame, blocks: DataFrame | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Every row, and every block of ``header_blocks``, as a header: doc_id, start, end, n_alias, text (share of cells that are
    not numbers, for rows of two cells at least without any hit), conf, n_numeric; ``keep``: further columns of a row (null for a block)."""
    share = F.when(F.col("n_nonblank") > 0, (F.col("n_nonblank") - F.col("n_numeric")) / F.col("n_nonblank"))
    text = F.when((F.col("n_alias") == 0) & (F.col("n_nonblank") >= 2), share).otherwise(F.lit(0.0))
    conf = F.when(F.col("n_alias") > 0, F.col("n_alias") / F.col("n_nonblank")).otherwise(F.coalesce(share, F.lit(0.0)))
    rows = stats.select("doc_id", F.col("row_idx").alias("start"), F.col("row_idx").alias("end"), "n_alias", text.alias("text"),
                        conf.alias("conf"), "n_numeric", *[F.col(c) for c in keep])
    if blocks is None:
        return rows
    return rows.unionByName(blocks.select("doc_id", F.col("header_start").alias("start"), F.col("header_end").alias("end"), "n_alias",
                                          F.lit(0.0).alias("text"), (F.col("n_alias") / F.col("n_texts")).alias("conf"), F.lit(0).alias("n_numeric"),
                                          *[F.lit(None).cast("int").alias(c) for c in keep]))


def detect_header(stats: DataFrame, blocks: DataFrame | None = None) -> DataFrame:
    """Deterministic header scorer over the rows of a sheet, and over blocks of rows where ``blocks`` are given.

    The header is the row or block with most vocabulary hits (on ties the one with fewest rows, then the earliest); without any hit,
    the row (with >= 2 cells) with the largest share of non-numeric cells; else the first row.  Content starts at the first later
    row holding a digit (else the next row).  Confidence is the vocabulary share (or text share) of what was chosen.

    Partial aggregations only, so a sheet of any length is spread over many
    tasks.  ``header_numeric`` (numeric cells of the header) and
    ``content_digit`` (whether the content row has a digit) save
    ``validate_header`` from reading the rows again.
    """
    key = F.struct("n_alias", "text", (F.col("start") - F.col("end")).alias("l"), (-F.col("start")).alias("s"), "conf", F.col("n_numeric").alias("num"))
    best = header_candidates(stats, blocks).groupBy("doc_id").agg(F.max(key).alias("b"), (F.max("end") + 1).cast("int").alias("n_rows"))
    best = best.select("doc_id", (-F.col("b.s")).cast("int").alias("_h"), (-F.col("b.s") - F.col("b.l")).cast("int").alias("_e"), "n_rows",
                       F.col("b.conf").cast("double").alias("confidence"), F.col("b.num").alias("header_numeric"))
    digits = stats.where(F.col("has_digit") == 1).select("doc_id", "row_idx")
    content = (digits.join(best.select("doc_id", "_e"), "doc_id").where(F.col("row_idx") > F.col("_e"))
                     .groupBy("doc_id").agg(F.min("row_idx").cast("int").alias("_cs")))
    return (best.join(content, "doc_id", "left")
                .select("doc_id", F.col("_h").alias("header_start"), F.col("_e").alias("header_end"),
                        F.coalesce(F.col("_cs"), F.col("_e") + 1).cast("int").alias("content_start"), "n_rows", "confidence",
                        "header_numeric", F.when(F.col("_cs").isNotNull(), 1).otherwise(0).alias("content_digit")))


def _passed(start, end, content, n_rows, numeric, digit):
    """How many of the three checks a header passes: lines in order, no numeric cell in it, a digit in the first content row."""
    checks = [(start >= 0) & (start <= end) & (end < content) & (content <= n_rows), F.coalesce(numeric, F.lit(1)) == 0,
              F.coalesce(digit, F.lit(0)) == 1]
    return sum((F.when(F.coalesce(c, F.lit(False)), 1).otherwise(0) for c in checks), F.lit(0))


def validate_header(ctx: DataFrame, stats: DataFrame, blocks: DataFrame | None = None, reach: int | None = REACH) -> DataFrame:
    """Check a proposed context and mend it; confidence = share of checks passed.

    Checks: 0 <= start <= end < content <= n_rows; no numeric cell in the header's last row; the content row holds a digit.

    A proposal that fails a check is held against every row and block that starts at most ``reach`` rows from its start, with
    the first row with a digit within 2 * ``reach`` rows as content.  The one that passes most checks, then has most vocabulary
    hits, then is nearest, replaces it if it passes more checks than the proposal.  ``reach`` None: no search.  ``moved`` tells
    whether the context was replaced.  Only rows around failing proposals are read again, a bounded number a document.
    """
    if {"header_numeric", "content_digit"} <= set(ctx.columns):
        j = ctx.withColumns({"_hnum": F.col("header_numeric"), "_cdig": F.col("content_digit")})
    else:
        hs = stats.select("doc_id", F.col("row_idx").alias("header_end"), F.col("n_numeric").alias("_hnum"))
        cs = stats.select("doc_id", F.col("row_idx").alias("content_start"), F.col("has_digit").alias("_cdig"))
        j = ctx.join(hs, ["doc_id", "header_end"], "left").join(cs, ["doc_id", "content_start"], "left")
    lines = ["header_start", "header_end", "content_start"]
    checked = j.select("doc_id", *lines, "n_rows", _passed(*map(F.col, lines), F.col("n_rows"), F.col("_hnum"), F.col("_cdig")).alias("passed"))
    if reach is None:
        return checked.select("doc_id", *lines, "n_rows", (F.col("passed") / F.lit(3.0)).alias("confidence"), F.lit(False).alias("moved"))
    failing = checked.where("passed < 3").select("doc_id", F.coalesce("header_start", F.lit(0)).alias("at"), F.col("n_rows").alias("rows"))
    around = (header_candidates(stats, blocks, keep=("has_digit",)).join(failing.hint("shuffle_hash"), "doc_id")
              .where((F.col("start") >= F.col("at") - reach) & (F.col("start") <= F.col("at") + 2 * reach)))
    digits = F.collect_list(F.when(F.col("has_digit") == 1, F.col("start"))).over(Window.partitionBy("doc_id"))  # at most 3 * reach + 1 rows
    near = around.withColumn("digits", digits).where(F.abs(F.col("start") - F.col("at")) <= reach)
    near = near.withColumn("cs", F.array_min(F.filter("digits", lambda r: r > F.col("end"))))
    content = F.coalesce("cs", F.col("end") + 1)
    passed = _passed(F.col("start"), F.col("end"), content, F.col("rows"), F.col("n_numeric"), F.col("cs").isNotNull().cast("int"))
    rank = F.struct(passed.alias("p"), F.col("n_alias").alias("a"), (-F.abs(F.col("start") - F.col("at"))).alias("d"),
                    (-F.col("start")).alias("s"), (-F.col("end")).alias("e"), content.cast("int").alias("c"))
    better = near.groupBy("doc_id").agg(F.max(rank).alias("b"))
    out = checked.join(better, "doc_id", "left").withColumn("moved", F.coalesce(F.col("b.p") > F.col("passed"), F.lit(False)))
    pick = lambda new, old: F.when(F.col("moved"), new).otherwise(F.col(old)).cast("int").alias(old)
    return out.select("doc_id", pick(-F.col("b.s"), "header_start"), pick(-F.col("b.e"), "header_end"), pick(F.col("b.c"), "content_start"), "n_rows",
                      (F.when(F.col("moved"), F.col("b.p")).otherwise(F.col("passed")) / F.lit(3.0)).alias("confidence"), "moved")


def header_gate(ctx: DataFrame, threshold: float = D.HEADER_CONFIDENCE_THRESHOLD):
    """Split contexts into (passed, errors).  Missing or null confidence fails."""
    ok = F.coalesce(F.col("confidence") >= threshold, F.lit(False))
    passed = ctx.where(ok)
    errors = ctx.where(~ok).select(
        "doc_id", F.lit("header").alias("stage"),
        F.when(F.col("confidence").isNull(), F.lit(NOT_DETECTED)).otherwise(F.lit(LOW_CONFIDENCE)).alias("code"),
        F.concat(F.lit("header confidence "), F.coalesce(F.col("confidence").cast("string"), F.lit("missing")),
                 F.lit(" below "), F.lit(str(threshold))).alias("message"),
        F.lit("ERROR").alias("severity"))
    return passed, errors


def focus_bounds(ctx: DataFrame, n_content: int = D.FOCUS_CONTENT_ROWS) -> DataFrame:
    """[lo, hi) line range shown to the section scorer; 0 counts as 'missing' for the content start."""
    he = F.coalesce(F.col("header_end"), F.lit(0))
    cs = F.coalesce(F.nullif(F.col("content_start"), F.lit(0)), he + 1)
    return ctx.select("doc_id", F.coalesce(F.col("header_start"), F.lit(0)).alias("lo"),
                      (cs + n_content).alias("hi"))


def focus_content(lines: DataFrame, ctx: DataFrame, n_content: int = D.FOCUS_CONTENT_ROWS) -> DataFrame:
    """Header lines plus at most ``n_content`` content lines, as one ordered text per document."""
    b = focus_bounds(ctx, n_content)
    sel = (lines.join(b.hint("shuffle_hash"), "doc_id")
                .where((F.col("line_no") >= F.col("lo")) & (F.col("line_no") < F.col("hi"))))
    arr = F.sort_array(F.collect_list(F.struct("line_no", "line")))
    return sel.groupBy("doc_id").agg(F.array_join(arr["line"], "\n").alias("focus"),
                                     F.count(F.lit(1)).alias("n_focus_lines"))


def context_struct(ctx: DataFrame, docs: DataFrame) -> DataFrame:
    """The per-document Context record as a struct column."""
    j = docs.select("doc_id", "doc_name", "file_type").join(ctx.hint("shuffle_hash"), "doc_id")
    return j.select("doc_id", F.struct(
        F.col("confidence").cast("double").alias("ValidationConfidence"),
        F.col("doc_name").alias("FileName"),
        F.col("header_start").alias("HeaderStartLine"),
        F.col("header_end").alias("HeaderEndLine"),
        F.col("content_start").alias("ContentStartLine"),
        F.col("file_type").alias("FileType"),
        F.lit(None).cast("double").alias("ProcessingTimeSeconds")).alias("context"))


def row_summary(cells: DataFrame, aliases) -> DataFrame:
    """One row per grid row with everything later stages need, from a single aggregation.

    ``aliases``: the vocabulary as a DataFrame (column ``alias``; broadcast joins) or as a list of
    spellings (in-set tests).

    (doc_id, row_idx, cells array<struct<col_idx, value>>, line, n_nonblank, n_alias, n_part, n_numeric,
    has_digit).  The vocabulary is a broadcast hash join before the aggregation, so the cells are
    shuffled once; each group is one grid row (bounded by its column count).
    """
    arr = F.sort_array(F.collect_list(F.struct(F.col("col_idx"), F.coalesce(F.col("value"), F.lit("")).alias("value"))))
    out = _marked(cells, aliases).groupBy("doc_id", "row_idx").agg(arr.alias("cells"), *_row_counts())
    return out.withColumn("line", markdown_line("cells"))


def markdown_line(cells_col: str) -> F.Column:
    """The Markdown line of a row's cells as ``row_summary`` gathers them."""
    return F.concat(F.lit("| "), F.array_join(gap_filled(F.col(cells_col)), " | "), F.lit(" |"))


def possible_header_rows(rows: DataFrame, threshold: float = D.HEADER_CONFIDENCE_THRESHOLD) -> DataFrame:
    """The rows that can have a text of a header which passed ``header_gate``; most content rows can't, so they need not be sent.

    Blank rows have no texts.  Where the gate lets only those through that pass all three checks of ``validate_header``, no row of
    a header has a numeric cell: a single row by the check itself, the rows of a block because they have no digit.
    """
    some = F.col("n_nonblank") > 0
    return rows.where(some & (F.col("n_numeric") == 0) if threshold > 2 / 3 else some)


def header_texts(rows: DataFrame, ctx: DataFrame) -> DataFrame:
    """(doc_id, col_idx, header): non-blank cells of the header rows joined with ' ' per column."""
    h = (rows.join(ctx.select("doc_id", "header_start", "header_end").hint("shuffle_hash"), "doc_id")
             .where(F.col("row_idx").between(F.col("header_start"), F.col("header_end")))
             .select("doc_id", "row_idx", F.explode("cells").alias("c"))
             .select("doc_id", "row_idx", F.col("c.col_idx").alias("col_idx"), F.col("c.value").alias("value"))
             .where(~T.is_blank("value")))
    arr = F.sort_array(F.collect_list(F.struct("row_idx", "value")))
    return h.groupBy("doc_id", "col_idx").agg(F.array_join(arr["value"], " ").alias("header"))
