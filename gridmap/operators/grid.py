"""Grid operators over the long ``cells`` table and the ``lines`` table.

``cells``: doc_id, row_idx, col_idx, value (+ optional num_format, is_number)
``lines``: doc_id, line_no, line        (line_no is 0-based, equal to row_idx)

All operators are keyed by ``doc_id``; aggregations only gather one *row* of a
grid (bounded by its column count) or one column slice inside the row window,
never a whole document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridmap.functions import text as T
from gridmap.functions.cellformat import format_cell


def row_window(cells: DataFrame, start: int = 0, end: int | None = None) -> DataFrame:
    """Rows ``[start, end)`` of every sheet (all later rows without ``end``); placed before any wide operation."""
    keep = F.col("row_idx") >= start
    return cells.where(keep if end is None else keep & (F.col("row_idx") < end))


def display_cells(cells: DataFrame) -> DataFrame:
    """Add ``display``: the value as the sheet would show it under its number format."""
    return cells.withColumn("display", format_cell("value", "num_format", "is_number"))


def gap_filled(cells):
    """Values of an array of (col_idx, value) sorted by column, with '' for columns that have no cell."""
    n = F.element_at(cells, -1)["col_idx"] + 1
    before = lambda i: F.coalesce(F.get(cells, i - 1)["col_idx"], F.lit(-1))
    filled = lambda x, i: F.concat(F.array_repeat(F.lit(""), x["col_idx"] - before(i) - 1), F.array(x["value"]))
    return F.when(F.size(cells) == n, cells["value"]).otherwise(F.flatten(F.transform(cells, filled)))


def _ordered_join(values_col: str, order_col: str, sep: str):
    arr = F.sort_array(F.collect_list(F.struct(F.col(order_col).alias("o"), F.col(values_col).alias("v"))))  # compiled; array_sort isn't
    return F.array_join(arr["v"], sep)


def rows_to_lines(cells: DataFrame, value_col: str = "value", keys=("doc_id",)) -> DataFrame:
    """One Markdown table line per grid row: ``| a | b | c |`` (0-based line numbers); a missing cell is an empty one."""
    keys = list(keys)
    return (cells.withColumn("_v", F.coalesce(F.col(value_col), F.lit("")))
                 .groupBy(*keys, "row_idx")
                 .agg(F.sort_array(F.collect_list(F.struct("col_idx", F.col("_v").alias("value")))).alias("_c"))
                 .select(*keys, F.col("row_idx").alias("line_no"),
                         F.concat(F.lit("| "), F.array_join(gap_filled(F.col("_c")), " | "), F.lit(" |")).alias("line")))


def text_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Strip a text, split it on newlines, number the lines from 0."""
    return df.select(F.col(id_col).alias("doc_id"),
                     F.posexplode(T.split_lines(text_col)).alias("line_no", "line"))


def lines_to_text(lines: DataFrame, keys=("doc_id",)) -> DataFrame:
    """Ordered concatenation of lines (use only on windowed / focused lines)."""
    return lines.groupBy(*keys).agg(_ordered_join("line", "line_no", "\n").alias("text"))


def _small(per_doc: DataFrame) -> DataFrame:
    """The side of a join that has a few rows a document: it is hashed, so that the cells or lines on the other side stream by unsorted."""
    return per_doc.hint("shuffle_hash")


def _non_blank_keys(cells: DataFrame, keys) -> DataFrame:
    return (cells.groupBy(*keys)
                 .agg(F.max(F.when(T.is_blank("value"), 0).otherwise(1)).alias("_any"))
                 .where(F.col("_any") == 1).drop("_any"))


def drop_empty_cols(cells: DataFrame) -> DataFrame:
    """Remove columns whose every cell is blank."""
    keys = ["doc_id", "col_idx"]
    return cells.join(_small(_non_blank_keys(cells, keys)), keys, "left_semi")


def drop_empty_rows(cells: DataFrame) -> DataFrame:
    """Remove rows whose every cell is blank."""
    keys = ["doc_id", "row_idx"]
    return cells.join(_non_blank_keys(cells, keys), keys, "left_semi")


def first_row_header(cells: DataFrame) -> DataFrame:
    """Sheet -> named table: row 0 gives the column names, rows >= 1 the data."""
    names = cells.where(F.col("row_idx") == 0).select("doc_id", "col_idx", F.col("value").alias("column_name"))
    data = cells.where(F.col("row_idx") >= 1).select("doc_id", "row_idx", "col_idx", "value")
    return data.join(names, ["doc_id", "col_idx"], "left")


def flatten_headers(cells: DataFrame, ctx: DataFrame) -> DataFrame:
    """Join the non-blank header cells of each column over the header rows with ' '."""
    hdr = (cells.join(_small(ctx.select("doc_id", "header_start", "header_end")), "doc_id")
                .where(F.col("row_idx").between(F.col("header_start"), F.col("header_end"))
                       & ~T.is_blank("value")))
    return (hdr.groupBy("doc_id", "col_idx")
               .agg(_ordered_join("value", "row_idx", " ").alias("header")))


def header_slice(lines: DataFrame, ctx: DataFrame, n_content: int = 5) -> DataFrame:
    """Header lines plus up to ``n_content`` content lines."""
    j = lines.join(_small(ctx.select("doc_id", "header_start", "header_end", "content_start")), "doc_id")
    keep = (F.col("line_no").between(F.col("header_start"), F.col("header_end"))
            | ((F.col("line_no") >= F.col("content_start"))
               & (F.col("line_no") < F.col("content_start") + n_content)))
    return j.where(keep).select("doc_id", "line_no", "line")


def map_to_columns(cells: DataFrame, ctx: DataFrame, mapping: DataFrame) -> DataFrame:
    """field -> col_idx: case-insensitive, trimmed equality with the last header row; first column wins."""
    last = (cells.join(_small(ctx.select("doc_id", "header_end")), "doc_id")
                 .where(F.col("row_idx") == F.col("header_end"))
                 .select("doc_id", "col_idx", F.lower(T.strip("value")).alias("_k")))
    m = (mapping.where(F.col("header").isNotNull())
                .select("doc_id", "section", "field", F.lower(T.strip("header")).alias("_k")))
    return (m.join(_small(last), ["doc_id", "_k"])
             .groupBy("doc_id", "section", "field")
             .agg(F.min("col_idx").alias("col_idx")))


def project_mapped(cells: DataFrame, ctx: DataFrame, colmap: DataFrame) -> DataFrame:
    """The actual data: content cells of mapped columns as (doc_id, row_idx, section, field, value)."""
    content = (cells.join(_small(ctx.select("doc_id", "content_start")), "doc_id")
                    .where(F.col("row_idx") >= F.col("content_start"))
                    .select("doc_id", "row_idx", "col_idx", "value"))
    return content.join(_small(colmap), ["doc_id", "col_idx"]).select("doc_id", "row_idx", "section", "field", "value")


def format_profile(cells: DataFrame, probe_row_of_doc: DataFrame) -> DataFrame:
    """Number format of each column at a probe row; falls back to the column's most common format.

    ``probe_row_of_doc``: doc_id, probe_row.  Ties of the most common format go
    to the alphabetically first one.
    """
    per_fmt = cells.groupBy("doc_id", "col_idx", "num_format").agg(F.count(F.lit(1)).alias("_n"))
    mode = (per_fmt.groupBy("doc_id", "col_idx")
                   .agg(F.min_by(F.struct((-F.col("_n")).alias("n"), F.col("num_format").alias("f")),
                                 F.struct((-F.col("_n")).alias("n"), F.col("num_format").alias("f")))
                        .getField("f").alias("mode_format")))
    at_probe = (cells.join(_small(probe_row_of_doc), "doc_id")
                     .where(F.col("row_idx") == F.col("probe_row"))
                     .select("doc_id", "col_idx", F.col("num_format").alias("probe_format")))
    return (mode.join(at_probe, ["doc_id", "col_idx"], "left")
                .select("doc_id", "col_idx", F.coalesce("probe_format", "mode_format").alias("num_format"),
                        F.col("probe_format").isNotNull().alias("from_probe")))
