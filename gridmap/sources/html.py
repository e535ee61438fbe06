"""HTML tables and lists -> long cells, with regular expressions on the page text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridmap.functions.text import col_, strip

LIST_ITEM_RE = "(?s)<li(?:[ \\t\\r\\n][^>]*)?>(.*?)</li>"
ROW_RE = "(?s)<tr(?:[ \\t\\r\\n][^>]*)?>(.*?)</tr>"
CELL_RE = "(?s)<t[dh](?:[ \\t\\r\\n][^>]*)?>(.*?)</t[dh]>"
TAG_RE = "<[^>]+>"


def _text(c):
    return strip(F.regexp_replace(c, TAG_RE, ""))


def list_items(df: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """(id, item_idx, text) for every <li> element."""
    return (df.select(F.col(id_col), F.posexplode(F.regexp_extract_all(col_(html_col), F.lit(LIST_ITEM_RE), 1))
                      .alias("item_idx", "_item"))
              .select(id_col, F.col("item_idx").cast("int").alias("item_idx"), _text("_item").alias("text")))


def table_cells(df: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """(doc_id, row_idx, col_idx, value) for every <tr>/<td|th> of the page's tables."""
    rows = df.select(F.col(id_col).alias("doc_id"),
                     F.posexplode(F.regexp_extract_all(col_(html_col), F.lit(ROW_RE), 1)).alias("row_idx", "_row"))
    return rows.select("doc_id", "row_idx",
                       F.posexplode(F.regexp_extract_all("_row", F.lit(CELL_RE), 1)).alias("col_idx", "_cell")) \
               .select("doc_id", "row_idx", "col_idx", _text("_cell").alias("value"))
