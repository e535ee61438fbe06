"""Delimited text: delimiter vote / sniffing, encoding choice, grid split.

All rules are column expressions over one document row (no Python per row).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridmap.functions.text import col_

VOTE_LINES = 5
# Delimiter candidates in preference order, and their names.
CANDIDATES = [",", ";", "|", "\t"]
CANDIDATE_NAMES = ["comma", "semicolon", "pipe", "tab"]
NAME_TO_DELIM = dict(zip(CANDIDATE_NAMES, CANDIDATES))


def _count(s, ch: str):
    return F.length(s) - F.length(F.replace(s, F.lit(ch), F.lit("")))


def delimiter_vote(df: DataFrame, text_col: str = "text", n_lines: int = VOTE_LINES) -> DataFrame:
    """Comma / semicolon vote over the first ``n_lines`` lines.

    More commas -> ',', more semicolons -> ';', a tie with some -> 'Undetermined',
    none -> 'No delimiters found in the first N lines.'
    """
    t = col_(text_col)
    head = F.array_join(F.slice(F.split(t, "\n", -1), 1, n_lines), "\n")
    n = F.when(t == "", F.lit(0)).otherwise(
        F.least(F.lit(n_lines), F.size(F.split(F.regexp_replace(t, "\n\\z", ""), "\n", -1))))
    x = df.select("doc_id", _count(head, ",").cast("bigint").alias("n_comma"),
                  _count(head, ";").cast("bigint").alias("n_semicolon"), n.alias("_n"))
    verdict = (F.when(F.col("n_comma") > F.col("n_semicolon"), F.lit(","))
                .when(F.col("n_semicolon") > F.col("n_comma"), F.lit(";"))
                .when((F.col("n_comma") > 0) | (F.col("n_semicolon") > 0), F.lit("Undetermined"))
                .otherwise(F.concat(F.lit("No delimiters found in the first "), F.col("_n").cast("string"),
                                    F.lit(" lines."))))
    return x.select("doc_id", "n_comma", "n_semicolon", verdict.alias("delimiter"))


def sniff_delimiter(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Delimiter that occurs the same number of times on every line that has it,
    and on at least half of the non-empty lines (title or note lines without
    delimiters do not disqualify it).

    Among such candidates the highest per-line count wins, then preference
    order; with none, 'comma'.  Every line of the text is examined.
    """
    ls = F.filter(F.split(col_(text_col), "\n", -1), lambda x: F.length(x) > 0)
    oks, mins = [], []
    def counter(ch):
        return lambda x: _count(x, ch)

    for c in CANDIDATES:
        pos = F.filter(F.transform(ls, counter(c)), lambda x: x > 0)
        mn, mx = F.array_min(pos), F.array_max(pos)
        oks.append(F.coalesce((mn == mx) & (F.size(pos) * 2 >= F.size(ls)), F.lit(False)))
        mins.append(mn)
    best = F.greatest(*[F.when(ok, mn).otherwise(F.lit(0)) for ok, mn in zip(oks, mins)])
    pick = F.lit("comma")
    for ok, mn, name in reversed(list(zip(oks, mins, CANDIDATE_NAMES))):
        pick = F.when(ok & (mn == best), F.lit(name)).otherwise(pick)
    return df.select("doc_id", pick.alias("delimiter"))


# ---------------------------------------------------------------- encodings
# Byte-order marks checked in this order.
BOMS = [("EFBBBF", "UTF-8"), ("FFFE0000", "UTF-32LE"), ("0000FEFF", "UTF-32BE"),
        ("FFFE", "UTF-16LE"), ("FEFF", "UTF-16BE")]


def encoding_choice(content) -> F.Column:
    """Charset of raw bytes: a byte-order mark wins; else valid UTF-8; else ISO-8859-1."""
    h = F.hex(F.substring(col_(content), 1, 4))
    out = F.when(F.is_valid_utf8(col_(content).cast("string")), F.lit("UTF-8")).otherwise(F.lit("ISO-8859-1"))
    for bom, cs in reversed(BOMS):
        out = F.when(F.startswith(h, F.lit(bom)), F.lit(cs)).otherwise(out)
    return out


def bom_length(content) -> F.Column:
    h = F.hex(F.substring(col_(content), 1, 4))
    out = F.lit(0)
    for bom, _ in reversed(BOMS):
        out = F.when(F.startswith(h, F.lit(bom)), F.lit(len(bom) // 2)).otherwise(out)
    return out


def decode_bytes(content, charset) -> F.Column:
    """Text of raw bytes in ``charset`` after dropping a byte-order mark."""
    c, cs = col_(content), col_(charset)
    body = F.substr(c, (bom_length(c) + 1).cast("int"))
    # Spark reads UTF-32 in big-endian order: turn every four bytes around
    turned = F.unhex(F.regexp_replace(F.hex(body), "(..)(..)(..)(..)", "$4$3$2$1"))
    out = F.lit(None).cast("string")
    for name, spark_cs, data in [("UTF-8", "UTF-8", body), ("UTF-16LE", "UTF-16LE", body), ("UTF-16BE", "UTF-16BE", body),
                                 ("UTF-32BE", "UTF-32", body), ("UTF-32LE", "UTF-32", turned), ("ISO-8859-1", "ISO-8859-1", body)]:
        out = F.when(cs == name, F.decode(data, spark_cs)).otherwise(out)
    return out


# Characters that stand for a delimiter and a line break inside quotes while a text is cut.
_HELD = "\x01\x02"


def hold_quoted(text, delim: str) -> F.Column:
    """``text`` with delimiters and line breaks inside double quotes replaced by characters that do not cut.

    The text is cut at every quote and the odd pieces are the quoted ones, so the work is linear however many
    quotes there are.  A text with an odd number of quotes has a stray one: its quotes are ordinary characters.
    """
    t = col_(text)
    pieces = F.split(t, '"', -1)
    held = F.transform(pieces, lambda x, i: F.when(i % 2 == 1, F.translate(x, delim + "\n", _HELD)).otherwise(x))
    return F.when(F.size(pieces) % 2 == 1, F.array_join(held, '"')).otherwise(t)


def split_record(line, delim: str) -> F.Column:
    """Split one record (from ``hold_quoted``) into fields.

    Leading blanks of a field are skipped and surrounding quotes removed (doubled quotes inside become one).
    """
    def field(x):
        x = F.ltrim(x)
        quoted = (F.length(x) >= 2) & F.startswith(x, F.lit('"')) & F.endswith(x, F.lit('"'))
        x = F.when(quoted, F.substr(x, F.lit(2), F.length(x) - 2)).otherwise(x)
        return F.replace(F.translate(x, _HELD, delim + "\n"), F.lit('""'), F.lit('"'))

    return F.transform(F.split(col_(line), "\\t" if delim == "\t" else "\\" + delim, -1), field)


def csv_grid(docs: DataFrame, text_col: str = "text", delim_col: str = "delimiter") -> DataFrame:
    """Delimited text -> long cells (doc_id, row_idx, col_idx, value), no header inference.

    Line breaks inside quotes stay in their cell.  Blank lines are kept as rows with one empty cell; ragged rows are
    kept (``n_cells`` tells the width of each row).  A null text has no cells.
    """
    text = F.regexp_replace(col_(text_col), "\r\n", "\n")
    held, split = F.lit(None).cast("string"), F.lit(None).cast("array<string>")
    for name, ch in NAME_TO_DELIM.items():
        held = F.when(F.col("_d") == name, hold_quoted(F.col("_t"), ch)).otherwise(held)
        split = F.when(F.col("_d") == name, split_record("_line", ch)).otherwise(split)
    lines = (docs.select("doc_id", F.col(delim_col).alias("_d"), text.alias("_t"))
                 .select("doc_id", "_d", F.posexplode(F.split(held, "\n", -1)).alias("row_idx", "_line")))
    rows = lines.select("doc_id", "row_idx", split.alias("_cells"))
    return rows.select("doc_id", "row_idx", F.size("_cells").alias("n_cells"),
                       F.posexplode("_cells").alias("col_idx", "value"))
