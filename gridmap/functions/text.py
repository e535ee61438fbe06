"""Text rules as Spark Column expressions (all JVM-side, codegen friendly).

Character classes are written out in ASCII on purpose: Java and RE2 (used by
the SQL oracle) disagree on what ``\\s``/``\\d``/``\\b`` mean for non-ASCII
text, while explicit classes mean the same thing everywhere.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# whitespace removed by strip(): space, tab, LF, CR, FF, VT
WS = " \\t\\n\\r\\f\\x0B"
_STRIP_RE = f"^[{WS}]+|[{WS}]+$"
DIGIT_RE = "[0-9]"
# a line made only of pipes, dashes, plus signs and blanks (Markdown rule line)
RULE_LINE_RE = f"^[-|+{WS}]+$"
NUMERIC_RE = "^[-+]?[0-9][0-9,. ]*%?$"


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


STRIP_CHARS = " \t\n\r\f\x0b"


def strip(c) -> Column:
    """Remove leading/trailing whitespace (tab, newline, CR, FF, VT, space); plain trim, no regex."""
    return F.btrim(col_(c), F.lit(STRIP_CHARS))


def is_one_of(column: str, values) -> Column:
    """Whether a column is one of many fixed texts (one expression, where ``isin`` would make an object of each text)."""
    texts = ", ".join("'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'" for v in values)
    return F.expr(f"`{column}` IN ({texts})") if texts else F.lit(False)


def words_key(c) -> Column:
    """Lower-case words (runs of letters and digits) with one space between: the text without its formatting."""
    return F.btrim(F.regexp_replace(F.lower(col_(c)), "[^\\p{L}\\p{N}]+", " "))


def spelling_key(c) -> Column:
    """``words_key``, or the stripped lower-case text where it has neither letters nor digits."""
    return F.coalesce(F.nullif(words_key(c), F.lit("")), F.lower(strip(c)))


def split_lines(c) -> Column:
    """strip the text, then split on newline (``text.strip().split('\\n')``)."""
    return F.split(strip(c), "\n", -1)


def is_blank(c) -> Column:
    """null, or only whitespace."""
    c = col_(c)
    return c.isNull() | (strip(c) == F.lit(""))


def has_digit(c) -> Column:
    """Any ASCII digit (translate-based, no regex)."""
    c = col_(c)
    return F.length(F.translate(c, "0123456789", "")) < F.length(c)


def is_numeric_text(c) -> Column:
    return strip(c).rlike(NUMERIC_RE)


def token_estimate(c) -> Column:
    """Cheap token count: characters // 4 (the estimate used when no tokenizer is available)."""
    return F.floor(F.length(col_(c)) / F.lit(4)).cast("bigint")


def available_tokens(max_tokens: int, pct: float, base_tokens) -> Column:
    """Tokens left for content: int(max_tokens * pct) - base_tokens."""
    return F.lit(int(max_tokens * pct)) - col_(base_tokens)


def truncate_to_budget(text, base_tokens, max_tokens: int = 4000, pct: float = 0.45,
                       chars_per_token: int = 4) -> Column:
    """Keep the first ``avail * chars_per_token`` characters, '' when the budget is used up."""
    avail = available_tokens(max_tokens, pct, base_tokens)
    n = (F.greatest(F.lit(0), avail) * F.lit(chars_per_token)).cast("int")
    return F.when(avail <= 0, F.lit("")).otherwise(F.substr(col_(text), F.lit(1), n))


def render(template, **values) -> Column:
    """Fill ``{name}`` placeholders with columns/literals by plain replacement.

    Replacement (not ``str.format``) keeps literal braces elsewhere in the
    template intact.  Values are substituted left to right in keyword order.
    """
    out = col_(template) if not isinstance(template, str) else F.lit(template)
    for k, v in values.items():
        v = v if isinstance(v, Column) else F.lit(v)
        out = F.replace(out, F.lit("{" + k + "}"), F.coalesce(v.cast("string"), F.lit("")))
    return out


PLACEHOLDER_RE = "\\{[a-z_]+\\}"


def leftover_placeholder(c) -> Column:
    """First unfilled ``{name}`` placeholder, '' when none is left."""
    return F.regexp_extract(col_(c), f"({PLACEHOLDER_RE})", 1)
