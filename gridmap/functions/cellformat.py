"""Display formatting of cell values as Spark Column expressions.

Numbers are formatted through DECIMAL, built from the shortest decimal text
of the value (``cast(value AS STRING)``), so ``2.675`` is the decimal 2.675 and
not its binary neighbour.  Thousands separators come from ``format_number``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridmap.functions.text import col_

# The currency pattern inside a number format, e.g. "[$€-407]"
# or "[$USD]"; group 1 is the symbol.
CURRENCY_FMT_RE = r"\[\$([^\-\]]+)(?:\-[0-9A-F]+)?\]"

_DEC = "decimal(38,12)"


def _dec(raw: Column) -> Column:
    return raw.try_cast(_DEC)


def _fmt(dec: Column, dp: Column) -> Column:
    """'{:,.{dp}f}' of a decimal, half-even, for dp in 0..3."""
    return (F.when(dp == 0, F.format_number(F.bround(dec, 0), 0))
             .when(dp == 1, F.format_number(F.bround(dec, 1), 1))
             .when(dp == 2, F.format_number(F.bround(dec, 2), 2))
             .otherwise(F.format_number(F.bround(dec, 3), 3)))


def currency_symbol(fmt) -> Column:
    return F.regexp_extract(col_(fmt), CURRENCY_FMT_RE, 1)


def format_currency(raw, fmt) -> Column:
    """Currency number format: symbol before the number when the format starts with '['."""
    raw, fmt = col_(raw), col_(fmt)
    sym = currency_symbol(fmt)
    dp = F.when(F.instr(fmt, ".00") > 0, F.lit(2)).otherwise(F.lit(0))
    num = _fmt(_dec(raw), dp)
    return F.when(F.startswith(fmt, F.lit("[")), F.concat(sym, num)).otherwise(F.concat(num, F.lit(" "), sym))


def format_percent(raw, fmt) -> Column:
    raw, fmt = col_(raw), col_(fmt)
    dp = (F.when(F.instr(fmt, ".0%") > 0, F.lit(1))
           .when(F.instr(fmt, ".00%") > 0, F.lit(2)).otherwise(F.lit(0)))
    return F.concat(_fmt(_dec(raw) * F.lit(100), dp), F.lit("%"))


def format_plain(raw, fmt) -> Column:
    raw, fmt = col_(raw), col_(fmt)
    dp = (F.when(F.instr(fmt, ".000") > 0, F.lit(3))
           .when(F.instr(fmt, ".00") > 0, F.lit(2))
           .when(F.instr(raw, ".") > 0, F.lit(2)).otherwise(F.lit(0)))
    return _fmt(_dec(raw), dp)


def format_cell(raw, fmt, is_number) -> Column:
    """Display text of a cell from its raw text, number format and numeric flag.

    null -> ''; text cells, empty format and 'General' keep the raw text;
    otherwise currency, then percent, then plain number rules.  A value that
    cannot be read as a number keeps its raw text.
    """
    raw, fmt, is_number = col_(raw), col_(fmt), col_(is_number)
    has_cur = F.length(currency_symbol(fmt)) > 0
    formatted = (F.when(has_cur, format_currency(raw, fmt))
                  .when(F.instr(fmt, "%") > 0, format_percent(raw, fmt))
                  .otherwise(format_plain(raw, fmt)))
    return (F.when(raw.isNull(), F.lit(""))
             .when(~F.coalesce(is_number, F.lit(False)) | fmt.isNull() | (fmt == "") | (fmt == "General"), raw)
             .otherwise(F.coalesce(formatted, raw)))


def clean_number(x) -> Column:
    """Float text with 4 decimals, trailing zeros and dot removed (decimal half-up)."""
    x = col_(x)
    s = _fixed(x, 4)
    s = F.regexp_replace(F.regexp_replace(s, "0+$", ""), "\\.$", "")
    return F.when(F.isnan(x), F.lit("nan")).otherwise(s)


def clean_value(c, kind: str) -> Column:
    """Clean a typed value to text: float -> 4 dp trimmed, timestamp -> date, null -> ' '."""
    c = col_(c)
    if kind == "float":
        out = clean_number(c)
    elif kind == "timestamp":
        out = F.date_format(c, "yyyy-MM-dd")
    else:
        out = c.cast("string")
    return F.coalesce(out, F.lit(" "))


def _fixed(x: Column, dp: int) -> Column:
    """'{:.{dp}f}' without thousands separators, decimal half-up."""
    return F.regexp_replace(F.format_number(F.round(x.cast("string").cast(_DEC), dp), dp), ",", "")


def _one_dp(x: Column, unit: str) -> Column:
    return F.concat(_fixed(x, 1), F.lit(unit))


def format_duration(seconds) -> Column:
    """'12.3 seconds' / '4.5 minutes' / '1.2 hours' (one decimal, half-up)."""
    s = col_(seconds)
    return (F.when(s < 60, _one_dp(s, " seconds"))
             .when(s < 3600, _one_dp(s / 60, " minutes"))
             .otherwise(_one_dp(s / 3600, " hours")))


def format_duration_short(seconds) -> Column:
    """'850.00 ms' / '12.35 seconds' / '2 min 3.50 sec' (two decimals, half-up)."""
    s = col_(seconds)

    def two(x):
        return _fixed(x, 2)

    return (F.when(s < 1, F.concat(two(s * 1000), F.lit(" ms")))
             .when(s < 60, F.concat(two(s), F.lit(" seconds")))
             .otherwise(F.concat(F.floor(s / 60).cast("bigint").cast("string"), F.lit(" min "),
                                 two(s - F.floor(s / 60) * 60), F.lit(" sec"))))
