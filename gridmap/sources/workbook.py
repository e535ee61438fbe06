"""XLSX workbooks <-> long cells, with the standard library only (zipfile + ElementTree).

Reading: ``binaryFile`` lists the workbooks (one row per file, content loaded
lazily by the scan); ``mapInPandas`` parses each workbook inside the task that
holds it and emits cell rows, so parallelism = number of files and nothing
passes through the driver.  Cached cell values are read (formulas are not
evaluated), with the number format of every cell.

Writing (used to derive workbook fixtures from tables): rows are grouped by
workbook key and ``applyInPandas`` writes one ``.xlsx`` per group into a
shared folder.
"""

from __future__ import annotations

import datetime as dt
import io
import posixpath
import re
import zipfile
from xml.etree import ElementTree as ET
from xml.sax.saxutils import escape

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main",
      "r": "http://schemas.openxmlformats.org/officeDocument/2006/relationships",
      "pr": "http://schemas.openxmlformats.org/package/2006/relationships"}
# Built-in number format ids of the file format.
BUILTIN_FORMATS = {0: "General", 1: "0", 2: "0.00", 3: "#,##0", 4: "#,##0.00", 9: "0%", 10: "0.00%", 11: "0.00E+00", 12: "# ?/?",
                   13: "# ??/??", 14: "mm-dd-yy", 15: "d-mmm-yy", 16: "d-mmm", 17: "mmm-yy", 18: "h:mm AM/PM", 19: "h:mm:ss AM/PM",
                   20: "h:mm", 21: "h:mm:ss", 22: "m/d/yy h:mm", 37: "#,##0 ;(#,##0)", 38: "#,##0 ;[Red](#,##0)",
                   39: "#,##0.00;(#,##0.00)", 40: "#,##0.00;[Red](#,##0.00)", 45: "mm:ss", 46: "[h]:mm:ss", 47: "mmss.0",
                   48: "##0.0E+0", 49: "@"}
CELL_SCHEMA = ("path string, sheet string, sheet_idx int, row_idx int, col_idx int, value string, "
               "num_format string, is_number boolean, error string")
UNREADABLE = "WORKBOOK_UNREADABLE"
_NOT_CODES = re.compile(r'"[^"]*"|\\.|_.|\*.|\[[^\]]*\]')


def is_date_format(fmt: str) -> bool:
    """Whether a number format shows a date or time (letters of day, month, year, hour or second outside quotes)."""
    return fmt != "General" and bool(re.search("[dmyhs]", _NOT_CODES.sub("", fmt.split(";")[0]).lower()))


def serial_text(serial: float, epoch_1904: bool) -> str:
    """A serial day number as ISO date, with the time of day if it has one."""
    if epoch_1904:
        base = dt.datetime(1904, 1, 1)
    else:  # the 1900 system counts a 29 February 1900 that never was
        base = dt.datetime(1899, 12, 30) if serial >= 60 else dt.datetime(1899, 12, 31)
    t = base + dt.timedelta(seconds=round(serial * 86400))
    return t.strftime("%Y-%m-%d") if t.time() == dt.time() else t.strftime("%Y-%m-%d %H:%M:%S")


def _col_index(ref: str) -> int:
    letters = re.match(r"[A-Z]+", ref).group(0)
    n = 0
    for ch in letters:
        n = n * 26 + (ord(ch) - 64)
    return n - 1


def parse_workbook(data: bytes, start_row: int = 0, end_row: int | None = None, sheet: str | None = None,
                   all_sheets: bool = True):
    """Yield (sheet, sheet_idx, row_idx, col_idx, value, num_format, is_number) for one workbook.

    Sheets are read as streams, row by row, up to ``end_row``.  Rows and cells without a reference follow the one
    before; a shared string that does not exist is an empty cell; dates are ISO texts.
    """
    z = zipfile.ZipFile(io.BytesIO(data))
    names = set(z.namelist())
    shared = []
    if "xl/sharedStrings.xml" in names:
        for si in ET.fromstring(z.read("xl/sharedStrings.xml")).findall("m:si", NS):
            shared.append("".join(t.text or "" for t in si.iter(f"{{{NS['m']}}}t")))
    fmts, xf_fmt = dict(BUILTIN_FORMATS), []
    if "xl/styles.xml" in names:
        st = ET.fromstring(z.read("xl/styles.xml"))
        for nf in st.findall("m:numFmts/m:numFmt", NS):
            fmts[int(nf.get("numFmtId"))] = nf.get("formatCode")
        for xf in st.findall("m:cellXfs/m:xf", NS):
            xf_fmt.append(fmts.get(int(xf.get("numFmtId", "0")), "General"))
    wb = ET.fromstring(z.read("xl/workbook.xml"))
    properties = wb.find("m:workbookPr", NS)
    epoch_1904 = properties is not None and properties.get("date1904") in ("1", "true")
    rels = {}
    if "xl/_rels/workbook.xml.rels" in names:
        for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels")).findall("pr:Relationship", NS):
            rels[r.get("Id")] = r.get("Target")
    for s_idx, sh in enumerate(wb.findall("m:sheets/m:sheet", NS)):
        name = sh.get("name")
        if sheet is not None and name != sheet:
            continue
        if sheet is None and not all_sheets and s_idx > 0:
            break
        target = rels.get(sh.get(f"{{{NS['r']}}}id"), f"worksheets/sheet{s_idx + 1}.xml")
        path = target.lstrip("/") if target.startswith("/") else posixpath.normpath(posixpath.join("xl", target))
        r_idx = -1
        for _, row in ET.iterparse(z.open(path)):
            if row.tag != f"{{{NS['m']}}}row":
                continue
            r_idx = int(row.get("r")) - 1 if (row.get("r") or "").isdigit() else r_idx + 1
            if end_row is not None and r_idx >= end_row:
                break
            c_idx = -1
            for c in row.findall("m:c", NS) if r_idx >= start_row else ():
                ref = c.get("r") or ""
                c_idx = _col_index(ref) if re.match("[A-Z]", ref) else c_idx + 1
                style = c.get("s") or ""
                fmt = xf_fmt[int(style)] if style.isdigit() and int(style) < len(xf_fmt) else "General"
                val, num = _cell_value(c, shared, fmt, epoch_1904)
                if val is not None:
                    yield name, s_idx, r_idx, c_idx, val, fmt, num
            row.clear()


def _cell_value(c, shared: list[str], fmt: str, epoch_1904: bool) -> tuple[str | None, bool]:
    """(text, whether it is a number) of one cell element."""
    t, v = c.get("t"), c.find("m:v", NS)
    text = v.text if v is not None else None
    if t == "s":
        i = int(text) if (text or "").strip().isdigit() else -1
        return (shared[i] if 0 <= i < len(shared) else None), False
    if t == "inlineStr":
        return "".join(x.text or "" for x in c.iter(f"{{{NS['m']}}}t")), False
    if t in ("str", "e", "d"):
        return text, False
    if t == "b":
        return ("TRUE" if text == "1" else "FALSE"), False
    if text is not None and is_date_format(fmt):
        try:
            return serial_text(float(text), epoch_1904), False
        except (ValueError, OverflowError):
            return text, True
    return text, text is not None


def file_cells(files: DataFrame, start_row: int = 0, end_row: int | None = None, sheet: str | None = None,
               all_sheets: bool = True) -> DataFrame:
    """Cells of workbook files (path, content); a workbook that cannot be read gives one row with ``error`` and nothing else."""
    names = [c.split()[0] for c in CELL_SCHEMA.split(", ")]

    def parse(batches):
        for pdf in batches:
            for p, content in zip(pdf["path"], pdf["content"]):
                out = []
                try:
                    for rec in parse_workbook(bytes(content), start_row, end_row, sheet, all_sheets):
                        out.append((p, *rec, None))
                        if len(out) == 50_000:
                            yield pd.DataFrame(out, columns=names)
                            out = []
                except Exception as e:  # whatever is wrong with one file must not end the job
                    out.append((p, None, None, None, None, None, None, None, f"{type(e).__name__}: {e}"))
                if out:
                    yield pd.DataFrame(out, columns=names).astype({"sheet_idx": "Int32", "row_idx": "Int32", "col_idx": "Int32"})

    return files.select("path", "content").mapInPandas(parse, CELL_SCHEMA)


def _scan(spark: SparkSession, path: str, *how) -> DataFrame:
    files = (spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx")
                  .option("recursiveFileLookup", "true").load(path))
    return file_cells(files, *how)


def read_workbooks(spark: SparkSession, path: str, start_row: int = 0, end_row: int | None = None,
                   sheet: str | None = None, all_sheets: bool = True) -> DataFrame:
    """Long cells of every ``*.xlsx`` under ``path`` (row window applied while parsing).

    A file that breaks off midway keeps the cells read so far; ``workbook_errors`` names it.
    """
    return _scan(spark, path, start_row, end_row, sheet, all_sheets).where("row_idx is not null").drop("error")


def workbook_errors(spark: SparkSession, path: str) -> DataFrame:
    """(path, code, message) of the workbooks under ``path`` that cannot be read to their end."""
    return _scan(spark, path, 0, None, None, True).where("error is not null").select(
        "path", F.lit(UNREADABLE).alias("code"), F.col("error").alias("message"))


# ------------------------------------------------------------------ writer
def _cell_ref(r: int, c: int) -> str:
    s, c1 = "", c + 1
    while c1:
        c1, rem = divmod(c1 - 1, 26)
        s = chr(65 + rem) + s
    return f"{s}{r + 1}"


def build_workbook(sheets: dict[str, list[tuple[int, int, object, str]]]) -> bytes:
    """Workbook bytes from {sheet: [(row, col, value, num_format)]}; strings go inline."""
    formats = sorted({f for cells in sheets.values() for *_x, f in cells if f and f != "General"})
    fmt_id = {f: 164 + i for i, f in enumerate(formats)}
    xf_index = {"General": 0, **{f: i + 1 for i, f in enumerate(formats)}}
    styles = ('<?xml version="1.0" encoding="UTF-8"?><styleSheet xmlns="%s"><numFmts count="%d">%s</numFmts>'
              '<cellXfs count="%d"><xf numFmtId="0"/>%s</cellXfs></styleSheet>') % (
        NS["m"], len(formats), "".join(f'<numFmt numFmtId="{fmt_id[f]}" formatCode="{escape(f, {chr(34): "&quot;"})}"/>'
                                       for f in formats),
        len(formats) + 1, "".join(f'<xf numFmtId="{fmt_id[f]}" applyNumberFormat="1"/>' for f in formats))
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", '<?xml version="1.0" encoding="UTF-8"?><Types xmlns='
                   '"http://schemas.openxmlformats.org/package/2006/content-types"/>')
        sheet_xml = []
        rels = []
        for i, (name, cells) in enumerate(sheets.items()):
            rows: dict[int, list] = {}
            for r, c, v, f in cells:
                rows.setdefault(r, []).append((c, v, f))
            body = []
            for r in sorted(rows):
                cs = []
                for c, v, f in sorted(rows[r], key=lambda x: x[0]):
                    s = xf_index.get(f or "General", 0)
                    if isinstance(v, (int, float)) and not isinstance(v, bool):
                        cs.append(f'<c r="{_cell_ref(r, c)}" s="{s}"><v>{v!r}</v></c>')
                    else:
                        cs.append(f'<c r="{_cell_ref(r, c)}" t="inlineStr"><is><t>{escape(str(v))}</t></is></c>')
                body.append(f'<row r="{r + 1}">{"".join(cs)}</row>')
            z.writestr(f"xl/worksheets/sheet{i + 1}.xml", f'<?xml version="1.0" encoding="UTF-8"?><worksheet '
                       f'xmlns="{NS["m"]}"><sheetData>{"".join(body)}</sheetData></worksheet>')
            sheet_xml.append(f'<sheet name="{escape(name)}" sheetId="{i + 1}" r:id="rId{i + 1}"/>')
            rels.append(f'<Relationship Id="rId{i + 1}" Type="http://schemas.openxmlformats.org/officeDocument/2006/'
                        f'relationships/worksheet" Target="worksheets/sheet{i + 1}.xml"/>')
        z.writestr("xl/workbook.xml", f'<?xml version="1.0" encoding="UTF-8"?><workbook xmlns="{NS["m"]}" '
                   f'xmlns:r="{NS["r"]}"><sheets>{"".join(sheet_xml)}</sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'<?xml version="1.0" encoding="UTF-8"?><Relationships '
                   f'xmlns="{NS["pr"]}">{"".join(rels)}</Relationships>')
        z.writestr("xl/styles.xml", styles)
    return buf.getvalue()


def write_workbooks(cells: DataFrame, out_dir: str) -> DataFrame:
    """Write one workbook per ``book`` from rows (book, sheet, row_idx, col_idx, value, num_format, is_number).

    Each group is one workbook (bounded by the sheets written into it); the
    task that builds it writes it to ``out_dir`` -- any URI Arrow's file
    systems understand (shared storage on a cluster) -- and returns
    (book, path, n_cells).
    """
    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        book = str(pdf["book"].iloc[0])
        sheets: dict[str, list] = {}
        for s in pdf.sort_values(["sheet", "row_idx", "col_idx"]).itertuples(index=False):
            v = float(s.value) if s.is_number else s.value
            sheets.setdefault(s.sheet, []).append((int(s.row_idx), int(s.col_idx), v, s.num_format))
        fs, root = pafs.FileSystem.from_uri(out_dir)
        fs.create_dir(root, recursive=True)
        path = f"{root.rstrip('/')}/{book}.xlsx"
        with fs.open_output_stream(path) as fh:
            fh.write(build_workbook(sheets))
        return pd.DataFrame({"book": [book], "path": [path], "n_cells": [len(pdf)]})

    return cells.groupBy("book").applyInPandas(one, "book string, path string, n_cells long")
