
from gridmap.functions.parse import parse_class, parse_class_validation
from gridmap.operators import grid as G
from gridmap.operators import headers as H
from gridmap.operators.sections import typed_values
from gridmap.sources import delimited as DL


def grid_of(spark, text, delimiter="comma"):
    docs = spark.createDataFrame([(1, text, delimiter)], "doc_id long, text string, delimiter string")
    return {(r.row_idx, r.col_idx): r.value for r in DL.csv_grid(docs).collect()}


def test_quoted_line_breaks_and_doubled_quotes(spark):
    g = grid_of(spark, 'a,"b\r\nc",d\n"say ""hi"", x",  "y z",""\n')
    assert [g[0, c] for c in range(3)] == ["a", "b\nc", "d"]
    assert [g[1, c] for c in range(3)] == ['say "hi", x', "y z", ""]
    assert grid_of(spark, 'h;"1;2"\n3;4', "semicolon")[0, 1] == "1;2"


def test_stray_quote_and_null_text(spark):
    g = grid_of(spark, '5" pipe,x\ny,z')
    assert (g[0, 0], g[0, 1], g[1, 1]) == ('5" pipe', "x", "z")
    assert grid_of(spark, None) == {}


def test_many_quoted_fields(spark):
    g = grid_of(spark, ",".join(f'"f,{i}"' for i in range(10_000)))
    assert len(g) == 10_000 and g[0, 9_999] == "f,9999"


def test_utf32_little_endian(spark):
    df = spark.createDataFrame([(b"\xff\xfe\x00\x00" + "hé€𝄞".encode("utf-32-le"),), (b"\x00\x00\xfe\xff" + "hé".encode("utf-32-be"),)], "c binary")
    got = [(r.cs, r.t) for r in df.select(DL.encoding_choice("c").alias("cs"), DL.decode_bytes("c", DL.encoding_choice("c")).alias("t")).collect()]
    assert got == [("UTF-32LE", "hé€𝄞"), ("UTF-32BE", "hé")]


def test_missing_cells_stay_in_their_column(spark):
    cells = spark.createDataFrame([(1, 0, 0, "a"), (1, 0, 2, "c"), (1, 1, 1, None), (1, 1, 2, "d")], "doc_id long, row_idx int, col_idx int, value string")
    want = {0: "| a |  | c |", 1: "|  |  | d |"}
    assert {r.line_no: r.line for r in G.rows_to_lines(cells).collect()} == want
    assert {r.row_idx: r.line for r in H.row_summary(cells, ["a"]).collect()} == want


def test_header_far_down(spark):
    rows = [(1, i, 0, f"note {'x' * i}") for i in range(40)] + [(1, 40, c, v) for c, v in enumerate(["ISIN", "NAV"])]
    rows += [(1, 41 + i, c, v) for i in range(300) for c, v in enumerate([f"LU{i}", f"{i}.5"])]
    cells = spark.createDataFrame(rows, "doc_id long, row_idx int, col_idx int, value string")
    stats = H.row_summary(cells, ["isin", "nav"])
    found = H.detect_header(stats)
    r = found.first()
    assert (r.header_start, r.content_start, r.n_rows) == (40, 41, 341)
    with_columns = H.validate_header(found, stats).first()
    assert with_columns == H.validate_header(found.drop("header_numeric", "content_digit"), stats).first()
    assert with_columns.confidence == 1.0


def test_typed_values_keep_every_type(spark):
    kinds = ["float", "int", "bool", "date", "datetime", "string", "other", None]
    texts = ["1.5", "7", "true", "2024-01-02", "2024-01-02 03:04:05", "t", "u", "v"]
    fields = spark.createDataFrame([("S", f"f{i}", k) for i, k in enumerate(kinds)], "section string, field string, field_type string")
    values = spark.createDataFrame([(1, 0, "S", f"f{i}", t) for i, t in enumerate(texts)], "doc_id long, row_idx int, section string, field string, value string")
    out = {r.field: r for r in typed_values(values, fields).collect()}
    columns = ["value_double", "value_long", "value_boolean", "value_date", "value_timestamp", "value_string", "value_string", "value_string"]
    for i, c in enumerate(columns):
        assert out[f"f{i}"][c] is not None
        assert sum(out[f"f{i}"][k] is not None for k in set(columns)) == 1, i


def test_label_synonyms(spark):
    answers = ["<class>real estate</class>", "<sol>the Real Estate kind</sol>", "surely Real Estate.", "<class>Real State</class>"]
    df = spark.createDataFrame([(a,) for a in answers], "a string")
    out = df.select(parse_class("a")["predicted_class"].alias("c"), parse_class_validation("a")["predicted_class"].alias("v")).collect()
    assert [r.c for r in out] == ["Real State"] * 4
    assert out[0].v == "Real State" and out[3].v == "Real State"




def test_workbook_dates_missing_references_and_bad_files(spark, tmp_path):
    import zipfile

    from gridmap.sources import workbook as WB

    assert WB.serial_text(45321, False) == "2024-01-30" and WB.serial_text(45321.75, False) == "2024-01-30 18:00:00"
    assert WB.serial_text(1, False) == "1900-01-01" and WB.serial_text(0, True) == "1904-01-01"
    assert [WB.is_date_format(f) for f in ("mm-dd-yy", "h:mm", "General", "#,##0.00", '0 "days"', "[Red]0", "@")] == [True, True] + [False] * 5
    (tmp_path / "ok.xlsx").write_bytes(WB.build_workbook({"S": [(0, 0, 45321, "mm-dd-yy"), (1, 0, 2.5, "0.00")]}))
    (tmp_path / "bad.xlsx").write_bytes(b"not a zip")
    cut = (tmp_path / "ok.xlsx").read_bytes()
    (tmp_path / "cut.xlsx").write_bytes(cut[:len(cut) // 2])
    ns = WB.NS["m"]
    with zipfile.ZipFile(tmp_path / "odd.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{ns}"><sheets><sheet name="T" sheetId="1"/></sheets></workbook>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{ns}"><sheetData><row><c><v>1</v></c><c t="s"><v>99</v></c><c t="inlineStr">'
                   '<is><t>x</t></is></c></row><row r="5"><c r="C5"><v>2</v></c><c><v>3</v></c></row></sheetData></worksheet>')
    cells = {(r.path.rsplit("/", 1)[1], r.row_idx, r.col_idx): r.value for r in WB.read_workbooks(spark, str(tmp_path)).collect()}
    assert cells == {("ok.xlsx", 0, 0): "2024-01-30", ("ok.xlsx", 1, 0): "2.5", ("odd.xlsx", 0, 0): "1", ("odd.xlsx", 0, 2): "x",
                     ("odd.xlsx", 4, 2): "2", ("odd.xlsx", 4, 3): "3"}
    errors = {r.path.rsplit("/", 1)[1]: r.code for r in WB.workbook_errors(spark, str(tmp_path)).collect()}
    assert errors == {"bad.xlsx": WB.UNREADABLE, "cut.xlsx": WB.UNREADABLE}


def test_scorer_failures_stay_with_their_row(spark):
    from gridmap.operators.scorer import score

    def fn(pdf):
        if pdf["prompt"].str.contains("bad").any():
            raise ValueError("no")
        return pdf["prompt"] + "!"

    df = spark.createDataFrame([("a", "x"), ("b", "bad"), ("c", "y")], "doc_id string, prompt string").coalesce(1)
    out = {r.doc_id: (r.answer, r.error) for r in score(df, fn, retries=1, backoff_s=0.0).collect()}
    assert out == {"a": ("x!", None), "b": (None, "ValueError: no"), "c": ("y!", None)}


def test_stream_batches_replace_themselves(spark, tmp_path):
    from gridmap.sources import workbook as WB
    from gridmap.streaming.ingest import identify, ingest_folder, map_arrivals

    src, out = tmp_path / "src", str(tmp_path / "out")
    (src / "a").mkdir(parents=True)
    (src / "b").mkdir()
    book = WB.build_workbook({"P": [(0, c, v, "General") for c, v in enumerate(["ISIN Code", "Fund Name", "NAV", "Currency"])]
                              + [(1, c, v, "General") for c, v in enumerate(["LU0000000001", "Fund A", 12.5, "EUR"])]})
    for d in "ab":
        (src / d / "prices.xlsx").write_bytes(book)
    rows = spark.read.parquet(ingest_folder(spark, str(src), out, str(tmp_path / "c1"), batch_fn=map_arrivals))
    assert rows.where("header is not null").select("field").distinct().count() >= 3 and rows.select("doc_id").distinct().count() == 1
    n = rows.count()
    ingest_folder(spark, str(src), out, str(tmp_path / "c2"), batch_fn=map_arrivals)  # the first batch once more
    assert spark.read.parquet(out).count() == n
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(src))
    assert identify(files).first().path.endswith("/a/prices.xlsx")
