import json

from pyspark.sql import functions as F

from gridmap.operators import vocab as VO
from gridmap.sources import delimited as DL
from gridmap.sources import html as HT
from gridmap.sources import labels as LB
from gridmap.sources import workbook as WB


def test_delimiter_vote_and_sniff(spark):
    docs = spark.createDataFrame([(1, "a,b;c\nd,e"), (2, "a;b;c\nd;e;f"), (3, "a,b;c"), (4, "abc\ndef\n"),
                                  (5, "a\tb\tc\nd\te\tf")], "doc_id long, text string")
    vote = {r.doc_id: r.delimiter for r in DL.delimiter_vote(docs).collect()}
    assert vote == {1: ",", 2: ";", 3: "Undetermined", 4: "No delimiters found in the first 2 lines.", 5:
                    "No delimiters found in the first 2 lines."}
    sniff = {r.doc_id: r.delimiter for r in DL.sniff_delimiter(docs).collect()}
    assert sniff[2] == "semicolon" and sniff[5] == "tab" and sniff[4] == "comma"


def test_csv_grid_quotes_and_ragged_rows(spark):
    docs = spark.createDataFrame([(1, 'a,"b,c",d\n\nx,y', "comma")], "doc_id long, text string, delimiter string")
    g = {(r.row_idx, r.col_idx): r.value for r in DL.csv_grid(docs).collect()}
    assert g[(0, 1)] == "b,c" and g[(1, 0)] == "" and g[(2, 1)] == "y" and (2, 2) not in g


def test_encoding_choice(spark):
    df = spark.createDataFrame([(bytes.fromhex("FFFE") + "hé".encode("utf-16-le"),), ("hé".encode("latin-1"),),
                                (b"\xef\xbb\xbfabc",), ("plain é".encode("utf-8"),)], "c binary")
    out = df.select(DL.encoding_choice("c").alias("cs"), DL.decode_bytes("c", DL.encoding_choice("c")).alias("t"))
    got = [(r.cs, r.t) for r in out.collect()]
    assert got == [("UTF-16LE", "hé"), ("ISO-8859-1", "hé"), ("UTF-8", "abc"), ("UTF-8", "plain é")]


def test_workbook_roundtrip(spark, tmp_path):
    data = WB.build_workbook({"Prices": [(0, 0, "Fund", "General"), (0, 1, "NAV", "General"),
                                         (1, 0, "A", "General"), (1, 1, 1234.5, "[$€-407]#,##0.00"),
                                         (2, 1, 0.05, "0.00%")],
                              "Empty": []})
    recs = list(WB.parse_workbook(data))
    assert ("Prices", 0, 1, 1, "1234.5", "[$€-407]#,##0.00", True) in recs
    assert all(r[0] == "Prices" for r in recs)          # empty sheet gives no cells
    (tmp_path / "b.xlsx").write_bytes(data)
    (tmp_path / "bad.xlsx").write_bytes(b"not a zip")
    cells = WB.read_workbooks(spark, str(tmp_path), 0, 2)
    assert cells.count() == 4                            # window [0, 2); the broken file yields nothing


def test_html_tables_and_lists(spark):
    html = "<ul><li>one</li><li class='x'><b>two</b></li></ul><link rel='x'><table><tr><th>A</th><td>1</td></tr></table>"
    df = spark.createDataFrame([(1, html)], "id long, html string")
    assert [r.text for r in HT.list_items(df, "id", "html").collect()] == ["one", "two"]
    assert [(r.row_idx, r.col_idx, r.value) for r in HT.table_cells(df, "id", "html").collect()] == [
        (0, 0, "A"), (0, 1, "1")]


def test_label_files_and_vocabulary(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(indent=2, obj={"Identifier": [{"Code": "ISIN", "Currency": "Devise"},
                                                                {"Code": "Sedol"}],
                                                 "Valorisation": {"Nav": "vl", "NavDate": ""}}))
    (tmp_path / "b.json").write_text(json.dumps({"Valorisation": {"Nav": "NAV"}}))
    (tmp_path / "broken.json").write_text("{not json")
    files = LB.read_json_files(spark, str(tmp_path))
    assert LB.bad_files(files).count() == 1
    labels = LB.label_rows(files)
    vocab = {(r.section, r.field): r["values"] for r in VO.value_vocabulary(labels).collect()}
    assert vocab[("Identifier", "Code")] == "ISIN, Sedol"
    assert vocab[("Valorisation", "Nav")] == "NAV, vl"
    assert ("Valorisation", "NavDate") not in vocab


def test_config_scan(spark, tmp_path):
    (tmp_path / "ok.json").write_text(json.dumps({"end_row": 20}))
    (tmp_path / "bad.json").write_text(json.dumps({"end_row": "twenty"}))
    (tmp_path / "broken.json").write_text("{")
    got = {r.path.split("/")[-1]: (r.end_row, r.start_row, r.status) for r in LB.read_configs(spark, str(tmp_path)).collect()}
    assert got["ok.json"] == (20, 0, "OK")
    assert got["bad.json"][2] == "CONFIG_INVALID_TYPE"
    assert got["broken.json"][2] == "INVALID_JSON"


def test_prompt_dimension(spark, tmp_path):
    (tmp_path / "classify.md").write_text("Name: {doc_name}\n{question}")
    (tmp_path / "other.txt").write_text("ignored")
    p = LB.read_prompts(spark, str(tmp_path))
    assert [(r.name, r.template) for r in p.collect()] == [("classify.md", "Name: {doc_name}\n{question}")]
    req = spark.createDataFrame([("classify.md",), ("validate.md",)], "name string")
    assert [r.name for r in LB.missing_prompts(req, p).collect()] == ["validate.md"]


def test_markdown_sink(spark, tmp_path):
    from gridmap.plans.results import markdown_documents, write_markdown
    lines = spark.createDataFrame([(1, 1, "| b |"), (1, 0, "| a |")], "doc_id long, line_no int, line string")
    docs = spark.createDataFrame([(1, "x", "csv")], "doc_id long, doc_name string, file_type string")
    md = markdown_documents(lines, docs)
    assert md.collect()[0].markdown == "| a |\n| b |"
    write_markdown(md, str(tmp_path / "md"))
    back = spark.read.json(str(tmp_path / "md")).collect()
    assert back[0].doc_name == "x" and back[0].file_type == "csv"
