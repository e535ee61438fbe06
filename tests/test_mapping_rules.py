"""Headers of several rows, repair of wrong headers, similar spellings, typed corrections, consistency of conflicts."""

import random

import pytest
from pyspark.sql import functions as F

from gridmap.operators import headers as H
from gridmap.operators import sections as S
from gridmap.plans import dims

MAPPING = "doc_id long, doc_class string, section string, section_ord int, field string, field_ord int, header string"


def grid(spark, *sheets):
    rows = [(d, r, c, v) for d, sheet in enumerate(sheets) for r, row in enumerate(sheet) for c, v in enumerate(row)]
    return spark.createDataFrame(rows, "doc_id long, row_idx int, col_idx int, value string")


def detected(spark, *sheets, vocabulary=None):
    aliases = vocabulary or dims.aliases(spark)
    rows = H.row_summary(grid(spark, *sheets), aliases)
    blocks = H.header_blocks(rows, aliases)
    return rows, blocks, H.detect_header(rows, blocks)


TWO = [["Price list", "", ""], ["ISIN", "Fund", "NAV"], ["Code", "Name", "Date"], ["LU1", "A", "2024-01-01"], ["LU2", "B", "2024-01-02"]]
THREE = [["ISIN", "Fund", "NAV"], ["Code", "Name", "per"], ["", "and Class", "share"], ["---", "---", "---"], ["LU1", "A", "1.5"]]
ONE = [["ISIN Code", "Fund Name", "NAV"], ["Alpha", "Fund", "Name"], ["LU1", "A", "1.5"]]


@pytest.mark.parametrize("as_list", [False, True])
def test_headers_of_several_rows(spark, as_list):
    vocabulary = [r[5] for r in dims.alias_rows()] if as_list else None
    rows, blocks, found = detected(spark, TWO, THREE, ONE, vocabulary=vocabulary)
    got = {r.doc_id: (r.header_start, r.header_end, r.content_start, r.confidence) for r in found.collect()}
    assert got == {0: (1, 2, 3, 1.0), 1: (0, 2, 4, 1.0), 2: (0, 0, 2, 1.0)}
    ctx = H.validate_header(found, rows, blocks)
    assert all(r.confidence == 1.0 and not r.moved for r in ctx.collect())
    texts = {(r.doc_id, r.col_idx): r.header for r in H.header_texts(rows, ctx).collect()}
    assert [texts[0, c] for c in range(3)] == ["ISIN Code", "Fund Name", "NAV Date"]
    assert [texts[1, c] for c in range(3)] == ["ISIN Code", "Fund Name and Class", "NAV per share"]


def test_blocks_need_neighbouring_rows(spark):
    _, blocks, found = detected(spark, [["ISIN", "Fund"], ["", ""], ["Code", "Name"], ["LU1", "2"]])
    assert blocks.count() == 0 and found.first().header_end == found.first().header_start


def test_wrong_headers_are_moved(spark):
    sheet = [["Currency", "Price", "12.5", "Date", "NAV", "Quota"], ["", "", "", "", "", ""], ["Code ISIN", "FONDS", "VL", "Devise", "Date VL", ""],
             ["LU1", "A", "1.5", "EUR", "2024-01-01", ""]]
    rows, blocks, found = detected(spark, sheet, sheet[2:], [["ISIN", "NAV"], ["none", "here"]])
    assert {r.doc_id: r.header_start for r in found.collect()}[0] == 0
    got = {r.doc_id: (r.header_start, r.header_end, r.content_start, round(r.confidence, 2), r.moved) for r in H.validate_header(found, rows, blocks).collect()}
    assert got == {0: (2, 2, 3, 1.0, True), 1: (0, 0, 1, 1.0, False), 2: (0, 0, 1, 0.67, False)}
    kept = {r.doc_id: r.moved for r in H.validate_header(found, rows, blocks, reach=None).collect()}
    assert not any(kept.values())
    # a proposal from elsewhere: lines in the wrong order, beyond the sheet, or missing
    told = spark.createDataFrame([(0, 5, 1, 2, 4), (1, 40, 41, 42, 2)], "doc_id long, header_start int, header_end int, content_start int, n_rows int")
    got = {r.doc_id: (r.header_start, r.content_start, r.moved) for r in H.validate_header(told, rows, blocks).collect()}
    assert got == {0: (2, 3, True), 1: (40, 42, False)}


def test_similarity_join_equals_all_pairs(spark):
    rnd = random.Random(3)
    words = ["net", "asset", "value", "fund", "name", "share", "class", "currency", "price", "date", "isin", "code", "number"]
    spelt = sorted({" ".join(rnd.choice(words) for _ in range(rnd.randrange(1, 5))) for _ in range(60)})
    texts = set()
    for _ in range(400):
        t = rnd.choice(spelt)
        for _ in range(rnd.randrange(4)):
            i = rnd.randrange(len(t) + 1)
            t = rnd.choice([t[:i] + t[i + 1:], t[:i] + rnd.choice("abcxyz ") + t[i:], t + " " + rnd.choice(words), rnd.choice(words) + " " + t])
        texts.add(" ".join(t.split()) or "x")
    texts -= set(spelt)
    aliases = spark.createDataFrame([("C", "S", 0, f"f{i % 7}", i % 7, a, i) for i, a in enumerate(spelt)], dims.ALIAS_SCHEMA)
    found = S.similar_spellings(spark.createDataFrame([("C", t) for t in sorted(texts)], "doc_class string, key string"), aliases)
    got = {(r.key, r.alias): (r.kind, round(r.similarity, 9)) for r in found.collect()}

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            last, row[0] = row[0], i + 1
            for j, y in enumerate(b):
                last, row[j + 1] = row[j + 1], min(row[j + 1] + 1, row[j] + 1, last + (x != y))
        return row[-1]

    want = {}
    for t in texts:
        for a in spelt:
            n = max(len(t), len(a))
            if f" {a} " in f" {t} " or " " in t and f" {t} " in f" {a} ":
                want[t, a] = (S.CONTAINED, round(min(len(t), len(a)) / n, 9))
            elif min(len(t), len(a)) >= 4 and distance(t, a) <= (3 if n >= 16 else 2 if n >= 9 else 1 if n >= 5 else 0):
                want[t, a] = (S.DISTANCE, round(1 - distance(t, a) / n, 9))
    assert got == want and {k for k, _ in want.values()} == {S.CONTAINED, S.DISTANCE}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_kinds_of_fit_are_ranked(spark):
    cells = spark.createDataFrame([(1, 0, "ISN Code"), (1, 1, "Fund Name of the share"), (1, 2, "nav"), (1, 3, "NAV-Date:"), (1, 4, "Curency"), (1, 5, " "),
                                   (2, 0, "VL (latest)"), (2, 1, "VL"), (3, 0, "???")], "doc_id long, col_idx int, header string")
    docs = spark.createDataFrame([(i, "Mutual Funds") for i in (1, 2, 3)], "doc_id long, doc_class string")
    got = {(r.doc_id, r.field): (r.col_idx, r.header, r.match_kind) for r in S.best_matches(cells, docs, dims.aliases(spark)).collect()
           if (r.section, r.field) in {("Identifier", "Code"), ("Denomination", "InstrumentName"), ("Valorisation", "Nav"), ("Identifier", "Currency")}}
    assert got[1, "Code"] == (0, "ISN Code", S.DISTANCE)
    assert got[1, "InstrumentName"] == (1, "Fund Name of the share", S.CONTAINED)
    assert got[1, "Nav"] == (2, "NAV", S.CASE)
    assert got[1, "Currency"] == (4, "Curency", S.DISTANCE)
    assert got[2, "Nav"] == (1, "VL", S.EXACT) and not any(d == 3 for d, _ in got)


def test_five_types_of_corrections(spark):
    cells = spark.createDataFrame([(1, 0, "ISIN Code"), (1, 1, "Fund Name"), (1, 2, "NAV"), (1, 3, "Date VL"), (1, 4, "Devise"), (1, 5, "Remarks")],
                                  "doc_id long, col_idx int, header string")
    answers = {("Identifier", 0, "Code", 0): "isin code", ("Identifier", 0, "CodeType", 1): None, ("Identifier", 0, "Currency", 2): None,
               ("Denomination", 1, "InstrumentName", 2): "Fund-Name:", ("Denomination", 1, "ShareType", 3): "Made up", ("Valorisation", 2, "Nav", 0): "NAV",
               ("Valorisation", 2, "NavDate", 1): "Remarks", ("Characteristics", 5, "Strategy", 0): "Remarks"}
    mapping = spark.createDataFrame([(1, "Mutual Funds", *k[:2], k[2], k[3], v) for k, v in answers.items()], MAPPING)
    out, corrections = S.validate_sections(mapping, cells, dims.aliases(spark))
    got = {r.field: (r.original_value, r.corrected_value, r.error_type) for r in corrections.collect()}
    assert got == {"Code": ("isin code", "ISIN Code", S.CASING), "Currency": (None, "Devise", S.MISSING), "InstrumentName": ("Fund-Name:", "Fund Name", S.FORMAT),
                   "ShareType": ("Made up", None, S.EXTRA), "NavDate": ("Remarks", "Date VL", S.WRONG)}
    final = {r.field: (r.header, r.col_idx, round(r.validation_confidence, 2)) for r in out.collect()}
    assert final["Nav"] == ("NAV", 2, 0.5) and final["Strategy"] == ("Remarks", 5, 1.0) and final["CodeType"] == (None, None, 0.0)
    assert {r.error_type: r.n_corrections for r in S.correction_summary(corrections).groupBy("error_type").agg(F.sum("n_corrections").alias("n_corrections")).collect()} == {
        t: 1 for t in (S.CASING, S.MISSING, S.FORMAT, S.EXTRA, S.WRONG)}
    # without a vocabulary nothing is added, and an answer that is no cell is extra
    _, plain = S.validate_sections(mapping, cells)
    assert {r.field: r.error_type for r in plain.collect()} == {"Code": S.CASING, "InstrumentName": S.FORMAT, "ShareType": S.EXTRA}


def test_one_cell_goes_to_one_open_field(spark):
    cells = spark.createDataFrame([(1, 0, "Fund Name"), (1, 1, "COMPARTMENT")], "doc_id long, col_idx int, header string")
    mapping = spark.createDataFrame([(1, "Mutual Funds", "Denomination", 1, f, i, None) for i, f in enumerate(["VehiculeName", "CompartmentName", "InstrumentName"])], MAPPING)
    _, corrections = S.validate_sections(mapping, cells, dims.aliases(spark))
    # "Fund Name" fits all three exactly, the second cell only the second field: the first pair in order wins, then what is left
    assert {r.field: r.corrected_value for r in corrections.collect()} == {"VehiculeName": "Fund Name", "CompartmentName": "COMPARTMENT"}


def test_consistency_with_the_section_decides(spark):
    rows = [("A", 0, "x1", 0, "Total", 5), ("B", 1, "y1", 0, "Total", 5), ("A", 0, "x2", 1, "Left", 1), ("B", 1, "y2", 1, "Beside", 6)]
    mapping = spark.createDataFrame([(1, s, so, f, fo, h, c, 1.0) for s, so, f, fo, h, c in rows],
                                    "doc_id long, section string, section_ord int, field string, field_ord int, header string, col_idx int, confidence double")
    kept = {r.field: r.header for r in S.resolve_conflicts(mapping).collect()}
    assert kept == {"x1": None, "y1": "Total", "x2": "Left", "y2": "Beside"}  # order alone would choose x1
    more = mapping.drop("col_idx").union(spark.createDataFrame([(1, "B", 1, "y3", 2, "Third", 1.0)], mapping.drop("col_idx").schema))
    assert {r.field for r in S.resolve_conflicts(more).where("header = 'Total'").collect()} == {"y1"}
    fewer = mapping.drop("col_idx")
    assert {r.field for r in S.resolve_conflicts(fewer).where("header = 'Total'").collect()} == {"x1"}
