from pyspark.sql import functions as F

from gridmap.operators import grid as G
from gridmap.operators import headers as H
from gridmap.operators import sections as S
from gridmap.plans import dims

# sample grid: title row inside content, colon-aligned separator, nan cells
SAMPLE = """| Fund | ISIN | NAV |
|:---|:---|---:|
| Alpha | LU0001 | 10.5 |
| nan | nan | nan |
| Beta | LU0002 | 11.0 |"""


def cells_of(spark, grid):
    data = [(1, r, c, v) for r, row in enumerate(grid) for c, v in enumerate(row)]
    return spark.createDataFrame(data, "doc_id long, row_idx int, col_idx int, value string")


def test_fallback_header_colon_rule_does_not_match(spark):
    lines = G.text_lines(spark.createDataFrame([(1, SAMPLE)], "doc_id long, text string"))
    r = H.fallback_header(lines).collect()[0]
    # '|:---|' has colons, so no rule line is found: end 0, content = first digit line after 0
    assert (r.header_start, r.header_end, r.content_start) == (0, 0, 2)
    plain = SAMPLE.replace(":---", "---").replace("---:", "---")
    r = H.fallback_header(G.text_lines(spark.createDataFrame([(1, plain)], "doc_id long, text string"))).collect()[0]
    assert (r.header_start, r.header_end, r.content_start) == (0, 0, 2)


def test_focus_content_zero_counts_as_missing(spark):
    lines = G.text_lines(spark.createDataFrame([(1, "\n".join(f"l{i}" for i in range(30)))], "doc_id long, text string"))
    ctx = spark.createDataFrame([(1, 0, 2, 0)], "doc_id long, header_start int, header_end int, content_start int")
    r = H.focus_content(lines, ctx).collect()[0]
    assert r.n_focus_lines == 13      # lines [0, 3 + 10)


def test_detect_and_validate_header(spark):
    grid = [["Price list", "", ""], ["", "", ""], ["ISIN Code", "Fund Name", "NAV"], ["LU1", "A", "1.5"],
            ["LU2", "B", "2.5"]]
    cells = cells_of(spark, grid)
    stats = H.row_stats(cells, dims.aliases(spark))
    ctx = H.validate_header(H.detect_header(stats), stats).collect()[0]
    assert (ctx.header_start, ctx.header_end, ctx.content_start, ctx.n_rows) == (2, 2, 3, 5)
    assert ctx.confidence == 1.0


def test_drop_empty_rows_and_cols(spark):
    cells = cells_of(spark, [["a", "", ""], ["", "", ""], ["b", "", "c"]])
    assert sorted(r.row_idx for r in G.drop_empty_rows(cells).select("row_idx").distinct().collect()) == [0, 2]
    assert sorted(r.col_idx for r in G.drop_empty_cols(cells).select("col_idx").distinct().collect()) == [0, 2]


def test_extract_validate_and_resolve(spark):
    hdr = spark.createDataFrame([(1, 0, "ISIN Code"), (1, 1, "Fund Name"), (1, 2, "nav date"), (1, 3, "Currency")],
                                "doc_id long, col_idx int, header string")
    docs = spark.createDataFrame([(1, "Mutual Funds")], "doc_id long, doc_class string")
    ext = S.extract_sections(hdr, docs, dims.field_defs(spark), dims.aliases(spark))
    got = {(r.section, r.field): r.header for r in ext.collect() if r.header}
    assert got[("Identifier", "Code")] == "ISIN Code"
    assert got[("Valorisation", "NavDate")] == "NAV DATE"        # vocabulary spelling on a case-insensitive hit
    val, corr = S.validate_sections(ext, hdr)
    fixed = {(r.section, r.field): r.header for r in val.collect() if r.header}
    assert fixed[("Valorisation", "NavDate")] == "nav date"
    corrections = [(r.field, r.error_type) for r in corr.collect()]
    assert ("NavDate", "capitalization") in corrections
    assert {t for _f, t in corrections} == {"capitalization"}   # every answer names a real header cell
    conf = S.field_conflicts(ext).collect()
    assert {r.header for r in conf} == {"Fund Name", "Currency"}
    res = S.resolve_conflicts(ext).where(F.col("header").isNotNull())
    winners = res.groupBy("doc_id", "header").count().collect()
    assert all(r["count"] == 1 for r in winners)           # exactly one winner per header
    untouched = ext.where(F.col("header") == "ISIN Code").count()
    assert res.where(F.col("header") == "ISIN Code").count() == untouched


def test_section_merge_rules(spark):
    slots = spark.createDataFrame(
        [(1, "S", "a", True, "E", True, None, 0.8), (1, "S", "b", True, "E", False, None, None),
         (1, "S", "c", False, None, False, None, None), (1, "S", "d", True, "E", True, "V", None)],
        "doc_id long, section string, field string, has_extracted boolean, extracted_header string, "
        "has_validated boolean, validated_header string, validated_confidence double")
    out = {r.field: (r.header, r.confidence, r.source) for r in S.section_merge(slots).collect()}
    assert out["a"] == (None, 0.8, "validated")     # validated null does not fall back
    assert out["b"] == ("E", 0.5, "extracted")
    assert out["c"] == (None, 0.0, "none")
    assert out["d"] == ("V", 0.9, "validated")
