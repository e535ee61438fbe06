"""Tasks of the mapping job hold a bounded number of documents; what is known of them isn't sent again."""

import re

from pyspark.sql import functions as F

from gridmap import session
from gridmap.operators import sections as S
from gridmap.plans import dims
from gridmap.plans import pipeline as P
from test_pipeline import small_corpus


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_matches_of_many_documents_are_many_partitions(spark, monkeypatch):
    cells, docs, _ = small_corpus(spark)
    monkeypatch.setattr(session, "DOCUMENTS_PER_TASK", 1)
    res = P.map_documents(cells, docs)
    assert res.tasks == 8
    assert {df.rdd.getNumPartitions() for df in (res.mapping, res.conflicting, res.checked)} == {8}


def test_known_fits_give_the_same_corrections_and_are_not_sent_again(spark):
    cells, docs, _ = small_corpus(spark)
    res = P.map_documents(cells, docs)
    wrong = res.extracted.where("header is not null").withColumn("header", F.when(F.col("field") == "Nav", "no such column").otherwise(F.upper("header")))
    wrong = session.stored(wrong, "wrong")
    checked, corrections = S.validate_sections(wrong, res.header_cells, dims.aliases(spark))
    given = S.validate_sections(wrong.repartition(3, "doc_id"), res.header_cells, candidates=res.candidates.repartition(3, "doc_id"))
    assert corrections.count() > 0
    for a, b in zip((checked, corrections), given):
        assert sorted(a.collect(), key=str) == sorted(b.select(*a.columns).collect(), key=str)
    assert not re.search(r"hashpartitioning\(doc_id#\w+, section", plan(given[0]))


def test_header_stages_do_not_run_the_section_stages(spark, monkeypatch):
    cells, docs, _ = small_corpus(spark)
    names = []
    monkeypatch.setattr(P, "stored", lambda df, name: names.append(name) or session.stored(df, name))
    res = P.map_documents(cells, docs)
    assert res.detected.count() == 8 and "mapping-matches" not in names
    assert res.mapping.count() > 0 and res.candidates.count() > 0 and names.count("mapping-matches") == 1


def test_a_cell_fits_a_field_once_and_answers_are_read_once(spark):
    cells, docs, _ = small_corpus(spark)
    res = P.map_documents(cells, docs)
    keys = ["doc_id", "col_idx", "section", "field"]
    assert res.candidates.count() == res.candidates.select(*keys).distinct().count() > 0  # several spellings of a field equal a cell
    wrong = session.stored(res.extracted.where("header is not null").withColumn("header", F.upper("header")), "wrong")
    _, corrections = S.validate_sections(wrong.repartition(7, "doc_id"), res.header_cells, candidates=res.candidates.repartition(7, "doc_id"))
    sent = [x for x in plan(corrections).splitlines() if "Exchange hashpartitioning(doc_id" in x and "REPARTITION_BY_NUM" in x]
    assert len(sent) == 2  # the answers and the fits
