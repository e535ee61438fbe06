"""Tables that grow with the documents never go through the driver: stored, they compress to so few bytes that Spark would broadcast millions of rows."""

import re

from gridmap import session
from gridmap.operators import headers as H
from gridmap.plans import pipeline as P
from gridmap.plans import queries_pipeline as QP
from gridmap.plans import results as R
from test_pipeline import small_corpus


def broadcast_by_document(df):
    return re.findall(r"BroadcastHashJoin \[doc_id#.*", df._jdf.queryExecution().executedPlan().toString())


def test_section_stages_broadcast_no_table_of_documents(spark, monkeypatch):
    cells, docs, _ = small_corpus(spark)
    found = {}

    def stored(df, name):
        found[name] = broadcast_by_document(df)
        return session.stored(df, name)

    monkeypatch.setattr(P, "stored", stored)
    res = P.map_documents(cells, docs)
    answers = QP._mistaken(res.extracted, res.header_cells)
    for name in ("mapping", "corrections", "checked", "conflicting", "extracted", "validated"):
        found[name] = broadcast_by_document(getattr(res, name))
    found |= {"answers": broadcast_by_document(answers), "results": broadcast_by_document(R.assemble(res, docs)),
              "context": broadcast_by_document(H.context_struct(res.context, docs))}
    names = ["mapping-header-cells", "mapping-matches", "mapping", "corrections", "checked", "conflicting", "extracted", "validated", "answers", "results", "context"]
    assert {n: found[n] for n in names} == {n: [] for n in names}
