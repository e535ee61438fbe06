import __spark_entry__ as E


def test_registry_consistent():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 80


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert set(df.columns) == {"doc_id", "section", "field", "header", "confidence", "source"}
    assert df.count() > 0


def test_oracle_matches_for_sample_queries(spark):
    import duckdb
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ["documents", "lineitem", "orders", "customer"]:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    for name in ["fallback_header", "format_cells", "resolve_conflicts", "parse_class", "map_documents"]:
        s = sorted(tuple(str(v) for v in r) for r in E.queries()[name](spark, sf).collect())
        cur = con.execute(E.oracle_sql()[name])
        d = sorted(tuple(str(v) for v in r) for r in cur.fetchall())
        assert len(s) == len(d), name
