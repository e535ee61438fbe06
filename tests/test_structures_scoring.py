"""Nested labels, ordered vocabularies, whole-document scoring with an answer store, repeated uploads, damaged XML."""

import json
import random

import pandas as pd
from pyspark.sql import functions as F

from gridmap.operators import scorer as SC
from gridmap.operators import structures as ST
from gridmap.plans import defaults as D
from gridmap.sources import xml as X
from gridmap.streaming.ingest import first_uploads, ingest_folder, run_batches


def plain_leaves(v, path="", place=""):
    if isinstance(v, dict) and v:
        for k, x in v.items():
            yield from plain_leaves(x, f"{path}.{k}" if path else k, place)
    elif isinstance(v, list) and v:
        for i, x in enumerate(v):
            yield from plain_leaves(x, path + "[]", f"{place}.{i}" if place else str(i))
    else:
        kind = "empty" if v in ({}, []) and not isinstance(v, bool) else "null" if v is None else "boolean" if isinstance(v, bool) else \
            "string" if isinstance(v, str) else "number"
        yield path, place, kind, None if kind in ("empty", "null") else str(v).lower() if kind == "boolean" else str(v)


def random_json(rnd, depth):
    kind = rnd.randrange(7) if depth else rnd.randrange(2, 7)
    if kind == 0:
        return {rnd.choice("abcd"): random_json(rnd, depth - 1) for _ in range(rnd.randrange(4))}
    if kind == 1:
        return [random_json(rnd, depth - 1) for _ in range(rnd.randrange(4))]
    return rnd.choice([None, True, False, 7, 12, "x", "Y", "", "y z"])


def test_any_nesting_is_walked(spark):
    rnd = random.Random(4)
    docs = {i: random_json(rnd, 5) for i in range(120)}
    rows = [(i, json.dumps(v)) for i, v in docs.items()] + [(900, "{broken"), (901, None)]
    got = ST.walk_json(spark.createDataFrame(rows, "id long, doc string").repartition(3), ["id"], "doc")
    want = sorted((i, *leaf) for i, v in docs.items() for leaf in plain_leaves(v))
    assert sorted(map(tuple, got.select("id", "path", "place", "kind", F.coalesce("value", F.lit("-"))).collect())) == sorted(
        (i, p, q, k, "-" if v is None else v) for i, p, q, k, v in want)


def test_merged_structures(spark):
    docs = [("A", '{"s":{"f":"b","g":null},"l":[{"x":1},{"x":2,"y":" "}],"v":["q","P"]}'), ("A", '{"s":{"f":"a"},"v":"q","w":{"z":[]}}'), ("B", '{"s":"t"}')]
    merged = ST.merge_structures(spark.createDataFrame(docs, "g string, doc string"), ["g"], "doc")
    got = sorted((r.g, r.path, r.position, r.value) for r in merged.collect())
    assert got == [("A", "l[].x", 0, "1"), ("A", "l[].x", 1, "2"), ("A", "s.f", 0, "a"), ("A", "s.f", 1, "b"), ("A", "v", 0, "q"), ("A", "v[]", 0, "P"),
                   ("A", "v[]", 1, "q"), ("B", "s", 0, "t")]
    shown = {r.g: json.loads(r.json) for r in ST.vocabulary_json(merged, ["g"], 1).collect()}
    assert shown == {"A": {"l[].x": ["1"], "s.f": ["a"], "v": ["q"], "v[]": ["P"]}, "B": {"s": ["t"]}}


def test_positions_of_a_key_with_many_values(spark):
    hot = spark.range(60_000).select(F.lit("hot").alias("k"), F.concat(F.lit("v"), F.lpad((F.col("id") % 50_000).cast("string"), 6, "0")).alias("value"))
    few = spark.createDataFrame([("few", "b"), ("few", "A"), ("few", "a"), ("few", " "), (None, "n"), ("few", None)], "k string, value string")
    out = ST.ordered_distinct(hot.union(few).repartition(6), ["k"])
    assert out.where("k = 'hot'").count() == 50_000
    assert out.where("k = 'hot' and value <> concat('v', lpad(cast(position as string), 6, '0'))").count() == 0
    assert sorted((r.k or "", r.position, r.value) for r in out.where("k is null or k = 'few'").collect()) == [("", 0, "n"), ("few", 0, "A"), ("few", 1, "a"), ("few", 2, "b")]


def asked_counter(log):
    def fn(pdf):
        with open(log, "a") as f:
            f.write("x\n" * len(pdf))
        if pdf["prompt"].str.contains("broken").any():
            raise ValueError("down")
        return pd.Series(["<class>" + ("Bonds" if "bond" in p else "ETF" if "etf" in p else "None of those") + "</class>" for p in pdf["prompt"]])
    return fn


def test_answers_are_asked_once(spark, tmp_path):
    log, store = tmp_path / "log", str(tmp_path / "store")
    log.write_text("")
    prompts = spark.createDataFrame([(1, "a bond"), (2, "an etf"), (3, "a bond"), (4, "broken")], "doc_id long, prompt string").repartition(2)
    first = {r.doc_id: (r.answer, r.error) for r in SC.stored_answers(prompts, asked_counter(log), store, retries=0, backoff_s=0).collect()}
    assert first[1] == first[3] == ("<class>Bonds</class>", None) and first[4] == (None, "ValueError: down")
    log.write_text("")
    again = {r.doc_id: r.answer for r in SC.stored_answers(prompts.where("doc_id < 4"), asked_counter(log), store).collect()}
    assert again == {1: "<class>Bonds</class>", 2: "<class>ETF</class>", 3: "<class>Bonds</class>"} and log.read_text() == ""
    SC.stored_answers(prompts, asked_counter(log), store, retries=0, backoff_s=0).collect()
    assert log.read_text().count("x") == 1  # only the one that failed


def test_windows_hold_whole_texts(spark):
    docs = spark.createDataFrame([(1, "abcdefgh" * 10), (2, ""), (3, None), (4, "é" * 7)], "doc_id long, text string")
    parts = {}
    for r in SC.text_windows(docs, F.lit(7)).orderBy("doc_id", "window").collect():
        parts.setdefault(r.doc_id, []).append(r.part)
    assert "".join(parts[1]) == "abcdefgh" * 10 and max(map(len, parts[1])) == 7 and parts[2] == [""] == parts[3] and parts[4] == ["é" * 7]
    rnd = random.Random(2)
    lines = {d: ["x" * rnd.randrange(30) for _ in range(n)] for d, n in ((1, 5000), (2, 1), (3, 40))}
    df = spark.createDataFrame([(d, i, t) for d, ts in lines.items() for i, t in enumerate(ts)], "doc_id long, line_no int, line string").repartition(5)
    budget = spark.createDataFrame([(1, 400), (2, 400), (3, 1)], "doc_id long, budget long")
    got = {}
    for r in SC.line_windows(df, budget).orderBy("doc_id", "window").collect():
        got.setdefault(r.doc_id, []).append(r.part)
    assert {d: "\n".join(p) for d, p in got.items()} == {d: "\n".join(ts) for d, ts in lines.items()}
    assert max(map(len, got[1])) < 430 and len(got[3]) == 40


def test_classes_of_windows_are_merged(spark):
    say = lambda c: f"<class>{c}</class>"
    rows = [(1, say("Bonds"), None), (1, say("ETF"), None), (1, say("ETF"), None), (2, say(D.NONE_LABEL), None), (2, say("Stocks"), None), (3, say("Bonds"), None),
            (3, say("ETF"), None), (4, None, "E"), (4, say("Index"), None), (5, None, "E"), (6, say(D.NONE_LABEL), None)]
    got = {r.doc_id: (r.predicted_class, r.confidence, r.n_windows, r.n_votes, r.n_failed) for r in
           SC.merge_classes(spark.createDataFrame(rows, "doc_id long, answer string, error string")).collect()}
    assert got == {1: ("ETF", "Medium", 3, 2, 0), 2: ("Stocks", "Medium", 2, 1, 0), 3: ("ETF", "Medium", 2, 1, 0), 4: ("Index", "Medium", 2, 1, 1),
                   5: (D.NONE_LABEL, "Low", 1, 0, 1), 6: (D.NONE_LABEL, "Low", 1, 0, 0)}


def test_an_upload_in_two_triggers_counts_once(spark, tmp_path):
    src, out, ckpt = str(tmp_path / "src"), str(tmp_path / "out"), str(tmp_path / "ckpt")

    def upload(rows, day):
        df = spark.createDataFrame([(n, c.encode()) for n, c in rows], "doc_name string, content binary").coalesce(1)
        df.withColumn("uploaded_at", F.lit(f"2024-01-{day} 00:00:00").cast("timestamp")).write.mode("append").parquet(src)

    def run(horizon=None, where=(out, ckpt)):
        stream = spark.readStream.schema("doc_name string, content binary, uploaded_at timestamp").option("maxFilesPerTrigger", 1).parquet(src)
        path = run_batches(first_uploads(stream, horizon).select("doc_name", "sha256"), *where)
        return sorted(r.doc_name for r in spark.read.parquet(path).collect())

    upload([("a", "1"), ("b", "2"), ("a", "1")], "01")
    upload([("a", "1"), ("c", "3")], "02")
    assert run() == ["a", "b", "c"]
    upload([("b", "2"), ("b", "changed")], "03")  # after a restart from the checkpoint
    assert run() == ["a", "b", "b", "c"]
    assert run() == ["a", "b", "b", "c"]
    assert run("30 days", (str(tmp_path / "out2"), str(tmp_path / "ckpt2"))) == ["a", "b", "b", "c"]


def test_repeated_files_are_ingested_once(spark, tmp_path):
    src, out, ckpt = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "ck")
    (src / "x").mkdir(parents=True)
    (src / "x" / "a.csv").write_text("1,2\n")
    ingest_folder(spark, str(src), out, ckpt, files_per_batch=1)
    (src / "y").mkdir()
    (src / "y" / "a.csv").write_text("1,2\n")
    (src / "y" / "b.csv").write_text("1,2\n")
    ingest_folder(spark, str(src), out, ckpt, files_per_batch=1)
    assert sorted(r.base for r in spark.read.parquet(out).collect()) == ["a.csv", "b.csv"]


def test_a_damaged_record_costs_one_row(spark, tmp_path):
    records = ["<row><a>1</a><b>x &amp; y</b></row>", "<row><a>2</a><b>open", "<row id='3'><a>3</a></row>", "<row><a>4</b></a></row>", "<row/>",
               "<row><a>no number</a><b>t</b></row>", "<row><a>6</a><b>é</b></row>"]
    text = "<?xml version='1.0'?>\n<rows>\n" + "\n".join(records) + "\n</rows>\n"
    (tmp_path / "f.xml").write_text(text, encoding="utf-8")
    found = X.read_records(spark, str(tmp_path), "row").collect()
    raw = text.encode()
    assert len(found) == 7 and all(raw[r.start_byte:r.end_byte].decode() == r.record for r in found)
    rows, damaged = X.recover_rows(spark, str(tmp_path), "row", "a long, b string")
    assert sorted((r.a or 0, r.b or "") for r in rows.collect()) == [(0, ""), (1, "x & y"), (3, ""), (6, "é")]
    bad = {r.record[:11]: r.code for r in damaged.collect()}
    assert bad == {"<row><a>2</": X.NO_END, "<row><a>4</": X.MALFORMED, "<row><a>no ": X.MALFORMED}


def test_records_of_a_split_file(spark, tmp_path):
    (tmp_path / "f.xml").write_text("<rows>" + "".join(f"<row><a>{i}</a><b>{'z' * (i % 90)}</b></row>" for i in range(20_000)) + "</rows>")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        rows, damaged = X.recover_rows(spark, str(tmp_path), "row", "a long, b string")
        assert X.read_records(spark, str(tmp_path), "row", offsets=False).rdd.getNumPartitions() > 3
        assert rows.select(F.sum("a"), F.count("a")).first() == (199_990_000, 20_000) and damaged.isEmpty()
        raw = (tmp_path / "f.xml").read_bytes()
        got = X.read_records(spark, str(tmp_path), "row").where("start_byte % 97 = 0").collect()
        assert len(got) > 50 and all(raw[r.start_byte:r.end_byte].decode() == r.record for r in got)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
