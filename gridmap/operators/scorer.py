"""User-supplied scorer hook: prompts -> answers with ``mapInPandas``.

The callable receives a pandas DataFrame batch (id + prompt columns) and
returns a Series of answer texts.  A client (if any) is created once per
partition by the callable's own closure; concurrency = number of partitions.
Calls are retried inside the task; a batch that still fails is scored row by
row, and a row that fails alone gets a null answer with the error text instead
of failing the job.  ``prompt_sha`` (hash of the prompt) tells which prompt an
answer belongs to.

Documents longer than a prompt's budget are scored in windows (``text_windows``,
``line_windows``), whose answers are merged (``merge_classes``); an answer store
(``stored_answers``) makes reruns call the scorer only for new prompts.
"""

from __future__ import annotations

import time
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridmap.functions import text as T
from gridmap.functions.parse import parse_class
from gridmap.plans import defaults as D
from gridmap.session import cut_lineage

ANSWER_SCHEMA = "prompt_sha string, answer string"
#: Lines of a document that are numbered together when running lengths are summed.
LINE_BUCKET = 1024


def score(prompts: DataFrame, fn: Callable[[pd.DataFrame], pd.Series], id_col: str = "doc_id",
          prompt_col: str = "prompt", retries: int = 2, backoff_s: float = 0.5) -> DataFrame:
    """(doc_id, prompt_sha, answer, error) of every prompt; ids keep their type."""
    src = prompts.select(F.col(id_col).alias("doc_id"), F.col(prompt_col).alias("prompt"),
                         F.sha2(F.col(prompt_col), 256).alias("prompt_sha"))

    def call(pdf):
        error = None
        for attempt in range(retries + 1):
            try:
                return list(fn(pdf[["doc_id", "prompt"]])), [None] * len(pdf)
            except Exception as e:  # noqa: BLE001 - any scorer failure is recorded, not raised
                error = f"{type(e).__name__}: {e}"
                time.sleep(backoff_s * (attempt + 1))
        if len(pdf) == 1:
            return [None], [error]
        parts = [call(pdf.iloc[k:k + 1]) for k in range(len(pdf))]
        return [a[0] for a, _ in parts], [e[0] for _, e in parts]

    def run(batches):
        for pdf in batches:
            if len(pdf):
                answers, errors = call(pdf)
                yield pd.DataFrame({"doc_id": pdf["doc_id"].to_numpy(), "prompt_sha": pdf["prompt_sha"].to_numpy(),
                                    "answer": answers, "error": errors})

    kind = src.schema["doc_id"].dataType.simpleString()
    return src.mapInPandas(run, f"doc_id {kind}, prompt_sha string, answer string, error string")


def stored_answers(prompts: DataFrame, fn: Callable[[pd.DataFrame], pd.Series], store: str, id_col: str = "doc_id",
                   prompt_col: str = "prompt", **kwargs) -> DataFrame:
    """(id, prompt_sha, answer, error) of every row of ``prompts``, each distinct prompt answered once ever.

    ``store`` is a folder of Parquet files (prompt_sha, answer) in shared storage.  Prompts whose hash is stored are not sent to the
    scorer; answers of the others are appended.  Failed prompts are not stored, so the next run asks them again; their ``error`` is
    returned.  A run that was cut off leaves what its finished tasks committed, or nothing, never half an answer.
    """
    spark = prompts.sparkSession
    asked = prompts.select(F.col(id_col).alias("doc_id"), F.col(prompt_col).alias("prompt"), F.sha2(F.col(prompt_col), 256).alias("prompt_sha"))
    known = _read_store(spark, store)
    new = asked.groupBy("prompt_sha").agg(F.any_value("prompt").alias("prompt"), F.min("doc_id").alias("doc_id"))  # the scorer sees one of its ids
    new = new if known is None else new.join(known, "prompt_sha", "left_anti")
    fresh = cut_lineage(score(new, fn, **kwargs).select("prompt_sha", "answer", "error"))
    fresh.where("answer is not null").select("prompt_sha", "answer").write.mode("append").parquet(store)
    failed = fresh.where("answer is null").select("prompt_sha", "error")
    known = _read_store(spark, store).dropDuplicates(["prompt_sha"])  # two runs at once may have asked the same
    return asked.join(known, "prompt_sha", "left").join(failed, "prompt_sha", "left").select("doc_id", "prompt_sha", "answer", "error")


def _read_store(spark, store: str) -> DataFrame | None:
    path = spark._jvm.org.apache.hadoop.fs.Path(store)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return None
    return spark.read.schema(ANSWER_SCHEMA).parquet(store)


def text_windows(docs: DataFrame, budget: Column, text_col: str = "text") -> DataFrame:
    """The columns of ``docs`` but its text, with window (from 0) and part: consecutive pieces of at most ``budget`` characters."""
    rest = [c for c in docs.columns if c != text_col]
    text, size = F.coalesce(F.col(text_col), F.lit("")), F.greatest(budget, F.lit(1)).cast("int")
    windows = F.sequence(F.lit(0), F.greatest(F.ceil(F.length(text) / size) - 1, F.lit(0)).cast("int"))
    return docs.select(*rest, text.alias("_t"), size.alias("_s"), F.explode(windows).alias("window")).select(
        *rest, "window", F.substring("_t", F.col("window") * F.col("_s") + 1, F.col("_s")).alias("part"))


def line_windows(lines: DataFrame, budget: DataFrame) -> DataFrame:
    """(doc_id, window, part): the lines of each document in windows of about ``budget`` characters (doc_id, budget), in order.

    A line belongs to the window in which it begins; no line is cut, so a part is at most a line longer than the budget.  Where a line
    begins is the sum of earlier lengths, over buckets of LINE_BUCKET lines and then inside a bucket: a sheet of any length is
    numbered by many tasks, and only one window's lines are ever gathered.
    """
    bucket = F.floor(F.col("line_no") / LINE_BUCKET)
    x = lines.select("doc_id", "line_no", "line", bucket.alias("_b"), (F.length("line") + 1).cast("long").alias("_n"))
    sums = x.groupBy("doc_id", "_b").agg(F.sum("_n").alias("_sum"))
    before = Window.partitionBy("doc_id").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("doc_id", "_b", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start")).join(budget.hint("shuffle_hash"), "doc_id")
    inside = Window.partitionBy("doc_id", "_b").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    placed = x.withColumn("_at", F.coalesce(F.sum("_n").over(inside), F.lit(0))).join(starts, ["doc_id", "_b"])
    window = F.floor((F.col("_start") + F.col("_at")) / F.greatest("budget", F.lit(1))).alias("window")
    gathered = F.array_sort(F.collect_list(F.struct("line_no", "line")))
    return (placed.select("doc_id", window, "line_no", "line").groupBy("doc_id", "window")
            .agg(F.array_join(F.transform(gathered, lambda r: r["line"]), "\n").alias("part")))


def merge_classes(answers: DataFrame, labels=D.CLASS_LABELS, none_label: str = D.NONE_LABEL) -> DataFrame:
    """One class for each document from the answers of its windows (columns doc_id, answer, error).

    Every answer is parsed by the class ladder; of the classes but ``none_label`` the one most windows name wins (ties by label order).
    doc_id, predicted_class, confidence (Medium for a class, else Low), n_windows, n_votes (windows that name the class), n_failed
    (windows without an answer), error (of one of them).
    """
    order = F.element_at(F.create_map(*[x for i, label in enumerate(labels) for x in (F.lit(label), F.lit(i))]), F.col("c"))
    told = answers.select("doc_id", "answer", "error", F.when(F.col("answer").isNotNull(), parse_class("answer", labels)["predicted_class"]).alias("c"))
    votes = told.groupBy("doc_id", "c").agg(F.count(F.lit(1)).alias("n"), F.max("error").alias("e"))
    real = F.col("c").isNotNull() & (F.col("c") != none_label)
    best = votes.groupBy("doc_id").agg(F.max(F.when(real, F.struct("n", (-order).alias("o"), "c"))).alias("b"), F.sum("n").alias("n_windows"),
                                       F.sum(F.when(F.col("c").isNull(), F.col("n")).otherwise(0)).alias("n_failed"), F.max("e").alias("error"))
    named = F.col("b").isNotNull()
    return best.select("doc_id", F.coalesce("b.c", F.lit(none_label)).alias("predicted_class"),
                       F.when(named, "Medium").otherwise("Low").alias("confidence"), "n_windows", F.coalesce("b.n", F.lit(0)).cast("long").alias("n_votes"),
                       "n_failed", "error")


def class_budget(doc_name: Column, max_tokens: int = D.CLASS_MAX_TOKENS, share: float = D.CLASS_CONTEXT_PCT) -> Column:
    """Characters of a document that fit into one class prompt beside the template and the name."""
    base = T.token_estimate(T.render(D.CLASS_PROMPT, doc_name=doc_name, question=F.lit("")))
    return (F.greatest(T.available_tokens(max_tokens, share, base), F.lit(1)) * 4).cast("long")


def class_prompts(windows: DataFrame) -> DataFrame:
    """(doc_id, window, prompt) from rows (doc_id, doc_name, window, part)."""
    prompt = T.render(D.CLASS_PROMPT, doc_name=F.col("doc_name"), question=F.coalesce("part", F.lit("")))
    return windows.select("doc_id", "window", prompt.alias("prompt"))
