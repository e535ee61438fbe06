"""Registered queries of the training-data operators (thin: operator call plus digest columns) and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridmap.llm import exact_dedup as dedup
from gridmap.llm import (conversation_repair, decontaminate, html_main, language_id, lm_scoring, near_dup, packing, periodic_runs,
                         quality_rules, sharding, token_output, toxicity)
from gridmap.llm.common import crc_bucket, prepare, read, sha256_hex
from gridmap.session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            prepare(spark)
            return fn(spark, sf_dir)
        run.__name__ = name
        QUERIES[name] = run
        if sql:
            ORACLE[name] = sql
        return run
    return deco


@query("op3_exact_dedup", """
WITH n AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM n WINDOW w AS (PARTITION BY t)""")
def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup.exact_dedup(read(spark, sf_dir, "documents", "doc_id", "text"), sha_col="text_sha256")
    return out.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


@query("op10_sharding")
def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.minimax_shards(read(spark, sf_dir, "documents", "doc_id", "text"), shards=40)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))


@query("op2_token_output")
def op2_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "llm-token-shards")
    token_output.write_shards(read(spark, sf_dir, "documents", "doc_id", "text"), path)
    return token_output.read_documents(spark, path)


@query("op8_best_fit_packing")
def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces(read(spark, sf_dir, "documents", "doc_id", "text")))


@query("op4_toxicity")
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    machine = toxicity.train(docs, read(spark, sf_dir, "labels", "doc_id", "toxic"), crc_bucket(F.col("id"), 3) != 1)
    return toxicity.score(docs, machine).select("doc_id", F.coalesce(crc_bucket(F.col("doc_id"), 3) == 1, F.lit(True)).alias("held_out"), "score", "predicted")


@query("op6_language_id")
def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text", "lang")
    filters = language_id.train(docs, crc_bucket(F.col("doc_id"), 4) != 2)
    out = language_id.identify(docs.drop("lang"), filters)
    return out.select("doc_id", F.coalesce(crc_bucket(F.col("doc_id"), 4) == 2, F.lit(True)).alias("held_out"), "lang_pred", "score")


@query("op7_html_main")
def op7_html_main(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_main.extract(read(spark, sf_dir, "pages", "page_id", "url", "html")).select("page_id", "url", "text", "n_chars")


@query("op5_minhash_near_dup")
def op5_minhash_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(read(spark, sf_dir, "documents", "doc_id", "text"), k=2)


@query("op9_decontamination")
def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = read(spark, sf_dir, "documents", "doc_id", "text"), read(spark, sf_dir, "benchmark", "item_id", "text")
    return decontaminate.contaminated(docs, items).withColumn("contaminated", F.lit(True))


@query("op1_lm_scoring")
def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    held_out = F.coalesce(crc_bucket(F.col("doc_id"), 5) == 1, F.lit(True))
    out = lm_scoring.score(docs, ~held_out)
    return out.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_subwords")


def periodic_damage(doc_id: Column, words: Column) -> Column:
    """Every tenth document (crc32 of its id) gets a periodic tail: word i >= a becomes word a + (i - a) % p."""
    h, n = F.crc32(doc_id.cast("string").cast("binary")), F.size(words).cast("long")
    g = F.floor(h / 10)
    a = g % n
    p = 1 + F.floor((n - a) / (3 + g % 8))
    copies = F.array_repeat(F.slice(words, (a + 1).cast("int"), p.cast("int")), F.ceil((n - a) / p).cast("int"))
    changed = F.slice(F.concat(F.slice(words, F.lit(1), a.cast("int")), F.flatten(copies)), F.lit(1), n.cast("int"))
    return F.when((h % 10 == 0) & (n > 0), changed)


@query("op11_periodic_runs")
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0
    damaged = docs.select("doc_id", "text", F.when(hit, words).alias("w"))
    damaged = damaged.select("doc_id", F.coalesce(F.array_join(periodic_damage(F.col("doc_id"), F.col("w")), " "), "text").alias("text"))
    found = periodic_runs.periodic_runs(damaged)
    best = F.aggregate("runs", F.get("runs", F.lit(0)), lambda best, r: F.when(r.length * best.period > best.length * r.period, r).otherwise(best))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r.start, r.length, r.period))
    listed = F.when(F.size(lines) > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n"))).otherwise("")
    out = found.select("doc_id", "runs", "collapsed", best.alias("best"), listed.alias("listed"))
    return out.select("doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
                      F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
                      sha256_hex(F.col("listed")).alias("runs_sha256"), sha256_hex(F.col("collapsed")).alias("collapsed_sha256"))


def damaged_turns(turns: DataFrame) -> DataFrame:
    """Rows of conversations with nulls as one space and a fault in every fourth row, by crc32 of ``conv_id:turn`` modulo 20."""
    key = F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    hit = F.crc32(key.cast("binary")) % 20
    text = F.when(hit == 1, "").when(hit == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(hit == 4, "user").otherwise(F.col("role"))
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    rows = rows.where(hit != 0).select("conv_id", "turn", role.alias("role"), text.alias("text"), hit.alias("hit"))
    again = F.explode(F.when(F.col("hit") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", "role", "text", again.alias("copy")).drop("copy")


@query("op13_conversation_repair")
def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    found = conversation_repair.reports(damaged_turns(turns)).withColumnRenamed("conv_id", "c")
    every = turns.select("conv_id").distinct()
    out = every.join(found, F.col("conv_id").eqNullSafe(F.col("c")), "left")
    counts = [F.coalesce(n, F.lit(0).cast("long")).alias(n) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("repaired_sha256", sha256_hex(F.lit(""))).alias("repaired_sha256"))


@query("op12_quality_rules")
def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    ensemble = quality_rules.train(docs, read(spark, sf_dir, "labels", "doc_id", "quality"), crc_bucket(F.col("id"), 3) != 1)
    held_out = F.coalesce(crc_bucket(F.col("doc_id"), 3) == 1, F.lit(True))
    return quality_rules.score(docs, ensemble).select("doc_id", held_out.alias("held_out"), "score", "predicted")
