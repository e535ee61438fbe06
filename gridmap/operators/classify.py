"""Deterministic class scorer, class validation, early exit and agreement.

Scoring is a keyword join: text -> tokens (explode) -> equi-join with the
broadcast term table -> partial aggregate per (doc, label).  Tokens that hit
no term are dropped map-side, so only (doc, label) partial sums are shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridmap.functions.parse import class_answer
from gridmap.functions.text import col_
from gridmap.plans import defaults as D

TOKEN_SPLIT_RE = "[^\\p{L}\\p{N}]+"


def tokens(df: DataFrame, text_col: str, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, token): lower-cased letter/digit runs of a text column."""
    return (df.select(F.col(id_col).alias("doc_id"),
                      F.explode(F.split(F.lower(col_(text_col)), TOKEN_SPLIT_RE)).alias("token"))
              .where(F.col("token") != ""))


def score_confidence(score) -> F.Column:
    s = col_(score)
    return F.when(s >= 4, F.lit("High")).when(s >= 2, F.lit("Medium")).otherwise(F.lit("Low"))


def source_scores(name_toks: DataFrame | None, content_toks: DataFrame, terms: DataFrame) -> DataFrame:
    """(doc_id, label, label_ord, s_name, s_content, s_all): one aggregation for every class stage."""
    parts = content_toks.withColumn("_src", F.lit(1))
    if name_toks is not None:
        parts = parts.unionByName(name_toks.withColumn("_src", F.lit(0)))
    hits = parts.join(F.broadcast(terms), F.col("token") == F.col("term"))
    return (hits.groupBy("doc_id", "label", "label_ord")
                .agg(F.sum(F.when(F.col("_src") == 0, F.col("weight")).otherwise(0)).cast("bigint").alias("s_name"),
                     F.sum(F.when(F.col("_src") == 1, F.col("weight")).otherwise(0)).cast("bigint").alias("s_content"))
                .withColumn("s_all", F.col("s_name") + F.col("s_content")))


def _best(score_col: str):
    """(label, score) of the best-scoring label among labels with score > 0; label order breaks ties."""
    s = F.col(score_col)
    key = F.when(s > 0, F.struct(s.alias("s"), (-F.col("label_ord")).alias("o")))
    return F.max_by(F.when(s > 0, F.col("label")), key), F.max(F.when(s > 0, s))


def class_decisions(docs: DataFrame, scores: DataFrame) -> DataFrame:
    """Both class stages from one score table (no re-scan of the text).

    * first answer (class scorer): best label on name + content tokens;
    * validation: best label on the name and on the content separately;
      both agree -> High, one agrees -> Medium, none -> Low; when neither
      agrees the content's (else the name's) best label replaces the class.
    """
    a_l, a_s = _best("s_all")
    n_l, _ = _best("s_name")
    c_l, _ = _best("s_content")
    per_doc = scores.groupBy("doc_id").agg(a_l.alias("label"), a_s.alias("score"),
                                           n_l.alias("name_label"), c_l.alias("content_label"))
    j = docs.select("doc_id").join(per_doc, "doc_id", "left")
    cls = F.coalesce(F.col("label"), F.lit(D.NONE_LABEL))
    score = F.coalesce(F.col("score"), F.lit(0)).cast("bigint")
    conf = F.when(F.col("label").isNull(), F.lit("Low")).otherwise(score_confidence(score))
    a_n = F.coalesce(F.col("name_label") == cls, F.lit(False))
    a_c = F.coalesce(F.col("content_label") == cls, F.lit(False))
    n_agree = a_n.cast("int") + a_c.cast("int")
    validated = F.when(a_n | a_c, cls).otherwise(
        F.coalesce(F.col("content_label"), F.col("name_label"), F.lit(D.NONE_LABEL)))
    reason = F.concat(F.lit("name suggests "), F.coalesce(F.col("name_label"), F.lit("nothing")),
                      F.lit("; content suggests "), F.coalesce(F.col("content_label"), F.lit("nothing")), F.lit("."))
    return j.select("doc_id", cls.alias("predicted_class"), score.alias("score"), conf.alias("confidence"),
                    class_answer(cls, conf).alias("answer"),
                    validated.alias("validated_class"),
                    F.when(n_agree == 2, F.lit("High")).when(n_agree == 1, F.lit("Medium"))
                     .otherwise(F.lit("Low")).alias("validation_confidence"),
                    reason.alias("validation_reason"))


def classify_docs(docs: DataFrame, toks: DataFrame, terms: DataFrame) -> DataFrame:
    """Rule class scorer: (doc_id, predicted_class, score, confidence, answer).

    Documents without any term hit are 'None of those' with score 0.
    """
    d = class_decisions(docs, source_scores(None, toks, terms))
    return d.select("doc_id", "predicted_class", "score", "confidence", "answer")


def validate_class(docs: DataFrame, name_toks: DataFrame, content_toks: DataFrame, terms: DataFrame) -> DataFrame:
    """First answer plus its validation from name and content scored separately."""
    d = class_decisions(docs, source_scores(name_toks, content_toks, terms))
    return d.select("doc_id", F.col("predicted_class").alias("first_class"), "validated_class",
                    F.col("validation_confidence").alias("confidence"), "validation_reason")


def early_exit(classified: DataFrame, class_col: str = "validated_class"):
    """Split into (to_process, finished): 'None of those' documents stop here."""
    is_none = F.col(class_col) == F.lit(D.NONE_LABEL)
    return classified.where(~is_none), classified.where(is_none)


def agreement_route(first: DataFrame, second: DataFrame) -> DataFrame:
    """Per document: 'ready' when both class stages agree, else 'human check'."""
    j = first.select("doc_id", F.col("predicted_class").alias("class_a")).join(
        second.select("doc_id", F.col("predicted_class").alias("class_b")), "doc_id")
    return j.withColumn("route", F.when(F.col("class_a") == F.col("class_b"), F.lit("ready"))
                        .otherwise(F.lit("human check")))


def agreement_rate(routes: DataFrame) -> DataFrame:
    """Agreement share overall and per first-stage class (grouping sets)."""
    return (routes.groupBy("class_a")
                  .agg(F.count(F.lit(1)).alias("n_docs"),
                       F.avg(F.when(F.col("route") == "ready", 1.0).otherwise(0.0)).alias("agreement_rate")))
