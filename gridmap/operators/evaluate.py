"""Evaluation and run statistics: per-class F1, weighted F1, run summaries, error summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def class_f1(pairs: DataFrame, true_col: str = "y_true", pred_col: str = "y_pred") -> DataFrame:
    """Per class: support, predicted, tp, precision, recall, f1.

    One pass: every (true, pred) pair contributes a support row for its true
    class and a prediction row for its predicted class; a single aggregation
    by class (partial sums map-side) gives all counts, no join.
    """
    t, p = F.col(true_col), F.col(pred_col)
    roles = F.array(F.struct(t.alias("cls"), F.lit(1).alias("s"), F.lit(0).alias("q"),
                             F.when(t == p, 1).otherwise(0).alias("tp")),
                    F.struct(p.alias("cls"), F.lit(0).alias("s"), F.lit(1).alias("q"), F.lit(0).alias("tp")))
    x = pairs.select(F.explode(roles).alias("r")).select("r.*")
    j = x.groupBy("cls").agg(F.sum("s").cast("bigint").alias("support"), F.sum("q").cast("bigint").alias("predicted"),
                             F.sum("tp").cast("bigint").alias("tp"))
    prec = F.when(F.col("predicted") > 0, F.col("tp") / F.col("predicted")).otherwise(F.lit(0.0))
    rec = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(F.lit(0.0))
    j = j.select("cls", "support", "predicted", "tp", prec.alias("precision"), rec.alias("recall"))
    f1 = F.when(F.col("precision") + F.col("recall") > 0,
                F.lit(2.0) * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))) \
          .otherwise(F.lit(0.0))
    return j.withColumn("f1", f1)


def weighted_f1(per_class: DataFrame) -> DataFrame:
    """Support-weighted F1, macro F1 and accuracy in one row (rounded to 10 places)."""
    return per_class.agg(
        F.round(F.sum(F.col("f1") * F.col("support")) / F.sum("support"), 10).alias("weighted_f1"),
        F.round(F.avg("f1"), 10).alias("macro_f1"),
        F.round(F.sum("tp") / F.sum("support"), 10).alias("accuracy"),
        F.sum("support").cast("bigint").alias("n"))


def run_records(events: DataFrame) -> DataFrame:
    """Event rows seen as processing records: file, sheet, duration, success, fields extracted."""
    k = F.from_json("props", "k int")["k"]
    return events.select(F.concat(F.lit("file_"), F.col("user_id").cast("string")).alias("file"),
                         F.col("event_type").alias("sheet"),
                         F.col("value").cast("decimal(18,2)").alias("duration"),
                         (F.col("event_type") != "error").alias("success"),
                         F.coalesce(k, F.lit(0)).alias("fields_extracted"))


def run_by_file(records: DataFrame, keys=("file",)) -> DataFrame:
    return (records.groupBy(*keys)
                   .agg(F.count(F.lit(1)).alias("n_runs"),
                        F.sum(F.col("success").cast("int")).cast("bigint").alias("n_success"),
                        F.sum(F.col("duration")).cast("double").alias("total_duration"),
                        F.sum("fields_extracted").cast("bigint").alias("fields_extracted")))


def run_summary(by_file: DataFrame, planned_files: int | None = None) -> DataFrame:
    """Totals over files: a file succeeded when all its runs did."""
    ok = F.col("n_success") == F.col("n_runs")
    s = by_file.agg(F.count(F.lit(1)).alias("total_files"),
                    F.sum(ok.cast("int")).cast("bigint").alias("success_count"),
                    F.sum((~ok).cast("int")).cast("bigint").alias("error_count"),
                    F.sum("fields_extracted").cast("bigint").alias("total_fields_extracted"),
                    F.sum(F.col("total_duration").cast("decimal(38,2)")).cast("double").alias("total_duration"),
                    F.sum(F.when(ok, F.col("fields_extracted")).otherwise(0)).cast("bigint").alias("_fs"))
    out = s.select("total_files", "success_count", "error_count",
                   F.when(F.col("total_files") > 0, F.col("success_count") / F.col("total_files") * 100.0)
                    .otherwise(F.lit(0.0)).alias("success_rate"),
                   "total_fields_extracted",
                   F.when(F.col("success_count") > 0, F.col("_fs") / F.col("success_count"))
                    .otherwise(F.lit(0.0)).alias("avg_fields_per_success"),
                   "total_duration",
                   F.when(F.col("total_files") > 0, F.col("total_duration") / F.col("total_files"))
                    .otherwise(F.lit(0.0)).alias("avg_file_seconds"))
    if planned_files is not None:
        out = out.withColumn("eta_seconds", F.greatest(F.lit(0), F.lit(planned_files) - F.col("total_files"))
                             * F.col("avg_file_seconds"))
    return out


def error_records(events: DataFrame) -> DataFrame:
    """Error events as error rows: stage by duration band, code PIPELINE_<STAGE>, severity by payload."""
    k = F.from_json("props", "k int")["k"]
    v = F.col("value")
    stage = F.when(v < 10, F.lit("header")).when(v < 100, F.lit("sections")).when(v < 400, F.lit("config")) \
             .otherwise(F.lit(None))
    code = F.when(stage.isNull(), F.lit("UNHANDLED_ERROR")).otherwise(F.concat(F.lit("PIPELINE_"), F.upper(stage)))
    return events.where(F.col("event_type") == "error").select(
        F.col("event_id").alias("doc_id"), F.coalesce(stage, F.lit("unknown")).alias("stage"), code.alias("code"),
        F.when(k >= 50, F.lit("ERROR")).otherwise(F.lit("WARNING")).alias("severity"))


def error_summary(errors: DataFrame) -> DataFrame:
    return errors.groupBy("stage", "code", "severity").agg(F.count(F.lit(1)).alias("n_errors"))


def mapping_scores(pred: DataFrame, truth: DataFrame) -> DataFrame:
    """Per (section, field): support (true headers), predicted (non-null answers), tp (exact matches)."""
    k = ["doc_id", "section", "field"]
    j = pred.select(*k, F.col("header").alias("_p")).join(truth.select(*k, F.col("header").alias("_t")), k, "full")
    return (j.groupBy("section", "field")
             .agg(F.sum(F.col("_t").isNotNull().cast("int")).cast("bigint").alias("support"),
                  F.sum(F.col("_p").isNotNull().cast("int")).cast("bigint").alias("predicted"),
                  F.sum((F.col("_p").isNotNull() & (F.col("_p") == F.col("_t"))).cast("int")).cast("bigint")
                  .alias("tp")))
