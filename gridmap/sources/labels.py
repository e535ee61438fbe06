"""JSON label files, typed configuration files and structured answers.

Bad inputs never fail the job: unparsable rows are kept with a flag and go to
the quarantine table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridmap.functions.text import col_

INVALID_JSON = "INVALID_JSON"
CONFIG_MISSING_KEY = "CONFIG_MISSING_KEY"
CONFIG_BAD_TYPE = "CONFIG_INVALID_TYPE"


def parse_structured(df: DataFrame, json_col: str, schema: str) -> DataFrame:
    """Add ``parsed`` (struct of ``schema``) and ``is_valid`` (the text is JSON at all)."""
    return df.withColumn("parsed", F.from_json(col_(json_col), schema)) \
             .withColumn("is_valid", F.try_parse_json(col_(json_col)).isNotNull())


def read_json_files(spark: SparkSession, path: str) -> DataFrame:
    """Whole-file text of every ``*.json`` under ``path`` as (path, text, doc)."""
    raw = spark.read.option("pathGlobFilter", "*.json").text(path, wholetext=True)
    return raw.select(F.input_file_name().alias("path"), F.col("value").alias("text")) \
              .withColumn("doc", F.try_parse_json("text"))


def label_rows(files: DataFrame) -> DataFrame:
    """Label file -> (path, section, item_idx, field, value).

    A section is an object of field -> header or a list of such objects;
    both shapes become long rows (item_idx 0 for objects).
    """
    ok = files.where(F.col("doc").isNotNull())
    sec = ok.select("path", F.explode(F.from_json(F.to_json("doc"), "map<string,string>")).alias("section", "_v"))
    as_list = F.from_json("_v", "array<map<string,string>>")
    as_obj = F.from_json("_v", "map<string,string>")
    items = sec.select("path", "section",
                       F.when(F.startswith(F.ltrim("_v"), F.lit("[")), as_list)
                        .otherwise(F.array(as_obj)).alias("_items"))
    return (items.select("path", "section", F.posexplode("_items").alias("item_idx", "_m"))
                 .select("path", "section", "item_idx", F.explode("_m").alias("field", "value")))


def bad_files(files: DataFrame) -> DataFrame:
    return files.where(F.col("doc").isNull()).select(
        F.col("path").alias("doc_id"), F.lit("labels").alias("stage"), F.lit(INVALID_JSON).alias("code"),
        F.lit("file is not valid JSON").alias("message"), F.lit("WARNING").alias("severity"))


APP_CONFIG_SCHEMA = ("input_dir string, output_dir string, start_row int, end_row int, all_sheets boolean, "
                     "include_header_examples_in_prompt boolean, enable_deduplication_agent boolean, "
                     "classification_prompt string, classification_validation_prompt string, "
                     "classification_labels array<string>, "
                     "classification_model struct<model_name:string, max_tokens:int, context_window_percentage:double>")
# Defaults of the application configuration.
APP_DEFAULTS = {"input_dir": "input", "output_dir": "json_outputs", "start_row": 0, "end_row": 15,
                "all_sheets": False, "include_header_examples_in_prompt": True, "enable_deduplication_agent": True}


def read_configs(spark: SparkSession, path: str, schema: str = APP_CONFIG_SCHEMA) -> DataFrame:
    """Typed read of configuration files (see ``parse_configs``)."""
    raw = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))
    return parse_configs(raw, schema)


def parse_configs(raw: DataFrame, schema: str = APP_CONFIG_SCHEMA) -> DataFrame:
    """Configuration texts (path, text) as typed rows with defaults filled and problems coded.

    ``status``: OK, INVALID_JSON (not parsable), CONFIG_INVALID_TYPE (a key
    is present but does not fit its declared type).
    """
    typed = raw.withColumn("cfg", F.from_json("text", schema)).withColumn("_j", F.try_parse_json("text"))
    cols = [F.coalesce(F.col(f"cfg.{k}"), F.lit(v)).alias(k) for k, v in APP_DEFAULTS.items()]
    bad_type = F.lit(False)
    for k in APP_DEFAULTS:
        present = F.try_variant_get("_j", f"$.{k}", "string").isNotNull()
        bad_type = bad_type | (present & F.col(f"cfg.{k}").isNull())
    status = (F.when(F.col("_j").isNull(), F.lit(INVALID_JSON))
               .when(bad_type, F.lit(CONFIG_BAD_TYPE)).otherwise(F.lit("OK")))
    return typed.select("path", *cols, F.col("cfg.classification_labels").alias("classification_labels"),
                        status.alias("status"))


def read_prompts(spark: SparkSession, path: str) -> DataFrame:
    """Prompt templates: every ``*.md`` under ``path`` as (name, template); a small, broadcastable table."""
    raw = (spark.read.option("pathGlobFilter", "*.md").text(path, wholetext=True)
                .select(F.input_file_name().alias("path"), F.col("value").alias("template")))
    return F.broadcast(prompt_table(raw))


def prompt_table(files: DataFrame) -> DataFrame:
    """(name, template) of the ``*.md`` files among (path, template)."""
    return files.where(F.col("path").endswith(".md")).select(F.regexp_extract("path", "([^/]+)$", 1).alias("name"), "template")


def missing_prompts(required: DataFrame, prompts: DataFrame) -> DataFrame:
    """Required template names without a file: PROMPT_FILE_NOT_FOUND rows."""
    return required.join(prompts, "name", "left_anti").select(
        "name", F.lit("PROMPT_FILE_NOT_FOUND").alias("code"))
