"""Label profiling: header vocabulary (as text, for prompts) and completeness.

Labels are long rows (doc_id, section, field, value).  ``structures`` has the
vocabulary as rows, for keys with any number of values, and merges nested
label documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridmap.functions import text as T


def sorted_distinct_text(col: str, sep: str = ", ") -> F.Column:
    """Distinct values sorted case-insensitively (then by value), joined with ``sep``."""
    arr = F.array_sort(F.collect_set(F.struct(F.lower(F.col(col)).alias("k"), F.col(col).alias("v"))))
    return F.array_join(F.transform(arr, lambda x: x["v"]), sep)


def value_vocabulary(labels: DataFrame, keys=("section", "field")) -> DataFrame:
    """Distinct non-empty values per key, sorted case-insensitively."""
    ok = labels.where(~T.is_blank("value"))
    return (ok.groupBy(*keys)
              .agg(F.count_distinct("value").alias("n_values"), sorted_distinct_text("value").alias("values")))


def completeness(slots: DataFrame) -> DataFrame:
    """Share of blank fields per (doc, section); null counts as blank."""
    blank = F.when(T.is_blank("value"), 1).otherwise(0)
    return (slots.groupBy("doc_id", "section")
                 .agg(F.count(F.lit(1)).alias("n_fields"), F.sum(blank).cast("bigint").alias("n_blank"))
                 .withColumn("blank_share", F.col("n_blank") / F.col("n_fields")))
