"""XML records from large files, one damaged record at a time.

A file is cut at every start tag of a record, so the reader finds its footing again at the next record whatever
is wrong with the one before: a missing end tag, tags out of order, a stray character.  Spark's text source does the
cutting and splits long files over tasks.  Each record is then parsed on its own by ``from_xml``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

NO_END, MALFORMED = "XML_RECORD_NOT_CLOSED", "XML_RECORD_MALFORMED"
_CORRUPT = "_corrupt"


def read_records(spark: SparkSession, path: str, row_tag: str, offsets: bool = True) -> DataFrame:
    """(path, start_byte, end_byte, record, closed) of every record element under ``path``.

    ``record`` is the element's text from its start tag to its end tag (``closed``), or, where the end tag is missing, up to the next
    record.  Bytes count from the start of the file: lengths are summed inside each split of a file, then over the file's splits.
    What stands before the first record or between records is left out.
    """
    open_tag, close_tag = f"<{row_tag}", f"</{row_tag}>"
    raw = spark.read.option("lineSep", open_tag).text(path)
    parts = raw.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("_split"),
                       F.monotonically_increasing_id().alias("_at"), "value")
    parts = parts.withColumn("_n", (F.octet_length("value") + len(open_tag)).cast("long"))  # the cut-off start tag comes after each part
    if offsets:
        inside = Window.partitionBy("path", "_split").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
        sums = parts.groupBy("path", "_split").agg(F.sum("_n").alias("_sum"))
        before = Window.partitionBy("path").orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)  # a row for each split
        starts = sums.select("path", "_split", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"))
        parts = parts.withColumn("_in", F.coalesce(F.sum("_n").over(inside), F.lit(0))).join(starts, ["path", "_split"])
        parts = parts.withColumn("start_byte", F.col("_start") + F.col("_in") - len(open_tag))
    else:
        parts = parts.withColumn("start_byte", F.lit(None).cast("long"))
    # only what begins like a start tag of this name, so neither <rows> nor the text before the first record
    parts = parts.where(F.col("value").rlike("^[\\s/>]") & (F.coalesce("start_byte", F.lit(0)) >= 0))
    end = F.instr("value", close_tag)
    own = F.regexp_extract("value", "^[^<>]*/>", 0)  # <row/>
    record = F.when(end > 0, F.substr("value", F.lit(1), end + len(close_tag) - 1)).when(own != "", own).otherwise(F.col("value"))
    out = parts.select("path", "start_byte", F.concat(F.lit(open_tag), record).alias("record"), ((end > 0) | (own != "")).alias("closed"))
    return out.select("path", "start_byte", (F.col("start_byte") + F.octet_length("record")).alias("end_byte"), "record", "closed")


def recover_rows(spark: SparkSession, path: str, row_tag: str, schema: str, offsets: bool = True):
    """(rows, damaged): the typed rows of well-formed records, and the others with their byte range, code and text."""
    records = read_records(spark, path, row_tag, offsets)
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT, "rowTag": row_tag}
    parsed = records.withColumn("r", F.when(F.col("closed"), F.from_xml("record", f"{schema}, {_CORRUPT} string", options)))
    good = F.col("closed") & F.col(f"r.{_CORRUPT}").isNull() & F.col("r").isNotNull()
    fields = [f for f in parsed.schema["r"].dataType.names if f != _CORRUPT]
    damaged = parsed.where(~good).select("path", "start_byte", "end_byte", F.when(F.col("closed"), MALFORMED).otherwise(NO_END).alias("code"), "record")
    return parsed.where(good).select(*[F.col(f"r.{f}").alias(f) for f in fields]), damaged
