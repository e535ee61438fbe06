"""File listing and document identity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridmap.functions.text import col_

# File types the mapping job reads.
SUPPORTED = ["xlsx", "xls", "csv"]
UNSUPPORTED_CODE = "UNSUPPORTED_FILE_TYPE"


def identity_columns(path) -> dict:
    """base name, last extension (with dot), name without it, lower-case type."""
    p = col_(path)
    base = F.regexp_extract(p, "([^/]*)$", 1)
    ext = F.when(base.rlike("^[.]*[^.].*[.][^.]*$"), F.regexp_extract(base, "([.][^.]*)$", 1)).otherwise(F.lit(""))
    name = F.substr(base, F.lit(1), F.length(base) - F.length(ext))
    ftype = F.lower(F.substr(ext, F.lit(2)))
    return {"base": base, "ext": ext, "doc_name": name, "file_type": ftype,
            "supported": ftype.isin(*SUPPORTED)}


def doc_identity(df: DataFrame, path_col: str = "path") -> DataFrame:
    cols = identity_columns(path_col)
    return df.select("*", *[v.alias(k) for k, v in cols.items()])


def scan_files(spark: SparkSession, root: str, recursive: bool = True, with_content: bool = False) -> DataFrame:
    """List files under ``root`` with identity columns; ``content`` only when asked for.

    The binary-file source prunes the ``content`` column when it is not
    selected, so listing does not read file bodies.
    """
    df = (spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(root))
    cols = ["path", "length", "modificationTime"] + (["content"] if with_content else [])
    out = doc_identity(df.select(*cols), "path")
    return out.withColumn("doc_id", F.xxhash64("path"))


def split_supported(files: DataFrame):
    """(supported files, error rows for the others)."""
    ok = files.where(F.col("supported"))
    bad = files.where(~F.col("supported")).select(
        "doc_id", F.lit("scan").alias("stage"), F.lit(UNSUPPORTED_CODE).alias("code"),
        F.concat(F.lit("unsupported file type '"), F.col("file_type"), F.lit("': "), F.col("base")).alias("message"),
        F.lit("WARNING").alias("severity"))
    return ok, bad
