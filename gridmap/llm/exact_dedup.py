"""Exact duplicate removal by progressive refinement: length, then prefix hash, then the hash of the full text.

Only DataFrame functions.  Texts are grouped by length and prefix hash (16 bytes a row move); the groups of two or more are
remembered in a bitmap of FILTER_BITS bits, of fixed size whatever the corpus.  Only texts whose length and prefix hash are in it
are read in full and hashed; of the full hashes, groups of two or more are the duplicates.  A text that comes through the bitmap by
chance is hashed in vain, nothing else.

Edge cases: a null text counts as empty, texts differ only by more than the case of A-Z.  Of a group the row with
the largest id stays; ids that are null stay only if the whole group has no id.  Rows that repeat an id and a text
are all marked alike (``drop_duplicates`` keeps one of them).  Input columns named like an added column are replaced;
helper columns take names that the input doesn't have.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridmap.llm.common import checked_broadcast, lower_az, replace_columns, sha256_hex, written

ADDED = ["keep_id", "group_size", "kept"]
#: Bits of the filter of lengths and prefix hashes; at most 16 MB, in at most 4,096 rows.
FILTER_BITS = 1 << 27
PREFIX_CHARS = 64


def _free(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` doesn't have (in any case)."""
    have = {c.lower() for c in docs.columns}
    while name.lower() in have:
        name += "_"
    return name


def _slot(text: Column, prefix_chars: int) -> Column:
    """The place of a text's length and prefix hash in the filter."""
    return F.pmod(F.xxhash64(F.octet_length(text), F.xxhash64(lower_az(F.substring(text, 1, prefix_chars)))), F.lit(FILTER_BITS))


def _filter(docs: DataFrame, text_col: str, prefix_chars: int) -> DataFrame:
    """(bucket, bits): the slots of lengths and prefix hashes that more than one row has."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    slots = docs.select(_slot(text, prefix_chars).alias("s")).groupBy("s").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    slots = slots.select(F.bitmap_bucket_number("s").alias("bucket"), F.bitmap_bit_position("s").alias("at"))
    return written(slots.groupBy("bucket").agg(F.bitmap_construct_agg("at").alias("bits")), "dedup-filter")


def _marked(docs: DataFrame, found: DataFrame, text_col: str, prefix_chars: int, sha: str) -> DataFrame:
    """``docs`` with the full hash of the texts that the filter lets through (null for the others, which are not read in full)."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    slot, bucket, bits = (_free(docs, c) for c in ("__slot", "__bucket", "__bits"))
    rows = docs.withColumn(slot, _slot(text, prefix_chars))
    small = F.broadcast(found.select(F.col("bucket").alias(bucket), F.col("bits").alias(bits)))  # FILTER_BITS / 32,768 rows at most
    rows = rows.join(small, F.bitmap_bucket_number(slot) == F.col(bucket), "left")
    at = F.bitmap_bit_position(slot)
    byte = F.conv(F.hex(F.substring(bits, (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    again = F.col(bits).isNotNull() & (F.getbit(byte, (at % 8).cast("int")) == 1)
    return rows.withColumn(sha, F.when(again, sha256_hex(lower_az(text)))).drop(slot, bucket, bits)


def duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = PREFIX_CHARS,
                     found: DataFrame | None = None) -> DataFrame:
    """(sha, keep_id, group_size, copies) of every group of two or more equal texts.

    ``sha`` is of the normalised text, ``copies`` is the number of rows that have the id that stays; ``found``: the filter.
    """
    found = _filter(docs, text_col, prefix_chars) if found is None else found
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("t"))
    hashed = _marked(rows, found, "t", prefix_chars, "sha").where("sha is not null")
    by_id = hashed.groupBy("sha", "id").agg(F.count(F.lit(1)).alias("n"))
    return written(by_id.groupBy("sha").agg(F.max("id").alias("keep_id"), F.sum("n").alias("group_size"),
                                            F.max(F.struct("id", "n"))["n"].alias("copies")).where("group_size > 1"), "dedup-groups")


def _with_groups(rows: DataFrame, groups: DataFrame, id_col: str, sha: str) -> DataFrame:
    small, _ = checked_broadcast(groups.drop("copies"))
    out = rows.join(small.withColumnRenamed("sha", sha), sha, "left")
    keep = F.when(F.col("group_size").isNull(), F.col(f"`{id_col}`")).otherwise(F.col("keep_id"))
    out = out.withColumn("keep_id", keep).withColumn("group_size", F.coalesce("group_size", F.lit(1)).cast("long"))
    return out.withColumn("kept", F.col(f"`{id_col}`").eqNullSafe(F.col("keep_id")))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = PREFIX_CHARS,
                sha_col: str | None = None) -> DataFrame:
    """All rows and columns of ``docs`` with keep_id, group_size and kept.

    ``sha_col``: return the normalised text's hash too, which reads every text in full.
    """
    found = _filter(docs, text_col, prefix_chars)
    groups = duplicate_groups(docs, id_col, text_col, prefix_chars, found)
    base = replace_columns(docs, ADDED + ([sha_col] if sha_col else []))
    sha = _free(base, sha_col or "__sha")
    if sha_col:
        rows = base.withColumn(sha, sha256_hex(lower_az(F.coalesce(F.col(f"`{text_col}`"), F.lit("")))))
    else:
        rows = _marked(base, found, text_col, prefix_chars, sha)
    out = _with_groups(rows, groups, id_col, sha)
    return out if sha_col else out.drop(sha)


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = PREFIX_CHARS) -> DataFrame:
    """The rows of ``docs`` that stay, with the columns of ``docs``; of rows that repeat an id and a text one stays.

    Texts that the filter doesn't let through pass without being hashed.
    """
    found = _filter(docs, text_col, prefix_chars)
    groups = duplicate_groups(docs, id_col, text_col, prefix_chars, found)
    names = {c: _free(docs, f"__own_{c}") for c in docs.columns if c.lower() in ADDED}  # such columns of the input come back
    own = docs.select(*[F.col(f"`{c}`").alias(names.get(c, c)) for c in docs.columns])
    id_col, sha = names.get(id_col, id_col), _free(own, "__sha")
    kept = _with_groups(_marked(own, found, names.get(text_col, text_col), prefix_chars, sha), groups, id_col, sha).where("kept")
    if not groups.where("copies > 1").isEmpty():  # only then do rows have to meet
        kept = kept.where("group_size = 1").unionByName(kept.where("group_size > 1").dropDuplicates([id_col, sha]))
    return kept.select(*[F.col(f"`{names.get(c, c)}`").alias(c) for c in docs.columns])
