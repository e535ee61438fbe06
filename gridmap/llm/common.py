"""Shared helpers: table access, written intermediate tables, vectorised word hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridmap.session import scratch_path, ship_package

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LOWER_BYTES = bytes.maketrans(UPPER.encode(), LOWER.encode())
#: Lower-cases A-Z and reads other ASCII than letters as spaces; bytes of other characters stay.
LETTER_BYTES = bytes(LOWER_BYTES[b] if b >= 128 or chr(b).isalpha() else 32 for b in range(256))
#: The same, but digits stay too.
WORD_BYTES = bytes(LOWER_BYTES[b] if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
#: Rows that a broadcast side may have; beyond it the join is a shuffle join.
BROADCAST_ROWS = 200_000
#: Rows of an Arrow batch, so that a batch of long documents stays small in a Python worker.
BATCH_ROWS = 1024
#: Bytes of text that the vectorised word functions look at together.
SEGMENT_BYTES = 2 << 20


def read(spark: SparkSession, sf_dir: str, table: str, *cols: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")
    return df.select(*cols) if cols else df


def prepare(spark: SparkSession) -> None:
    """Makes the package known to Python workers and keeps Arrow batches of long documents small."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """``df`` written to the shared scratch folder and read back: lineage is cut, a lost executor costs nothing."""
    spark = df.sparkSession
    path = scratch_path(spark, f"llm-{name}")
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def checked_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> tuple[DataFrame, bool]:
    """``df`` (a written table) with a broadcast hint if it has at most ``rows`` rows, and whether it has."""
    small = df.limit(rows + 1).count() <= rows
    return (F.broadcast(df) if small else df), small


def lower_az(text: Column) -> Column:
    """Lower-cases A to Z only.  For ASCII texts (as many bytes as characters) ``lower`` does just that, and faster."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def sha256_hex(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def crc_bucket(doc_id: Column, modulus: int) -> Column:
    """crc32 of the decimal doc_id, modulo ``modulus`` (null for a null id)."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(modulus)


def replace_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """``df`` without columns whose names (in any case) an operator is about to add."""
    low = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in low])


def with_fields(df: DataFrame, **kinds: str) -> T.StructType:
    """The schema of ``df`` with further nullable fields."""
    new = [{"name": k, "type": v, "nullable": True, "metadata": {}} for k, v in kinds.items()]
    return T.StructType.fromJson({"type": "struct", "fields": [*df.schema.jsonValue()["fields"], *new]})


# --- words of many texts at once (inside Arrow tasks) -------------------------------------------------------------

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BASE = np.uint64(0x9E3779B97F4A7C55)
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, base, np.uint64)]))


_POW = _powers(_BASE, SEGMENT_BYTES + 1)
_INV = _powers(np.uint64(pow(int(_BASE), -1, 1 << 64)), SEGMENT_BYTES + 1)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _MIX1
        x = (x ^ (x >> np.uint64(27))) * _MIX2
        return x ^ (x >> np.uint64(31))


def texts_bytes(texts: list, table: bytes = LOWER_BYTES) -> tuple[bytes, np.ndarray]:
    """UTF-8 of all texts (null: empty), each followed by a space, and the offset at which each text starts."""
    parts = [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts]
    starts = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(p) + 1 for p in parts], out=starts[1:])
    data = b" ".join(parts) + b" " if parts else b""
    return data.translate(table), starts


def word_spans(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+``; ``data`` ends with a space."""
    gap = _SPACE[np.frombuffer(data, np.uint8)]
    if not len(gap):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts = np.flatnonzero(~gap & np.concatenate([[True], gap[:-1]]))
    ends = np.flatnonzero(gap & np.concatenate([[False], ~gap[:-1]]))
    return starts, ends


def span_hashes(data: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans (in order of their starts): a rolling polynomial per segment, then mixed.

    Spans longer than a segment are hashed one by one in steps.
    """
    raw, out = np.frombuffer(data, np.uint8), np.empty(len(starts), np.uint64)
    k = 0
    with np.errstate(over="ignore"):
        while k < len(starts):
            a = int(starts[k])
            m = int(np.searchsorted(ends, a + SEGMENT_BYTES, side="right"))
            if m <= k:  # one span longer than a segment
                h, b = np.uint64(0), int(ends[k])
                for s in range(a, b, SEGMENT_BYTES):
                    piece = raw[s:min(b, s + SEGMENT_BYTES)].astype(np.uint64) + np.uint64(1)
                    h = mix64(np.array([h]))[0] + (piece * _POW[:len(piece)]).sum(dtype=np.uint64)
                out[k] = h + np.uint64(b - a) * _MIX1
                k += 1
                continue
            seg = raw[a:int(ends[m - 1])].astype(np.uint64) + np.uint64(1)
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(seg * _POW[:len(seg)], dtype=np.uint64)])
            s, e = starts[k:m] - a, ends[k:m] - a
            out[k:m] = (total[e] - total[s]) * _INV[s] + (e - s).astype(np.uint64) * _MIX1
            k = m
    return mix64(out)


def word_hashes(texts: list, table: bytes = LOWER_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of all texts, and where each text's words start (one more entry at the end)."""
    data, offsets = texts_bytes(texts, table)
    starts, ends = word_spans(data)
    return span_hashes(data, starts, ends), np.searchsorted(starts, offsets)


def slices(texts: list, limit: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """Consecutive index ranges of ``texts`` of about ``limit`` characters (one longer text is a range of its own)."""
    a = size = 0
    for i, t in enumerate(texts):
        n = 0 if t is None else len(t)
        if i > a and size + n > limit:
            yield a, i
            a, size = i, 0
        size += n
    if texts:
        yield a, len(texts)
