"""Best-fit decreasing packing of token pieces, certified by lower bounds, with exchange between partitions.

Documents are encoded where they are read; only piece rows move.  Pieces of full length are sequences of their own.
The others are dealt to partitions of about GROUP_PIECES; each is packed by best-fit decreasing, and its number of
bins is held against lower bounds from dual feasible functions.  A partition that meets its bound is final.  The
others exchange documents: the pieces of their bins that are not full are dealt anew, together with those of other
such partitions, and packed again; a result counts only if it needs fewer bins.

Edge cases: a null or empty text is its end id alone; null ids and repeated rows are packed like others; an empty
table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridmap.llm.common import written
from gridmap.llm.tokens import BYTE_BPE, encoder, tokenizer_path

LENGTH, END_ID, GROUP_PIECES, ROUNDS, MERGED = 2048, 0, 20_000, 2, 4
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = PIECE + ", grp long, bin long, offset long, certified boolean"


def pieces(docs: DataFrame, length: int = LENGTH, tokenizer: str | None = None, id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """The pieces of every document: at most ``length`` ids; of a longer document the first piece takes the odd rest."""
    vocabulary = tokenizer or tokenizer_path(BYTE_BPE)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(vocabulary, True), np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            flat, counts = enc.encode(batch.column(1).to_pylist())
            raw, at, out = np.ascontiguousarray(flat, "<u4").tobytes(), 0, [[], [], [], [], []]
            for d, n in zip(batch.column(0).to_pylist(), counts.tolist()):
                ids, size = raw[4 * at:4 * (at + n)] + end, n + 1
                at += n
                edges = [0, *range(size % length or length, size + 1, length)] if size > length else [0, size]
                for k, (a, b) in enumerate(zip(edges, edges[1:])):
                    for column, x in zip(out, (d, k, a, b - a, zlib.crc32(ids[4 * a:4 * b]))):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()),
                                              *[pa.array(x, pa.int64()) for x in out[2:]]],
                                             names=[c.split()[0] for c in PIECE.split(", ")])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(cut, PIECE)


def lower_bound(sizes: np.ndarray, length: int = LENGTH) -> int:
    """No packing needs fewer bins: the best of two families of dual feasible functions, from counts by size."""
    counts = np.bincount(sizes, minlength=length + 1).astype(np.int64)
    size = np.arange(length + 1, dtype=np.int64)
    n, total = np.cumsum(counts), np.cumsum(counts * size)
    cut = np.arange(length // 2 + 1)  # sizes under the cut count nothing, those over length - cut a whole bin
    inner = total[length - cut] - np.where(cut > 0, total[np.maximum(cut, 1) - 1], 0)
    bounds = [int(-(-(inner + length * (n[-1] - n[length - cut])).max() // length))]
    for k in range(1, 25):  # a size counts its share of a bin rounded down to k-ths, where it is not a whole number of (k+1)-ths
        x = (k + 1) * size
        share = np.where(x % length == 0, size * k, x // length * length)
        bounds.append(int(-(-int((share * counts).sum()) // (k * length))))
    return max(bounds)


def best_fit(sizes: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Bin of each piece by best-fit decreasing; bins are kept by the room they have left."""
    order = np.argsort(-sizes, kind="stable")
    bins, room, filled, n = np.empty(len(sizes), np.int64), [[] for _ in range(length + 1)], 0, 0
    for i, s in zip(order.tolist(), sizes[order].tolist()):
        fits = filled >> s
        if fits:
            left = s + (fits & -fits).bit_length() - 1
            b = room[left].pop()
            if not room[left]:
                filled &= ~(1 << left)
        else:
            left, b, n = length, n, n + 1
        bins[i] = b
        room[left - s].append(b)
        filled |= 1 << (left - s)
    return bins


def _pack(pdf: pd.DataFrame, length: int) -> pd.DataFrame:
    pdf = pdf.sort_values(["length", "doc_id", "piece", "ids_crc32"], kind="stable").reset_index(drop=True)
    sizes = pdf["length"].to_numpy(np.int64)
    bins = best_fit(sizes, length)
    order = np.argsort(bins, kind="stable")
    ends = np.cumsum(sizes[order])
    first = np.searchsorted(bins[order], bins[order])
    offset = np.empty(len(sizes), np.int64)
    offset[order] = ends - sizes[order] - (ends - sizes[order])[first]
    n = int(bins.max()) + 1
    return pdf.assign(bin=bins, offset=offset, certified=n <= lower_bound(sizes, length))


def _exchange(pdf: pd.DataFrame, length: int) -> pd.DataFrame:
    """Packs the pieces of all bins that are not full anew; full bins stay, and all if that needs no fewer bins."""
    loose = pdf.groupby(["grp", "bin"])["length"].transform("sum") < length
    open_, full = pdf[loose], pdf[~loose]
    if not len(open_):
        return pdf.assign(certified=True)
    bins = len(open_[["grp", "bin"]].drop_duplicates())
    better = _pack(open_.drop(columns=["bin", "offset", "certified"]), length)
    if better["bin"].max() + 1 >= bins:
        return pdf.assign(certified=bins <= lower_bound(open_["length"].to_numpy(np.int64), length))
    top = full["bin"].max() + 1 if len(full) else 0
    better = better.assign(grp=pdf["grp"].min(), bin=better["bin"] + top)
    return pd.concat([full, better]).assign(certified=bool(better["certified"].all()))


def pack(found: DataFrame, length: int = LENGTH, group_pieces: int = GROUP_PIECES, rounds: int = ROUNDS) -> DataFrame:
    """``found`` (pieces) with sequence_id, offset and certified (its partition met its lower bound)."""
    found = written(found, "pack-pieces")
    names = [c.split()[0] for c in PIECE.split(", ")]
    full, rest = found.where(F.col("length") == length), found.where(F.col("length") < length)
    groups = max(1, rest.count() // group_pieces)
    deal = lambda *x: F.pmod(F.xxhash64(*x), F.lit(groups))
    packed = written(rest.withColumn("grp", deal("doc_id", "piece", "ids_crc32")).groupBy("grp")
                     .applyInPandas(lambda pdf: _pack(pdf, length)[[*names, "grp", "bin", "offset", "certified"]], PACKED), "pack-0")
    done, todo = packed.where("certified"), packed.where("not certified")

    def exchange(pdf: pd.DataFrame) -> pd.DataFrame:
        return _exchange(pdf, length)[[*names, "grp", "bin", "offset", "certified"]]

    for k in range(1, rounds + 1):
        gaps = todo.select("grp").distinct().count()
        if gaps < 2:
            break
        # partitions with gaps, MERGED at a time, in an order that differs by round
        new = F.pmod(F.xxhash64("grp", F.lit(k)), F.lit(max(1, gaps // MERGED)))

        packed = written(todo.withColumn("m", new).groupBy("m").applyInPandas(exchange, PACKED), f"pack-{k}")
        done, todo = done.unionByName(packed.where("certified")), packed.where("not certified")
    sequence = F.col("grp") * F.lit(1 << 32) + F.col("bin")
    small = done.unionByName(todo).select(*names, sequence.alias("sequence_id"), "offset", "certified")
    whole = full.select(*names, (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"),
                        F.lit(True).alias("certified"))
    return small.unionByName(whole)
