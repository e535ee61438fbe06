"""Shards of near equal bytes: minimax contiguous partition of ordered, atomic groups of equal texts.

The groups stand in one order (smallest doc_id, then text hash); their prefix sums are made by ranges of that
order.  The smallest shard capacity for which greedy filling needs no more than the given shards is found by
binary search; the checks use a bounded number of boundaries, which are refined around the cuts until the answer
is exact.  The cuts are then placed as near to equal as that capacity allows.

Only DataFrame functions.  Edge cases: a null text counts as empty (no bytes), and so shares a group with empty
texts; null ids come first; repeated rows are rows of one group with slots of their own; an empty table gives an
empty result.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridmap.llm.common import written

#: Bytes added to each document's size.
OVERHEAD = 16
#: Cells of the order of which the driver gets two boundaries each.
CELLS = 50_000


def text_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       (F.octet_length(text) + OVERHEAD).cast("long").alias("size"),
                       F.crc32(text).alias("text_crc32"), F.unhex(F.sha2(text, 256)).alias("sha"))


def _ordered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """``df`` dealt by ranges of ``order`` and written with the number of its range as ``pid``."""
    return written(df.repartitionByRange(*order).withColumn("pid", F.spark_partition_id()), name)


def prefix_sums(groups: DataFrame) -> DataFrame:
    """(sha, gid, gsize, upto): ``upto`` is the sum of sizes up to and with the group, over the whole order."""
    g = _ordered(groups, ["gid", "sha"], "shard-groups")
    totals = g.groupBy("pid").agg(F.sum("gsize").alias("in_range"))
    before = totals.select("pid", (F.sum("in_range").over(Window.orderBy("pid")) - F.col("in_range")).alias("before"))
    running = F.sum("gsize").over(Window.partitionBy("pid").orderBy("gid", "sha"))
    g = g.withColumn("running", running).join(F.broadcast(before), "pid")  # one row for each range
    return written(g.select("sha", "gid", "gsize", (F.col("before") + F.col("running")).alias("upto"))
                   .sortWithinPartitions("upto"), "shard-prefix")


class Boundaries:
    """What the driver knows of the boundaries: some of them exactly, and cells between whose ends others may lie."""

    def __init__(self, known: set[int], cells: list[tuple[int, int]]):
        self.known = sorted(known | {0})
        self.cells = sorted(c for c in cells if c[1] - c[0] > 1)
        self.starts = [c[0] for c in self.cells]

    def surely(self, t: int) -> int:
        """The last known boundary up to ``t``."""
        return self.known[bisect_right(self.known, t) - 1]

    def at_most(self, t: int) -> int:
        """No boundary lies between this and ``t``."""
        k = bisect_right(self.starts, t) - 1
        return t if k >= 0 and self.cells[k][0] < t < self.cells[k][1] else self.surely(t)

    def chain(self, capacity: int, shards: int, reach) -> list[int]:
        """Greedy cuts: where each shard ends if all are filled as far as ``reach`` says."""
        at, ends = 0, []
        for _ in range(shards):
            at = max(at, reach(at + capacity))
            ends.append(at)
        return ends


def _least(low: int, high: int, feasible) -> int:
    """Binary search: the least feasible number above ``low``; ``high`` is feasible."""
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (low, mid) if feasible(mid) else (mid, high)
    return high


def smallest_capacity(prefix: DataFrame, shards: int, cells: int = CELLS) -> tuple[int, int, Boundaries]:
    """(capacity, sum of all sizes, known boundaries); exact.

    The driver gets two boundaries for each of at most ``cells`` cells of the order.  Greedy filling with known
    boundaries bounds the capacity from above, with any place in a cell as boundary from below; both chains leave
    windows around each cut, which are cut into finer cells until the windows hold at most ``cells`` boundaries.
    """
    total, largest = prefix.agg(F.max("upto"), F.max("gsize")).first()
    if not total:
        return 0, 0, Boundaries(set(), [])
    low, high = max(-(-total // shards), largest) - 1, -(-total // shards) + largest  # below any; feasible
    windows, known, upto, before = [(0, total)], {total}, F.col("upto"), None
    cells = max(cells, 16 * shards)
    while True:
        length = sum(b - a + 1 for a, b in windows)
        cells, before = cells * (2 if before and length > before // 2 else 1), length  # always ends
        near = prefix.where(reduce(or_, [upto.between(a, b) for a, b in windows])).select("upto")
        width = max(1, length // cells)
        found = near.groupBy(F.expr(f"upto div {width}").alias("c")).agg(
            F.min("upto").alias("first"), F.max("upto").alias("last"), F.count(F.lit(1)).alias("n")).collect()
        known |= {r[k] for r in found for k in ("first", "last")}
        bounds = Boundaries(known, [(r["first"], r["last"]) for r in found if r["n"] > 2])
        high = _least(low, high, lambda c: bounds.chain(c, shards, bounds.surely)[-1] >= total)
        if not bounds.cells:
            return high, total, bounds
        low = _least(low, high, lambda c: bounds.chain(c, shards, bounds.at_most)[-1] >= total) - 1
        ends = zip(bounds.chain(low, shards, bounds.surely), bounds.chain(high, shards, bounds.at_most))
        windows = sorted({(a, b) for a, b in ends})


def balanced_cuts(bounds: Boundaries, shards: int, capacity: int, total: int) -> list[int]:
    """Where shards 0 to shards-2 end: each as near to an equal part of the rest as the capacity allows."""
    known = bounds.known
    least = [total]  # least[n]: the first known boundary from which n shards reach the end
    for _ in range(shards - 1):
        least.append(known[bisect_left(known, least[-1] - capacity)] if least[-1] > capacity else 0)
    cuts, at = [], 0
    for k in range(shards - 1):
        aim = at + (total - at) // (shards - k)
        low, high = max(at, least[shards - k - 1]), bounds.surely(at + capacity)
        i = bisect_right(known, aim)
        options = {*known[max(0, i - 1):i + 1], low, high}
        at = min((x for x in options if low <= x <= high), key=lambda x: (abs(x - aim), x))
        cuts.append(at)
    return cuts


def _shard_of(upto: Column, cuts: list[int]) -> Column:
    return sum([(upto > F.lit(c)).cast("int") for c in cuts], F.lit(0))


def minimax_shards(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, shard and slot (gapless from 0 in each shard) of every row."""
    rows = written(text_groups(docs, id_col, text_col), "shard-rows")
    groups = rows.groupBy("sha").agg(F.sum("size").alias("gsize"), F.min("doc_id").alias("gid"))
    prefix = prefix_sums(groups)
    capacity, total, bounds = smallest_capacity(prefix, shards)
    cuts = balanced_cuts(bounds, shards, capacity, total) if total else []
    placed = rows.join(prefix.select("sha", "gid", _shard_of(F.col("upto"), cuts).alias("shard")), "sha")
    order = ["shard", "gid", "sha", "doc_id"]  # with doc_id, so that one large group is many ranges
    placed = _ordered(placed, order, "shard-placed")
    counts = placed.groupBy("shard", "pid").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("shard", "pid", (F.sum("n").over(Window.partitionBy("shard").orderBy("pid")) - F.col("n"))
                           .alias("before"))
    rank = F.row_number().over(Window.partitionBy("pid", "shard").orderBy("gid", "sha", "doc_id"))
    return (placed.withColumn("rank", rank).join(F.broadcast(before), ["shard", "pid"])  # ranges plus shards rows
            .select("doc_id", "size", "text_crc32", F.col("shard").cast("int"),
                    (F.col("before") + F.col("rank") - 1).cast("long").alias("slot")))
