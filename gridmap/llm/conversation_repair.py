"""Repair of the role structure of conversations by iterative-deepening A*.

A conversation is its rows by turn (nulls first; rows of one turn by role, then by the hash of their text).  The first fault of a
row counts: blank (nothing but white space), duplicate (the same role and text earlier in the conversation), truncated (the last
character that isn't white space is none of . ! ?).  Edits of a row: K keeps it (0), R gives it the role user or assistant (1), D
deletes it (2; a must for blank and duplicate rows); I inserts an empty row of user or assistant anywhere (5).  A truncated row
that stays costs 5 more.  Wanted are the cheapest edits after which the roles' initials read ``(s?(ua)+)?``, of equally cheap
ones those whose initials come first in ASCII order.

The search is depth-first in ASCII order (D, I, K, R) under a cost bound that starts at the estimate and grows by one; states (row,
grammar state) that failed are kept with the budget they failed with, over all bounds.  The estimate never exceeds the true cost:
2 for each faulty row, 1 for each disjoint pair of neighbouring sound rows whose initials can't follow each other.  Under the least
sufficient bound the first accepting path is the answer.

Long conversations are cut into blocks of BLOCK rows, so that no search grows with the conversation.  A block that doesn't hold a
whole conversation is searched for every pair of grammar states before and after it; blocks are then joined from left to right,
keeping for each state the cheapest path.  In a block every path ends with the edit of its last row, so of two equally cheap paths
none is the other's beginning, and comparing them block by block equals comparing whole strings.

What Spark moves: for the search a short row for each distinct (conversation, turn, role, text) with a 16-byte hash, never a text;
texts once, to the edits of their conversation (``repaired``).  Copies of a row are counted before the first shuffle.  Blocks come from ranges over
(conversation, turn, ...), so one very long conversation is searched by many tasks; one task joins its blocks (some bytes a row:
the edits are one string), and one reads its rows in order (a stream: SHA-256 and the order of the rows need it).

Edge cases: a null role or text counts as one space; rows without a conversation are one conversation, rows without a turn come first;
an empty table gives empty tables; other columns are left out.  Roles other than system, user and assistant are matched by their
first letter (none: no grammar role).
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridmap.llm.common import written

BLOCK = 32
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
SPACE = " \t\n\x0b\x0c\r"
#: Grammar states: nothing yet, after system, after user, after assistant; accepting are the first and the last.
START, AFTER_S, AFTER_U, AFTER_A = range(4)
_KEEP = {(START, "s"): AFTER_S, (START, "u"): AFTER_U, (AFTER_S, "u"): AFTER_U, (AFTER_U, "a"): AFTER_A, (AFTER_A, "u"): AFTER_U}
_NEXT = (AFTER_U, AFTER_U, AFTER_A, AFTER_U)  # the state after a row of the only role that may be put in
_TAIL = {START: (0, ""), AFTER_S: (2 * INSERT, "II"), AFTER_U: (INSERT, "I"), AFTER_A: (0, "")}
_FOLLOWS = {"su", "ua", "au"}
#: Symbols of rows: the initial (s, u, a, o for others) plus the fault (none, blank, duplicate, truncated).
_SYMBOLS = {chr(65 + 4 * f + i): ("suao"[i], f) for f in range(4) for i in range(4)}
_BLANK, _DUPLICATE, _TRUNCATED = 1, 2, 3


def _estimate(rows: list[tuple[str, int]]) -> list[int]:
    """For each row the least cost of it and all later ones, as far as faults and unfit neighbours tell."""
    out, after, follower = [0] * (len(rows) + 1), 0, None  # follower: initial of the next row that may stay, if it isn't used yet
    for i in range(len(rows) - 1, -1, -1):
        initial, fault = rows[i]
        if fault:
            after += DELETE
            if fault == _TRUNCATED:
                follower = None
        elif follower is not None and initial + follower not in _FOLLOWS:
            after, follower = after + 1, None
        else:
            follower = initial
        out[i] = after
    return out


@lru_cache(maxsize=1 << 16)
def search(symbols: str, entry: int = START, goal: int | None = None) -> tuple[int, str] | None:
    """Cost and initials of the cheapest edits of these rows from state ``entry`` on.

    Without ``goal`` they end the conversation; with it they end in that state, right after the edit of the last row (None if
    that can't be).
    """
    rows = [_SYMBOLS[c] for c in symbols]
    n, least, failed = len(rows), _estimate(rows), {}
    if goal in (START, AFTER_S):
        if entry > goal or (entry, goal) == (START, AFTER_S) and not any(r[0] == "s" and r[1] in (0, _TRUNCATED) for r in rows):
            return None

    def deeper(i: int, state: int, left: int) -> str | None:
        if i == n and (state == goal if goal is not None else state in (START, AFTER_A)):
            return ""
        if i == n and goal is not None or goal in (START, AFTER_S) and state > goal or failed.get((i, state), -1) >= left:
            return None
        edits = []
        if i < n:
            edits.append(("D", DELETE, i + 1, state))
        edits.append(("I", INSERT, i, _NEXT[state]))
        if i < n and rows[i][1] in (0, _TRUNCATED):
            more, kept = (TRUNCATED if rows[i][1] else 0), _KEEP.get((state, rows[i][0]))
            if kept is not None:
                edits.append(("K", KEEP + more, i + 1, kept))
            edits.append(("R", REROLE + more, i + 1, _NEXT[state]))
        for letter, cost, j, to in edits:
            if cost + least[j] <= left:
                rest = deeper(j, to, left - cost)
                if rest is not None:
                    return letter + rest
        failed[i, state] = left
        return None

    bound = least[0]
    while (found := deeper(0, entry, bound)) is None:
        bound += 1
    return bound, found


def _faulty(text: Column) -> Column:
    last = F.right(F.rtrim(text, F.lit(SPACE)), F.lit(1))
    return F.when(last == "", _BLANK).when(~last.isin(".", "!", "?"), _TRUNCATED).otherwise(0)


def _rows(turns: DataFrame, columns: tuple[str, str, str, str]) -> DataFrame:
    conv, turn, role, text = (F.col(f"`{c}`") for c in columns)
    out = turns.select(conv.alias("conv"), turn.cast("long").alias("turn"), F.coalesce(role, F.lit(" ")).alias("role"),
                       F.coalesce(text, F.lit(" ")).alias("text"))
    return out.withColumn("h", F.substring(F.unhex(F.sha2(F.col("text").cast("binary"), 256)), 1, 16))


def _blocks(rows: DataFrame) -> DataFrame:
    """Blocks of consecutive rows of a conversation with the answers of their searches."""
    one = rows.select("conv", "turn", "role", "h", _faulty(F.col("text")).alias("fault"))
    one = one.groupBy("conv", "turn", "role", "h", "fault").agg(F.count(F.lit(1)).alias("copies"))
    one = written(one, "repair-rows")
    seen = one.groupBy("conv", "role", "h").agg(F.min(F.struct("turn")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    seen = seen.select(F.col("conv").alias("c"), F.col("role").alias("r"), F.col("h").alias("g"), "first")
    same = F.col("conv").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("h") == F.col("g"))
    initial = F.instr(F.lit("sua"), F.left("role", F.lit(1)))
    initial = F.when((F.col("role") == "") | (initial == 0), 3).otherwise(initial - 1)
    again = (F.col("fault") != _BLANK) & F.coalesce(F.struct("turn") > F.col("first"), F.lit(False))
    one = one.join(seen, same, "left").select("conv", "turn", "role", "h", initial.alias("i"), F.when(again, _DUPLICATE).otherwise(F.col("fault")).alias("f"), "copies")
    one = written(one, "repair-faults").repartitionByRange("conv", "turn", "role", "h").sortWithinPartitions("conv", "turn", "role", "h")
    conv = one.schema["conv"].dataType
    schema = T.StructType([T.StructField("conv", conv)]).add("turn", "long").add("role", "string").add("h", "binary").add("part", "integer")
    schema = schema.add("block", "long").add("first_turn", "long").add("last_turn", "long").add("n_turns", "long").add("symbols", "string")
    schema = schema.add("whole", "boolean").add("costs", T.ArrayType(T.IntegerType())).add("edits", T.ArrayType(T.StringType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*[c.to_pylist() for c in b.columns]))
        out, first_conv, held = [], True, None

        def add(conv, part, number, cells, whole):
            symbols, turns = "".join(c[0] for c in cells), [c[1] for c in cells if c[1] is not None]
            # a conversation that may go on in another range isn't whole: the first one may have begun there
            ends = [(START, None)] if whole else [(s, t) for s in range(4) for t in range(4)]
            found = [search(symbols, s, t) for s, t in ends]
            out.append((conv, *cells[0][1:], part, number, turns[0] if turns else None, turns[-1] if turns else None, len(set(turns)),
                        symbols, whole, [-1 if x is None else x[0] for x in found], ["" if x is None else x[1] for x in found]))

        def batch():
            done = pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in out], schema=arrow)
            out.clear()
            return done

        for conv, group in groupby(rows, key=lambda r: r[0]):
            if held is not None:
                add(*held)  # a short conversation that another one follows
                held = None
            cells, number = [], 0
            for _, turn, role, h, initial, fault, copies, part in group:
                for k in range(copies):
                    if len(cells) == BLOCK:
                        add(conv, part, number, cells, False)
                        cells, number = [], number + 1
                    cells.append((chr(65 + 4 * (fault if k == 0 or fault == _BLANK else _DUPLICATE) + initial), turn, role, h))
                if len(out) >= 1000:
                    yield batch()
            held = (conv, part, number, cells, not first_conv and number == 0)
            first_conv = False
        if held is not None:
            add(*held[:4], False)  # the last one may go on in the next range
        if out:
            yield batch()

    names = schema.names
    arrow = _arrow(schema)
    return written(one.withColumn("part", F.spark_partition_id()).mapInArrow(run, schema), "repair-blocks")


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


_SUMMARY = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _joined(blocks: list[tuple]) -> tuple[int, list[str]]:
    """Cost and the edits of each block of a conversation; a block is (symbols, whole, costs, edits)."""
    if blocks[0][1]:
        return blocks[0][2][0], [blocks[0][3][0]]
    # for each state: cost, rank among the paths in ASCII order, and (path before, edits of the block)
    best: dict[int, tuple[int, int, tuple | None]] = {START: (0, 0, None)}
    for _, _, costs, edits in blocks:
        ways: dict[int, tuple] = {}
        for s, (cost, rank, path) in best.items():
            for t in range(4):
                k = 4 * s + t
                if costs[k] >= 0 and (t not in ways or (cost + costs[k], rank, edits[k]) < ways[t][:3]):
                    ways[t] = (cost + costs[k], rank, edits[k], path)
        order = sorted(ways, key=lambda t: ways[t][1:3])
        best = {t: (ways[t][0], order.index(t), (ways[t][3], ways[t][2])) for t in ways}
    end = min(best, key=lambda t: (best[t][0] + _TAIL[t][0], best[t][1]))
    pieces, path = [], best[end][2]
    while path is not None:
        pieces.append(path[1])
        path = path[0]
    pieces.reverse()
    pieces[-1] += _TAIL[end][1]
    return best[end][0] + _TAIL[end][0], pieces


def edits(turns: DataFrame, columns: tuple[str, str, str, str] = ("conv_id", "turn", "role", "text")) -> DataFrame:
    """The cheapest edits of all conversations, a row for each block of rows (written to the shared folder).

    conv, the key (turn, role, h) of the block's first row, block, piece (the initials of its edits); on the last block of a
    conversation also summary: gaps, blank, duplicate, truncated, illegal, cost and audit (all initials), null elsewhere.
    """
    blocks = _blocks(_rows(turns, columns))
    summary = T.StructType([T.StructField(n, T.LongType()) for n in _SUMMARY]).add("audit", "string")
    schema = T.StructType([blocks.schema["conv"], blocks.schema["turn"], blocks.schema["role"], blocks.schema["h"]])
    schema = schema.add("block", "long").add("piece", "string").add("summary", summary)
    names, arrow = schema.names, _arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, out = (r for b in batches for r in zip(*[c.to_pylist() for c in b.columns])), []
        for conv, group in groupby(rows, key=lambda r: r[0]):
            group = list(group)
            cost, pieces = _joined([r[9:] for r in group])
            faults, illegal, turns, before, last = [0] * 4, 0, 0, None, None
            low = next((r[6] for r in group if r[6] is not None), None)
            for r in group:
                for c in r[9]:
                    initial, fault = _SYMBOLS[c]
                    faults[fault] += 1
                    illegal += before is not None and before + initial not in _FOLLOWS
                    before = initial
                if r[6] is not None:
                    turns += r[8] - (r[6] == last)
                    last = r[7]
            gaps = 0 if low is None else last - low + 1 - turns
            for k, (r, piece) in enumerate(zip(group, pieces)):
                total = (gaps, *faults[1:], illegal, cost, "".join(pieces))
                out.append((conv, *r[1:4], k, piece, dict(zip(summary.names, total)) if k == len(group) - 1 else None))
            if len(out) >= 1000:
                yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in out], schema=arrow)
                out = []
        if out:
            yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in out], schema=arrow)

    ordered = blocks.repartition("conv").sortWithinPartitions("conv", "part", "block")
    return written(ordered.mapInArrow(run, schema), "repair-edits")


def _edited(rows: Iterator[tuple]) -> Iterator[tuple[str, str, str]]:
    """(edit, role, text) of the rows that stay or come in, from pieces of edits and rows in order; state starts anew with each call."""
    state, waiting = START, deque()

    def put_in():
        nonlocal state
        state = _NEXT[state]
        return "user" if state == AFTER_U else "assistant"

    for kind, role, text in rows:
        if kind == 0:
            waiting.extend(text)
            continue
        while waiting[0] == "I":
            yield waiting.popleft(), put_in(), ""
        edit = waiting.popleft()
        if edit == "K":
            state = _KEEP[state, role[:1]]
            yield edit, role, text
        elif edit == "R":
            yield edit, put_in(), text
    for edit in waiting:
        yield edit, put_in(), ""


def _streamed(turns: DataFrame, plan: DataFrame, columns: tuple[str, str, str, str]) -> DataFrame:
    """Rows and pieces of edits of each conversation in one partition, each piece before the first of its rows."""
    rows = _rows(turns, columns).withColumns({"kind": F.lit(1), "block": F.lit(None).cast("long"), "summary": F.lit(None).cast(plan.schema["summary"].dataType)})
    pieces = plan.withColumns({"kind": F.lit(0), "text": F.col("piece")})
    names = ["conv", "turn", "role", "h", "kind", "block", "text", "summary"]
    both = pieces.select(*names).unionByName(rows.select(*names))
    return both.repartition("conv").sortWithinPartitions("conv", "turn", "role", "h", "kind", "block").select("conv", "kind", "role", "text", "summary")


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(conversation, its stream of rows); summaries are put into the list that comes with it."""
    rows = (r for b in batches for r in zip(*[c.to_pylist() for c in b.columns]))
    for conv, group in groupby(rows, key=lambda r: r[0]):
        found: list = []

        def stream(group=group, found=found):
            for _, kind, role, text, summary in group:
                if summary is not None:
                    found.append(summary)
                yield kind, role, text

        yield conv, stream(), found


def repaired(turns: DataFrame, columns: tuple[str, str, str, str] = ("conv_id", "turn", "role", "text"), plan: DataFrame | None = None) -> DataFrame:
    """The repaired conversations: conv_id, place (from 0), edit (K, R or I), role, text."""
    plan = edits(turns, columns) if plan is None else plan
    conv = plan.schema["conv"].dataType
    schema = T.StructType([T.StructField(columns[0], conv)]).add("place", "long").add("edit", "string").add("role", "string").add("text", "string")
    names, arrow = schema.names, _arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size = [], 0
        for conv, rows, _ in _conversations(batches):
            for place, (edit, role, text) in enumerate(_edited(rows)):
                out.append((conv, place, edit, role, text))
                size += len(text)
                if len(out) >= 1000 or size > 1 << 22:
                    yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in out], schema=arrow)
                    out, size = [], 0
        if out:
            yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in out], schema=arrow)

    return _streamed(turns, plan, columns).mapInArrow(run, schema)


def reports(turns: DataFrame, columns: tuple[str, str, str, str] = ("conv_id", "turn", "role", "text"), plan: DataFrame | None = None) -> DataFrame:
    """A row for each conversation: conv_id, its summary (see ``edits``) and repaired_sha256 of its repaired ``role:text`` lines."""
    plan = edits(turns, columns) if plan is None else plan
    conv = plan.schema["conv"].dataType
    schema = T.StructType([T.StructField(columns[0], conv), *plan.schema["summary"].dataType.fields]).add("repaired_sha256", "string")
    arrow = _arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for conv, rows, summaries in _conversations(batches):
            digest, between = hashlib.sha256(), b""
            for _, role, text in _edited(rows):
                digest.update(between + f"{role}:{text}".encode("utf-8", "surrogatepass"))
                between = b"\n"
            out.append({columns[0]: conv, **summaries[0], "repaired_sha256": digest.hexdigest()})
            if len(out) >= 1000:
                yield pa.RecordBatch.from_pylist(out, schema=arrow)
                out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return _streamed(turns, plan, columns).mapInArrow(run, schema)
