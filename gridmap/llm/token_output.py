"""Token ids of documents in grammar-compressed shards, in ascending id order.

Format: a Parquet table of shards in one folder, written by Spark (a lost task leaves nothing behind).  A shard holds
the ids of consecutive documents, compressed by Re-Pair: every round replaces frequent adjacent pairs by new
nonterminals, until no pair can be replaced twice.  A round takes many pairs at once (where two overlap, the more frequent one wins)
and keeps a rule only if it is used twice at least.  Columns: part and shard (their order is the order of documents), ids_before (ids of earlier shards of
the part), doc_ids, doc_lens, rules (pairs), rule_lens (ids that each rule stands for), symbols (rules from RULE_BASE
on), marks (ids before every MARK-th symbol).  With rule_lens and marks any range of ids is decoded without the rest.

Edge cases: a null or empty text has the end id only; null doc_ids come first; repeated rows are encoded again; an
empty table gives a folder without shards.  A shard's size is bounded by SHARD_IDS or one document.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridmap.llm.tokens import WORD_BPE, encoder, tokenizer_path

END_ID, RULE_BASE, MARK = 1, 1 << 17, 4096
SHARD_IDS, QUICK_ROUNDS, PAIRS_PER_ROUND, MIN_USES, SLOT_BITS = 1 << 20, 3, 1 << 13, 4, 19
SCHEMA = ("part int, shard int, ids_before long, n_ids long, doc_ids binary, doc_null binary, doc_lens binary, rules binary, "
          "rule_lens binary, symbols binary, marks binary")


# --- one shard ----------------------------------------------------------------------------------------------------

def _taken(at: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Which of the pairs at places ``at`` (ascending) are replaced: of overlapping ones the heavier, of equally heavy ones in a row every other one."""
    first = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1] + 1) | (weight[1:] != weight[:-1])]))
    level, size = weight[first], np.diff(np.append(first, len(at)))
    apart = np.concatenate([[True], at[first[1:]] != at[first[1:] - 1] + 1, [True]])
    before, after = np.concatenate([[0], level[:-1]]), np.concatenate([level[1:], [0]])
    peak = (level > np.where(apart[:-1], 0, before)) & (level > np.where(apart[1:], 0, after))
    first, size = first[peak], (size[peak] + 1) // 2
    ends = np.cumsum(size)
    return np.repeat(first - 2 * (ends - size), size) + 2 * np.arange(int(size.sum()))


def _slots(pairs: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return ((pairs * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def _frequent(pairs: np.ndarray) -> np.ndarray:
    """Weight of each pair: the count of the PAIRS_PER_ROUND most frequent ones, 0 for others.  Pairs are counted by hash slots; a slot
    counts one of its pairs exactly, others wait for a later round."""
    owner, slot = np.zeros(1 << SLOT_BITS, np.uint64), _slots(pairs)
    owner[slot] = pairs
    mine = owner[slot] == pairs
    counts = np.bincount(slot[mine], minlength=1 << SLOT_BITS)
    often = counts >= MIN_USES
    if int(often.sum()) > PAIRS_PER_ROUND:
        often = counts >= max(MIN_USES, int(-np.partition(-counts, PAIRS_PER_ROUND)[PAIRS_PER_ROUND]))
    return np.where(often, counts, 0)[slot] * mine


def _repeated(at: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """Weight of each pair that can be replaced twice at least: its rank by number of uses, so that no two pairs weigh the same; 0 for others."""
    slot, out = _slots(pairs), np.zeros(len(pairs), np.int64)
    some = np.flatnonzero(np.bincount(slot, minlength=1 << SLOT_BITS)[slot] > 1)
    own, inv = np.unique(pairs[some], return_inverse=True)
    # of a pair that overlaps with itself in a row, every other one can be replaced
    new = np.concatenate([[True], (at[some[1:]] != at[some[1:] - 1] + 1) | (some[1:] != some[:-1] + 1) | (inv[1:] != inv[:-1])])[:len(some)]
    k = np.arange(len(some))
    uses = np.bincount(inv[(k - np.maximum.accumulate(np.where(new, k, 0))) % 2 == 0], minlength=len(own))
    many = np.flatnonzero(uses > 1)
    rank = np.zeros(len(own), np.int64)
    rank[many[np.argsort(uses[many], kind="stable")]] = np.arange(1, len(many) + 1)
    out[some] = rank[inv]
    return out


def compress(ids: np.ndarray, quick: int = QUICK_ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, rules): Re-Pair in rounds; rule k is a pair and is written RULE_BASE + k.

    The ``quick`` first rounds take frequent pairs only; the others all that repeat, until no pair can be replaced twice.
    """
    seq, rules, n_rules, live, done = ids.astype(np.uint32), [np.zeros((0, 2), np.uint32)], 0, None, 0
    while len(seq) > 3:
        # a rule's number is new, so a pair that occurs once stays so: later rounds look at pairs that repeated and at those next to a replaced one
        at = np.arange(len(seq) - 1) if live is None else np.flatnonzero(live[:-1])
        pairs = (seq[at].astype(np.uint64) << np.uint64(32)) | seq[at + 1]
        weight = _frequent(pairs) if done < quick else _repeated(at, pairs)
        some = np.flatnonzero(weight)
        if len(some):
            some = some[_taken(at[some], weight[some])]
        key = _slots(pairs[some]) if done < quick else weight[some]
        uses = np.bincount(key, minlength=1)
        some, key = some[uses[key] > 1], key[uses[key] > 1]  # pairs of equal count in a row may be left with a single use in a quick round
        if done >= quick and not len(some):
            break
        where, new = at[some], np.flatnonzero(uses > 1)
        example = np.zeros(len(uses), np.int64)
        example[key] = where
        number = np.zeros(len(uses), np.uint32)
        number[new] = np.arange(len(new), dtype=np.uint32) + np.uint32(RULE_BASE + n_rules)
        rules.append(np.stack([seq[example[new]], seq[example[new] + 1]], 1))
        n_rules, done = n_rules + len(new), done + 1
        keep = np.ones(len(seq), bool)
        keep[where + 1] = False
        if done > quick:
            live = np.zeros(len(seq), bool)
            live[at[weight > 0]] = True
            live[where] = True
            live[np.maximum(where - 1, 0)] = True
            live = live[keep]
        seq[where] = number[key]
        seq = seq[keep]
    return seq, np.concatenate(rules)


def rule_lengths(rules: np.ndarray) -> np.ndarray:
    """How many ids each rule stands for; a rule uses earlier rules only."""
    out = np.zeros(len(rules), np.int64)
    todo = np.arange(len(rules))
    while len(todo):
        parts = np.where(rules[todo] < RULE_BASE, 1, out[np.maximum(rules[todo].astype(np.int64) - RULE_BASE, 0)])
        ready = (parts > 0).all(1)
        out[todo[ready]] = parts[ready].sum(1)
        todo = todo[~ready]
    return out


def expand(symbols: np.ndarray, rules: np.ndarray, rule_lens: np.ndarray | None = None) -> np.ndarray:
    """The ids that the symbols stand for; each symbol of every rule used is visited once, however deep the rules are."""
    lens = rule_lengths(rules) if rule_lens is None else rule_lens
    each = symbol_lengths(symbols, lens)
    at, out = np.cumsum(each) - each, np.empty(int(each.sum()), np.uint32)
    while len(symbols):
        up = symbols >= RULE_BASE
        out[at[~up]] = symbols[~up]
        at, pair = at[up], rules[symbols[up] - RULE_BASE]
        at = np.concatenate([at, at + symbol_lengths(pair[:, 0], lens)])
        symbols = np.concatenate([pair[:, 0], pair[:, 1]])
    return out


def symbol_lengths(symbols: np.ndarray, rule_lens: np.ndarray) -> np.ndarray:
    up = symbols >= RULE_BASE
    out = np.ones(len(symbols), np.int64)
    out[up] = rule_lens[symbols[up] - RULE_BASE]
    return out


def decode_range(shard: dict, start: int, end: int) -> np.ndarray:
    """ids start to end of a shard; looks only at the symbols between the marks around them."""
    arr = lambda k, t: np.frombuffer(shard[k], t)
    marks, symbols, lens = arr("marks", "<i8"), arr("symbols", "<u4"), arr("rule_lens", "<i8")
    first = max(0, int(np.searchsorted(marks, start, side="right")) - 1)
    last = int(np.searchsorted(marks, end, side="left"))
    if end <= start:
        return np.zeros(0, np.uint32)
    some = symbols[first * MARK:last * MARK]
    upto = marks[first] + np.cumsum(symbol_lengths(some, lens))
    a, b = int(np.searchsorted(upto, start, side="right")), int(np.searchsorted(upto, end, side="left")) + 1
    before = marks[first] if a == 0 else upto[a - 1]
    return expand(some[a:b], arr("rules", "<u4").reshape(-1, 2), lens)[start - before:end - before]


# --- writing and reading ------------------------------------------------------------------------------------------

def _shard_row(part: int, shard: int, before: int, ids: list[np.ndarray], doc_ids: list, lens: list[int]) -> dict:
    flat = np.concatenate(ids)
    symbols, rules = compress(flat)
    rule_lens = rule_lengths(rules)
    each = symbol_lengths(symbols, rule_lens)
    marks = (np.cumsum(each) - each)[::MARK]
    raw = lambda x, t: np.ascontiguousarray(x, t).tobytes()
    return {"part": part, "shard": shard, "ids_before": before, "n_ids": len(flat),
            "doc_ids": raw([d or 0 for d in doc_ids], "<i8"), "doc_null": raw([d is None for d in doc_ids], "u1"),
            "doc_lens": raw(lens, "<i8"), "rules": raw(rules, "<u4"), "rule_lens": raw(rule_lens, "<i8"),
            "symbols": raw(symbols, "<u4"), "marks": raw(marks, "<i8")}


def _arrow(rows: list[dict]) -> pa.RecordBatch:
    kinds = {"part": pa.int32(), "shard": pa.int32(), "ids_before": pa.int64(), "n_ids": pa.int64()}
    return pa.RecordBatch.from_pylist(rows, schema=pa.schema(
        [(c.split()[0], kinds.get(c.split()[0], pa.binary())) for c in SCHEMA.split(", ")]))


def write_shards(docs: DataFrame, path: str, tokenizer: str | None = None, id_col: str = "doc_id",
                 text_col: str = "text", shard_ids: int = SHARD_IDS) -> None:
    """Encodes every whole text, appends END_ID, and writes the shards of all documents under ``path``."""
    vocabulary = tokenizer or tokenizer_path(WORD_BPE)

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, enc = TaskContext.get().partitionId(), encoder(vocabulary, False)
        n = before = 0
        ids, docs_, lens, size = [], [], [], 0
        for batch in batches:
            flat, counts = enc.encode(batch.column(1).to_pylist())
            at = 0
            for d, k in zip(batch.column(0).to_pylist(), counts.tolist()):
                ids += [flat[at:at + k], np.array([END_ID], np.uint32)]
                docs_.append(d)
                lens.append(k + 1)
                at, size = at + k, size + k + 1
                if size >= shard_ids:
                    yield _arrow([_shard_row(part, n, before, ids, docs_, lens)])
                    n, before, size = n + 1, before + size, 0
                    ids, docs_, lens = [], [], []
        if docs_:
            yield _arrow([_shard_row(part, n, before, ids, docs_, lens)])

    rows = docs.select(F.col(id_col).cast("long").alias("d"), F.col(text_col).alias("t"))
    rows.repartitionByRange("d").sortWithinPartitions("d", "t").mapInArrow(shards, SCHEMA).write.parquet(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the shards: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = expand(np.frombuffer(row["symbols"], "<u4"), np.frombuffer(row["rules"], "<u4").reshape(-1, 2),
                             np.frombuffer(row["rule_lens"], "<i8"))
                lens = np.frombuffer(row["doc_lens"], "<i8")
                ends, raw = np.cumsum(lens), np.ascontiguousarray(ids, "<u4").data.cast("B")
                crc = [zlib.crc32(raw[4 * (e - n):4 * e]) for e, n in zip(ends.tolist(), lens.tolist())]
                null = np.frombuffer(row["doc_null"], "u1").astype(bool)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(lens), row["part"], np.int32)),
                    pa.array(np.frombuffer(row["doc_ids"], "<i8"), mask=null),
                    pa.array(row["ids_before"] + ends - lens), pa.array(lens), pa.array(crc, pa.int64())],
                    names=["part", "doc_id", "local", "n_tokens", "ids_crc32"])

    shards = spark.read.schema(SCHEMA).parquet(path)
    sums = shards.groupBy("part").agg(F.sum("n_ids").alias("ids"))
    before = sums.select("part", (F.sum("ids").over(Window.orderBy("part")) - F.col("ids")).alias("before"))
    docs = shards.mapInArrow(decode, "part int, doc_id long, local long, n_tokens long, ids_crc32 long")
    return docs.join(F.broadcast(before), "part").select(  # one row for each written part
        "doc_id", (F.col("before") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")
