"""Benchmark passages in documents, paraphrases too, by latent semantic retrieval.

Words are lower-cased runs of letters and digits, weighted by their inverse document frequency over all documents (counted in
TERM_SLOTS hash slots).  Benchmark items are cut into passages of WINDOW words; a randomised SVD of their weighted term
vectors, summed up by Spark, gives a space of at most RANK dimensions.  Every window of every document is projected into
it (stride WINDOW / 2) and held against all passages of the benchmark, in blocks; a cosine of at least COSINE makes a
candidate.  A candidate's longest common subsequence with the item, weighted by word, decides: the document holds the
item if it covers STRONG of it, or WEAK of it together with ANSWER_SHARE of the answer (the item's last words, or a
column of its own).  Of an item with at least one number (a word with a digit) for every NUMBER_WORDS words, STRONG of the
numbers must be covered as well: the same wording with other numbers is another item.

The benchmark is searched in blocks of at most RANK passages (and BLOCK_ITEMS items), each with an SVD of its own: the rank of
a block's space is never below its number of passages, so it keeps every inner product with them.  The passages of one long
item may stand in several blocks.

Edge cases: null or empty texts and items without letters and digits match nothing; repeated items are items like others, repeated
documents give repeated rows of one result row (results are distinct by doc_id and item_id); rows without doc_id are searched and
reported with a null doc_id; an empty table on either side gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridmap.llm.common import WORD_BYTES, slices, texts_bytes, word_hashes, word_spans, written

SLOT_BITS, WINDOW, RANK, COSINE, BLOCK_ITEMS = 17, 32, 512, 0.35, 20_000
#: Passages that one task deals into blocks.
DEALT_PASSAGES = 16 * RANK
#: Passages whose products are bounded together before those of each are summed.
GROUP = 16
STRONG, WEAK, ANSWER_WORDS, ANSWER_SHARE, NUMBER_WORDS = 0.7, 0.5, 5, 0.8, 16


def slots_of(words: np.ndarray) -> np.ndarray:
    return (words >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def document_frequencies(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """In how many documents each hash slot has a word; the last entry is the number of documents."""
    n_slots = 1 << SLOT_BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_slots + 1, np.int64)
        for b in batches:
            texts = b.column(0).to_pylist()
            total[-1] += len(texts)
            for a, z in slices(texts):
                words, edges = word_hashes(texts[a:z], WORD_BYTES)
                doc = np.repeat(np.arange(z - a), np.diff(edges))
                key = np.unique((doc << SLOT_BITS) | slots_of(words))
                total += np.bincount(key & (n_slots - 1), minlength=n_slots + 1)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["slot", "n"])

    rows = (docs.select(text_col).mapInArrow(count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toPandas())
    out = np.zeros(n_slots + 1)
    out[rows["slot"].to_numpy()] = rows["n"].to_numpy()
    return out


def weights(frequencies: np.ndarray) -> np.ndarray:
    """Inverse document frequency of each slot."""
    return np.log1p(frequencies[-1] / (1 + frequencies[:-1])).astype(np.float32)


def numbers(texts: list) -> np.ndarray:
    """Which words of all texts have a digit, in the order of ``word_hashes``."""
    data, _ = texts_bytes(texts, WORD_BYTES)
    raw = np.frombuffer(data, np.uint8)
    digits = np.concatenate([[0], np.cumsum((raw >= ord("0")) & (raw <= ord("9")))])
    starts, ends = word_spans(data)
    return digits[ends] > digits[starts]


def passages(items: list[np.ndarray], spans: list[tuple[int, int]] | None = None) -> tuple[list[int], list[np.ndarray]]:
    """Windows of WINDOW words over each item (the last one ends with the item): item number and words.

    ``spans``: of each item only its passages from the first number to before the second.
    """
    number, out = [], []
    for i, w in enumerate(items):
        starts = [*range(0, max(1, len(w) - WINDOW), WINDOW), *([len(w) - WINDOW] if len(w) > WINDOW else [])] if len(w) else []
        for s in starts[slice(*spans[i])] if spans else starts:
            number.append(i)
            out.append(w[s:s + WINDOW])
    return number, out


def n_passages(texts: list) -> np.ndarray:
    """Number of passages of each text."""
    n = np.diff(word_hashes(texts, WORD_BYTES)[1])
    return np.where(n > WINDOW, -(-(n - WINDOW) // WINDOW) + 1, np.minimum(n, 1))


def dealt(items: DataFrame, rank: int) -> DataFrame:
    """``items`` (i, text, a) with block, first, last: passages first to before last of an item are in a block.

    No block has more than ``rank`` passages or BLOCK_ITEMS items; items without words are left out.
    """
    limit = BLOCK_ITEMS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([int(n_passages(b.column(0).to_pylist()).sum())])], names=["n"])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block, held, n_items = TaskContext.get().partitionId() << 32, 0, 0
        for b in batches:
            at, places = [], []
            for k, n in enumerate(n_passages(b.column(1).to_pylist()).tolist()):
                first = 0
                while first < n:
                    if held == rank or n_items == limit:
                        block, held, n_items = block + 1, 0, 0
                    last = min(n, first + rank - held)
                    at.append(k)
                    places.append((block, first, last))
                    held, n_items, first = held + last - first, n_items + 1, last
            some = b.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*some.columns, *[pa.array([p[c] for p in places], pa.int64()) for c in range(3)]],
                                             names=["i", "text", "a", "block", "first", "last"])

    total = items.select("text").mapInArrow(count, "n long").agg(F.sum("n")).first()[0] or 0
    return items.coalesce(max(1, total // DEALT_PASSAGES)).select("i", "text", "a").mapInArrow(
        deal, "i long, text string, a string, block long, first long, last long")


@dataclass
class Space:
    """Latent space: a row for each slot of the benchmark's vocabulary."""

    slots: np.ndarray
    basis: np.ndarray  # len(slots) x rank, orthonormal columns
    singular: np.ndarray

    def rows(self, slots: np.ndarray) -> np.ndarray:
        """Row of each slot, -1 outside the vocabulary."""
        if not len(self.slots):
            return np.full(len(slots), -1)
        at = np.minimum(np.searchsorted(self.slots, slots), len(self.slots) - 1)
        return np.where(self.slots[at] == slots, at, -1)


def _omega(slots: np.ndarray, rank: int) -> np.ndarray:
    """The same random row for a slot in every task."""
    return np.stack([np.random.default_rng(int(s)).standard_normal(rank) for s in slots]) if len(slots) else np.zeros((0, rank))


def latent_space(items: DataFrame, weight: np.ndarray, rank: int = RANK, text_col: str = "text", span_cols: tuple[str, ...] = ()) -> Space:
    """Randomised SVD of the weighted passages of ``items``: sums over passages are made in Spark.

    ``span_cols``: columns of the first passage of a row to take, and of the one after the last.
    One power iteration: Z = A' A Omega, an orthonormal basis of Z, and the singular values from the small Gram matrix of A Q.
    """
    weight_of = items.sparkSession.sparkContext.broadcast(weight)  # 2^SLOT_BITS numbers

    def matrix(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        words, edges = word_hashes(b.column(0).to_pylist(), WORD_BYTES)
        spans = list(zip(b.column(1).to_pylist(), b.column(2).to_pylist())) if span_cols else None
        _, some = passages([words[s:e] for s, e in zip(edges, edges[1:])], spans)
        vocabulary = np.unique(slots_of(np.concatenate([*some, np.zeros(0, np.uint64)])))
        a = np.zeros((len(some), len(vocabulary)))
        for i, w in enumerate(some):
            s = np.unique(slots_of(w))
            a[i, np.searchsorted(vocabulary, s)] = weight_of.value[s]
        return vocabulary, a

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 200):
                vocabulary, a = matrix(b.slice(k, 200))
                z = (a.T @ (a @ _omega(vocabulary, width))).astype(np.float32)
                yield pa.RecordBatch.from_arrays([pa.array(vocabulary), pa.array([r.tobytes() for r in z], pa.binary())], names=["slot", "z"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        """Sums of the rows of each slot (of one group of slots)."""
        own, inv = np.unique(pdf["slot"].to_numpy(), return_inverse=True)
        z = np.zeros((len(own), width), np.float32)
        for i, r in zip(inv, pdf["z"]):
            z[i] += np.frombuffer(r, np.float32)
        return pd.DataFrame({"slot": own, "z": [r.tobytes() for r in z]})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([sum(len(matrix(b.slice(k, 200))[1]) for k in range(0, b.num_rows, 200))])], names=["n"])

    items = items.select(text_col, *span_cols)
    width = min(rank, max(1, items.mapInArrow(count, "n long").agg(F.sum("n")).first()[0] or 0))
    rows = (items.mapInArrow(sketch, "slot long, z binary").groupBy(F.pmod("slot", F.lit(256)))
            .applyInPandas(add, "slot long, z binary").toPandas().sort_values("slot"))
    slots = rows["slot"].to_numpy(np.int64)
    z = np.frombuffer(b"".join(rows["z"]), np.float32).reshape(len(slots), width) if len(slots) else np.zeros((0, width), np.float32)
    q = np.linalg.qr(z)[0] if len(slots) else z

    def gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((q.shape[1], q.shape[1]))
        for b in batches:
            for k in range(0, b.num_rows, 200):
                vocabulary, a = matrix(b.slice(k, 200))
                y = a @ q[np.searchsorted(slots, vocabulary)]
                total += y.T @ y
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["g"])

    if not len(slots):
        return Space(slots, z.astype(np.float32), np.zeros(0))
    total = sum(np.frombuffer(r["g"]).reshape(q.shape[1], -1) for r in items.coalesce(8).mapInArrow(gram, "g binary").collect())
    value, vector = np.linalg.eigh(total)
    order = np.argsort(-value)
    order = order[value[order] > 1e-9 * value.max()][:rank]
    return Space(slots, (q @ vector[:, order]).astype(np.float32), np.sqrt(value[order]))


def covered(item: np.ndarray, weight: np.ndarray, text: np.ndarray) -> tuple[float, np.ndarray]:
    """Weight of the heaviest common subsequence as a share of the item's, and which words of the item it uses.

    Of the table only every sqrt(n)-th row is kept; on the way back the rows between are computed again, a stretch at a time.
    """
    def row(i: int, last: np.ndarray) -> np.ndarray:
        step = np.where(text == item[i], last[:-1] + weight[i], 0)
        return np.concatenate([[0.0], np.maximum.accumulate(np.maximum(step, last[1:]))])

    every = max(1, int(len(item) ** 0.5))
    kept, last = [], np.zeros(len(text) + 1)
    for i in range(len(item)):
        if i % every == 0:
            kept.append(last)
        last = row(i, last)
    total = last[-1]
    used, i, j = np.zeros(len(item), bool), len(item), len(text)
    for k in range(len(kept) - 1, -1, -1):
        first = k * every
        if i <= first or not j:
            continue
        best = [kept[k]]
        while first + len(best) <= i:
            best.append(row(first + len(best) - 1, best[-1]))
        while i > first and j:
            here, above = best[i - first], best[i - first - 1]
            if here[j] == above[j]:
                i -= 1
            elif here[j] == here[j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                used[i] = True
    return min(1.0, float(total / max(weight.sum(), 1e-9))), used


@dataclass
class Index:
    """A block of the benchmark: item words, passages in the latent space, and what is needed to weigh words."""

    ids: list
    items: list[np.ndarray]
    answers: list[np.ndarray]
    weight: np.ndarray
    space: Space
    spans: list[tuple[int, int]] | None = None  # of the passages of each item that are in the block
    numbers: list[np.ndarray] | None = None  # which words of each item have a digit

    def __post_init__(self) -> None:
        number, some = passages(self.items, self.spans)
        self.number = np.array(number, np.int64)
        x = np.zeros((len(some), self.space.basis.shape[1]), np.float32)
        norm = np.ones(len(some), np.float32)
        for k, w in enumerate(some):
            s = np.unique(slots_of(w))
            x[k] = self.weight[s] @ self.space.basis[self.space.rows(s)]
            norm[k] = np.sqrt((self.weight[s] ** 2).sum())
        self.vectors = x / np.maximum(norm, 1e-9)[:, None]
        self.least_norm = float(norm.min()) if len(some) else 1.0
        self.vocabulary = np.unique(np.concatenate([*some, np.zeros(0, np.uint64)]))
        self.row_of = self.space.rows(slots_of(self.vocabulary))

    @cached_property
    def lookup(self) -> np.ndarray:
        """Products of each word's weighted row of the space with all passages: a window's cosines are sums of these over its words."""
        return (self.weight[self.space.slots][:, None] * self.space.basis) @ self.vectors.T

    @cached_property
    def bounds(self) -> np.ndarray:
        """The greatest products among GROUP passages at a time."""
        return np.maximum.reduceat(self.lookup, np.arange(0, len(self.vectors), GROUP), axis=1)

    def possible(self, words: np.ndarray, edges: np.ndarray) -> np.ndarray:
        """Numbers of the documents (words ``edges[d]`` to before ``edges[d + 1]``) with a window that reaches COSINE, all documents at once;
        thresholds leave room for rounding, so that a document left out has no candidate."""
        n = np.diff(edges)
        if not len(words) or not len(self.vectors):
            return np.zeros(0, np.int64)
        w = self.weight[slots_of(words)].astype(np.float64) ** 2
        at = np.minimum(np.searchsorted(self.vocabulary, words), len(self.vocabulary) - 1)
        row = np.where(self.vocabulary[at] == words, self.row_of[at], -1)
        windows = np.where(n > 0, -(-np.maximum(n - WINDOW // 2, 1) // (WINDOW // 2)), 0)
        doc = np.repeat(np.arange(len(n)), windows)
        start = edges[doc] + (np.arange(len(doc)) - np.repeat(np.cumsum(windows) - windows, windows)) * (WINDOW // 2)
        end = np.minimum(start + WINDOW, edges[doc + 1])
        mass, own = (np.concatenate([[0], np.cumsum(x)]) for x in (w, np.where(row >= 0, w, 0)))
        slack = 1e-9 * (1 + mass[-1])  # sums over all documents are rounded more than those of one
        norm, shared = np.sqrt(np.maximum(mass[end] - mass[start] - slack, 0)), own[end] - own[start] + slack
        some, out = np.flatnonzero((np.sqrt(shared) >= COSINE * norm) & (shared >= COSINE * norm * self.least_norm)), []
        for k in range(0, len(some), 128):
            block = some[k:k + 128]
            at = start[block][:, None] + np.arange(WINDOW)
            rows = np.sort(np.where(at < end[block][:, None], row[np.minimum(at, len(row) - 1)], -1), 1)
            new = rows >= 0
            new[:, 1:] &= rows[:, 1:] != rows[:, :-1]
            for table in (self.bounds, self.lookup):
                size = new.sum(1)
                block, new, rows, size = (x[size > 0] for x in (block, new, rows, size))
                if len(block):
                    product = np.add.reduceat(table[rows[new]], np.cumsum(size) - size, axis=0).max(1)
                    left = product >= (COSINE - 0.001) * norm[block]
                    block, new, rows = block[left], new[left], rows[left]
            out.append(doc[block])
        return np.unique(np.concatenate(out)) if out else np.zeros(0, np.int64)

    def candidates(self, words: np.ndarray) -> list[tuple[int, int, float]]:
        """(item number, first word of the window, cosine) of one document's windows."""
        n = len(words)
        if not n or not len(self.vectors):
            return []
        slots = slots_of(words)
        w = self.weight[slots]
        at = np.minimum(np.searchsorted(self.vocabulary, words), len(self.vocabulary) - 1)
        row = np.where(self.vocabulary[at] == words, self.row_of[at], -1)  # other words of a slot are no match
        mass = np.concatenate([[0], np.cumsum(w.astype(np.float64) ** 2)])
        own = np.concatenate([[0], np.cumsum(np.where(row >= 0, w, 0).astype(np.float64) ** 2)])
        start = np.arange(0, max(1, n - WINDOW // 2), WINDOW // 2)
        end = np.minimum(start + WINDOW, n)
        norm = np.sqrt(mass[end] - mass[start])
        shared = own[end] - own[start]  # the product with a passage is at most this, and at most its root times the passage's norm
        some = np.flatnonzero((np.sqrt(shared) >= COSINE * norm) & (shared >= COSINE * norm * self.least_norm))
        out = []
        for k in range(0, len(some), 256):
            block = some[k:k + 256]
            x = np.zeros((len(block), self.space.basis.shape[1]), np.float32)
            for i, s in enumerate(block):
                seen = row[start[s]:end[s]]
                seen = np.unique(seen[seen >= 0])
                x[i] = self.weight[self.space.slots[seen]] @ self.space.basis[seen]
            cosine = x @ self.vectors.T / np.maximum(norm[block], 1e-9)[:, None]
            for i, j in zip(*np.nonzero(cosine >= COSINE)):
                out.append((int(self.number[j]), int(start[block[i]]), float(cosine[i, j])))
        return out

    def matches(self, words: np.ndarray) -> list[tuple]:
        """(item id, cosine, covered share, covered share of the answer, first word) of the items that the document holds."""
        best: dict[int, tuple] = {}
        for i, start, cosine in sorted(self.candidates(words), key=lambda c: -c[2]):
            item = self.items[i]
            if best.get(i, (0, 0))[1] >= 0.999:
                continue
            share, used = covered(item, self.weight[slots_of(item)], words[max(0, start - len(item)):start + WINDOW + len(item)])
            answer = np.isin(self.answers[i], item[used]).mean() if len(self.answers[i]) else 0.0
            number = self.numbers[i] if self.numbers else np.zeros(len(item), bool)
            if number.any() and number.sum() * NUMBER_WORDS >= len(item) and used[number].mean() < STRONG:
                continue
            if (share >= STRONG or share >= WEAK and answer >= ANSWER_SHARE) and share > best.get(i, (0, 0))[1]:
                best[i] = (cosine, share, float(answer), start)
        return [(self.ids[i], *b) for i, b in sorted(best.items())]


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                 item_text_col: str = "text", answer_col: str | None = None, rank: int = RANK) -> DataFrame:
    """doc_id, item_id, cosine, lcs_share, answer_share, first_word of every document that holds a benchmark item."""
    spark = docs.sparkSession
    schema = "doc_id long, item_id long, cosine double, lcs_share double, answer_share double, first_word long"
    items = written(benchmark.select(F.col(item_col).cast("long").alias("i"), F.coalesce(F.col(item_text_col), F.lit("")).alias("text"),
                                     (F.col(answer_col) if answer_col else F.lit(None)).cast("string").alias("a")), "bench-items")
    items = written(dealt(items, rank), "bench-blocks")
    blocks = sorted(r["block"] for r in items.select("block").distinct().collect())
    if not blocks:
        return spark.createDataFrame([], schema)
    weight, found = weights(document_frequencies(docs, text_col)), None
    for b in blocks:
        some = items.where(F.col("block") == b)
        space = latent_space(some, weight, rank, span_cols=("first", "last"))
        rows = some.orderBy("i", "text", "first").collect()  # at most ``rank`` passages
        words, edges = word_hashes([r["text"] for r in rows], WORD_BYTES)
        texts, digits = [words[s:e] for s, e in zip(edges, edges[1:])], numbers([r["text"] for r in rows])
        own, ends = word_hashes([r["a"] for r in rows], WORD_BYTES)
        answers = [own[s:e] if e > s else t[-ANSWER_WORDS:] for s, e, t in zip(ends, ends[1:], texts)]
        index = spark.sparkContext.broadcast(Index([r["i"] for r in rows], texts, answers, weight, space, [(r["first"], r["last"]) for r in rows],
                                                    [digits[s:e] for s, e in zip(edges, edges[1:])]))

        def search(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids, texts_, out = batch.column(0).to_pylist(), batch.column(1).to_pylist(), []
                for a, z in slices(texts_):
                    words, edges = word_hashes(texts_[a:z], WORD_BYTES)
                    for k in index.value.possible(words, edges).tolist():
                        out += [(ids[a + k], *m) for m in index.value.matches(words[edges[k]:edges[k + 1]])]
                kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], t) for c, t in enumerate(kinds)],
                                                 names=[c.split()[0] for c in schema.split(", ")])

        part = written(docs.select(F.col(id_col).cast("long").alias("d"), F.col(text_col).alias("t")).mapInArrow(search, schema), "bench-found")
        index.destroy()
        found = part if found is None else found.unionByName(part)
    best = F.max(F.struct("lcs_share", "cosine", "answer_share", "first_word")).alias("b")
    return (found.groupBy("doc_id", "item_id").agg(best)
            .select("doc_id", "item_id", "b.cosine", "b.lcs_share", "b.answer_share", "b.first_word"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows (id and text) that hold a benchmark item, with or without an id."""
    row = F.xxhash64(F.col(f"`{id_col}`").isNull(), F.col(f"`{id_col}`"), F.col(f"`{text_col}`"))
    rows = docs.select(row.alias("__row"), F.col(f"`{text_col}`").alias("__text"))
    gone = contaminated(rows, benchmark, "__row", "__text").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, row == F.col("__gone"), "left_anti")
