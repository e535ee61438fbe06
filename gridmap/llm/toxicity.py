"""Toxicity by a factorization machine over hashed terms.

Terms are lower-cased runs of letters and their prefixes, hashed to SLOTS.  The machine is fitted on a bounded sample
of labelled documents (SAMPLE rows with the smallest hash of their id), on the SELECTED terms that differ most between
the classes.  Its score is sigmoid(w0 + sum of w + sum over pairs of <v_i, v_j>): the pair terms learn what single
weights miss, such as an insult together with a group.  Every whole text is scored.

Edge cases: a null or empty text has no terms and scores sigmoid(w0); a document with several labels counts as its
highest; without labels of both classes every score is 0 or 1, as the labels are (0 without any).  Null ids are never
training rows.  Repeated rows are scored alike.  Columns named like an added one are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridmap.llm.common import LETTER_BYTES, replace_columns, slices, span_hashes, texts_bytes, with_fields, word_spans

SLOT_BITS, PREFIXES, SAMPLE, SELECTED, RANK, THRESHOLD = 20, (4, 5, 6), 12_000, 2048, 8, 0.7


def term_slots(texts: list) -> list[np.ndarray]:
    """Distinct hash slots of each text's terms, ascending."""
    out = []
    for a, b in slices(texts):
        data, offsets = texts_bytes(texts[a:b], LETTER_BYTES)
        starts, ends = word_spans(data)
        doc = np.searchsorted(offsets, starts, side="right") - 1
        keys = [(doc << SLOT_BITS) | (span_hashes(data, starts, ends) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)]
        for n in PREFIXES:
            longer = ends - starts > n
            h = span_hashes(data, starts[longer], starts[longer] + n) + np.uint64(n << 40)
            keys.append((doc[longer] << SLOT_BITS) | (h >> np.uint64(64 - SLOT_BITS)).astype(np.int64))
        keys = np.unique(np.concatenate(keys))
        edges = np.searchsorted(keys, np.arange(b - a + 1) << SLOT_BITS)
        out += [(keys[s:e] & ((1 << SLOT_BITS) - 1)).astype(np.int32) for s, e in zip(edges, edges[1:])]
    return out


def _csr(rows: list[np.ndarray], column: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Selected features of each row: flat column numbers and row edges."""
    picked = [c[c >= 0] for c in (column[r] for r in rows)]
    edges = np.concatenate([[0], np.cumsum([len(p) for p in picked])]).astype(np.int64)
    return (np.concatenate(picked) if picked else np.zeros(0, np.int64)).astype(np.int64), edges


def _row_sums(x: np.ndarray, edges: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros((1, *x.shape[1:])), np.cumsum(x, axis=0)])
    return total[edges[1:]] - total[edges[:-1]]


@dataclass
class Machine:
    column: np.ndarray  # slot -> feature, -1 for slots that are not used
    w0: float
    w: np.ndarray
    v: np.ndarray

    def margin(self, flat: np.ndarray, edges: np.ndarray) -> np.ndarray:
        v = self.v[flat]
        s = _row_sums(v, edges)
        return self.w0 + _row_sums(self.w[flat], edges) + 0.5 * ((s * s).sum(1) - _row_sums((v * v).sum(1), edges))

    def score(self, texts: list) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(*_csr(term_slots(texts), self.column)), -40, 40)))


def fit(rows: list[np.ndarray], labels: np.ndarray, selected: int = SELECTED, rank: int = RANK, epochs: int = 30) -> Machine:
    """AdaGrad on the logistic loss, in shuffled batches; only terms of at least 5 rows are selected, by chi-square."""
    y, slots, n = labels.astype(float), 1 << SLOT_BITS, len(rows)
    none = np.full(slots, -1, np.int16)
    if not n or y.min() == y.max():
        return Machine(none, 40.0 if n and y[0] else -40.0, np.zeros(1), np.zeros((1, rank)))
    df, pos = np.zeros(slots), np.zeros(slots)
    for k in range(0, n, 256):  # some rows at a time: the driver holds no second copy of the sample
        some = np.concatenate(rows[k:k + 256])
        df += np.bincount(some, minlength=slots)
        pos += np.bincount(some, np.repeat(y[k:k + 256], [len(r) for r in rows[k:k + 256]]), slots)
    p = y.mean()
    often = np.flatnonzero(df >= 5)
    d, o = df[often], pos[often]
    chi = (o - d * p) ** 2 / np.maximum(d * p * (1 - p) * (1 - d / (n + 1)), 1e-9)
    best = np.argsort(-chi, kind="stable")[:selected]
    best = often[best[chi[best] > 20]]
    column = none.copy()
    column[best] = np.arange(len(best))
    flat, edges = _csr(rows, column)
    rng = np.random.default_rng(7)
    m = Machine(column, float(np.log(p / (1 - p))), np.zeros(max(1, len(best))), rng.normal(0, 0.05, (max(1, len(best)), rank)))
    g0, gw, gv, rate, decay = 1e-6, np.full(len(m.w), 1e-6), np.full(m.v.shape, 1e-6), 0.15, 1e-4
    for _ in range(epochs):
        order = rng.permutation(n)
        for k in range(0, n, 256):
            pick = order[k:k + 256]
            lens = edges[pick + 1] - edges[pick]
            own = np.concatenate([[0], np.cumsum(lens)])
            cols = flat[np.repeat(edges[pick] - own[:-1], lens) + np.arange(own[-1])]
            err = 1 / (1 + np.exp(-np.clip(m.margin(cols, own), -40, 40))) - y[pick]
            e = np.repeat(err, lens)
            s = np.repeat(_row_sums(m.v[cols], own), lens, axis=0)
            dw, dv = np.bincount(cols, e, len(m.w)) / len(pick) + decay * m.w, decay * m.v
            step = e[:, None] * (s - m.v[cols])
            for f in range(rank):
                dv[:, f] += np.bincount(cols, step[:, f], len(m.w)) / len(pick)
            d0 = err.mean()
            g0, gw, gv = g0 + d0 * d0, gw + dw * dw, gv + dv * dv
            m.w0 -= rate * d0 / np.sqrt(g0)
            m.w -= rate * dw / np.sqrt(gw)
            m.v -= 0.3 * rate * dv / np.sqrt(gv)
    return m


def sample_rows(docs: DataFrame, labels: DataFrame, training: Column | None, sample: int = SAMPLE, id_col: str = "doc_id",
                text_col: str = "text", label_col: str = "toxic") -> tuple[list[np.ndarray], np.ndarray]:
    """Term slots and labels of the ``sample`` labelled documents with the smallest hash of their id."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("id is not null and y is not null")
    if training is not None:
        known = known.where(training)
    known = known.groupBy("id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("id"), "id").limit(sample)

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [r.tobytes() for r in term_slots(b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(rows, pa.binary())], names=["id", "y", "slots"])

    rows = (docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).join(F.broadcast(known), "id")  # SAMPLE rows
            .mapInArrow(slots, "id long, y int, slots binary").limit(sample).collect())
    rows.sort(key=lambda r: (r["id"], r["slots"]))
    return [np.frombuffer(r["slots"], np.int32) for r in rows], np.array([r["y"] for r in rows])


def score(docs: DataFrame, machine: Machine, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """All rows and columns of ``docs`` with score and predicted (1 from ``threshold`` on)."""
    base = replace_columns(docs, ["score", "predicted"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, s = b.column(b.schema.get_field_index(text_col)).to_pylist(), []
            for a, z in slices(texts):
                s.append(machine.score(texts[a:z]))
            s = np.concatenate(s) if s else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s), pa.array((s >= threshold).astype(np.int32))],
                                             names=[*b.schema.names, "score", "predicted"])

    return base.mapInArrow(run, with_fields(base, score="double", predicted="integer"))


def drop_toxic(docs: DataFrame, machine: Machine, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows and columns of ``docs`` that are not predicted toxic."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(b.schema.get_field_index(text_col)).to_pylist()
            keep = [machine.score(texts[a:z]) < threshold for a, z in slices(texts)]
            yield b.filter(pa.array(np.concatenate(keep) if keep else np.zeros(0, bool)))

    return docs.mapInArrow(run, docs.schema)


def train(docs: DataFrame, labels: DataFrame, training: Column | None = None, sample: int = SAMPLE) -> Machine:
    """``training``: a condition on the column ``id`` that training rows meet."""
    return fit(*sample_rows(docs, labels, training, sample))
