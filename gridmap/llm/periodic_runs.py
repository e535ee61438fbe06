"""Periodic runs of words by multi-scale minimizers.

A run is a stretch of consecutive words with smallest period q (words q apart are identical) and a length of at least
max(least, 3 q) that no neighbouring word extends.  Periods below ``first_scale`` come from direct scans at every lag.  Each
further scale looks for periods from Q to 2 Q - 1 in the texts that are long enough for one: of every window of 5 Q / 4 + 1
grams of 3 Q / 4 words the gram with the least hash is picked (the leftmost of equal ones).  Inside a run the same grams are
picked one period later, so pairs of equal picked grams Q to 2 Q - 1 words apart seed every run; each is extended to both sides
by comparing words.  Grams whose own period is at most a third of them are never picked: they lie in runs that earlier scales
found.  Equal picked grams therefore lie more than Q / 4 words apart, so a scale has fewer than eight pairs for each pick, also
in texts of one repeated word, and no pair is left out.  Why no run is missed: q consecutive grams of a run can't all be such
grams (its smallest period would be shorter), so a window at most 2 Q words wide around one that isn't picks a gram, and the
same window stands one period later, still inside the run, which is at least three periods long.

Edge cases: a null or empty text has no words, no runs and collapses to the empty text; a text shorter than ``least`` words has no
runs; rows without a doc_id and repeated rows are handled like any other; columns named like an added one are replaced.  Words are
compared by 64-bit hashes.  A task holds one slice of texts (about a million characters) or one longer text at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from gridmap.llm.common import mix64, replace_columns, slices, span_hashes, with_fields, word_spans

LEAST, TIMES = 24, 3
_SLICE = 1 << 20
_TOP, _NONE = np.uint64(0xFFFFFFFF00000000), np.uint64(0xFFFFFFFFFFFFFFFF)


def first_scale(least: int = LEAST) -> int:
    """The least Q of the scales: a power of two whose grams are no shorter than the shortest run."""
    q = 32
    while 3 * q // 4 < least:
        q *= 2
    return q


def _with_ends(words: np.ndarray, edges: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words of some texts, each text followed by a word of its own that ends every stretch; where each text starts."""
    sizes = edges[docs + 1] - edges[docs]
    at = np.concatenate([[0], np.cumsum(sizes + 1)]).astype(np.int64)
    out = np.empty(at[-1], np.uint64)
    out[at[1:] - 1] = mix64(np.arange(len(docs), dtype=np.uint64) + np.uint64(0x5EED << 40))
    inner = np.ones(len(out), bool)
    inner[at[1:] - 1] = False
    out[inner] = words if len(docs) == len(edges) - 1 else np.concatenate([words[edges[d]:edges[d + 1]] for d in docs])
    return out, at


def _stretches(same: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Maximal stretches of True of at least ``least`` places, as (start, end)."""
    at = np.flatnonzero(same)
    if len(at) < least:
        return []
    cut = np.flatnonzero(np.diff(at) > 1)
    s, e = at[np.concatenate([[0], cut + 1])], at[np.concatenate([cut, [len(at) - 1]])] + 1
    long = e - s >= least
    return list(zip(s[long].tolist(), e[long].tolist()))


def _smallest(x: np.ndarray, lo: int, hi: int, period: int) -> bool:
    """Whether no proper divisor of ``period`` is a period of x[lo:hi] (at least three periods long)."""
    rest, prime = period, 2
    while rest > 1:
        if prime * prime > rest:
            prime = rest
        if rest % prime == 0:
            q = period // prime
            if np.array_equal(x[lo:hi - q], x[lo + q:hi]):
                return False
            while rest % prime == 0:
                rest //= prime
        prime += 1
    return True


def _match_end(x: np.ndarray, a: int, lag: int) -> int:
    """The first place from ``a`` on whose word differs from the one ``lag`` further."""
    step = 256
    while a + lag < len(x):
        b = min(a + step, len(x) - lag)
        differs = x[a:b] != x[a + lag:b + lag]
        k = int(differs.argmax())
        if differs[k]:
            return a + k
        a, step = b, min(2 * step, 1 << 16)
    return a


def _match_start(x: np.ndarray, a: int, lag: int) -> int:
    """The first place of the stretch of such equal places that ends before ``a``."""
    step = 256
    while a > 0:
        b = max(0, a - step)
        differs = (x[b:a] != x[b + lag:a + lag])[::-1]
        k = int(differs.argmax())
        if differs[k]:
            return a - k
        a, step = b, min(2 * step, 1 << 16)
    return 0


def _gram_hashes(x: np.ndarray, q: int) -> np.ndarray:
    """Hashes of all grams of 3 q / 4 words (q a power of two): halves are hashed together, level by level."""
    h, size = x, 1
    with np.errstate(over="ignore"):
        while size < q // 4:
            h, size = mix64(h[:-size] + mix64(h[size:])), 2 * size
        half = mix64(h[:-size] + mix64(h[size:]))  # q / 2 words
        return mix64(half[:len(x) - 3 * size + 1] + mix64(h[2 * size:] + np.uint64(1)))


def _sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while 2 * size <= width:
        v, size = np.minimum(v[:-size], v[size:]), 2 * size
    return np.minimum(v[:-(width - size)], v[width - size:]) if width > size else v


def _seeds(x: np.ndarray, q: int, periodic: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """(lag, place) of equal picked grams q to 2 q - 1 words apart; ``periodic``: grams (from, to) that are never picked."""
    gram = 3 * q // 4
    v = (_gram_hashes(x, q) & _TOP) | np.arange(len(x) - gram + 1, dtype=np.uint64)
    if periodic:
        step = np.zeros(len(v) + 1, np.int64)
        np.add.at(step, [a for a, _ in periodic], 1)
        np.add.at(step, [b for _, b in periodic], -1)
        v[np.cumsum(step[:-1]) > 0] = _NONE
    picks = np.unique(_sliding_min(v, 2 * q - gram + 1))
    picks = picks[picks != _NONE]
    key, at = picks >> np.uint64(32), (picks & ~_TOP).astype(np.int64)
    out, j = [], 1
    while j < len(at):
        lag = at[j:] - at[:-j]
        near = (key[j:] == key[:-j]) & (lag < 2 * q)
        if not near.any():
            break
        near &= lag >= q
        out += zip(lag[near].tolist(), at[:-j][near].tolist())
        j += 1
    return sorted(out)


def find_runs(words: np.ndarray, edges: np.ndarray, least: int = LEAST) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of all runs of each text, by start and period; ``words``: word hashes of texts one after the other."""
    found: list[list[tuple[int, int, int]]] = [[] for _ in range(len(edges) - 1)]
    sizes = np.diff(edges)

    def add(x: np.ndarray, at: np.ndarray, docs: np.ndarray, lo: int, hi: int, q: int) -> None:
        if _smallest(x, lo, hi, q):
            k = int(np.searchsorted(at, lo, side="right")) - 1
            found[docs[k]].append((lo - int(at[k]), hi - lo, q))

    scale, docs = first_scale(least), np.flatnonzero(sizes >= least)
    if len(docs):
        x, at = _with_ends(words, edges, docs)
        for lag in range(1, min(scale, len(x))):
            need = max(least, TIMES * lag) - lag
            for lo, hi in _stretches(x[:-lag] == x[lag:], need):
                add(x, at, docs, lo, hi + lag, lag)
    while len(docs := np.flatnonzero(sizes >= TIMES * scale)):
        x, at = _with_ends(words, edges, docs)
        gram = 3 * scale // 4
        periodic = [(int(at[i]) + s, int(at[i]) + s + n - gram + 1) for i, d in enumerate(docs) for s, n, q in found[d]
                    if TIMES * q <= gram <= n]
        lag = end = -1
        for d, a in _seeds(x, scale, periodic):
            if d == lag and a < end:
                continue  # inside the stretch that was extended last
            lo, lag, end = _match_start(x, a, d), d, _match_end(x, a, d)
            if end - lo >= max(least, TIMES * d) - d:
                add(x, at, docs, lo, end + d, d)
        scale *= 2
    for runs in found:
        runs.sort(key=lambda r: (r[0], r[2]))
    return found


def collapse(text: bytes, runs: list[tuple[int, int, int]]) -> bytes:
    """The words of a text without those that stand in a run after its first period, joined by one space."""
    words = text.split()  # bytes split at the six ASCII white space characters
    if runs:
        keep = np.ones(len(words), bool)
        for start, length, period in runs:
            keep[start + period:start + length] = False
        words = compress(words, keep.tolist())
    return b" ".join(words)


def _hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    data = b" ".join(texts) + b" "
    starts, ends = word_spans(data)
    offsets = np.cumsum([0, *[len(t) + 1 for t in texts]])
    return span_hashes(data, starts, ends), np.searchsorted(starts, offsets)


def periodic_runs(docs: DataFrame, text_col: str = "text", least: int = LEAST) -> DataFrame:
    """The columns of ``docs`` but its text, with n_words, runs (start, length, period) and collapsed (the text without repeats)."""
    base = replace_columns(docs, ["n_words", "runs", "collapsed"])
    base = base.withColumn(text_col, base[text_col].cast("binary"))
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            place = b.schema.get_field_index(text_col)
            texts = [t or b"" for t in b.column(place).to_pylist()]
            rest = [i for i in range(b.num_columns) if i != place]
            for a, z in slices(texts, _SLICE):
                words, edges = _hashes(texts[a:z])
                found = find_runs(words, edges, least)
                flat = [r for runs in found for r in runs]
                cut = pa.array(np.cumsum([0, *map(len, found)]), pa.int32())
                cells = pa.StructArray.from_arrays([pa.array([r[i] for r in flat], pa.int64()) for i in range(3)], fields=list(kind.value_type))
                yield pa.RecordBatch.from_arrays(
                    [*[b.column(i).slice(a, z - a) for i in rest], pa.array(np.diff(edges), pa.int64()),
                     pa.ListArray.from_arrays(cut, cells, type=kind),
                     pa.array([collapse(t, r) for t, r in zip(texts[a:z], found)], pa.binary()).cast(pa.string())],
                    names=[*[b.schema.names[i] for i in rest], "n_words", "runs", "collapsed"])

    cell = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")])
    schema = with_fields(base.drop(text_col), n_words="long").add("runs", T.ArrayType(cell)).add("collapsed", "string")
    return base.mapInArrow(run, schema)
