"""Quality of documents by a sparse ensemble of rules over text statistics.

Statistics of every whole text (shares of kinds of characters, word and line counts, repeated words, ...) are counted with numpy in
Arrow tasks.  Boosted trees of DEPTH levels are grown on labelled documents; every path from a root to a node is a rule, a
conjunction of bounds on statistics.  A logistic model with an L1 penalty weighs the rules; the penalty is the largest whose loss
on every fourth row, not fitted on, is within one standard error of the least one.  The rules that keep a weight are compiled
into a Spark column over the statistics, so scoring is plain column arithmetic after the count.

Fitted on a bounded sample: the SAMPLE labelled documents with the smallest hash of their id.  Only their statistics reach the driver.

Edge cases: a null or empty text has all statistics 0 and is scored by the same rules; a document with several labels counts as its
lowest; without labels of both classes every score is 0 or 1, as the labels are (0 without any).  Null ids are never training
rows; an id that repeats is one training row (of its rows the one with the least statistics).  Columns named like an added one
are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridmap.llm.common import LOWER_BYTES, mix64, replace_columns, slices, span_hashes, with_fields, word_spans

SAMPLE, TREES, DEPTH, BINS, LEAST_ROWS, THRESHOLD = 12_000, 40, 3, 32, 5, 0.5
STATISTICS = ["chars", "words", "lines", "word_length", "longest_word", "line_length", "distinct_words", "distinct_lines", "commonest_word",
              "repeated_neighbours", "sentence_ends", "upper", "letters", "digits", "spaces", "commas", "stops", "exclamations", "bars", "symbols"]
_KINDS = ["lower", "upper", "other", "inside", "digit", "space", "comma", "stop", "exclamation", "bar", "symbol"]


def _kind_table() -> np.ndarray:
    """Kind of each byte; ``other``: first bytes of characters outside ASCII, ``inside``: their further bytes."""
    table = np.full(256, _KINDS.index("symbol"), np.uint8)
    for kind, chars in {"lower": b"abcdefghijklmnopqrstuvwxyz", "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789",
                        "space": b" \t\n\x0b\x0c\r", "comma": b",;:'\"()-", "stop": b".?", "exclamation": b"!", "bar": b"|"}.items():
        table[list(chars)] = _KINDS.index(kind)
    table[128:192], table[192:] = _KINDS.index("inside"), _KINDS.index("other")
    return table


_KIND = _kind_table()
_ENDS = np.isin(np.arange(256), list(b".!?"))


def _distinct(doc: np.ndarray, keys: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of each document and how often its commonest one stands there."""
    with np.errstate(over="ignore"):
        own, first, count = np.unique(mix64(keys + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True, return_counts=True)
    most = np.zeros(n, np.int64)
    np.maximum.at(most, doc[first], count)
    return np.bincount(doc[first], minlength=n), most


def statistics_of(texts: list[bytes]) -> np.ndarray:
    """A row of STATISTICS for each text."""
    out = np.zeros((len(texts), len(STATISTICS)))
    for a, z in slices(texts, 1 << 20):
        n, data = z - a, b" ".join(texts[a:z]) + b" "
        edges = np.cumsum([0, *[len(t) + 1 for t in texts[a:z]]])
        raw = np.frombuffer(data, np.uint8)
        doc = np.repeat(np.arange(n), np.diff(edges))
        kinds = np.bincount(doc * len(_KINDS) + _KIND[raw], minlength=n * len(_KINDS)).reshape(n, -1).astype(float)
        kinds[:, _KINDS.index("space")] -= 1  # the one that was put after each text
        k = dict(zip(_KINDS, kinds.T))
        chars = kinds.sum(1) - k["inside"]
        starts, ends = word_spans(data)
        w = np.searchsorted(edges, starts, side="right") - 1
        words = np.bincount(w, minlength=n)
        hashes = span_hashes(data.translate(LOWER_BYTES), starts, ends)
        distinct, most = _distinct(w, hashes, n)
        same = np.bincount(w[1:][(hashes[1:] == hashes[:-1]) & (w[1:] == w[:-1])], minlength=n)
        stops = np.bincount(w[_ENDS[raw[ends - 1]]], minlength=n)
        longest = np.zeros(n, np.int64)
        np.maximum.at(longest, w, ends - starts)
        breaks = np.union1d(np.flatnonzero(raw == 10), edges[1:] - 1)
        begin = np.concatenate([[0], breaks[:-1] + 1])
        full = breaks > begin
        line = np.searchsorted(edges, begin[full], side="right") - 1
        lines = np.bincount(line, minlength=n)
        other_lines, _ = _distinct(line, span_hashes(data, begin[full], breaks[full]), n)
        per = lambda x, y: x / np.maximum(y, 1)
        out[a:z] = np.stack([np.log1p(chars), np.log1p(words), np.log1p(lines), per(np.bincount(w, ends - starts, n), words), longest,
                             np.log1p(per(chars, lines)), per(distinct, words), per(other_lines, lines), per(most, words), per(same, words),
                             per(stops, words), per(k["upper"], k["upper"] + k["lower"]), per(k["upper"] + k["lower"] + k["other"], chars),
                             per(k["digit"], chars), per(k["space"], chars), per(k["comma"], chars), per(k["stop"], chars),
                             per(k["exclamation"], chars), per(k["bar"], chars), per(k["symbol"], chars)], axis=1)
    return out


def statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The columns of ``docs`` but its text, with the column ``statistics`` (an array in the order of STATISTICS)."""
    base = replace_columns(docs, ["statistics"])
    base = base.withColumn(text_col, base[text_col].cast("binary"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            place = b.schema.get_field_index(text_col)
            rest = [i for i in range(b.num_columns) if i != place]
            rows = statistics_of([t or b"" for t in b.column(place).to_pylist()])
            edges = pa.array(np.arange(len(rows) + 1) * len(STATISTICS), pa.int32())
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in rest], pa.ListArray.from_arrays(edges, pa.array(rows.ravel()))],
                                             names=[*[b.schema.names[i] for i in rest], "statistics"])

    return base.mapInArrow(run, with_fields(base.drop(text_col)).add("statistics", T.ArrayType(T.DoubleType())))


# --- rules from boosted trees --------------------------------------------------------------------------------------

Rule = tuple[tuple[int, float, float], ...]  # (statistic, more than, at most) for each bounded statistic


def _narrower(rule: Rule, feature: int, low: float, high: float) -> Rule:
    bounds = {f: (a, b) for f, a, b in rule}
    a, b = bounds.get(feature, (-np.inf, np.inf))
    bounds[feature] = (max(a, low), min(b, high))
    return tuple((f, *bounds[f]) for f in sorted(bounds))


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    return np.logical_and.reduce([(x[:, f] > a) & (x[:, f] <= b) for f, a, b in rule])


def grow_rules(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> list[Rule]:
    """The paths of boosted trees (Newton steps on the logistic loss, histograms of quantile bins)."""
    cuts = []
    for f in range(x.shape[1]):
        values = np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1]))
        inner = np.unique(x[:, f])
        near = inner[np.minimum(np.searchsorted(inner, values, side="right"), len(inner) - 1)]
        cuts.append(np.unique((values + near) / 2)[:BINS - 1])  # between neighbouring values, so that no row lies on a bound
    bins = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
    margin, rules = np.full(len(y), np.log(y.mean() / (1 - y.mean()))), {}
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, np.maximum(p * (1 - p), 1e-6)
        if np.abs(g).mean() < 1e-3:
            break
        step = np.zeros(len(y))
        nodes: list[tuple[np.ndarray, Rule]] = [(np.arange(len(y)), ())]
        for level in range(depth + 1):
            below = []
            for rows, rule in nodes:
                best = (1e-6, -1, -1)
                if level < depth and len(rows) >= 2 * LEAST_ROWS:
                    total_g, total_h = g[rows].sum(), h[rows].sum()
                    for f, c in enumerate(cuts):
                        if not len(c):
                            continue
                        b = bins[rows, f]
                        lg = np.cumsum(np.bincount(b, g[rows], len(c) + 1))[:-1]
                        lh = np.cumsum(np.bincount(b, h[rows], len(c) + 1))[:-1]
                        ln = np.cumsum(np.bincount(b, minlength=len(c) + 1))[:-1]
                        gain = lg ** 2 / (lh + 1) + (total_g - lg) ** 2 / (total_h - lh + 1) - total_g ** 2 / (total_h + 1)
                        gain[(ln < LEAST_ROWS) | (len(rows) - ln < LEAST_ROWS)] = -1
                        k = int(gain.argmax())
                        if gain[k] > best[0]:
                            best = (float(gain[k]), f, k)
                if best[1] < 0:
                    step[rows] = g[rows].sum() / (h[rows].sum() + 1)
                    continue
                _, f, k = best
                left = bins[rows, f] <= k
                for part, low, high in ((left, -np.inf, cuts[f][k]), (~left, cuts[f][k], np.inf)):
                    path = _narrower(rule, f, float(low), float(high))
                    rules.setdefault(path)
                    below.append((rows[part], path))
            nodes = below
        margin = margin + 0.3 * step
    return list(rules)


def _lasso(z: np.ndarray, y: np.ndarray, penalty: float, start: np.ndarray, steps: int = 400) -> np.ndarray:
    """L1-penalised logistic weights (the last one, the intercept, is free) by accelerated proximal gradient steps."""
    n = len(y)
    rate = 4 * n / (np.linalg.norm(z, 2) ** 2 + n)
    w, v, t = start.copy(), start.copy(), 1.0
    for _ in range(steps):
        err = 1 / (1 + np.exp(-np.clip(z @ v[:-1] + v[-1], -40, 40))) - y
        new = v - rate * np.append(z.T @ err, err.sum()) / n
        new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - rate * penalty, 0)
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        if np.abs(new - w).max() < 1e-6:
            return new
        v, w, t = new + (t - 1) / t_new * (new - w), new, t_new
    return w


@dataclass
class Ensemble:
    rules: list[Rule]
    weights: np.ndarray
    intercept: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self.intercept + sum((w * holds(r, x) for r, w in zip(self.rules, self.weights)), np.zeros(len(x)))

    def column(self, statistics: Column) -> Column:
        """The score as a Spark column over the array of statistics."""
        def bound(f: int, low: float, high: float) -> Column:
            value = F.get(statistics, F.lit(f))
            both = [c for c in (value > low if low > -np.inf else None, value <= high if high < np.inf else None) if c is not None]
            return reduce(Column.__and__, both)

        terms = [F.when(reduce(Column.__and__, [bound(*b) for b in rule]), float(w)).otherwise(0.0) for rule, w in zip(self.rules, self.weights)]
        margin = reduce(Column.__add__, terms, F.lit(float(self.intercept)))
        return 1 / (1 + F.exp(-F.greatest(F.lit(-40.0), F.least(F.lit(40.0), margin))))

    def describe(self) -> list[tuple[str, float]]:
        """The rules in words with their weights, the heaviest first."""
        def words(rule: Rule) -> str:
            return " and ".join(f"{f'{a:.4g} < ' if a > -np.inf else ''}{STATISTICS[f]}{f' <= {b:.4g}' if b < np.inf else ''}" for f, a, b in rule)

        return sorted(((words(r), float(w)) for r, w in zip(self.rules, self.weights)), key=lambda p: -abs(p[1]))


def fit(x: np.ndarray, y: np.ndarray) -> Ensemble:
    """Rules with weights from statistics and labels of training rows."""
    y = y.astype(float)
    if not len(y) or y.min() == y.max():
        return Ensemble([], np.zeros(0), 40.0 if len(y) and y[0] else -40.0)
    rules = grow_rules(x, y)
    hits = np.stack([holds(r, x) for r in rules], axis=1).astype(float) if rules else np.zeros((len(y), 0))
    share = hits.mean(0)
    keep = (share > 0) & (share < 1)
    rules, hits, share = [r for r, k in zip(rules, keep) if k], hits[:, keep], share[keep]
    if not rules:
        return Ensemble([], np.zeros(0), float(np.log(y.mean() / (1 - y.mean()))))
    scale = np.sqrt(share * (1 - share))
    z = (hits - share) / scale
    test = np.arange(len(y)) % 4 == 3
    largest = np.abs(z.T @ (y - y.mean())).max() / len(y)
    penalties, losses, w = largest * np.geomspace(0.5, 0.0005, 12), [], np.zeros(len(rules) + 1)
    if test.any() and 0 < y[~test].mean() < 1:
        for penalty in penalties:
            w = _lasso(z[~test], y[~test], penalty, w)
            m = np.clip(z[test] @ w[:-1] + w[-1], -40, 40)
            losses.append(np.logaddexp(0, np.where(y[test] > 0, -m, m)))
        mean = np.array([v.mean() for v in losses])
        best = int(mean.argmin())
        allowed = mean[best] + losses[best].std() / max(1, len(losses[best])) ** 0.5
        penalty = penalties[int(np.flatnonzero(mean <= allowed)[0])]
    else:
        penalty = penalties[len(penalties) // 2]
    w = _lasso(z, y, penalty, np.zeros(len(rules) + 1), 2000)
    kept = np.flatnonzero(w[:-1])
    weights = w[kept] / scale[kept]
    return Ensemble([rules[k] for k in kept], weights, float(w[-1] - (weights * share[kept]).sum()))


def train(docs: DataFrame, labels: DataFrame, training: Column | None = None, sample: int = SAMPLE, id_col: str = "doc_id",
          text_col: str = "text", label_col: str = "quality") -> Ensemble:
    """Fits the ensemble on at most ``sample`` labelled documents; ``training``: a condition on ``id`` that they meet."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("id is not null and y is not null")
    if training is not None:
        known = known.where(training)
    known = known.groupBy("id").agg(F.min("y").alias("y")).orderBy(F.xxhash64("id"), "id").limit(sample)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).join(F.broadcast(known), "id")  # SAMPLE rows
    rows = statistics(rows, "t").groupBy("id", "y").agg(F.min("statistics").alias("x")).orderBy(F.xxhash64("id"), "id").collect()
    return fit(np.array([r["x"] for r in rows]).reshape(len(rows), len(STATISTICS)), np.array([r["y"] for r in rows]))


def score(docs: DataFrame, ensemble: Ensemble, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The columns of ``docs`` but its text, with score and predicted (1 from ``threshold`` on)."""
    out = statistics(replace_columns(docs, ["score", "predicted"]), text_col)
    rest = [F.col(f"`{c}`") for c in out.columns if c != "statistics"]
    return (out.select(*rest, ensemble.column(F.col("statistics")).alias("score"))
            .select("*", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted")))
