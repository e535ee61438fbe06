"""Language identification with bit-sliced Bloom filters of n-grams.

N-grams are windows of four bytes of the lower-cased text, other ASCII than letters read as spaces.  Spark counts them
per language over all training documents.  A language's filter holds the n-grams that make up at least LEAST_SHARE of
its text and are at least BESIDE_BEST as common as in the language where they are most common, so at most 1 /
LEAST_SHARE of them.  All filters are one table of bitmasks, a bit for each language: the AND of an n-gram's HASHES
entries names all languages that contain it.  The counts per language, less the false positives to be expected from the
filter's fill, decide.

Edge cases: null, empty or letterless texts are UNKNOWN with score 0, as is everything if there is nothing to learn from;
a text none of whose n-grams is known gets the most common language; ties go to the first name.  Rows without a language
teach nothing; null ids never do.  Repeated rows count as often as they occur.  Columns named like an added one are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridmap.llm.common import LETTER_BYTES, mix64, replace_columns, slices, with_fields, written

UNKNOWN, LEAST_SHARE, BESIDE_BEST, HASHES, SLOTS_PER_GRAM, MAX_LANGUAGES = "und", 2e-5, 0.3, 3, 16, 1024


def grams(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """Four-byte windows (little-endian numbers) with a letter in one of the two middle bytes, and the text of each."""
    parts = [b"  " + ("" if t is None else t).encode("utf-8", "surrogatepass") + b"  " for t in texts]
    raw = np.frombuffer(b"".join(parts).translate(LETTER_BYTES) + b"   ", np.uint8).astype(np.uint32)
    key = raw[:-3] | (raw[1:-2] << np.uint32(8)) | (raw[2:-1] << np.uint32(16)) | (raw[3:] << np.uint32(24))
    own = (raw[1:-2] != 32) | (raw[2:-1] != 32)
    ends = np.cumsum([len(p) for p in parts])
    at = np.flatnonzero(own)
    text = np.searchsorted(ends, at, side="right")
    inside = at + 3 < ends[text]  # not across two texts
    return key[at[inside]], text[inside]


def gram_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, gram, n) over all rows with a language; each task sums its own rows first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        for b in batches:
            texts, langs = b.column(0).to_pylist(), np.array(b.column(1).to_pylist(), object)
            for a, z in slices(texts):
                key, text = grams(texts[a:z])
                for lang in set(langs[a:z]):
                    held.setdefault(lang, []).append(np.unique(key[(langs[a:z] == lang)[text]], return_counts=True))
                    if len(held[lang]) > 8:
                        held[lang] = [merge(held[lang])]
        for lang, some in held.items():
            key, n = merge(some)
            for k in range(0, len(key), 100_000):
                m = len(key[k:k + 100_000])
                yield pa.RecordBatch.from_arrays([pa.array([lang] * m, pa.string()), pa.array(key[k:k + m].astype(np.int64)),
                                                  pa.array(n[k:k + m])], names=["lang", "gram", "n"])

    def merge(some: list) -> tuple[np.ndarray, np.ndarray]:
        keys, inv = np.unique(np.concatenate([k for k, _ in some]), return_inverse=True)
        return keys, np.bincount(inv, np.concatenate([n for _, n in some])).astype(np.int64)

    rows = docs.select(F.col(text_col).alias("t"), F.col(lang_col).alias("l")).where("l is not null")
    return rows.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


@dataclass
class Filters:
    languages: list[str]
    prior: int  # the most common language
    table: np.ndarray  # slots x words of 64 languages
    false: np.ndarray  # expected share of false positives per language

    def slots(self, key: np.ndarray) -> list[np.ndarray]:
        h = mix64(key.astype(np.uint64))
        n = np.uint64(len(self.table) - 1)
        return [((h >> np.uint64(20 * k)) & n).astype(np.int64) for k in range(HASHES)]

    def masks(self, key: np.ndarray) -> np.ndarray:
        """Bitmask of the languages whose filter contains the n-gram."""
        first, *rest = self.slots(key)
        out = self.table[first]
        for s in rest:
            out = out & self.table[s]
        return out

    def decide(self, texts: list) -> tuple[list[str], np.ndarray]:
        key, text = grams(texts)
        edges = np.searchsorted(text, np.arange(len(texts) + 1))
        n = np.diff(edges)
        mask, found = self.masks(key), np.zeros((len(texts), len(self.languages)))
        for i in range(len(self.languages)):
            bits = (mask[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)
            total = np.concatenate([[0], np.cumsum(bits.astype(np.int64))])
            found[:, i] = total[edges[1:]] - total[edges[:-1]]
        found = np.maximum(0, (found - n[:, None] * self.false) / np.maximum(1e-9, 1 - self.false))
        best, whole = found.argmax(1), found.sum(1)
        best = np.where(whole > 0, best, self.prior)
        score = np.where(whole > 0, found[np.arange(len(texts)), best] / np.maximum(whole, 1e-9), 1 / len(self.languages))
        return [self.languages[b] for b in best], score


def train(docs: DataFrame, training: Column | None = None, **columns: str) -> Filters | None:
    """Filters from all rows of ``docs`` that meet ``training``; None if no row has a language."""
    counts = gram_counts(docs if training is None else docs.where(training), **columns)
    counts = written(counts, "lang-grams")
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total")).orderBy("lang").limit(MAX_LANGUAGES + 1).collect()
    if len(totals) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not totals:
        return None
    languages = [r["lang"] for r in totals]
    size = F.create_map(*[F.lit(x) for r in totals for x in (r["lang"], float(r["total"]))])
    share = counts.select("lang", "gram", (F.col("n") / size[F.col("lang")]).alias("s"))
    best = share.groupBy("gram").agg(F.max("s").alias("best")).where(F.col("best") >= LEAST_SHARE)
    held = (share.where(F.col("s") >= LEAST_SHARE).join(best, "gram").where(F.col("s") >= BESIDE_BEST * F.col("best"))
            .select("gram", "lang").toPandas())  # at most 1 / LEAST_SHARE n-grams of each language
    number = held["lang"].map({x: i for i, x in enumerate(languages)}).to_numpy(np.int64)
    key = held["gram"].to_numpy(np.int64)
    slots = 1 << max(10, int(SLOTS_PER_GRAM * max(1, len(np.unique(key))) - 1).bit_length())
    out = Filters(languages, max(range(len(totals)), key=lambda i: totals[i]["total"]),
                  np.zeros((slots, -(-len(languages) // 64)), np.uint64), np.zeros(len(languages)))
    for s in out.slots(key):
        np.bitwise_or.at(out.table, (s, number // 64), np.uint64(1) << (number % 64).astype(np.uint64))
    for i in range(len(languages)):
        fill = float(((out.table[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean())
        out.false[i] = fill ** HASHES
    return out


def identify(docs: DataFrame, filters: Filters | None, text_col: str = "text") -> DataFrame:
    """All rows and columns of ``docs`` with lang_pred and score."""
    base = replace_columns(docs, ["lang_pred", "score"])
    if filters is None:
        return base.select("*", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, langs, scores = b.column(b.schema.get_field_index(text_col)).to_pylist(), [], []
            for a, z in slices(texts):
                some, s = filters.decide(texts[a:z])
                langs += some
                scores += s.tolist()
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                                             names=[*b.schema.names, "lang_pred", "score"])

    out = base.mapInArrow(run, with_fields(base, lang_pred="string", score="double"))
    letter = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))
    return (out.withColumn("lang_pred", F.when(letter, F.col("lang_pred")).otherwise(F.lit(UNKNOWN)))
            .withColumn("score", F.when(letter, F.col("score")).otherwise(F.lit(0.0))))
