"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard verification.

A document is its set of distinct k-word shingles.  A first permutation places the shingles on a circle of 2^32 places;
coordinate k of the signature is the least value of a second permutation, shifted by k places, over the set.  Equal sets
become one class, so exact copies cost one row.  Bands of the signature name buckets.  In a bucket every class is held
against one of them, picked by a hash that differs by bucket (a star, never all pairs); candidates are confirmed on the
full sets, and confirmed links give components.  A second pass then takes, in each bucket, every class outside the bucket's
main component against all classes of other components there, each pair in its first shared bucket only.  Those pairs are
never rows: a bucket (or a tile of a very large one) is one group of a sorted stream, which holds its sets as an inverted
index, counts what each outsider shares with all members at once, and returns one link for each component it reaches.

Candidates are dropped early only if their sizes rule the similarity out, or if the sketches (four bits of each
coordinate) differ in more places than pairs of the wanted similarity do on average, plus SPREAD standard deviations (a pair
of just that similarity: with probability 3e-6).  A pair of similarity 0.8 shares a bucket with probability 1 - 3e-6.

Edge cases: null and empty texts have no shingles and are linked with nothing; a text of fewer than k words is one shingle;
rows without a doc_id are returned with themselves as (null) component and kept; rows that repeat an id are one document.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridmap.llm.common import checked_broadcast, mix64, slices, word_hashes, written

WORDS, SIMILARITY, BANDS, ROWS, SPREAD = 5, 80, 32, 5, 4.5
#: Members of all sets of a tile, about 16 MB.
TILE_ITEMS = 2_000_000
_A, _B, _C = np.uint32(0x7FEB352D), np.uint32(0x846CA68B), np.uint32(0x9E3779B1)
_BLOCK = 1 << 15


def shingle_sets(texts: list, k: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one after the other, and the edges of the texts."""
    sets = []
    for a, b in slices(texts):
        words, edges = word_hashes(texts[a:b])
        with np.errstate(over="ignore"):
            acc = words + np.uint64(k)
            for j in range(1, k):
                acc = mix64(acc[:-1] if len(acc) else acc) + words[j:]
        acc = mix64(acc)
        for s, e in zip(edges[:-1].tolist(), edges[1:].tolist()):
            if e - s >= k:
                sets.append(np.unique(acc[s:e - k + 1]))
            elif e > s:  # the whole sequence is one shingle, unlike any of k words
                h = np.uint64(e - s) << np.uint64(32)
                for w in words[s:e]:
                    h = mix64(np.array([h ^ w]))[0]
                sets.append(np.array([h], np.uint64))
            else:
                sets.append(np.zeros(0, np.uint64))
    edges = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int64)
    return (np.concatenate(sets) if sets else np.zeros(0, np.uint64)), edges


def signatures(flat: np.ndarray, edges: np.ndarray, coordinates: int) -> np.ndarray:
    """Circulant MinHash of non-empty sets: a row of ``coordinates`` 32-bit numbers for each."""
    place = (mix64(flat) >> np.uint64(32)).astype(np.uint32)  # the first permutation
    out = np.empty((len(edges) - 1, coordinates), np.uint32)
    row = 0
    while row < len(out):  # some sets at a time, so that the work stays in the processor's cache
        last = max(row + 1, int(np.searchsorted(edges, edges[row] + _BLOCK, side="right")) - 1)
        x, starts = place[edges[row]:edges[last]], edges[row:last] - edges[row]
        y, t = np.empty_like(x), np.empty_like(x)
        for k in range(coordinates):  # the second permutation, shifted by k
            np.add(x, np.uint32(k), out=y)
            for factor, shift in ((_A, 16), (_B, 15)):
                np.multiply(y, factor, out=y)
                np.right_shift(y, np.uint32(shift), out=t)
                np.bitwise_xor(y, t, out=y)
            np.multiply(y, _C, out=y)
            out[row:last, k] = np.minimum.reduceat(y, starts)
        row = last
    return out


def _digests(flat: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits for each set, from sums of two hashes of its members."""
    out = []
    for salt in (0x1234567, 0x89ABCDEF01):
        with np.errstate(over="ignore"):
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(flat + np.uint64(salt)), dtype=np.uint64)])
            out.append(mix64(total[edges[1:]] - total[edges[:-1]] + np.uint64(salt)).view(np.int64))
    return out[0], out[1]


def text_hash(text_col: str) -> Column:
    """Tells rows that share an id apart."""
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def _signature_rows(docs: DataFrame, k: int, bands: int, rows: int) -> DataFrame:
    """id, x (the text's hash), n, d1, d2 (the set's digest), s0.. (sketch) and bands of every row."""
    sketch = -(-bands * rows // 16)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts = b.column(0), b.column(1).to_pylist()
            for a, z in slices(texts, 2 << 20):
                flat, edges = shingle_sets(texts[a:z], k)
                n = np.diff(edges)
                some = np.flatnonzero(n)
                sig = signatures(flat, np.concatenate([edges[:-1][some], edges[-1:]]), bands * rows)
                four = np.zeros((z - a, sketch * 16), np.uint8)
                four[some, :bands * rows] = sig & np.uint32(15)
                words = np.ascontiguousarray(four[:, ::2] | four[:, 1::2] << np.uint8(4)).view(np.int64)
                key = np.tile(np.arange(bands, dtype=np.uint64), (len(some), 1))
                for r in range(rows):
                    key = mix64(key) + sig[:, r::rows]
                keys = pa.array(mix64(key).view(np.int64).ravel())
                counts = np.zeros(z - a + 1, np.int32)
                counts[some + 1] = bands
                d1, d2 = _digests(flat, edges)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(a, z - a), b.column(2).slice(a, z - a), pa.array(n), pa.array(d1), pa.array(d2),
                     *[pa.array(np.ascontiguousarray(words[:, i])) for i in range(sketch)],
                     pa.ListArray.from_arrays(pa.array(np.cumsum(counts, dtype=np.int32)), keys)],
                    names=["id", "x", "n", "d1", "d2", *[f"s{i}" for i in range(sketch)], "bands"])

    schema = "id long, x long, n long, d1 long, d2 long, " + "".join(f"s{i} long, " for i in range(sketch)) + "bands array<long>"
    return docs.select(F.col("id").cast("long"), "t", text_hash("t")).mapInArrow(run, schema)


def _sets(docs: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """(node, items) of the wanted nodes, recomputed from their texts; the digest tells rows that share an id apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            for a, z in slices(texts):
                flat, edges = shingle_sets(texts[a:z], k)
                d1, d2 = _digests(flat, edges)
                same = (d1 == b.column(2).to_numpy()[a:z]) & (d2 == b.column(3).to_numpy()[a:z])
                keep = np.repeat(same, np.diff(edges))
                edge = np.concatenate([[0], np.cumsum(np.diff(edges)[same])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(a, z - a).filter(pa.array(same)),
                     pa.ListArray.from_arrays(pa.array(edge), pa.array(flat.view(np.int64)[keep]))], names=["node", "items"])

    wanted, _ = checked_broadcast(nodes)
    return (docs.select(F.col("id").cast("long").alias("node"), "t").join(wanted, "node")
            .select("node", "t", "d1", "d2").mapInArrow(run, "node long, items array<long>"))


def _verified(docs: DataFrame, pairs: DataFrame, nodes: DataFrame, k: int, similarity: int, name: str) -> DataFrame:
    """The pairs (u, v) whose full sets are similar enough."""
    ends = pairs.select(F.col("u").alias("node")).union(pairs.select("v")).distinct()
    wanted = written(nodes.select("node", "d1", "d2").join(ends, "node", "left_semi"), f"near-wanted-{name}")
    sets = written(_sets(docs, wanted, k), f"near-sets-{name}")
    both = (pairs.join(sets.select(F.col("node").alias("u"), F.col("items").alias("a")), "u")
            .join(sets.select(F.col("node").alias("v"), F.col("items").alias("b")), "v"))
    common = F.size(F.array_intersect("a", "b"))
    sizes = F.size("a") + F.size("b")
    return written(both.select("u", "v", common.alias("i"), sizes.alias("s")).where(100 * F.col("i") >= similarity * (F.col("s") - F.col("i")))
                   .select("u", "v").distinct(), f"near-links-{name}")


def _tiled(placed: DataFrame, nodes: DataFrame) -> DataFrame:
    """Rows of every bucket with more than one component, dealt into tiles: key, a, b, probe, node, comp.

    Members outside the bucket's main component are probes; each is to meet every member.  Members and probes are dealt by hash to
    as many tiles as TILE_ITEMS asks for (one, but for buckets of very many or very long sets), and every pair of tiles is one group
    (key, a, b) that has its members and its probes.
    """
    count = placed.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("c"))
    main = count.groupBy("key").agg(F.max(F.struct("c", "comp")).alias("m"), F.count(F.lit(1)).alias("comps")).where("comps > 1")
    mixed = placed.join(main.select("key", F.col("m.comp").alias("main")), "key").join(nodes.select("node", "n"), "node")
    mixed = written(mixed.withColumn("out", F.col("comp") != F.col("main")), "near-mixed")
    tiles = mixed.groupBy("key").agg(F.ceil(F.sum("n") / TILE_ITEMS).cast("int").alias("ta"),
                                     F.ceil(F.sum(F.when(F.col("out"), F.col("n"))) / TILE_ITEMS).cast("int").alias("tb"))
    dealt = mixed.join(tiles, "key").withColumn("h", F.xxhash64("node"))
    own = [F.pmod("h", F.col(t)).cast("int") for t in ("ta", "tb")]
    every = [F.explode(F.sequence(F.lit(0), F.col(t) - 1)) for t in ("ta", "tb")]
    members = dealt.select("key", own[0].alias("a"), every[1].alias("b"), F.lit(False).alias("probe"), "node", "comp")
    return members.unionByName(dealt.where("out").select("key", every[0].alias("a"), own[1].alias("b"), F.lit(True).alias("probe"), "node", "comp"))


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Consecutive rows with equal first three columns (key, a, b) as one batch each."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(i).to_numpy().astype(np.int64) for i in range(3)])
        cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
        if held and not all(held[-1].column(i)[0].as_py() == int(keys[i, 0]) for i in range(3)):
            yield _one(held)
            held = []
        for s, e in zip(cuts[:-1], cuts[1:]):
            if s and held:
                yield _one(held)
                held = []
            held.append(batch.slice(s, e - s))
    if held:
        yield _one(held)


def _one(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return parts[0] if len(parts) == 1 else pa.Table.from_batches(parts).combine_chunks().to_batches()[0]


def _likely(group: pa.RecordBatch, bands: int, sketch: int, most: int, similarity: int) -> np.ndarray:
    """Rows of a group that may have a link: a probe and a member of different components whose sizes and sketches allow it, in
    the first bucket they share."""
    probe, comp = group.column("probe").to_numpy(zero_copy_only=False), group.column("comp").to_numpy()
    n = group.column("n").to_numpy()
    words = np.stack([group.column(f"s{i}").to_numpy() for i in range(sketch)]).view(np.uint64)
    keys = group.column("bands").flatten().to_numpy().reshape(-1, bands)
    here = int(np.flatnonzero(keys[0] == group.column("key")[0].as_py())[0])
    rows, wanted = np.flatnonzero(~probe), np.zeros(len(n), bool)
    probes = np.flatnonzero(probe)
    step = max(1, (1 << 19) // max(1, len(rows)))
    for k in range(0, len(probes), step):
        p = probes[k:k + step]
        small, large = np.minimum(n[p][:, None], n[rows]), np.maximum(n[p][:, None], n[rows])
        i, j = np.nonzero((comp[p][:, None] != comp[rows]) & (100 * small >= similarity * large))
        i, j = p[i], rows[j]
        for c in range(here):
            if not len(i):
                break
            later = keys[i, c] != keys[j, c]
            i, j = i[later], j[later]
        differ = np.zeros(len(i), np.int64)
        for w in words:
            x = w[i] ^ w[j]
            x |= x >> np.uint64(2)
            differ += np.bitwise_count((x | x >> np.uint64(1)) & np.uint64(0x1111111111111111))
        ok = differ <= most
        wanted[i[ok]] = wanted[j[ok]] = True
    return np.flatnonzero(wanted)


def _linked(group: pa.RecordBatch, similarity: int) -> Iterator[tuple[int, int]]:
    """Of each probe one link to each other component that has a similar enough member, found on the full sets."""
    probe, comp, node = (group.column(c).to_numpy(zero_copy_only=False) for c in ("probe", "comp", "node"))
    column = group.column("items")
    edges, items = column.offsets.to_numpy(), column.values.to_numpy()
    rows = np.flatnonzero(~probe)
    size = np.diff(edges)
    # inverted index of the members' sets: items in order, and the member of each
    flat = np.concatenate([items[edges[r]:edges[r + 1]] for r in rows]) if len(rows) else items[:0]
    owner = np.repeat(np.arange(len(rows)), size[rows])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    for p in np.flatnonzero(probe):
        own = items[edges[p]:edges[p + 1]]
        lo, hi = np.searchsorted(flat, own), np.searchsorted(flat, own, side="right")
        length = hi - lo
        take = np.repeat(lo - np.concatenate([[0], np.cumsum(length)[:-1]]), length) + np.arange(length.sum())
        common = np.bincount(owner[take], minlength=len(rows))
        near = np.flatnonzero((100 * common >= similarity * (size[p] + size[rows] - common)) & (comp[rows] != comp[p]))
        for c in np.unique(comp[rows[near]], return_index=True)[1]:
            yield int(node[p]), int(node[rows[near[c]]])


def _crossing(docs: DataFrame, placed: DataFrame, nodes: DataFrame, sketch: list[str], most: int, k: int, similarity: int) -> DataFrame:
    """Links (u, v) between components that meet in a bucket; pairs never become rows, only links do."""
    groups = written(_tiled(placed, nodes), "near-tiles")
    rows = groups.join(nodes.select("node", "n", "bands", *sketch), "node").select("key", "a", "b", "probe", "node", "comp", "n", "bands", *sketch)
    rows = rows.repartition("key", "a", "b").sortWithinPartitions("key", "a", "b")

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in _groups(batches):
            width = len(g.column("bands")[0])
            found = _likely(g, width, len(sketch), most, similarity)
            if len(found):
                yield g.select(["key", "a", "b", "probe", "node", "comp"]).take(pa.array(found))

    wanted = written(rows.mapInArrow(likely, "key long, a int, b int, probe boolean, node long, comp long"), "near-likely")
    need = written(nodes.select("node", "d1", "d2").join(wanted.select("node").distinct(), "node", "left_semi"), "near-wanted-crossing")
    sets = written(_sets(docs, need, k), "near-sets-crossing")
    full = wanted.join(sets, "node").select("key", "a", "b", "probe", "node", "comp", "items").repartition("key", "a", "b").sortWithinPartitions("key", "a", "b")

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in _groups(batches):
            links = [(min(x), max(x)) for x in _linked(g, similarity)]
            if links:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*links)], names=["u", "v"])

    return written(full.mapInArrow(verified, "u long, v long").distinct(), "near-links-crossing")


def components(links: DataFrame) -> DataFrame:
    """(node, comp): the smallest node that each linked node reaches; alternating large and small stars."""
    edges = written(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "cc")
    state = None
    while True:
        both = edges.union(edges.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            low.where("u > m").select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        edges = written(small.where("u <> v").distinct(), "cc")
        new = edges.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40)))).first()
        if new == state:
            break
        state = new
    return edges.select(F.col("u").alias("node"), F.col("v").alias("comp")).union(
        edges.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())


def near_duplicates(docs: DataFrame, k: int = WORDS, similarity: int = SIMILARITY, id_col: str = "doc_id", text_col: str = "text",
                    bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable over links) and kept, one row for each row of ``docs``."""
    return _near(docs, k, similarity, id_col, text_col, bands, rows).drop("x")


def _near(docs: DataFrame, k: int, similarity: int, id_col: str, text_col: str, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``near_duplicates`` with the hash of the text."""
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    sketch = [f"s{i}" for i in range(-(-bands * rows // 16))]
    differ = (1 - similarity / 100) * 15 / 16  # share of places in which four bits differ
    most = int(bands * rows * differ + SPREAD * (bands * rows * differ * (1 - differ)) ** 0.5)
    sig = written(_signature_rows(docs, k, bands, rows), "near-signatures")
    classes = written(sig.where("n > 0 and id is not null").groupBy("d1", "d2").agg(F.min("id").alias("node")), "near-classes")
    nodes = written(sig.join(classes.withColumnRenamed("node", "id"), ["d1", "d2", "id"], "left_semi").withColumnRenamed("id", "node"), "near-nodes")
    slim = nodes.select("node", "n", *sketch)

    def similar(df: DataFrame) -> DataFrame:
        """Of pairs with n and sketch of both ends (prefixed x and y), those whose sizes and sketches allow the similarity."""
        def places(c: str) -> Column:
            x = F.col("x" + c).bitwiseXOR(F.col("y" + c))
            x = x.bitwiseOR(F.shiftright(x, 1)).bitwiseOR(F.shiftright(x, 2)).bitwiseOR(F.shiftright(x, 3))
            return F.bit_count(x.bitwiseAND(F.lit(0x1111111111111111)))

        sizes = 100 * F.least("xn", "yn") >= similarity * F.greatest("xn", "yn")
        return df.where(sizes & (reduce(Column.__add__, map(places, sketch)) <= most))

    def ends(name: str, prefix: str) -> DataFrame:
        return slim.select(F.col("node").alias(name), *[F.col(c).alias(prefix + c) for c in ["n", *sketch]])

    members = nodes.select("node", F.explode("bands").alias("key")).withColumn("h", F.xxhash64("node", "key"))
    buckets = members.groupBy("key").agg(F.min("h").alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "hub")
    members = written(members.join(buckets, "key").select("key", "node", (F.col("h") == F.col("hub")).alias("hub")), "near-members")
    stars = (members.join(members.where("hub").select("key", F.col("node").alias("u")), "key").where("u <> node")
             .select(F.least("u", "node").alias("u"), F.greatest("u", "node").alias("v")).distinct())
    stars = written(similar(stars.join(ends("u", "x"), "u").join(ends("v", "y"), "v")).select("u", "v"), "near-stars")
    links = _verified(docs, stars, nodes, k, similarity, "stars")
    comp = written(components(links), "near-components")

    placed = written(members.select("key", "node").join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node")), "near-placed")
    more = _crossing(docs, placed, nodes, sketch, most, k, similarity)
    if not more.isEmpty():
        comp = written(components(links.union(more)), "near-components")

    node_of = classes.join(comp, "node", "left").select("d1", "d2", F.coalesce("comp", "node").alias("comp"))
    out = sig.select("id", "x", "n", "d1", "d2").join(node_of, ["d1", "d2"], "left")
    comp_id = F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.col("comp")).otherwise(F.col("id"))
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), comp_id.alias("component_id"),
                      F.col("id").eqNullSafe(comp_id).alias("kept"), "x")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = WORDS, similarity: int = SIMILARITY) -> DataFrame:
    """``docs`` without the rows (id and text) that are not the smallest id of their component; rows without an id stay."""
    found = _near(docs, k, similarity, id_col, text_col)
    gone = written(found.where("not kept").select(F.col("doc_id").alias("__near_id"), F.col("x").alias("__near_x")).distinct(), "near-dropped")
    same = (F.col(f"`{id_col}`").cast("long") == F.col("__near_id")) & (text_hash(f"`{text_col}`") == F.col("__near_x"))
    return docs.join(gone, same, "left_anti")
