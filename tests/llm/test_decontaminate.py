import random

import numpy as np

from gridmap.llm import decontaminate as D
from gridmap.llm.common import LETTER_BYTES, word_hashes


def corpus(seed=3):
    rnd = random.Random(seed)
    common = ["the", "of", "and", "to", "in", "is"]
    word = lambda: rnd.choice(common) if rnd.random() < 0.4 else f"{rnd.choice('bcdfg')}{''.join(rnd.choice('aeioustr') for _ in range(6))}"
    text = lambda n: [word() for _ in range(n)]
    items = [text(n) for n in (10, 14, 20, 33, 45, 60, 90, 25, 30, 12)]
    docs, want = [], set()
    for d in range(160):
        words = text(rnd.randrange(40, 500))
        if d % 4 == 0:
            i = d // 4 % len(items)
            leak = list(items[i])
            how = d // 40 % 4
            if how == 1:  # reworded: every seventh word is another one
                leak[3::7] = [word() + "x" for _ in leak[3::7]]
            elif how == 2:  # words put in
                leak = [w for x in leak for w in ([x] if rnd.random() < 0.85 else [x, "well"])]
            elif how == 3:
                leak = [w.upper() + rnd.choice(["", ",", "!"]) for w in leak]
            at = rnd.randrange(len(words))
            words[at:at] = leak
            want.add((d, i))
        docs.append((d, " ".join(words)))
    return docs, [(i, " ".join(w)) for i, w in enumerate(items)], want


def test_planted_passages_and_clean_documents(spark):
    docs, items, want = corpus()
    odd = [(1000, None), (1001, ""), (None, items[4][1]), (1002, items[3][1] + " " + "z" * 100_000), (0, docs[0][1])]
    d = spark.createDataFrame([(i, t, 9, 0.1) for i, t in docs + odd], "doc_id long, text string, item_id int, cosine double").repartition(4)
    b = spark.createDataFrame(items + [(70, None), (71, "12 !"), (3, items[3][1])], "item_id long, text string")
    out = D.contaminated(d, b)
    got = {(r["doc_id"], r["item_id"]) for r in out.collect()}
    assert got == want | {(None, 4), (1002, 3)} and out.count() == len(got)
    kept = sorted(str(r["doc_id"]) for r in D.drop_contaminated(d, b).collect())
    gone = {i for i, _ in got}  # the row without an id that holds an item goes too
    assert kept == sorted(str(i) for i, _ in docs + odd if i not in gone)


def test_blocks_of_items_give_the_same(spark, monkeypatch):
    docs, items, want = corpus(8)
    monkeypatch.setattr(D, "BLOCK_ITEMS", 4)
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in D.contaminated(d, b).collect()} == want


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b c d e")], "item_id long, text string")
    assert D.contaminated(docs.limit(0), items).count() == 0
    assert D.contaminated(docs, items.limit(0)).count() == 0
    assert D.contaminated(docs, items.select("item_id", D.F.lit(None).cast("string").alias("text"))).count() == 0


def test_latent_space_and_search_equal_brute_force(spark):
    docs, items, _ = corpus(5)
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string").repartition(3)
    df = D.document_frequencies(d)
    sets = [set(D.slots_of(word_hashes([t], LETTER_BYTES)[0])) for _, t in docs]
    want = np.zeros(1 << D.SLOT_BITS)
    for s in sets:
        want[list(s)] += 1
    assert df[-1] == len(docs) and (df[:-1] == want).all()
    weight = D.weights(df)
    space = D.latent_space(b, weight)
    words = [word_hashes([t], LETTER_BYTES)[0] for _, t in items]
    number, some = D.passages(words)
    a = np.zeros((len(some), len(space.slots)))
    for k, w in enumerate(some):
        s = np.unique(D.slots_of(w))
        a[k, np.searchsorted(space.slots, s)] = weight[s]
    assert np.allclose(np.linalg.svd(a, compute_uv=False)[:len(space.singular)], space.singular, rtol=1e-3)
    assert np.allclose(a @ space.basis @ space.basis.T, a, atol=1e-2)
    index = D.Index([i for i, _ in items], words, [w[-5:] for w in words], weight, space)
    found = total = 0
    for _, t in docs[:40]:
        w = word_hashes([t], LETTER_BYTES)[0]
        got = {(i, s) for i, s, _ in index.candidates(w)}
        for s in range(0, max(1, len(w) - D.WINDOW // 2), D.WINDOW // 2):
            window = w[s:s + D.WINDOW]
            own = set(window.tolist())
            norm = np.sqrt((weight[D.slots_of(window)] ** 2).sum())
            for i, p in zip(number, some):
                of = lambda x: weight[D.slots_of(np.array(sorted(x), np.uint64))]
                cosine = (of(own & set(p.tolist())) ** 2).sum() / norm / np.sqrt((of(set(p.tolist())) ** 2).sum())
                if cosine >= D.COSINE + 1e-3:
                    total += 1
                    found += (i, s) in got
    assert total > 5 and found >= 0.9 * total


def test_documents_without_a_window_that_reaches_the_cosine_are_left_out_together(spark):
    docs, items, want = corpus(5)
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    weight = D.weights(D.document_frequencies(d))
    words = [word_hashes([t], LETTER_BYTES)[0] for _, t in items]
    index = D.Index([i for i, _ in items], words, [w[-5:] for w in words], weight, D.latent_space(b, weight))
    texts = ["", None, " . ", *[t for _, t in docs], "the", ""]
    words, edges = word_hashes(texts, LETTER_BYTES)
    possible = index.possible(words, edges).tolist()
    some = [k for k, (s, e) in enumerate(zip(edges, edges[1:])) if index.candidates(words[s:e])]
    assert set(some) <= set(possible) and len(possible) <= len(some) + 2 < len(texts)
    assert {d for d, _ in want} <= {k - 3 for k in possible}
    assert len(index.possible(*word_hashes(["", None], LETTER_BYTES))) == 0


def test_covered_is_the_heaviest_common_subsequence():
    rnd = random.Random(1)
    for _ in range(50):
        a = np.array([rnd.randrange(5) for _ in range(rnd.randrange(1, 9))], np.uint64)
        b = np.array([rnd.randrange(5) for _ in range(rnd.randrange(1, 12))], np.uint64)
        weight = np.array([1.0, 2, 0.5, 3, 1.5])[a.astype(int)]
        best = 0
        for m in range(1 << len(a)):
            pick, it = [i for i in range(len(a)) if m >> i & 1], iter(b.tolist())
            if all(any(x == y for y in it) for x in a[pick].tolist()):
                best = max(best, weight[pick].sum())
        share, used = D.covered(a, weight, b)
        assert np.isclose(share, best / weight.sum()) and np.isclose(weight[used].sum(), best)


def test_verbatim_copies_of_thousands_of_items_are_found(spark):
    rnd = random.Random(4)
    vocabulary = [f"w{''.join(rnd.choice('abcdefgh') for _ in range(6))}" for _ in range(4000)]
    chance = [1 / (k + 3) for k in range(len(vocabulary))]
    text = lambda n: rnd.choices(vocabulary, chance, k=n)
    items = [text(32) for _ in range(3000)]
    docs = []
    for d in range(60):
        words = text(rnd.randrange(40, 120))
        words[16:16] = items[rnd.randrange(3000)] if d % 3 else []
        docs.append((d, " ".join(words)))
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    b = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    whole = [(i, f" {' '.join(w)} ") for i, w in enumerate(items)]
    want = {(i, k) for i, t in docs for k, w in whole if w in f" {t} "}
    got = {(r["doc_id"], r["item_id"]) for r in D.contaminated(d, b).collect()}
    assert len(want) >= 40 and want <= got


def test_blocks_hold_no_more_passages_than_their_rank(spark):
    items = [(i, " ".join(["word"] * n), None) for i, n in enumerate([32] * 900 + [0, 33, 64, 65, 32 * 1200 + 1])]
    out = D.dealt(spark.createDataFrame(items, "i long, text string, a string").repartition(3), 512).collect()
    held, spans = {}, {}
    for r in out:
        held[r["block"]] = held.get(r["block"], 0) + r["last"] - r["first"]
        spans.setdefault(r["i"], set()).update(range(r["first"], r["last"]))
    assert max(held.values()) <= 512
    number, _ = D.passages([word_hashes([t], LETTER_BYTES)[0] for _, t, _ in items])
    assert {i: len(s) for i, s in spans.items()} == {i: number.count(i) for i in set(number)}


def test_numbers_tell_items_apart(spark):
    items = [(1, "Tom has 5 apples and buys 7"), (2, "12 + 30 = 42; 42 * 2 = 84"), (3, "What is the sum of the two numbers, 317 or 412?")]
    filler = "this long report is about the weather in the north and about its many rivers "
    docs = [(0, "Tom has 5 apples and buys 7."), (1, "Tom has 9 apples and buys 3."), (2, filler + "12 + 30 = 42; 42 * 2 = 84 " + filler),
            (3, filler + "what is the sum of the two numbers, 317 or 412? " + filler), (4, "what is the sum of the two numbers, 25 or 26?"),
            (5, filler * 3), (6, "11 + 31 = 43; 43 * 3 = 129")]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(2)
    b = spark.createDataFrame(items, "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in D.contaminated(d, b).collect()} == {(0, 1), (2, 2), (3, 3)}
    assert D.numbers([t for _, t in items]).sum() == 2 + 6 + 2


def test_long_items_need_little_memory():
    import tracemalloc

    rng = np.random.default_rng(3)
    item = rng.integers(0, 400, 6000).astype(np.uint64)
    text = np.concatenate([rng.integers(0, 400, 3000).astype(np.uint64), item[::2], rng.integers(400, 900, 3000).astype(np.uint64)])
    tracemalloc.start()
    share, used = D.covered(item, np.ones(len(item)), text)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert share >= 0.5 and used.sum() == round(share * len(item)) and peak < 40 << 20


def test_rows_go_by_id_and_text(spark):
    passage = " ".join(f"alpha{i}beta" for i in range(40))
    items = spark.createDataFrame([(1, passage)], "item_id long, text string")
    filler = lambda n: " ".join(f"word{n}x{i}" for i in range(60))
    rows = [(1, filler(1) + " " + passage, 0), (1, filler(2), 1), (None, filler(3) + " " + passage, 2), (None, filler(4), 3), (None, None, 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __row int")
    left = D.drop_contaminated(docs, items)
    assert left.columns == docs.columns and sorted(r["__row"] for r in left.collect()) == [1, 3, 4]
