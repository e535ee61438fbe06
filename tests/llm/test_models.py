import random

import numpy as np

from gridmap.llm import language_id as L
from gridmap.llm import toxicity as T
from pyspark.sql import functions as F


def toxic_rows(n, seed):
    """Toxic only where an insult meets a group, so that no single word decides; some rows by an insult stem."""
    rnd, rows = random.Random(seed), []
    for i in range(n):
        words = [f"w{rnd.randrange(300)}" for _ in range(rnd.randrange(5, 60))]
        a, b, c = rnd.random() < 0.4, rnd.random() < 0.4, rnd.random() < 0.1
        words += ["foolish"] * a + ["greens"] * b + [f"zuckk{rnd.choice('abcdef')}{rnd.choice('xyz')}"] * c
        rnd.shuffle(words)
        rows.append((i, " ".join(words).capitalize(), int(a and b or c)))
    return rows


def test_pair_terms_are_learned(spark):
    rows = toxic_rows(3000, 1)
    docs = spark.createDataFrame([(i, t, 0.5) for i, t, _ in rows], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(0, None), (None, 1)], "doc_id long, toxic int")
    machine = T.train(docs, labels, F.col("id") % 3 != 1)
    out = {r["doc_id"]: r for r in T.score(docs, machine).collect()}
    held = [(out[i]["predicted"], y) for i, _, y in rows if i % 3 == 1]
    assert np.mean([p == y for p, y in held]) > 0.97
    assert {r["doc_id"] for r in T.drop_toxic(docs, machine).collect()} == {i for i, r in out.items() if r["predicted"] == 0}
    odd = spark.createDataFrame([(1, None), (None, ""), (2, "x" * 300_000), (2, "Foolish, greens!")], "doc_id long, text string")
    got = T.score(odd, machine).collect()
    assert len(got) == 4 and all(0 <= r["score"] <= 1 for r in got)
    assert [r["predicted"] for r in got if r["text"] and "F" in r["text"]] == [1]
    assert T.score(docs.limit(0), machine).count() == 0


def test_margin_equals_all_pairs():
    rng = np.random.default_rng(0)
    m = T.Machine(np.arange(1 << T.SLOT_BITS), 0.3, rng.normal(size=20), rng.normal(size=(20, 4)))
    rows = [[1, 5, 7], [], [3], list(range(20))]
    flat, edges = np.concatenate([np.array(r, int) for r in rows]), np.cumsum([0, *map(len, rows)])
    want = [0.3 + sum(m.w[i] for i in r) + sum(m.v[i] @ m.v[j] for a, i in enumerate(r) for j in r[:a]) for r in rows]
    assert np.allclose(m.margin(flat, edges), want)


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert T.score(docs, T.train(docs, labels)).first()["predicted"] == 0


ALPHABETS = {"aa": "abcdef", "bb": "efghij", "cc": "ijklmn"}


def language_rows(n, seed):
    rnd, rows = random.Random(seed), []
    words = {k: ["".join(random.Random(f"{k}{i}").choice(v) for _ in range(2 + i % 5)) for i in range(80)] for k, v in ALPHABETS.items()}
    for i in range(n):
        lang = rnd.choice(sorted(ALPHABETS))
        rows.append((i, " ".join(rnd.choice(words[lang]) for _ in range(rnd.randrange(1, 40))).capitalize() + ". ###", lang))
    return rows


def test_languages_are_told_apart(spark):
    rows = language_rows(1500, 2)
    odd = [(-1, None, "aa"), (-2, "", None), (-3, "12 %% 3", "bb"), (-4, "zzzz zzzz", None), (-5, "A", None), (None, "abcabc", "aa")]
    docs = spark.createDataFrame([(*r, "x") for r in rows + odd], "doc_id long, text string, lang string, score string").repartition(3)
    filters = L.train(docs, F.col("doc_id") % 4 != 2)
    assert filters.languages == sorted(ALPHABETS)
    out = {r["doc_id"]: r for r in L.identify(docs, filters).collect()}
    assert np.mean([out[i]["lang_pred"] == lang for i, t, lang in rows if i % 4 == 2]) > 0.97
    assert [out[i]["lang_pred"] for i in (-1, -2, -3)] == ["und"] * 3
    assert out[-4]["lang_pred"] in ALPHABETS and out[-5]["lang_pred"] in ALPHABETS
    assert all(0 <= r["score"] <= 1 for r in out.values())


def test_no_languages_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert L.train(docs) is None
    assert L.identify(docs, None).first()["lang_pred"] == "und"


def test_counts_and_masks_equal_brute_force(spark):
    rows = language_rows(60, 5)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    want = {}
    for _, t, lang in rows:
        raw = b"  " + "".join(c.lower() if c.isascii() and c.isalpha() else c if not c.isascii() else " " for c in t).encode() + b"  "
        for k in range(len(raw) - 3):
            if raw[k + 1:k + 3] != b"  ":
                key = (lang, int.from_bytes(raw[k:k + 4], "little"))
                want[key] = want.get(key, 0) + 1
    assert {(r["lang"], r["gram"]): r["n"] for r in L.gram_counts(docs).collect()} == want
    filters = L.train(docs)
    total = {k: sum(n for (g, _), n in want.items() if g == k) for k in ALPHABETS}
    for (lang, gram), n in want.items():
        share = n / total[lang]
        best = max(want.get((k, gram), 0) / total[k] for k in ALPHABETS)
        if share >= L.LEAST_SHARE and share >= L.BESIDE_BEST * best:  # no false negatives
            assert int(filters.masks(np.array([gram]))[0, 0]) >> filters.languages.index(lang) & 1
