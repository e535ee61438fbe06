import hashlib
import random
import zlib

from gridmap.llm import periodic_runs as P
from gridmap.llm.queries import QUERIES


def plain_runs(words, least=24):
    """All runs by trying every period at every place."""
    n, out = len(words), []
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if length >= max(least, 3 * q) and not any(words[i:i + length - p] == words[i + p:i + length] for p in range(1, q)):
                out.append((i, length, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def odd_text(rnd, size):
    words = []
    while len(words) < size:
        kind = rnd.randrange(4)
        if kind == 0:
            words += [f"w{rnd.randrange(500)}" for _ in range(rnd.randrange(30))]
        elif kind == 1:
            part = [f"w{rnd.randrange(rnd.choice([1, 2, 3, 50]))}" for _ in range(rnd.choice([1, 2, 3, 7, 20, 31, 32, 33, 63, 64, 65, 127, 128, 130]))]
            words += (part * 6)[:int(len(part) * rnd.uniform(2.5, 5))]
        elif kind == 2 and words:
            s = rnd.randrange(len(words))
            words += words[s:s + rnd.randrange(100)] * rnd.randrange(1, 5)
        else:
            part = ["a"] * rnd.randrange(1, 60) + ["b"] * rnd.randrange(3) + [f"w{rnd.randrange(2)}" for _ in range(rnd.randrange(40))]
            words += part * rnd.randrange(1, 5)
    return words


def test_runs_equal_brute_force_at_all_scales():
    rnd = random.Random(11)
    for _ in range(60):
        texts = [odd_text(rnd, rnd.choice([5, 30, 100, 300, 700])) for _ in range(rnd.randrange(1, 4))]
        got = P.find_runs(*P._hashes([" ".join(t).encode() for t in texts]))
        assert got == [plain_runs(t) for t in texts]


def test_long_texts_and_long_periods():
    words = [f"w{i % 7001}".encode() for i in range(30_000)]
    assert P.find_runs(*P._hashes([b" ".join(words)])) == [[(0, 30_000, 7001)]]
    assert P.find_runs(*P._hashes([b"a " * 200_000, b""])) == [[(0, 200_000, 1)], []]
    block = [b"a"] * 300 + [b"b", b"c"]
    runs = P.find_runs(*P._hashes([b" ".join(block * 40)]))[0]
    assert (0, 40 * 302, 302) in runs and sum(q == 1 for _, _, q in runs) == 40 and len(runs) == 41


def test_rows_columns_and_empty_tables(spark):
    rows = [(1, None, "x"), (None, "", "y"), (2, "go " * 30, "z"), (2, "go " * 30, "z"), (3, "é x\tb\x1fc\x0bd", None), (4, "q" * 300_000, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string")
    out = P.periodic_runs(docs).collect()
    assert len(out) == 6 and out[0].asDict().keys() == {"doc_id", "n_words", "runs", "collapsed"}
    got = {(r.doc_id, r.n_words, tuple(map(tuple, r.runs)), r.collapsed) for r in out}
    assert got == {(1, 0, (), ""), (None, 0, (), ""), (2, 30, ((0, 30, 1),), "go"), (3, 3, (), "é x b\x1fc d"), (4, 1, (), "q" * 300_000)}
    assert P.periodic_runs(docs.limit(0)).count() == 0


def test_query_equals_the_contract(spark, tmp_path):
    rnd = random.Random(5)
    texts = {i: " ".join(odd_text(rnd, rnd.randrange(1, 200))) + rnd.choice(["", "\n", "  "]) for i in range(300)} | {300: None, 301: ""}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in QUERIES["op11_periodic_runs"](spark, str(tmp_path)).collect()}
    assert len(got) == 302
    changed = 0
    for i, text in texts.items():
        words = (text or "").split()
        h, n = zlib.crc32(str(i).encode()), len((text or "").split())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words, changed = [words[k] if k < a else words[a + (k - a) % p] for k in range(n)], changed + 1
        runs = plain_runs(words)
        gone = {k for s, length, q in runs for k in range(s + q, s + length)}
        best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
        want = (len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
                hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest(),
                hashlib.sha256(" ".join(w for k, w in enumerate(words) if k not in gone).encode()).hexdigest())
        assert tuple(got[i])[1:] == want
    assert changed > 15
