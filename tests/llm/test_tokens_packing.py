import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gridmap.llm import packing, token_output
from gridmap.llm.tokens import BYTE_BPE, WORD_BPE, PieceEncoder, tokenizer_path

ODD = [None, "", " ", "\n", " a", "a ", "a  b\n\n c\t\td", "don't  stop, ...  now", "###$$$ ab'c d'll", "Été É İx ß ﬁ", "a\x1cb", "a\x00b",
       "1st2nd ½ x²", "日本 語", "é x", "x   y", "<|endoftext|> <|startoftext|>", "Σας ΣΑΣ", "A" * 5000, "w " * 3000]


@pytest.mark.parametrize("name,spaces", [(WORD_BPE, False), (BYTE_BPE, True)])
def test_encoder_equals_library(name, spaces):
    enc = PieceEncoder(tokenizer_path(name), spaces)

    @settings(max_examples=200, deadline=None)
    @given(st.lists(st.text(alphabet=st.sampled_from("ab'st ,.\n\t#1é ñE"), max_size=30), min_size=1, max_size=6))
    def check(texts):
        flat, lens = enc.encode(texts)
        for t, got in zip(texts, np.split(flat, np.cumsum(lens)[:-1])):
            assert got.tolist() == enc.whole(t)

    check()
    flat, lens = enc.encode(ODD)
    for t, got in zip(ODD, np.split(flat, np.cumsum(lens)[:-1])):
        assert got.tolist() == enc.whole(t or "")


def test_encoder_table_stays_bounded(monkeypatch):
    monkeypatch.setattr("gridmap.llm.tokens.KEPT_PIECES", 50)
    enc = PieceEncoder(tokenizer_path(BYTE_BPE), True)
    for k in range(5):
        texts = [" ".join(f"w{k}{i}{j}" for j in range(9)) for i in range(4)]
        flat, lens = enc.encode(texts)
        assert [x.tolist() for x in np.split(flat, np.cumsum(lens)[:-1])] == [enc.whole(t) for t in texts]
    assert len(enc.keys) <= 50


def test_grammar_round_trip_and_random_access():
    rng = np.random.default_rng(2)
    for ids in (np.zeros(0, np.uint32), np.full(999, 7, np.uint32), rng.integers(0, 9, 30_000).astype(np.uint32)):
        symbols, rules = token_output.compress(ids)
        assert token_output.expand(symbols, rules).tolist() == ids.tolist()
        lens = token_output.rule_lengths(rules)
        assert token_output.symbol_lengths(symbols, lens).sum() == len(ids)
        for k in range(min(5, len(rules))):
            assert len(token_output.expand(np.array([token_output.RULE_BASE + k], np.uint32), rules)) == lens[k]
        if len(ids):
            assert len(symbols) < 0.75 * len(ids)
            row = token_output._shard_row(0, 0, 0, [ids], [1], [len(ids)])
            for a, b in [(0, 1), (0, len(ids)), (len(ids) - 1, len(ids)), (500, 777), (5, 5), (998, 999)]:
                assert token_output.decode_range(row, a, b).tolist() == ids[a:b].tolist()


def test_no_pair_is_left_that_can_be_replaced_twice():
    rng = np.random.default_rng(4)
    copies = np.tile(rng.integers(0, 50_000, 700), 9)
    for ids in (copies, rng.integers(0, 40, 20_000), np.full(4096, 3), np.array([1, 2, 1, 2]), *[rng.integers(0, 3, n) for n in range(2, 40)]):
        symbols, rules = token_output.compress(ids.astype(np.uint32))
        assert token_output.expand(symbols, rules).tolist() == ids.tolist()
        uses, last = {}, {}
        for i, pair in enumerate(zip(symbols.tolist(), symbols.tolist()[1:])):
            if last.get(pair) != i - 1:  # else it overlaps with the one before
                uses[pair], last[pair] = uses.get(pair, 0) + 1, i
        assert max(uses.values(), default=0) < 2


@pytest.mark.parametrize("spaces", [False, True])
def test_ascii_pieces_have_the_ids_of_the_library(spaces):
    enc = PieceEncoder(tokenizer_path(BYTE_BPE if spaces else WORD_BPE), spaces)
    for piece in ["a", "Zz...", "USA,", "ab'c", "a_b", "O'Neil", "x`y", "Hello!!!", "a1", "--", "q{}", "it~", "!", "a\u0130", "caf\u00e9!"] * 2:
        for text in [piece, " " + piece] if spaces else [piece]:
            assert enc._ascii_piece(text.encode()) == enc.whole(text)


def test_shards_give_back_every_document(spark, tmp_path):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(tokenizer_path(WORD_BPE))
    tok.encode_special_tokens = True
    rows = [(i * 3, t) for i, t in enumerate(ODD * 3)] + [(None, "no id")]
    random.Random(1).shuffle(rows)
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, part int").repartition(5)
    token_output.write_shards(docs, str(tmp_path / "shards"), shard_ids=2000)
    out = {r["doc_id"]: r for r in token_output.read_documents(spark, str(tmp_path / "shards")).collect()}
    start = 0
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        assert (out[i]["start"], out[i]["n_tokens"], out[i]["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    token_output.write_shards(docs.limit(0), str(tmp_path / "none"))
    assert token_output.read_documents(spark, str(tmp_path / "none")).count() == 0


def brute_bins(sizes, length):
    """Fewest bins by trying all ways (few pieces)."""
    best = len(sizes)

    def go(k, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if k == len(sizes):
            best = len(bins)
            return
        for i in {b: i for i, b in enumerate(bins)}.values():
            if bins[i] + sizes[k] <= length:
                go(k + 1, bins[:i] + [bins[i] + sizes[k]] + bins[i + 1:])
        go(k + 1, bins + [sizes[k]])
    go(0, [])
    return best


def test_lower_bound_never_exceeds_the_optimum():
    rnd = random.Random(4)
    for _ in range(150):
        length = rnd.choice([10, 20, 31])
        sizes = sorted((rnd.randrange(1, length + 1) for _ in range(rnd.randrange(1, 9))), reverse=True)
        bound, best = packing.lower_bound(np.array(sizes), length), brute_bins(sizes, length)
        bins = packing.best_fit(np.array(sizes), length)
        assert -(-sum(sizes) // length) <= bound <= best <= bins.max() + 1
        assert max(np.bincount(bins, sizes)) <= length
    assert packing.lower_bound(np.array([6, 6, 6, 4]), 10) == 3


def check_packed(rows, length):
    places = defaultdict(list)
    for r in rows:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for p in places.values():
        at = 0
        for offset, n in sorted(p):
            assert offset == at
            at += n
        assert at <= length
    return len(places)


def test_pieces_and_packing(spark):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(tokenizer_path(BYTE_BPE))
    tok.encode_special_tokens = True
    rows = [(i, t) for i, t in enumerate(ODD * 2)] + [(None, "no id"), (2, " ")]
    docs = spark.createDataFrame([(i, t, 5) for i, t in rows], "doc_id long, text string, piece int").repartition(3)
    out = packing.pack(packing.pieces(docs, 64), 64, group_pieces=5).collect()
    whole = defaultdict(list)
    for r in out:
        whole[r["doc_id"]].append(r)
    for i, t in rows:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        parts = sorted({(r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in whole[i]})
        assert parts == [(k, s, n, zlib.crc32(ids[s:s + n].tobytes())) for k, s, n, _ in parts]
        assert [p[1] for p in parts] == np.cumsum([0, *[p[2] for p in parts]])[:-1].tolist() and sum(p[2] for p in parts) == len(ids)
        assert all(p[2] == 64 for p in parts[1:])
    assert check_packed(out, 64) <= 1.1 * -(-sum(r["length"] for r in out) // 64) + 1
    assert packing.pack(packing.pieces(docs.limit(0))).count() == 0


def test_partitions_with_gaps_exchange(spark):
    rnd = random.Random(3)
    rows = [(i, 0, 0, rnd.choice([22, 26, 27, 31, 35, 44]), i) for i in range(400)]
    found = spark.createDataFrame(rows, packing.PIECE)
    alone = check_packed(packing.pack(found, 100, group_pieces=20, rounds=0).collect(), 100)
    out = packing.pack(found, 100, group_pieces=20, rounds=2).collect()
    assert sorted(r["doc_id"] for r in out) == list(range(400))
    assert check_packed(out, 100) < alone
