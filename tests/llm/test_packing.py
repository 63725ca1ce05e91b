"""Plans against their lower bound, pieces against direct encoding, gapless sequences."""

import itertools
import os
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from corpuswarden.llm.packing import non_negative_fit, pack, patterns, plan, sequences
from corpuswarden.llm.queries import QUERIES

WORDS, BYTES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
FOLDER = "/root/testdata/sf0.001"


def gapless(rows, capacity):
    """Rows of sequence, offset and length fill their sequences from 0 without gap or overlap."""
    for _, group in itertools.groupby(sorted(rows), key=lambda r: r[0]):
        end = 0
        for _, offset, length in group:
            assert offset == end
            end += length
        assert end <= capacity


def test_patterns_are_all_partitions():
    expected = {t for n in range(1, 4) for t in itertools.product(range(1, 13), repeat=n) if sum(t) == 12 and list(t) == sorted(t, reverse=True)}
    assert set(patterns(12, 3)) == expected and len(patterns(12, 3)) == len(expected)


def test_fit_is_no_worse_than_any_small_change():
    rng = np.random.default_rng(2)
    for _ in range(30):
        a, b = rng.integers(0, 3, (8, 20)).astype(float), rng.integers(-5, 50, 8).astype(float)
        x = non_negative_fit(a, b)
        gradient = a.T @ (b - a @ x)
        assert (x >= 0).all() and (gradient < 1e-5).all() and np.abs(gradient[x > 0]).max(initial=0) < 1e-5


@pytest.mark.parametrize("seed", range(6))
def test_plan_holds_every_piece_once(seed):
    rng = np.random.default_rng(seed)
    capacity = [1, 7, 64, 100, 1000, 4096][seed]
    lengths = np.minimum(rng.geometric(4 / capacity, 5_000) if capacity > 4 else np.ones(5_000, int), capacity)
    found = plan(dict(zip(*map(np.ndarray.tolist, np.unique(lengths, return_counts=True)))), capacity)
    order = np.sort(lengths)
    rank = np.arange(len(order)) - np.searchsorted(order, order)
    sequence, offset = found.place(order, rank)
    gapless(list(zip(sequence.tolist(), offset.tolist(), order.tolist())), capacity)
    assert len(set(sequence.tolist())) == found.sequences <= 1.01 * -(-lengths.sum() // capacity) + 4


def test_plan_of_nothing_and_of_equal_lengths():
    assert plan({}, 4096).sequences == 0
    assert plan({4096: 3, 1: 1}, 4096).sequences == 4
    assert plan({1500: 10_001}, 4096).sequences == 5_001
    assert plan({2048: 10**12}, 4096).sequences == 5 * 10**11


@pytest.mark.parametrize("tokenizer, by_word, end", [(WORDS, True, 1), (BYTES, False, None)])
def test_pieces_equal_direct_encoding(spark, tokenizer, by_word, end):
    texts = [None, "", "a b c.", "word " * 300, "x" * 2_000, "İstanbul. " * 40, "same", "same", *["one two three " * k for k in range(40)]]
    rows = [(k if k != 2 else None, t, "x", 1, 2) for k, t in enumerate(texts)] + [(5, texts[5], "x", 1, 2)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, `offset` int, `a.b` int").repartition(5)
    capacity = 50
    packed = pack(docs, tokenizer, capacity, end, by_word)
    direct, expected = Tokenizer.from_file(tokenizer), []
    for d, t, *_ in rows:
        ids = direct.encode(t or "", add_special_tokens=False).ids + [end] * (end is not None)
        expected += [(d, i // capacity, i, min(capacity, len(ids) - i), np.array(ids[i : i + capacity], "<u4").tobytes()) for i in range(0, len(ids), capacity)]
    got = packed.collect()
    key = lambda r: (r[0] is not None, r[0] or 0, r[1], r[4])
    assert sorted([tuple(r)[:5] for r in got], key=key) == sorted(expected, key=key)
    gapless([(r["sequence_id"], r["offset"], r["length"]) for r in got], capacity)
    by_place = {(r["sequence_id"], r["offset"] + r["length"]): bytes(r["ids"]) for r in got}
    for s in sequences(packed).collect():
        assert bytes(s["ids"]) == b"".join(by_place[s["sequence_id"], e] for e in s["ends"])
        assert len(s["ids"]) == 4 * s["ends"][-1]


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert pack(empty, WORDS, by_word=True).count() == 0


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not there")
def test_query_equals_brute_force(spark):
    direct, expected, total = Tokenizer.from_file(WORDS), set(), 0
    for d, t in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect():
        ids = np.array(direct.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        total += len(ids)
        expected |= {(d, i // 4096, i, len(ids[i : i + 4096]), zlib.crc32(ids[i : i + 4096].tobytes())) for i in range(0, len(ids), 4096)}
    got = QUERIES["op11_packing"](spark, FOLDER).collect()
    assert len(got) == len(expected) and {tuple(r)[:5] for r in got} == expected
    gapless([(r["sequence_id"], r["offset"], r["length"]) for r in got], 4096)
    assert len({r["sequence_id"] for r in got}) <= -(-total // 4096) + 2
