"""Encoding against a whole-text search, round trips, and the scan against both."""

import random

import public_tokenizers
import pytest

from corpuswarden.llm import sentence_pieces as sp

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def pieces():
    return sp.Pieces(PATH)


def brute(pieces, text):
    """Best cut of the whole text at once, without segments or chunks."""
    if not text:
        return []
    s = " " + text
    return pieces.trace(s, pieces.forward(s, 0, len(s))[1], 0, len(s))[0]


def sample(rng, n):
    return "".join(rng.choice(["a", "aa", "the ", " ", "  ", "\n", "é", "▁", "梦", "\U0001f600", "ing", "<0x41>"]) for _ in range(n))


def test_best_sum_by_enumeration(pieces):
    def cuts(s):
        if not s:
            yield 0, ()
        for k in range(1, len(s) + 1):
            entry = pieces.pieces.get(s[-k:])
            if entry or k == 1:
                for total, begins in cuts(s[:-k]):
                    yield total + (entry[1] if entry else pieces.unknown), (len(s) - k, *begins)

    for text in ["aaaa", "the cat", "hello", "a  b", "x▁y", "inginga"]:
        s = " " + text
        best, back = pieces.forward(s, 0, len(s))
        total, begins = min(cuts(s), key=lambda c: (-c[0], c[1]))
        assert best[len(s)] == total and tuple(pieces.trace(s, back, 0, len(s))[1]) == begins


def test_segments_chunks_and_round_trip(pieces):
    rng = random.Random(3)
    for trial in range(150):
        text = sample(rng, rng.randint(0, 60)) if trial % 3 else "a" * rng.randint(0, 120)
        ids = brute(pieces, text)
        assert pieces.encode(text) == ids and pieces.decode(ids) == text
        if text:
            chunk = rng.choice([16, 17, 23, 40])
            parts = list(sp.chunks_of(text, chunk, pieces.longest))
            states = sp.boundary_states([pieces.transfer(s, n) for _, n, s in parts])
            joined = [i for (_, n, s), a, b in zip(parts, states, states[1:]) for i in pieces.between(s, n, a, b)]
            assert joined == ids, (text, chunk)


def test_combine_is_associative(pieces):
    parts = [pieces.transfer(s, n) for _, n, s in sp.chunks_of("aaaaaaa the thing " * 6, 20, pieces.longest)]
    left = right = None
    for p in parts:
        left = p if left is None else sp.combine(left, p)
    for p in reversed(parts):
        right = p if right is None else sp.combine(p, right)
    assert (left[0] == right[0]).all() and left[0][0, 0] == pieces.forward(" " + "aaaaaaa the thing " * 6, 0, 109)[0][109]


def test_on_spark(spark, docs, clashing, pieces):
    rng = random.Random(4)
    texts = [None, "", " ", "The cat", sample(rng, 300), "a" * 500, "The cat", "wort " * 200]
    rows = sp.decode(sp.encode(docs(*texts), PATH, chunk=64), PATH).collect()
    assert len(rows) == len(texts)
    for r in rows:
        text = texts[r["doc_id"]] or ""
        assert list(r["ids"]) == brute(pieces, text) and r["text"] == text
    assert sp.encode(docs(*texts).limit(0), PATH).count() == 0
    kept = sp.encode(clashing("a b", None, "c" * 99), PATH, chunk=32, carry=True).collect()
    assert sorted((r["_row"]["_row"], len(r["ids"]) > 0) for r in kept) == [(3, False), (3, True), (3, True)]
    twice = docs("x" * 80).union(docs("y" * 80))
    assert sp.encode(twice, PATH, chunk=32).count() == 2
